"""Numbers as listing pages write them: prices, acreages, coordinates. All are native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and bounds of prices and acreages.
ACREAGE = r"(?<![\d,])(?<!\d\.)(?:(?:\d{1,3}(?:,\d{3})+|\d+)?\.\d+|\d{1,3}(?:,\d{3})+(?![\d,])|\d+(?![\d,]))"
PRICE_AMOUNT = r"\$\s?(?:\d{1,3}(?:,\d{3})+(?:\.\d{1,2}(?!\d))?|\d+(?:\.\d+)?)"
ACRES_PHRASE = rf"(?i)({ACREAGE})\s*(?:±|\+/-)?\s*acres?(?![A-Za-z0-9_])"
SUBJECT_ACRES = rf"(?i)({ACREAGE})\s*(?:±|\+/-|\+-)?\s*[- ]?acres?(?![A-Za-z0-9_])"
LAT, LNG = (24.0, 50.0), (-125.0, -65.0)


def js_round(x: Column, decimals: int = 0) -> Column:
    """Half up, as the sources round: floor(x * 10^d + 0.5) / 10^d."""
    scale = float(10**decimals)
    return F.floor(x * scale + 0.5) / scale if decimals else F.floor(x + 0.5).cast("double")


def text_or_null(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def number_prefix(c: Column) -> Column:
    """The number that a text begins with, null if none."""
    # an empty text is kept from the cast, which answers it by an exception
    return let(F.regexp_extract(F.ltrim(c), r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", 0), text_or_null).try_cast("double")


def currency(c: Column) -> Column:
    """Number or currency text: "$2,900" is 2900."""
    return number_prefix(F.regexp_replace(c, r"[$,]", ""))


def digits_number(c: Column) -> Column:
    """The number left when all but digits and points is removed."""
    return number_prefix(F.regexp_replace(c, r"[^0-9.]", ""))


def acreage(c: Column) -> Column:
    """A number of thousandths at most; null unless above 0."""
    return let(js_round(number_prefix(F.trim(F.replace(c, F.lit(","), F.lit("")))), 3), lambda n: F.when(n > 0, n))


def price(c: Column) -> Column:
    """Price text in cents."""
    return js_round(digits_number(c), 2)


def acres(c: Column) -> Column:
    return acreage(F.regexp_replace(c, r"[^0-9.]", ""))


def price_value(c: Column) -> Column:
    """A price above 1,000, else null."""
    return let(digits_number(c), lambda n: F.when(n > 1000, n))


def total_price(text: Column) -> Column:
    """The largest dollar amount of 10,000 or more."""
    amounts = F.transform(F.regexp_extract_all(text, F.lit(PRICE_AMOUNT), F.lit(0)), digits_number)
    return F.array_max(F.filter(amounts, lambda n: n >= 10000))


def price_text(text: Column) -> Column:
    """A displayed total price above 1,000; per-acre prices and ranges are no total."""
    t = F.trim(text)
    per_acre = t.rlike(r"(?i)/\s*(?:acre|ac)(?![A-Za-z0-9_])|per\s+acre")
    amounts = F.size(F.regexp_extract_all(t, F.lit(r"\$?\s*\d[\d,]*(?:\.\d+)?"), F.lit(0)))
    return F.when(~per_acre & (amounts <= 1), price_value(t))


def decimal_places(n: Column) -> Column:
    """Digits after the point in the shortest form."""
    s = F.regexp_replace(n.cast("string"), r"\.0$", "")
    return F.when(s.rlike("[eE]") | ~s.contains("."), F.lit(0)).otherwise(F.length(F.substring_index(s, ".", -1)))


def acreages(text: Column, pattern: str = ACRES_PHRASE) -> Column:
    """Every acreage of the text in order, dollar amounts left out."""
    bare = F.regexp_replace(text, PRICE_AMOUNT, " ")
    return F.transform(F.regexp_extract_all(bare, F.lit(pattern), F.lit(1)), acreage)


def most_precise(headline: Column, candidates: Column) -> Column:
    """The headline, or a candidate with more decimals that rounds to it (the first of the most decimals)."""

    def of(v: Column) -> Column:
        better = lambda best, c: F.when((decimal_places(c) > decimal_places(best)) & (F.abs(c - v["h"]) <= v["tolerance"]), c).otherwise(best)
        return F.aggregate(F.coalesce(candidates, F.array().cast("array<double>")), v["h"], better)

    tolerance = lambda h: F.lit(0.5) * F.pow(F.lit(10.0), -decimal_places(h)) + 1e-9
    return let(headline, lambda h: let(F.struct(h.alias("h"), tolerance(h).alias("tolerance")), of))


def headline_acres(text: Column) -> Column:
    """The first acreage of a card, refined by a later figure that agrees with it."""
    rest = lambda found: F.slice(found, F.lit(2), F.greatest(F.size(found) - 1, F.lit(0)))
    return let(acreages(text), lambda found: let(F.try_element_at(found, F.lit(1)), lambda first: F.when(first.isNotNull(), most_precise(first, rest(found)))))


def refined_acres(headline: Column, text: Column) -> Column:
    return let(headline, lambda h: F.when(text.isNull() | (text == ""), h).otherwise(most_precise(h, acreages(text))))


def usual_acres(text: Column) -> Column:
    """The most frequent of the first 25 acreages under 100,000; of equals the largest."""
    found = F.transform(F.regexp_extract_all(text, F.lit(SUBJECT_ACRES), F.lit(1)), acreage)
    found = F.slice(F.filter(found, lambda n: n < 100000), 1, 25)
    ranked = lambda some: F.transform(F.array_distinct(some), lambda v: F.struct(F.size(F.filter(some, lambda x: x == v)).alias("n"), v.alias("v")))
    return let(found, lambda some: F.array_max(ranked(some)).getField("v"))


def coordinates(text: Column) -> Column:
    """struct<lat,lng> inside the bounds of the continental US, else null; the text is matched once for each."""
    pattern = r"(-?\d+\.?\d*)\s*,\s*(-?\d+\.?\d*)"
    lat, lng = (F.regexp_extract(text, pattern, i).try_cast("double") for i in (1, 2))
    return let(F.struct(lat.alias("lat"), lng.alias("lng")), lambda p: F.when(p["lat"].between(*LAT) & p["lng"].between(*LNG), p))


def money(n: Column) -> Column:
    """$1,234 of a number rounded to whole dollars; $0 if missing."""
    return F.concat(F.lit("$"), F.format_number(F.coalesce(js_round(n), F.lit(0.0)), 0))


def exceeds_decimals(n: Column, places: int) -> Column:
    """Whether a number has more decimals than places, float noise below 1e-9 left out."""
    return F.coalesce(F.abs(n - F.round(n, places)) >= 1e-9, F.lit(False))


def bucket(value: Column, size: float) -> Column:
    """The nearest multiple of size, the first for small values, 0 for missing ones and those not above 0."""
    return F.when(value > 0, F.greatest(F.lit(float(size)), js_round(value / size) * size)).otherwise(0.0)


def ipv4(c: Column) -> Column:
    """The address as a number, null if it is none."""
    ok = c.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$")
    parts = F.transform(F.split(c, r"\."), lambda p: p.try_cast("bigint"))
    value = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, p: a * 256 + p)
    return F.when(ok & F.forall(parts, lambda p: p <= 255), value)


# Address blocks that must not be fetched (base, bits).
BLOCKED_IPV4 = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24),
    ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
]


def blocked_ipv4(c: Column) -> Column:
    """Whether the address lies in a blocked range; a text that is no address does not."""

    def judge(value: Column) -> Column:
        hit = F.lit(False)
        for base, bits in BLOCKED_IPV4:
            low = sum(int(p) << (24 - 8 * i) for i, p in enumerate(base.split(".")))
            hit = hit | value.between(low, low + (1 << (32 - bits)) - 1)
        return hit

    return F.coalesce(let(ipv4(c), judge), F.lit(False))


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once a row, however often body names it."""
    return F.transform(F.array(value), body)[0]


def ipv6_groups(c: Column) -> Column:
    """The eight 16-bit groups of an address in any of its forms, else null."""
    none = F.array().cast("array<string>")
    groups = lambda s: F.when(F.coalesce(s, F.lit("")) == "", none).otherwise(F.split(s, ":"))

    def plain(bare: Column) -> Column:
        """A dotted tail as two groups."""
        tail = F.regexp_extract(bare, r"[^:]*$", 0)
        dotted = lambda v: F.concat(F.substring(bare, F.lit(1), F.length(bare) - F.length(tail)), F.hex(F.shiftright(v, 16)), F.lit(":"), F.hex(v.bitwiseAND(F.lit(65535))))
        return F.when(bare.contains("."), let(ipv4(tail), dotted)).otherwise(bare)

    def full(head: Column, end: Column, halves: Column) -> Column:
        gap = 8 - F.size(head) - F.size(end)
        return F.when(F.size(halves) == 1, head).when((F.size(halves) == 2) & (gap >= 0), F.concat(head, F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0)).cast("int")), end))

    def numbers_of(g: Column) -> Column:
        ok = (F.size(g) == 8) & F.forall(g, lambda x: x.rlike("^[0-9a-fA-F]{1,4}$"))
        return F.when(ok, F.transform(g, lambda x: F.conv(x, 16, 10).cast("int")))

    cut = lambda text: let(F.split(text, "::"), lambda h: let(groups(F.get(h, F.lit(0))), lambda a: let(groups(F.get(h, F.lit(1))), lambda b: let(full(a, b, h), numbers_of))))
    return let(F.split(c, "%")[0], lambda bare: let(plain(bare), cut))


def blocked_ipv6(c: Column) -> Column:
    """Whether the address is unspecified, loopback, local, multicast or documentation, or carries a blocked IPv4 address."""

    def judge(g: Column) -> Column:
        zero = lambda n: F.forall(F.slice(g, 1, n), lambda x: x == 0)
        last = F.concat_ws(".", *[F.shiftright(g[i], s).bitwiseAND(F.lit(255)).cast("string") for i in (6, 7) for s in (8, 0)])
        carried = (zero(5) & (g[5] == 0xFFFF)) | ((g[0] == 0x64) & (g[1] == 0xFF9B) & F.forall(F.slice(g, 3, 4), lambda x: x == 0))
        own = (zero(7) & g[7].isin(0, 1)) | (g[0].bitwiseAND(F.lit(0xFE00)) == 0xFC00) | g[0].bitwiseAND(F.lit(0xFFC0)).isin(0xFE80, 0xFEC0) | (g[0].bitwiseAND(F.lit(0xFF00)) == 0xFF00) | ((g[0] == 0x2001) & (g[1] == 0x0DB8))
        return F.coalesce(F.when(carried, let(last, blocked_ipv4)).otherwise(own), F.lit(False))

    return F.coalesce(let(ipv6_groups(c), judge), F.lit(False))
