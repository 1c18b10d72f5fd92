"""What can be read from a page's HTML by patterns alone, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import county_of_url, known_state
from .numbers import SUBJECT_ACRES, acreage, coordinates, currency, let, text_or_null
from .text import squeeze, status_kind

# Texts that mark a challenge page, and pages without results.
BLOCK_MARKERS = ["just a moment", "access denied", "incapsula", "_incapsula_resource", "perimeterx", "px-captcha", "cf-browser-verification", "cf-challenge", "attention required", "request unsuccessful", "verify you are a human", "are you a robot", "enable javascript and cookies to continue"]
EMPTY_MARKERS = ["no results", "no properties", "no listings", "no land for sale", "0 results", "0 properties", "nothing matched", "try adjusting", "no matches"]
NAMED = {"&amp;": "&", "&#39;": "'", "&apos;": "'", "&quot;": '"', "&nbsp;": " ", "&middot;": "·", "&#183;": "·"}


def visible_text(html: Column) -> Column:
    """Text without scripts, styles and tags; named and numeric references decoded; spaces single."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script.*?</script>|<style.*?</style>", " ")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    for k, v in NAMED.items():
        t = F.replace(t, F.lit(k), F.lit(v))
    t = F.regexp_replace(t, r"(?i)&#xB7;", "·")

    def join(t: Column) -> Column:
        """Numeric references: the pieces between them joined with the characters they stand for."""
        code = r"&#(\d{1,7}|[xX][0-9a-fA-F]{1,6});"
        number = lambda c: F.when(c.rlike("^[xX]"), F.conv(F.substring(c, 2, 7), 16, 10)).otherwise(c).cast("bigint")
        chars = F.transform(F.regexp_extract_all(t, F.lit(code), F.lit(1)), lambda c: F.decode(F.unhex(F.lpad(F.hex(number(c)), 8, "0")), "UTF-32BE"))
        return F.array_join(F.zip_with(F.split(t, code, -1), chars, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    return F.regexp_replace(let(t, lambda x: F.when(x.contains("&#"), join(x)).otherwise(x)), r"\s+", " ")


def error_shell(html: Column) -> Column:
    return F.coalesce(F.substring(html, 1, 20000).rlike(r"(?i)<title>[^<]*/\s*[45]\d\d\s*</title>"), F.lit(False))


def blocked_page(html: Column) -> Column:
    """A challenge or error page, by its first 20,000 characters."""
    lower, out = F.lower(F.substring(html, 1, 20000)), error_shell(html)
    for m in BLOCK_MARKERS:
        out = out | F.coalesce(lower.contains(m), F.lit(False))
    return out


def empty_shell(html: Column) -> Column:
    """A page with less than 200 characters of text."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>", " "), r"<[^>]+>", " "), r"(?i)&[a-z#0-9]+;", " ")
    return F.coalesce(F.length(squeeze(t)) < 200, F.lit(False))


def count_tags(html: Column) -> Column:
    return F.length(html) - F.length(F.replace(html, F.lit("<"), F.lit("")))


def without_scripts(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>", " ")


def showing_range(html: Column) -> Column:
    """struct<to,total> of "Showing a-b of n listings"."""
    pattern = r"(?i)showing\s+([\d,]+)\s*-\s*([\d,]+)\s+of\s+([\d,]+)\s+listings?"
    bare = without_scripts(html)
    n = lambda i: F.replace(F.regexp_extract(bare, pattern, i), F.lit(","), F.lit("")).try_cast("bigint")
    return F.when(bare.rlike(pattern), F.struct(n(2).alias("to"), n(3).alias("total")))


def total_count(html: Column) -> Column:
    """Results of a search, from the page's state or else its description."""
    state = F.get_json_object(F.regexp_extract(html, r"(?is)<script[^>]*\bid=[\"']__SERVER_STATE__[\"'][^>]*>(.*?)</script>", 1), "$.searchPage.searchResults.totalCount").try_cast("bigint")
    said = F.replace(F.regexp_extract(html, r"(?i)<meta\b[^>]*name=[\"']description[\"'][^>]*content=[\"'][^\"']*LandWatch has ([\d,]+) land listings? for sale\b", 1), F.lit(","), F.lit("")).try_cast("bigint")
    return F.coalesce(F.when(state >= 0, state), said)


def empty_results(html: Column, site: str = "") -> Column:
    """A page that says that nothing was found: by its counts where the site gives them, else by a marker."""
    lower, marked = F.lower(without_scripts(html) if site == "whitetail" else html), F.lit(False)
    for m in EMPTY_MARKERS:
        marked = marked | F.coalesce(lower.contains(m), F.lit(False))
    if site == "whitetail":
        r = showing_range(html)
        return F.when(r.isNotNull(), r["total"] == 0).otherwise(marked)
    return (F.coalesce(total_count(html) == 0, F.lit(False)) | marked) if site == "landwatch" else marked


def decoded(c: Column) -> Column:
    for a, b in (("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&#039;", "'"), ("&lt;", "<"), ("&gt;", ">")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def meta_description(html: Column) -> Column:
    """The og or plain description, attributes in either order; "" if none."""
    head = F.substring(html, 1, 200000)
    name = "(?:property=[\"']og:description[\"']|name=[\"']description[\"'])"
    a = F.regexp_extract(head, rf"(?i)<meta\s[^>]*{name}[^>]*content=[\"']([^\"']*)", 1)
    b = F.regexp_extract(head, rf"(?i)<meta\s[^>]*content=[\"']([^\"']*)[\"'][^>]*{name}", 1)
    return squeeze(decoded(F.coalesce(text_or_null(a), b)))


def meta_contents(html: Column) -> Column:
    """map of lower-case meta names to contents; of equal names the last wins."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<meta\b([^>]*)>"), F.lit(1))
    pairs = F.filter(F.transform(tags, lambda t: F.struct(F.lower(F.trim(F.regexp_extract(t, r"(?i)(?:name|property)\s*=\s*[\"']([^\"']+)[\"']", 1))).alias("key"), F.when(t.rlike(r"(?i)content\s*=\s*[\"']"), F.regexp_extract(t, r"(?i)content\s*=\s*[\"']([^\"']*)[\"']", 1)).alias("value"))), lambda p: (p["key"] != "") & p["value"].isNotNull())
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def coordinates_of_meta(html: Column) -> Column:
    m = meta_contents(html)
    get = lambda k: F.try_element_at(m, F.lit(k))
    pair = F.concat(F.coalesce(text_or_null(get("place:location:latitude")), get("og:latitude")), F.lit(", "), F.coalesce(text_or_null(get("place:location:longitude")), get("og:longitude")))
    return F.coalesce(coordinates(F.replace(get("geo.position"), F.lit(";"), F.lit(","))), coordinates(get("icbm")), coordinates(pair))


# Places of coordinates in links and scripts (pattern, whether latitude comes first).
MAP_LINKS = [
    (r"(?i)[?&](?:q|ll|center|sll|daddr|saddr)=(-?\d{1,3}\.\d+)\s*,\s*(-?\d{1,3}\.\d+)", True),
    (r"/@(-?\d{1,3}\.\d+),(-?\d{1,3}\.\d+)", True),
    (r"(?i)LatLng\(\s*(-?\d{1,3}\.\d+)\s*,\s*(-?\d{1,3}\.\d+)\s*\)", True),
    (r"(?i)[\"']lat(?:itude)?[\"']\s*:\s*[\"']?(-?\d{1,3}\.\d+)[\"']?\s*[,}][^{]*?[\"']l(?:ng|on|ongitude)[\"']\s*:\s*[\"']?(-?\d{1,3}\.\d+)", True),
    (r"(?i)[\"']l(?:ng|on|ongitude)[\"']\s*:\s*[\"']?(-?\d{1,3}\.\d+)[\"']?\s*[,}][^{]*?[\"']lat(?:itude)?[\"']\s*:\s*[\"']?(-?\d{1,3}\.\d+)", False),
]


def coordinates_of_links(html: Column) -> Column:
    return F.coalesce(*[coordinates(F.concat_ws(", ", F.regexp_extract(html, p, 1 if first else 2), F.regexp_extract(html, p, 2 if first else 1))) for p, first in MAP_LINKS])


def title_acres(html: Column) -> Column:
    """The first acreage of og:title, else the first heading, else the title."""
    og = F.regexp_extract(html, r"(?i)<meta\s[^>]*property=[\"']og:title[\"'][^>]*content=[\"']([^\"']*)", 1)
    strip = lambda p: F.regexp_replace(F.regexp_extract(html, p, 1), "<[^>]+>", "")
    title = F.coalesce(text_or_null(og), text_or_null(strip(r"(?is)<h1\b[^>]*>(.*?)</h1>")), strip(r"(?is)<title\b[^>]*>(.*?)</title>"))
    return acreage(F.regexp_extract(title, SUBJECT_ACRES, 1))


def structured_acres(html: Column) -> Column:
    """struct<value,source>: the acreage of the page-load event, else that of the title."""
    tag = F.regexp_extract(html, r"(?is)<[a-z][^>]*data-track-event=[\"']page_load[\"'][^>]*>", 0)
    raw = F.coalesce(text_or_null(F.regexp_extract(tag, r"data-track-data='([^']*)'", 1)), decoded(F.regexp_extract(tag, r'data-track-data="([^"]*)"', 1)))
    loaded = F.when(F.get_json_object(raw, "$.listing_acreage").rlike(r"^[0-9.eE+-]+$") & ~raw.rlike(r'"listing_acreage"\s*:\s*"'), F.get_json_object(raw, "$.listing_acreage").try_cast("double"))
    titled = title_acres(html)
    of = lambda v, s: F.struct(v.alias("value"), F.lit(s).alias("source"))
    return F.when(loaded > 0, of(loaded, "page_load")).when(titled.isNotNull(), of(titled, "title"))


def market_status(html: Column) -> Column:
    return text_or_null(F.regexp_extract(html, r'"marketStatus"\s*:\s*(-?\d+(?:\.\d+)?)', 1)).try_cast("double")


def high_risk_zone(zone: Column) -> Column:
    return F.coalesce(zone.rlike(r"(?i)^\s*[AV]"), F.lit(False))


def subject(ok: Column, source: str, status: Column, price: Column, acres: Column, county: Column, state: Column, note: Column) -> Column:
    """The common form of a reading: everything null unless ok, numbers above 0, a known state, the kind of its status."""

    def of(v: Column) -> Column:
        when = lambda c: F.when(v["ok"], c)
        kind = F.when(v["ok"], status_kind(v["status"]))
        return F.struct(v["ok"].alias("ok"), F.lit(source).alias("source"), when(v["status"]).alias("status"), kind.alias("status_kind"), F.coalesce(kind.isin("pending", "sold"), F.lit(False)).alias("unavailable"), when(F.when(v["price"] > 0, v["price"])).alias("price"), when(F.when(v["acres"] > 0, v["acres"])).alias("acres"), when(v["county"]).alias("county"), when(known_state(v["state"])).alias("state"), v["note"].alias("note"))

    texts = {"status": status, "county": county}
    return let(F.struct(ok.alias("ok"), price.cast("double").alias("price"), acres.cast("double").alias("acres"), state.alias("state"), note.cast("string").alias("note"), *[text_or_null(F.trim(v)).alias(k) for k, v in texts.items()]), of)


def note_unless(ok: Column, text: str) -> Column:
    return F.when(~ok, text)


def landwatch_subject(html: Column, url: Column) -> Column:
    return let(F.struct(visible_text(html).alias("t"), meta_description(html).alias("meta"), county_of_url(url).alias("slug")), lambda v: landwatch_reading(v["t"], v["meta"], v["slug"]))


def landwatch_reading(t: Column, meta: Column, slug: Column) -> Column:
    pattern = r"(?i)^\s*View ([\d,.]+) acres? priced at \$([\d,]+) in (.*)$"
    ok, place = F.coalesce(meta.rlike(pattern), F.lit(False)), F.regexp_extract(meta, pattern, 3)
    named = r"([A-Za-z .'-]+?) County, ([A-Z]{2})(?![A-Za-z0-9_])"
    status = text_or_null(F.regexp_extract(t, r"(?i)View all \d+ pictures? (Available|Under Contract|Off Market|Sold|Pending|Auction|New)(?![A-Za-z0-9_])", 1))
    state = F.coalesce(text_or_null(F.regexp_extract(place, named, 2)), slug["state"])
    note = F.when(~ok, "no summary of a listing in the page from LandWatch").when(status.isNull(), "the page names no status of the listing")
    return subject(ok, "LandWatch", status, currency(F.regexp_extract(meta, pattern, 2)), acreage(F.regexp_extract(meta, pattern, 1)), F.trim(F.regexp_extract(place, named, 1)), state, note)


def whitetail_subject(html: Column, url: Column) -> Column:
    """Three headers in turn: the details' status, an offer, a closed offer."""
    return let(F.struct(visible_text(html).alias("t"), county_of_url(url).alias("slug")), lambda v: whitetail_reading(v["t"], v["slug"]))


def whitetail_reading(t: Column, slug: Column) -> Column:
    closed = F.regexp_extract(t, r"Status ([A-Za-z ]{2,40}?) Property For more information", 1)
    is_closed = closed.rlike("(?i)sold|pending|under contract|off market")
    shop = r"Shop (?:[A-Za-z ]{2,30}?) ([\d,.]+)± Acres ([A-Za-z .'-]+?) County"
    offer = r"Interactive Map (.{0,40}?)\$([\d,]+) · ([\d,.]+)± Acres(?: · \$[\d,]+ Price / Acre)? ([A-Za-z .'-]+?) County"
    gone = r"Interactive Map (Pending Under Contract|Under Contract|Pending|Sold)[^·]{0,20}· ([\d,.]+)± Acres ([A-Za-z .'-]+?) County"
    x = lambda p, i: text_or_null(F.trim(F.regexp_extract(t, p, i)))
    of = lambda s, p, a, c: F.struct(s.alias("s"), p.alias("p"), a.alias("a"), c.alias("c"))
    none = F.lit(None).cast("double")
    r = F.when(is_closed, of(closed, none, acreage(x(shop, 1)), F.coalesce(x(shop, 2), slug["county"]))).when(t.rlike(offer), of(F.coalesce(x(offer, 1), F.lit("For Sale")), currency(x(offer, 2)), acreage(x(offer, 3)), x(offer, 4))).when(t.rlike(gone), of(x(gone, 1), none, acreage(x(gone, 2)), x(gone, 3)))
    return let(r, lambda v: subject(v.isNotNull(), "WhitetailProperties", v["s"], v["p"], v["a"], v["c"], slug["state"], note_unless(v.isNotNull(), "none of the known headers of Whitetail is in the page")))


def mossyoak_subject(html: Column, url: Column) -> Column:
    return let(F.struct(visible_text(html).alias("t"), county_of_url(url).alias("slug")), lambda v: mossyoak_reading(v["t"], v["slug"]))


def mossyoak_reading(t: Column, slug: Column) -> Column:
    block = r"Status: (.*?) Price: (\$[\d,]+|[A-Za-z ]+?) Acres: ([\d,.]+)"
    x = lambda p, i: text_or_null(F.trim(F.regexp_extract(t, p, i)))
    ok = F.coalesce(t.rlike(block), F.lit(False))
    county = F.coalesce(x(r"County: ([A-Za-z .'-]+?) Acres:", 1), slug["county"])
    state = F.coalesce(known_state(x(r"City, State: [A-Za-z .'-]+, ([A-Za-z ]+?) County:", 1)), slug["state"])
    return subject(ok, "MossyOakProperties", x(block, 1), currency(x(block, 2)), acreage(x(block, 3)), county, state, note_unless(ok, "the page lacks the block of status, price and acres"))


def title_of(html: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1), "<[^>]+>", "")


def nationalland_subject(html: Column) -> Column:
    """The header; the county is the last one named in the 300 characters before it, else the title's. Not ok without header."""
    return let(F.struct(visible_text(html).alias("t"), title_of(html).alias("title")), lambda v: nationalland_reading(v["t"], v["title"]))


def nationalland_reading(t: Column, title: Column) -> Column:
    header = r"(?<![A-Za-z0-9_])(ACTIVE|PENDING|UNDER CONTRACT|SOLD)\s+([\d,.]+)\s*\+/-\s*Acres\s*\$([\d,]+)"
    ok = F.coalesce(t.rlike(header), F.lit(False))
    before = F.right(F.call_function("substring_index", t, F.regexp_extract(t, header, 0), F.lit(1)), F.lit(300))
    named = r"([A-Z][a-z.'-]+(?: [A-Z][a-z.'-]+){0,2}) County, ([A-Z]{2})(?![A-Za-z0-9_])"
    last = lambda i: F.try_element_at(F.regexp_extract_all(before, F.lit(named), F.lit(i)), F.lit(-1))
    titled = r" in ([A-Z][A-Za-z.'-]*(?: [A-Z][A-Za-z.'-]*){0,2}) County, ([A-Za-z ]+?)\s*(?:\(|\||$)"
    x = lambda i: F.regexp_extract(t, header, i)
    return subject(ok, "NationalLandRealty", x(1), currency(x(3)), acreage(x(2)), F.coalesce(last(1), F.regexp_extract(title, titled, 1)), F.coalesce(last(2), F.regexp_extract(title, titled, 2)), note_unless(ok, "header not found"))
