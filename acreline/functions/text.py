"""Phrases, statuses, notes and report texts as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import js_round, let, money, text_or_null

# Phrases that say a listing is no longer available.
UNAVAILABLE = ["under contract", "sale pending", "pending sale", "no longer available", "off market", "off-market"]
SOLD = [r"(?i)^\s*sold(?:\s+out)?\s*-", r"(?i)^\s*sold(?:\s+out)?\s*$", r"(?i)(?<![A-Za-z0-9_])status\s*:\s*sold(?![A-Za-z0-9_])", r"(?i)(?<![A-Za-z0-9_])has\s+been\s+sold(?![A-Za-z0-9_])", r"(?i)(?<![A-Za-z0-9_])(?:now|just)\s+sold(?![A-Za-z0-9_])"]

# Words of a review.
DEALBREAKERS = [
    "conservation easement", "deed restriction", "landlocked", "no access", "no road access", "no road frontage", "no legal access", "no utilities", "condemned", "superfund",
    "contaminated", "right of way only", "mineral rights excluded", "leased mineral", "cemetery", "pipeline easement", "high-voltage transmission", "eminent domain", "landfill", "industrial waste",
]
YELLOW_FLAGS = [
    "flood zone", "flood plain", "fema flood", "mobile home", "manufactured home", "wetland", "wetlands", "swamp", "marsh", "creek bottom", "bottom land", "timber lease", "hunting lease",
    "oil lease", "gas lease", "seasonal road", "unmaintained road", "gravel road", "steep", "rough terrain", "rocky", "mostly wooded", "hoa", "homeowners association", "deed restriction",
    "well needed", "no well", "no water", "no electric", "no power",
]
POSITIVES = [
    "paved road", "paved frontage", "highway frontage", "road frontage", "flat", "level", "gently rolling", "open pasture", "cleared", "multiple frontages", "two road frontage", "corner lot",
    "creek", "pond", "lake", "spring", "water feature", "well on property", "existing well", "city water available", "electric available", "power on property", "barn", "fenced", "cross-fenced",
    "motivated seller", "price reduced", "must sell", "timber value", "merchantable timber", "recreational", "hunting", "deer", "turkey", "wildlife",
]

MARKER = "--- AUTO ANALYSIS ---"

# Reason beginnings and their categories, first match wins.
REASONS = [
    ("fetch failed", "fetch-failed"), ("could not extract", "unextractable"), ("listing gone", "listing-gone"), ("now ", "now-unavailable"), ("below ", "below-acre-floor"),
    ("county has no CPA Target in Airtable", "county-no-cpa-target"), ("county not a target", "county-not-target"), ("county (from page text) not a target", "county-not-target-unconfirmed"),
    ("availability phrase outside subject listing", "availability-outside-scope"), ("corroborating page data", "status-corroboration"), ("page data disagrees with phrase", "status-disagreement"),
    ("page data:", "status-unmapped"), ("$/ac over threshold", "over-threshold"), ("price sources disagree", "price-source-disagreement"), ("price:", "price-mismatch"),
    ("acres sources disagree", "acres-source-disagreement"), ("acres:", "acres-mismatch"), ("county link missing", "county-link-missing"), ("county mismatch", "county-mismatch"),
    ("county could not be determined", "county-unresolved"), ("watch zone", "watch-zone"),
]


def phrase_pattern(phrase: str, gap: str = r"[\s-]+", case: str = "(?i)") -> str:
    """Whole words with any white space or hyphens (gap) between them; word borders are ASCII, and so is case unless told."""
    words = [w.replace(".", r"\.") for w in phrase.split()]
    return case + r"(?<![A-Za-z0-9_])" + gap.join(words) + r"(?![A-Za-z0-9_])"


def found(t: Column, low: Column, phrases: list[str]) -> list[Column]:
    """Each phrase or null: where low, t in lower case, has the phrase's longest word, the pattern decides."""
    return [F.when(low.contains(max(p.split(), key=len)) & t.rlike(phrase_pattern(p)), F.lit(p)) for p in phrases]


def present(text: Column, phrases: list[str]) -> Column:
    """The phrases that occur in text, in the list's order."""
    return let(F.struct(text.alias("t"), F.lower(text).alias("low")), lambda x: F.array_compact(F.array(*found(x["t"], x["low"], phrases))))


def sold(text: Column) -> Column:
    out = text.rlike(SOLD[0])
    for p in SOLD[1:]:
        out = out | text.rlike(p)
    return out


def availability(text: Column) -> Column:
    """Phrases that say the listing is not available, sold last."""
    both = F.struct(text.alias("t"), F.lower(text).alias("low"))
    return let(both, lambda x: F.array_compact(F.array(*found(x["t"], x["low"], UNAVAILABLE), F.when(x["low"].contains("sold") & sold(x["t"]), F.lit("sold")))))


def status_kind(status: Column) -> Column:
    """sold, pending, active or null of a status text."""
    s = F.lower(status)
    return F.when(s.rlike(r"(?<![a-z0-9_])sold(?![a-z0-9_])|off[\s-]*market|no longer available|withdrawn|expired"), "sold").when(s.rlike(r"under[\s-]*contract|pending|contingent"), "pending").when(s.rlike(r"available|for sale|active|(?<![a-z0-9_])new(?![a-z0-9_])|reduced|auction|listing|price change"), "active")


def status_of_availability(c: Column) -> Column:
    """Sold or Available of a schema.org availability."""
    return F.when(c.rlike("(?i)SoldOut|Discontinued|OutOfStock"), "Sold").when(c.rlike("(?i)InStock|OnlineOnly|InStoreOnly"), "Available")


def merged_status(readings: Column) -> Column:
    """Of several readings the first that says sold, else pending, else active, else the first at all."""
    first = lambda some, kind: F.try_element_at(F.filter(some, lambda r: status_kind(r).eqNullSafe(F.lit(kind))), F.lit(1))
    some = F.filter(readings, lambda r: r.isNotNull() & (r != ""))
    return let(some, lambda x: F.coalesce(first(x, "sold"), first(x, "pending"), first(x, "active"), F.try_element_at(x, F.lit(1))))


def unavailable_status(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?i)(?<![A-Za-z0-9_])(?:pending|sold|under contract|off market|contingent)(?![A-Za-z0-9_])"), F.lit(False))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def clean_title(c: Column) -> Column:
    """The title before a site's suffix, 120 characters at most; null if nothing is left."""
    return text_or_null(F.substring(F.trim(F.split(squeeze(c), r"\s+[|–—-]\s+(?=[A-Z])")[0]), 1, 120))


def reason_category(c: Column) -> Column:
    out = F.lit("other")
    for start, name in reversed(REASONS):
        hit = c.startswith(start)
        out = F.when(hit & c.contains("-acre floor") if start == "below " else hit, name).otherwise(out)
    return out


def merged_note(existing: Column, entry: Column) -> Column:
    """existing with entry above the analysis marker, or at the end."""
    old = F.coalesce(existing, F.lit(""))
    blank = F.lit(" \n\t\r")
    above, below = F.trim(F.substring_index(old, MARKER, 1), blank), F.substring(old, F.locate(MARKER, old) + len(MARKER), F.length(old))
    return F.trim(F.when(old.contains(MARKER), F.concat(above, F.lit("\n"), entry, F.lit(f"\n\n{MARKER}"), below)).otherwise(F.concat(F.trim(old, blank), F.lit("\n"), entry)), blank)


def log_entry(log: Column, day: Column, message: Column) -> Column:
    """log with a dated line at the end."""
    return F.concat_ws("\n", text_or_null(log), F.concat(F.lit("["), day.cast("string"), F.lit("] "), message))


def joined_descriptions(card: Column, detail: Column, most: int = 2400) -> Column:
    """The detail text if it holds the card's, else both."""
    b, d = squeeze(card), squeeze(detail)
    return F.substring(F.when(d == "", b).when((b == "") | F.contains(d, b), d).otherwise(F.concat(b, F.lit(" "), d)), 1, most)


def without_contained(parts: Column) -> Column:
    """Texts that no longer text of the array contains, empty ones left out."""
    some = F.filter(parts, lambda p: p.isNotNull() & (p != ""))
    return F.filter(some, lambda x: ~F.exists(some, lambda y: (F.length(y) > F.length(x)) & F.contains(y, x)))


def fraction(count: Column, total: Column, unit: str) -> Column:
    """every request, or n of m requests."""
    return F.when((total > 0) & (count == total), F.lit(f"every {unit}")).otherwise(F.concat(count.cast("string"), F.lit(" of "), total.cast("string"), F.when(total == 1, F.lit(f" {unit}")).otherwise(F.lit(f" {unit}s"))))


def stars(score: Column) -> Column:
    n = js_round(score).cast("int")
    return F.concat(F.repeat(F.lit("★"), n), F.repeat(F.lit("☆"), F.lit(5) - n))


def created_summary(price: Column, acres: Column, county: Column, state: Column) -> Column:
    parts = F.array_compact(F.array(
        F.when(price > 0, money(price)).otherwise("price unknown"),
        F.when(acres > 0, F.concat(F.regexp_replace(acres.cast("string"), r"\.0$", ""), F.lit(" acres"))).otherwise("acres unknown"),
        F.when(text_or_null(county).isNotNull(), F.concat(county, F.lit(" County, "), state)),
    ))
    return F.concat(F.lit("Created New Lead from submitted URL: "), F.array_join(parts, ", "), F.lit("."))


def gaps(price: Column, acres: Column, county: Column) -> Column:
    missing = lambda c, name: F.when(c.isNull() | (c.cast("string").isin("", "0", "0.0")), F.lit(name))
    return F.array_compact(F.array(missing(price, "price"), missing(acres, "acres"), missing(county, "county")))


def csv_field(c: Column) -> Column:
    s = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(s.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def csv_row(*columns: Column) -> Column:
    return F.concat(F.array_join(F.array(*map(csv_field, columns)), ","), F.lit("\n"))


# Anchor texts that are no title.
JUNK_WORDS = ["photos", "photo", "gallery", "video", "map", "tour", "virtual tour", "save", "share", "details", "more", "learn more", "read more"]


def junk_anchor(c: Column) -> Column:
    t = F.trim(F.coalesce(c, F.lit("")))
    return (F.length(t) < 3) | F.lower(t).isin(*JUNK_WORDS) | t.rlike(r"(?i)^(?:click|tap)(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?:view|see)\s+(?:more|photos?|details?|listing)|^\d+\s+photos?$")
