"""Normal forms that define equality: counties, states, URLs, fingerprints, rotation groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import bucket, let, text_or_null

# States and their two letters.
STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware",
    "FL": "Florida", "GA": "Georgia", "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa", "KS": "Kansas", "KY": "Kentucky",
    "LA": "Louisiana", "ME": "Maine", "MD": "Maryland", "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi", "MO": "Missouri",
    "MT": "Montana", "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico", "NY": "New York", "NC": "North Carolina",
    "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania", "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota",
    "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia", "WA": "Washington", "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming",
}

# Counties that one site spells its own way.
SLUGS = {"leflore": "le-flore"}
FILTER_NAMES = {"leflore": "Le Flore"}

# Host endings of the known sites.
SITES = [("landwatch.com", "LandWatch"), ("whitetailproperties.com", "WhitetailProperties"), ("mossyoakproperties.com", "MossyOakProperties"), ("nationalland.com", "NationalLandRealty"), ("tuttland.com", "TuttLand"), ("landflip.com", "LANDFLIP"), ("landandfarm.com", "LandAndFarm")]


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def state_name(c: Column) -> Column:
    """Full name of two letters; anything else as it is."""
    return F.coalesce(literal_map(STATES)[F.upper(c)], c)


def state_letters(c: Column) -> Column:
    """Two letters of a full name; anything else trimmed and in capitals."""
    return F.coalesce(literal_map({v.lower(): k for k, v in STATES.items()})[F.trim(F.lower(c))], F.upper(F.trim(c)))


def known_state(c: Column) -> Column:
    """Two letters if the text is a state's letters or name, else null."""
    letters = state_letters(F.regexp_replace(c, "-", " "))
    return F.when(letters.isin(*STATES), letters)


def state_slug(c: Column, lower: bool = True) -> Column:
    slug = F.regexp_replace(state_name(c), r"\s+", "-")
    return F.lower(slug) if lower else slug


def county_form(c: Column) -> Column:
    """Lower case without the words county and parish, letters and single spaces only."""
    bare = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?<![a-z0-9_])(?:county|parish)(?![a-z0-9_])", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[^a-z\s]", ""), r"\s+", " "))


def exact_key(county: Column, state: Column) -> Column:
    return F.concat(F.lower(F.coalesce(county, F.lit(""))), F.lit("|"), F.upper(F.coalesce(state, F.lit(""))))


def loose_key(county: Column, state: Column) -> Column:
    """County form without spaces and state letters; null if either is missing."""
    c, s = F.regexp_replace(county_form(county), " ", ""), state_letters(F.coalesce(state, F.lit("")))
    return F.when((c != "") & (s != ""), F.concat(c, F.lit("|"), s))


def saint_key(county: Column) -> Column:
    """County form with St and Ste spelled out, without spaces."""
    c = F.regexp_replace(county_form(county), r"^ste(?![a-z])", "sainte")
    return F.regexp_replace(F.regexp_replace(c, r"^st(?![a-z])", "saint"), " ", "")


def site_key(county: Column) -> Column:
    """Letters alone, with St. and Ste. spelled out."""
    c = F.regexp_replace(F.lower(F.coalesce(county, F.lit(""))), r"^st\.?\s+", "saint ")
    return F.regexp_replace(F.regexp_replace(c, r"^ste\.?\s+", "sainte "), r"[^a-z]", "")


def location_key(county: Column, state: Column, acres: Column, acre_bucket: float = 5) -> Column:
    """county form | state | acreage bucket; null if a part is missing."""
    c, s, a = county_form(county), F.upper(F.trim(F.coalesce(state, F.lit("")))), bucket(acres, acre_bucket)
    return F.when((c != "") & (s != "") & (a > 0), F.concat_ws("|", c, s, a.cast("bigint").cast("string")))


def fingerprint(county: Column, state: Column, acres: Column, price: Column, acre_bucket: float = 5, price_bucket: float = 5000) -> Column:
    """16 hex digits that agree for one property on different sites; null if a part is missing."""
    p = bucket(price, price_bucket)
    raw = F.concat_ws("|", location_key(county, state, acres, acre_bucket), p.cast("bigint").cast("string"))
    return F.when(location_key(county, state, acres, acre_bucket).isNotNull() & (p > 0), F.substring(F.sha2(raw, 256), 1, 16))


def county_slug(c: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(c), "[.'’]", ""), r"[^a-z0-9\s-]", "")
    return F.regexp_replace(F.trim(slug), r"\s+", "-")


def county_slug_at(c: Column, site: str) -> Column:
    """The county's slug in a site's URLs."""
    known = literal_map(SLUGS)[F.lower(F.trim(c))]
    if site == "landwatch":
        return F.coalesce(known, county_slug(c))
    if site == "mossyoak":
        return F.coalesce(known, county_slug(F.regexp_replace(F.trim(c), "([a-z])([A-Z])", "$1-$2")))
    return county_slug(filter_name(c)) if site == "whitetail" else county_slug(c)


def filter_name(c: Column) -> Column:
    """The county's name in a search form: saints spelled out."""
    spelled = F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i)^st\.?\s+", "Saint "), r"(?i)^ste\.?\s+", "Sainte ")
    return F.coalesce(literal_map(FILTER_NAMES)[F.lower(F.trim(c))], spelled)


def slug(c: Column, empty: str = "stage") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", F.lit(empty)).otherwise(s)


def host(url: Column) -> Column:
    """Lower-case host without www.; null for what is no URL."""
    return text_or_null(F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"^www\.", ""))


def source_of(url: Column) -> Column:
    """The site that a URL belongs to, generic if none is known."""
    h = host(url)
    out = F.lit("generic")
    for ending, name in reversed(SITES):
        out = F.when(h.endswith(ending), name).otherwise(out)
    return out


def path_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))


STATE_SLUGS = "|".join(sorted((v.lower().replace(" ", "-") for v in STATES.values()), key=len, reverse=True))


def county_of_url(url: Column) -> Column:
    """struct<county,state> from the path of a known site's URL, else null. State is two letters where it is known."""
    shapes = {
        "LandWatch": (rf"/([a-z]+(?:-[a-z]+)*)-county-({STATE_SLUGS})(?:-|/|$)", 1, 2),
        "WhitetailProperties": (r"/hunting-land/([^/]+)/([^/]+)/", 2, 1),
        "MossyOakProperties": (rf"/property/(?:.+-)?([^/-]+)-({STATE_SLUGS})/\d+/?$", 1, 2),
        "TuttLand": (r"/land-sale/([^/]+)/([^/]+)-county/", 2, 1),
    }
    pick = lambda of: F.create_map(*[F.lit(x) for k, v in shapes.items() for x in (k, v[of])])

    def found(v: Column) -> Column:
        part = lambda i: F.call_function("regexp_extract", v["path"], v["pattern"], v[i])
        county = F.initcap(F.trim(F.regexp_replace(part("c"), "-+", " ")))
        state = let(part("s"), known_state)
        return F.when(F.call_function("regexp_like", v["path"], v["pattern"]), F.struct(county.alias("county"), state.alias("state")))

    site = source_of(url)
    return let(F.struct(path_of(url).alias("path"), pick(0)[site].alias("pattern"), pick(1)[site].alias("c"), pick(2)[site].alias("s")), found)


def canonical_url(url: Column) -> Column:
    """Lower case without fragment, query and closing slashes."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"[#?].*$", ""), r"/+$", ""))


def is_detail_url(url: Column, site: str) -> Column:
    path = F.regexp_replace(F.regexp_replace(url, r"(?i)^https?://[^/]+", ""), r"[#?].*$", "")
    if site == "landflip":
        return F.coalesce(path.rlike(r"^/land/\d+/?$"), F.lit(False))
    return F.coalesce(path.rlike(r"^/listings/[^/]+/?$") & ~path.rlike(r"(?i)^/listings/feed/?$"), F.lit(False))


def series_key(url: Column, county: Column, state: Column) -> Column:
    """county | state | URL without its page number, so that the pages of one search share a key."""
    u = F.regexp_replace(url, r"(?i)^(.*?)([?&])(?:pg|page)=\d+&", "$1$2")
    for pattern in (r"(?i)^(.*?)[?&](?:pg|page)=\d+(?![A-Za-z0-9_])", r"(?i)^(.*?)/page-\d+(?![A-Za-z0-9_])", r"(?i)^(.*?)/\d+-p(?![A-Za-z0-9_])"):
        u = F.regexp_replace(u, pattern, "$1")
    return F.concat_ws("|", F.coalesce(county, F.lit("")), F.coalesce(state, F.lit("")), u)


def evidence_name(url: Column) -> Column:
    """host-slug-hash.html, the same for the same URL."""
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "^/+|/+$", "")
    return F.concat(F.regexp_extract(url, r"://([^/?#:]+)", 1), F.lit("-"), slug(path, "root"), F.lit("-"), F.substring(F.sha2(url, 256), 1, 8), F.lit(".html"))


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a of ASCII text as an unsigned number."""
    codes = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.ascii(F.substring(c, i, F.lit(1))))
    step = lambda h, x: F.pmod(h.bitwiseXOR(x.cast("bigint")) * F.lit(16777619), F.lit(4294967296).cast("bigint"))
    return F.when(F.length(c) == 0, F.lit(2166136261).cast("bigint")).otherwise(F.aggregate(codes, F.lit(2166136261).cast("bigint"), step))


def day_index(day: Column) -> Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date"))
