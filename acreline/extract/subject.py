"""Readings of detail pages in one form: subject, intake and audit, put together from native columns and one page function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys, numbers, pages
from ..functions import text as T
from .cards import detail_of


#: Fields of the page function that the readings of a site use; of a site that is not named all of READING.
READING = ("title", "scoped_html", "h1", "availability", "ld_price", "ld_name", "offer_price", "price_texts", "panel")
NEEDS = {
    **dict.fromkeys(("LandWatch", "WhitetailProperties", "MossyOakProperties"), ()),
    "TuttLand": ("availability", "ld_price", "ld_name", "panel"),
    "LANDFLIP": ("scoped_html", "h1", "availability", "ld_price", "offer_price"),
}


def with_detail(rows: DataFrame, html: str = "html", *fields: str) -> DataFrame:
    """rows with struct d of what the page says, of all fields or some, and text t, its visible text."""
    return rows.withColumn("d", detail_of(F.col(html), *fields)).withColumn("t", pages.visible_text(F.col(html)))


def read_price() -> Column:
    """The scoped page's price: of JSON-LD, else the first of the usual places that holds a total."""
    shown = F.try_element_at(F.filter(F.transform("d.price_texts", numbers.price_text), lambda p: p.isNotNull()), F.lit(1))
    return F.coalesce("d.offer_price", shown)


def scoped_text() -> Column:
    return F.trim(pages.visible_text(F.regexp_replace("d.scoped_html", r"(?is)^.*?<body[^>]*>", "")))


def text_status(html: Column, own: Column | None = None) -> Column:
    """The status that titles, descriptions and the scoped body (own, else worked out) say by phrase."""
    plain = lambda c: F.coalesce(T.squeeze(c), F.lit(""))
    title = F.regexp_replace(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1), "<[^>]+>", "")
    og = F.regexp_extract(html, r"(?i)<meta\s[^>]*property=[\"']og:title[\"'][^>]*content=[\"']([^\"']*)", 1)
    fields = [plain(title), plain(og), plain(F.col("d.h1")), pages.meta_description(html), scoped_text() if own is None else own]
    return T.merged_status(F.flatten(F.array(*[T.availability(f) for f in fields])))


def generic_acres() -> Column:
    """Takes the columns of with_parts."""
    return numbers.usual_acres(F.concat_ws(" ", "d.title", "about", "own"))


def panel_status() -> Column:
    """The first panel figure that is a status, else the word after the header's acres."""
    shown = F.try_element_at(F.filter("d.panel", lambda x: T.status_kind(x).isNotNull()), F.lit(1))
    return F.coalesce(shown, numbers.text_or_null(F.regexp_extract("t", r"(?i)Explore the Property .{0,160}?\$[\d,]+ [\d,.]+ acres (Active|Under Contract|Contract Pending|Sale Pending|Pending|Contingent|Sold|Off Market|New|Reduced)(?![A-Za-z0-9_])", 1)))


COUNTY_STATE = r"(?<![A-Za-z0-9_])in\s+([A-Z][A-Za-z.'\-]*(?:\s+[A-Z][A-Za-z.'\-]*)*?)\s+County,\s+([A-Za-z]{2,})(?:\s+([A-Za-z]{2,}))?"


def description_place(c: Column) -> Column:
    """struct<county,state> of "in X County, State"; nothing unless the state is one."""
    a, b = F.regexp_extract(c, COUNTY_STATE, 2), F.regexp_extract(c, COUNTY_STATE, 3)
    state = F.coalesce(keys.known_state(F.when(b != "", F.concat(a, F.lit(" "), b))), keys.known_state(a))
    return F.when(state.isNotNull(), F.struct(T.squeeze(F.regexp_extract(c, COUNTY_STATE, 1)).alias("county"), state.alias("state")))


def description_acres(c: Column) -> Column:
    return numbers.acreage(F.regexp_extract(c, rf"(?i)(?<![A-Za-z0-9_])with\s+({numbers.ACREAGE})\s+acres?(?![A-Za-z0-9_])", 1))


def with_parts(rows: DataFrame, html: str, url: str, whole: bool = True) -> DataFrame:
    """with_detail, and what several sites' readings share, each worked out once a row: site, about, slug, own (the scoped text), said and some_acres; the last two where the site's reading asks for them.

    Struct d has the fields of READING; unless whole, those alone that the site's own reading uses are not null.
    """
    h, d = F.col(html), rows.withColumn("site", keys.source_of(F.col(url)))
    d = d.withColumn("d", detail_of(h, *READING) if whole else detail_of(h, *READING, site=F.col("site"), needs=NEEDS)).withColumn("t", pages.visible_text(h))
    d = d.withColumns({"about": pages.meta_description(h), "slug": keys.county_of_url(F.col(url)), "own": scoped_text()})
    asks = ~F.col("site").isin("LandWatch", "WhitetailProperties", "MossyOakProperties", "TuttLand")
    return d.withColumns({"said": F.when(asks, text_status(h, F.col("own"))), "some_acres": F.when(asks & (F.col("site") != "LANDFLIP"), generic_acres())})


def ld_subject(source: str) -> Column:
    """The reading of a site that writes JSON-LD, helped by its panel, description or text. Takes the columns of with_parts."""
    slug, about, ld_status = F.col("slug"), F.col("about"), T.status_of_availability(F.col("d.availability"))
    none = F.lit(None)
    price, acres, county, state, head, text = F.col("d.ld_price"), none.cast("double"), none.cast("string"), none.cast("string"), none.cast("string"), none.cast("string")
    if source == "TuttLand":
        header, offer = r"(?i)Explore the Property .{0,160}?\$([\d,]+) ([\d,.]+) acres", r"Land for Sale in ([A-Za-z ]+?) / ([A-Za-z .'-]+?) County(?![A-Za-z0-9_])"
        price = F.coalesce(price, numbers.currency(F.regexp_extract("t", header, 1)))
        named = numbers.acreage(F.regexp_extract("d.ld_name", rf"(?i)({numbers.ACREAGE})\s*(?:\+/-|±)?\s*acres?", 1))
        acres = F.coalesce(numbers.acreage(F.regexp_extract("t", header, 2)), named)
        county, state = numbers.text_or_null(F.trim(F.regexp_extract("t", offer, 2))), keys.known_state(F.regexp_extract("t", offer, 1))
        head = panel_status()
    elif source == "LANDFLIP":
        place = description_place(about)
        price, acres, county, state, text = F.coalesce(price, F.col("d.offer_price")), description_acres(about), place["county"], place["state"], F.col("said")
    else:
        price, acres, text = F.coalesce(price, read_price()), F.col("some_acres"), F.col("said")
    status = T.merged_status(F.array(head, ld_status, text))

    def reading(v: Column) -> Column:
        ok = v["price"].isNotNull() | v["acres"].isNotNull() | v["status"].isNotNull()
        note = F.when(~ok, "listing price, acreage and status not found").when(v["status"].isNull(), "listing status not shown on the page")
        return pages.subject(ok, source, v["status"], v["price"], v["acres"], v["county"], v["state"], note)

    where = [F.coalesce(county, slug["county"]).alias("county"), F.coalesce(state, slug["state"]).alias("state")]
    return numbers.let(F.struct(price.alias("price"), acres.alias("acres"), status.alias("status"), *where), reading)


def generic_subject() -> Column:
    status = T.merged_status(F.array(T.status_of_availability(F.col("d.availability")), F.col("said")))
    none = F.lit(None).cast("string")

    def reading(v: Column) -> Column:
        ok = v["price"].isNotNull() | v["acres"].isNotNull() | v["status"].isNotNull()
        return pages.subject(ok, "generic", v["status"], v["price"], v["acres"], none, none, pages.note_unless(ok, "no price, acreage or status found on the page"))

    return numbers.let(F.struct(read_price().alias("price"), F.col("some_acres").alias("acres"), status.alias("status")), reading)


def with_subject(rows: DataFrame, html: str, url: str, whole: bool = True) -> DataFrame:
    """Struct row of the columns of rows, html, url, the columns of with_parts, and struct subject, read the way of the URL's site."""
    # the parts are named so that no column of rows can be taken for one
    d = with_parts(rows.select(F.struct(*rows.columns).alias("row"), F.col(html).alias("html"), F.col(url).alias("url")), "html", "url", whole)
    title, t, about, slug = pages.title_of(F.col("html")), F.col("t"), F.col("about"), F.col("slug")
    national = numbers.let(pages.nationalland_reading(t, title), lambda v: F.when(v["ok"], v).otherwise(ld_subject("NationalLandRealty")))
    readers = {"LandWatch": pages.landwatch_reading(t, about, slug), "WhitetailProperties": pages.whitetail_reading(t, slug), "MossyOakProperties": pages.mossyoak_reading(t, slug), "NationalLandRealty": national, **{x: ld_subject(x) for x in ("TuttLand", "LANDFLIP", "LandAndFarm")}}
    out = generic_subject()
    for site, reading in readers.items():
        out = F.when(F.col("site") == site, reading).otherwise(out)
    # exploded: a selection by a plain column would be moved below all parts, with the whole reading in place of every name
    return d.select("*", F.explode(F.array(out)).alias("subject"))


def subjects(rows: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """rows with struct subject, read the way of the site that the URL belongs to."""
    return with_subject(rows, html, url, whole=False).select("row.*", "subject")


def intake_flags() -> Column:
    s = F.col("subject")
    return F.when(s["ok"], F.when(s["unavailable"], F.array(F.lower(s["status"]))).otherwise(F.array().cast("array<string>"))).otherwise(T.availability(F.concat_ws(" ", "d.title", "about", "own")))


def intake_columns() -> list[Column]:
    """What intake_details adds but flags, of the columns of with_subject."""
    s, about = F.col("subject"), F.col("about")
    error = F.when(~s["ok"] & (s["source"] != "generic"), F.concat(F.lit("Could not read the listing ("), F.coalesce(s["note"], F.lit("listing details not found on the page")), F.lit(")")))
    return [T.clean_title(F.col("d.title")).alias("name"), F.substring(about, 1, 500).alias("description"), F.when(s["ok"], s["price"]).otherwise(read_price()).alias("price"), F.when(s["ok"], s["acres"]).otherwise(F.coalesce("some_acres", generic_acres())).alias("acres"), s["county"].alias("county"), s["state"].alias("state"), F.col("flags"), error.alias("error")]


def intake_details(rows: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """rows with name, description, price, acres, county, state, flags, error: what a submitted page gives.

    A known site whose block is missing is an error; any other page is read generically. A page is read once.
    """
    return with_subject(rows, html, url).withColumn("flags", intake_flags()).select("row.*", *intake_columns())


def audit_readings(rows: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """intake_details with ld_price, structured_acres, market_status and review_flags: phrases of the whole page that its scoped part lacks."""
    h, d = F.col("html"), with_subject(rows, html, url).withColumn("flags", intake_flags())
    more = {"ld_price": F.col("d.offer_price"), "structured_acres": pages.structured_acres(h), "market_status": pages.market_status(h), "review_flags": F.array_except(T.availability(F.col("t")), F.col("flags"))}
    return d.select("row.*", *intake_columns(), *[v.alias(k) for k, v in more.items()])


def page_coordinates(html: Column, geo: Column) -> Column:
    """Coordinates of JSON-LD, else of the head, else of a map link."""
    return F.coalesce(numbers.coordinates(geo), pages.coordinates_of_meta(html), pages.coordinates_of_links(html))


def detail_description(html: Column, d: Column) -> Column:
    """The page function's description; of a page too large for it the one in the head."""
    return F.when(d["too_large"], F.substring(pages.meta_description(html), 1, 2000)).otherwise(d["description"])
