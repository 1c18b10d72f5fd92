"""Search plans: counties or their states, times pages, as URLs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys


@dataclass(frozen=True)
class Site:
    """How a site is searched: by county or by state, and its passes of (pages, first URL, URL of page n)."""

    name: str
    base: str
    unit: str  # county, state or none
    passes: tuple[tuple[int, str, str], ...]
    slug: str = "plain"
    title: bool = False
    states: tuple[str, ...] = ()
    page_size: int | None = None
    warn_full: int | None = None
    rotation: int | None = None
    enabled: bool = True


# The sites' URLs. {s} is the state's slug, {c} the county's, {n} the page, {f} the acreage floor.
SITES = {s.name: s for s in (
    Site("landwatch", "https://www.landwatch.com", "county", ((10, "/{s}-land-for-sale/{c}-county/acres-over-{f}", "/{s}-land-for-sale/{c}-county/acres-over-{f}/page-{n}"),), "landwatch", page_size=25, warn_full=25, rotation=3),
    Site("landcom", "https://www.land.com", "county", ((5, "", "/{s}/{c}-county/land-over-40-acres/all-land/date-posted/page-{n}"), (3, "", "/{s}/{c}-county/land-over-150-acres/all-land/date-posted/page-{n}")), title=True, rotation=3, enabled=False),
    Site("landfarm", "https://www.landandfarm.com", "county", ((3, "", "/search/{s}/{c}-county/land-for-sale?minAcres=40&sort=newest&page={n}"), (2, "", "/search/{s}/{c}-county/land-for-sale?minAcres=150&sort=newest&page={n}")), rotation=3, enabled=False),
    Site("landsofamerica", "https://www.landsofamerica.com", "county", ((2, "", "/property/{s}/{c}-county/land-for-sale?minAcres=40&sort=newest&page={n}"), (2, "", "/property/{s}/{c}-county/land-for-sale?minAcres=150&sort=newest&page={n}")), enabled=False),
    Site("livingthedream", "https://www.livingthedreamland.com", "state", ((2, "/land-for-sale/{s}/", "/land-for-sale/{s}/?pg={n}"),), states=("MO", "KY")),
    Site("whitetail", "https://www.whitetailproperties.com", "county", ((1, "/hunting-land?state%5B%5D={S}&county%5B{S}%5D%5B%5D={C}&acreage_min={f}", ""),), "whitetail", warn_full=50, rotation=3),
    Site("mossyoak", "https://www.mossyoakproperties.com", "county", ((2, "/land-for-sale/{s}/{c}-county/", "/land-for-sale/{s}/{c}-county/?pg={n}"),), "mossyoak"),
    Site("midwestlandgroup", "https://midwestlandgroup.com", "none", ((1, "/listings/", ""),)),
    Site("landflip", "https://www.landflip.com", "state", ((2, "/land-for-sale/{s}", "/land-for-sale/{s}/{n}-p"),)),
    Site("nationalland", "https://nationalland.com", "state", ((2, "/land-for-sale/{s}", "/land-for-sale/{s}?page={n}"),)),
    Site("tuttland", "https://www.tuttland.com", "state", ((1, "/land-sale/{s}/", ""),), states=("AL", "GA", "MS", "TN", "FL")),
)}


def encoded(c: Column) -> Column:
    """Percent-encoded, a space as %20."""
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def search_urls(site: Site, counties: DataFrame, floor: int = 40) -> DataFrame:
    """(site, url, county, state, page, page_size, warn_full) of a site's searches for counties (county, state)."""
    if site.unit == "none":
        d = counties.sparkSession.range(1).select(F.lit(None).cast("string").alias("county"), F.lit(None).cast("string").alias("state"))
    elif site.unit == "state":
        d = counties.select(F.lit(None).cast("string").alias("county"), F.upper(F.coalesce("state", F.lit(""))).alias("state")).where("state <> ''").distinct()
        d = d.where(F.col("state").isin(*site.states)) if site.states else d
    else:
        d = counties.select("county", "state")
    step = lambda first, later: lambda n: F.struct(n.alias("page"), F.when((n == 1) & F.lit(bool(first)), F.lit(first)).otherwise(F.lit(later)).alias("shape"))
    plan = F.flatten(F.array(*[F.transform(F.sequence(F.lit(1), F.lit(pages)), step(first, later)) for pages, first, later in site.passes]))
    d = d.withColumn("p", F.explode(plan)).select("county", "state", "p.page", "p.shape")
    url = F.concat(F.lit(site.base), F.col("shape"))
    parts = {"{s}": keys.state_slug(F.col("state"), not site.title), "{c}": keys.county_slug_at(F.col("county"), site.slug), "{S}": encoded(keys.state_name(F.col("state"))), "{C}": encoded(keys.filter_name(F.col("county"))), "{n}": F.col("page").cast("string"), "{f}": F.lit(str(floor))}
    for mark, value in parts.items():
        url = F.replace(url, F.lit(mark), F.coalesce(value, F.lit("")))
    last = F.col("page") == max(p for p, _, _ in site.passes)
    return d.select(F.lit(site.name).alias("site"), url.alias("url"), "county", "state", "page", F.lit(site.page_size).cast("int").alias("page_size"), F.when(last, F.lit(site.warn_full).cast("int")).alias("warn_full"))


def rotation(counties: DataFrame, n: int | None, day: Column) -> DataFrame:
    """The counties whose turn it is: group hash(county|state) mod n equal to the day's; all unless n is 2 or more."""
    if n is None or n < 2:
        return counties
    return counties.where(F.pmod(keys.fnv1a(F.concat_ws("|", "county", "state")), F.lit(n)) == F.pmod(keys.day_index(day), F.lit(n)))


def plan(counties: DataFrame, day: Column, names: list[str] | None = None, bypass_rotation: bool = False) -> DataFrame:
    """The URLs of all enabled sites (or the named ones that exist), each for the counties of its turn."""
    out = None
    for site in SITES.values():
        if site.name not in names if names is not None else not site.enabled:
            continue
        turn = counties if bypass_rotation or site.unit != "county" else rotation(counties, site.rotation, day)
        urls = search_urls(site, turn)
        out = urls if out is None else out.unionByName(urls)
    return out


def catalog(spark) -> DataFrame:
    """(name, enabled, rotation, unit) of the sites."""
    return spark.createDataFrame([(s.name, s.enabled, s.rotation, s.unit) for s in SITES.values()], "name string, enabled boolean, rotation int, unit string")


def requested(counties: DataFrame, wanted: DataFrame) -> DataFrame:
    """The county rows of wanted (pos, county, state) in its order; a row that is no county fails the query."""
    c, s = F.col("county"), F.col("state")
    d = wanted.select("pos", keys.exact_key(c, s).alias("k")).join(counties.withColumn("k", keys.exact_key(c, s)), "k", "left")
    return d.withColumn("_ok", F.assert_true(c.isNotNull(), F.concat(F.lit("no such county: "), "k"))).where("_ok IS NULL").orderBy("pos").drop("k", "_ok")


def requested_of(option: DataFrame, column: str = "option") -> DataFrame:
    """(pos, county, state) of texts "County|ST,County|ST"; a part without both fails the query."""
    d = option.select(F.posexplode(F.split(column, ",")).alias("pos", "part")).withColumn("p", F.transform(F.split("part", r"\|"), lambda x: F.trim(x)))
    ok = (F.size("p") == 2) & (F.get("p", F.lit(0)) != "") & (F.get("p", F.lit(1)) != "")
    return d.withColumn("_ok", F.assert_true(ok, F.concat(F.lit("malformed county: "), "part"))).where("_ok IS NULL").select("pos", F.get("p", F.lit(0)).alias("county"), F.get("p", F.lit(1)).alias("state"))


def pending(urls: DataFrame, files: DataFrame) -> DataFrame:
    """(url, file) of requested URLs whose evidence file is not there; of equal file names the first by pos."""
    d = urls.withColumn("file", keys.evidence_name(F.col("url"))).groupBy("file").agg(F.min_by("url", "pos").alias("url"))
    return d.join(files.select("file"), "file", "left_anti")
