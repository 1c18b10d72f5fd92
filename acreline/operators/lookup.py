"""Lookups of listings in the county dimension. Strategies are left to Spark, which broadcasts by measured size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys


def county_index(counties: DataFrame) -> DataFrame:
    """One row a county key: of rows with the same key one with a target wins, then the one with the highest seq.

    counties: seq, county, state, max_cpa.
    """
    d = counties.withColumn("key", keys.exact_key(F.col("county"), F.col("state"))).withColumn("has_target", F.coalesce(F.col("max_cpa") > 0, F.lit(False)))
    best = F.max_by(F.struct("seq", "county", "state", "max_cpa", "has_target"), F.struct("has_target", "seq"))
    return d.groupBy("key").agg(best.alias("b")).select("key", "b.*")


def latest_targets(counties: DataFrame, key: Column) -> DataFrame:
    """(key, max_cpa): the row with the highest seq of each key, rows without a positive target left out."""
    return counties.where("max_cpa > 0").withColumn("key", key).where("key IS NOT NULL").groupBy("key").agg(F.max_by("max_cpa", "seq").alias("max_cpa"))


def with_target(listings: DataFrame, counties: DataFrame, out: str = "cpa_target") -> DataFrame:
    """listings with the target of their county: by the exact key, else by the loose one."""
    c, s = F.col("county"), F.col("state")
    exact = latest_targets(counties, keys.exact_key(c, s)).select(F.col("key").alias("_exact"), F.col("max_cpa").alias("_t1"))
    loose = latest_targets(counties, keys.loose_key(c, s)).select(F.col("key").alias("_loose"), F.col("max_cpa").alias("_t2"))
    d = listings.withColumn("_exact", keys.exact_key(c, s)).withColumn("_loose", keys.loose_key(c, s))
    return d.join(exact, "_exact", "left").join(loose, "_loose", "left").withColumn(out, F.coalesce("_t1", "_t2")).drop("_exact", "_loose", "_t1", "_t2")


def in_target_county(listings: DataFrame, counties: DataFrame) -> DataFrame:
    """Listings whose county has a target."""
    return with_target(listings, counties, "_target").where("_target IS NOT NULL").drop("_target")


def with_county_id(listings: DataFrame, counties: DataFrame) -> DataFrame:
    """listings with county_id, the seq of their county's index row, by exact then loose key."""
    c, s = F.col("county"), F.col("state")
    index = county_index(counties)
    exact = index.select(F.col("key").alias("_exact"), F.col("seq").alias("_i1"))
    loose = index.withColumn("_loose", keys.loose_key(c, s)).where("_loose IS NOT NULL").groupBy("_loose").agg(F.max_by("seq", F.struct("has_target", "seq")).alias("_i2"))
    d = listings.withColumn("_exact", keys.exact_key(c, s)).withColumn("_loose", keys.loose_key(c, s))
    return d.join(exact, "_exact", "left").join(loose, "_loose", "left").withColumn("county_id", F.coalesce("_i1", "_i2")).drop("_exact", "_loose", "_i1", "_i2")


def through_links(records: DataFrame, counties: DataFrame, key: str = "id", links: str = "county_link") -> DataFrame:
    """records with county and state: of the linked rows the first that exists; without any the text columns county_text, state_text."""
    hits = records.select(key, F.posexplode(links).alias("pos", "seq")).join(counties.select("seq", "county", "state"), "seq")
    first = hits.groupBy(key).agg(F.min_by(F.struct("county", "state"), "pos").alias("_c"))
    d = records.join(first, key, "left")
    state = F.when(F.col("_c").isNotNull(), F.col("_c.state")).otherwise(F.col("state_text"))
    return d.withColumn("county", F.coalesce("_c.county", "county_text")).withColumn("state", state).drop("_c")


def pick(candidates: DataFrame, key: str, full: Column, short: Column) -> DataFrame:
    """The one candidate of each key; of several the only one whose state's name occurs, else the only one whose letters do."""
    d = candidates.withColumn("_f", full.cast("int")).withColumn("_s", short.cast("int"))
    g = d.groupBy(key).agg(F.count("*").alias("n"), F.sum("_f").alias("nf"), F.sum("_s").alias("ns"), F.first(F.struct("county", "state")).alias("any"), F.max_by(F.struct("county", "state"), "_f").alias("byf"), F.max_by(F.struct("county", "state"), "_s").alias("bys"))
    return g.withColumn("c", F.when(F.col("n") == 1, F.col("any")).when(F.col("nf") == 1, F.col("byf")).when(F.col("ns") == 1, F.col("bys"))).where("c IS NOT NULL").select(key, "c.county", "c.state")


def county_in_text(pages: DataFrame, counties: DataFrame, key: str = "id", url: str = "url", text: str = "text") -> DataFrame:
    """(key, county, state): the county that URL or text names as "X county", the URL before the text.

    The candidates of a page are the ends of what stands before each " county", in the lengths that county names have,
    looked up by equality, so the work grows with the text and not with pages times counties.
    """
    slug = F.regexp_replace(F.lower(F.url_decode(F.regexp_replace(F.coalesce(F.col(url), F.lit("")), "%(?![0-9A-Fa-f]{2})", "%25"))), "[_-]+", " ")
    body = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+", " "), F.lit(" "))
    d = pages.select(F.col(key), slug.alias("_u"), body.alias("_b"), F.array_distinct(F.filter(F.split(slug, "[^a-z]+"), lambda x: x != "")).alias("_w"))
    names = counties.select("county", "state", F.lower("county").alias("_n")).distinct()
    sizes = [r.w for r in names.select(F.length("_n").alias("w")).distinct().orderBy("w").collect()]  # the lengths of county names

    def candidates(column: str) -> DataFrame:
        before = F.split(F.col(column), " county")
        ends = F.transform(F.slice(before, 1, F.size(before) - 1), lambda b: F.array(*[F.right(b, F.lit(n)) for n in sizes or [1]]))
        return d.withColumn("_n", F.explode(F.array_distinct(F.flatten(ends)))).join(names, "_n").dropDuplicates([key, "county", "state"])

    name = F.lower(keys.state_name(F.col("state")))
    by_url = pick(candidates("_u"), key, F.contains("_u", name), F.array_contains("_w", F.lower("state")))
    by_text = pick(candidates("_b"), key, F.contains("_b", name), F.contains("_b", F.concat("_n", F.lit(" county, "), F.lower("state"))))
    both = by_url.withColumn("_o", F.lit(0)).unionByName(by_text.withColumn("_o", F.lit(1)))
    return both.groupBy(key).agg(F.min_by(F.struct("county", "state"), "_o").alias("c")).select(key, "c.*")


def subject_county(subjects: DataFrame, counties: DataFrame) -> DataFrame:
    """subjects with table_county, table_state and note: the county row with the same saints-spelled key and state."""
    index = counties.select(F.upper("state").alias("_s"), keys.saint_key(F.col("county")).alias("_k"), "seq", "county", "state")
    index = index.groupBy("_s", "_k").agg(F.min_by(F.struct("county", "state"), "seq").alias("_c"))
    d = subjects.withColumn("_k", keys.saint_key(F.col("county"))).withColumn("_s", F.col("state")).join(index, ["_s", "_k"], "left")
    note = F.when(F.col("_c").isNull() & F.col("county").isNotNull() & F.col("state").isNotNull(), F.concat(F.lit("the page says "), "county", F.lit(" County, "), "state", F.lit(", which is not in the County table")))
    return d.withColumn("table_county", F.col("_c.county")).withColumn("table_state", F.col("_c.state")).withColumn("note", note).drop("_k", "_s", "_c")


def same_name(rows: DataFrame, counties: DataFrame, key: str = "id") -> DataFrame:
    """rows with the first county row of the same name; a missing state matches any."""
    index = counties.select("seq", F.lower("county").alias("_k"), F.col("county").alias("table_county"), F.col("state").alias("table_state"))
    d = rows.withColumn("_k", F.lower("county")).withColumn("_s", keys.state_letters(F.regexp_replace("state", "-", " ")))
    hits = d.join(index, "_k").where("_s IS NULL OR _s = upper(table_state)").groupBy(key).agg(F.min_by(F.struct("table_county", "table_state"), "seq").alias("_c"))
    return rows.join(hits, key, "left").withColumn("table_county", F.col("_c.table_county")).withColumn("table_state", F.col("_c.table_state")).drop("_c")


def near_county_name(searches: DataFrame, site_names: DataFrame) -> DataFrame:
    """(search, near): searches that returned nothing though the site has the county under a spelling of the same letters.

    searches: search; site_names: name. An exactly equal name (case aside) is no mismatch.
    """
    names = site_names.select(F.col("name"), keys.site_key(F.col("name")).alias("_k"))
    d = searches.withColumn("_k", keys.site_key(F.col("search"))).join(names, "_k")
    return d.groupBy("search").agg(F.bool_or(F.lower("name") == F.lower("search")).alias("_same"), F.min("name").alias("near")).where("NOT _same").select("search", "near")


def mentions_other_county(text: Column, county: Column) -> Column:
    """Whether a card's text names a county and none of the spellings of the searched one."""
    norm = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z\s]", " "), r"\s+", " ")), F.lit(" "))
    t = F.regexp_replace(F.regexp_replace(F.lower(county), r"^st\.?\s+", "saint "), r"^ste\.?\s+", "sainte ")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"[^a-z\s]", ""), r"\s+", " "))
    spelled = F.array_distinct(F.array(t, F.regexp_replace(t, "^saint ", "st "), F.regexp_replace(t, "^sainte ", "ste ")))
    joined = F.transform(spelled, lambda v: F.when(v.contains(" "), F.replace(v, F.lit(" "), F.lit(""))).otherwise(F.regexp_replace(v, "^(mc|mac|le|la|de|del|van|von|o)(?=[a-z]{2})", "$1 ")))
    variants = F.array_distinct(F.concat(spelled, joined))
    return norm.rlike(r"(?<![a-z])[a-z]+ county(?! road)(?![a-z])") & ~F.exists(variants, lambda v: F.contains(norm, F.concat(F.lit(" "), v, F.lit(" county "))))


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key in the order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def with_descriptions(cards: DataFrame, found: DataFrame, page: str = "page") -> DataFrame:
    """cards (page, url and others) with description: the first that their page's structured data gives for the same canonical url.

    found: page, pos, url, description. Empty urls and descriptions give none; a card without a match keeps null. A column
    description of cards is replaced.
    """
    given = found.where("url <> '' AND description <> ''").groupBy(page, keys.canonical_url(F.col("url")).alias("canonical")).agg(F.min_by("description", "pos").alias("description"))
    d = cards.drop("description").withColumn("canonical", keys.canonical_url(F.col("url")))
    return d.join(given.where("canonical <> ''"), [page, "canonical"], "left").drop("canonical")
