"""The generic test tables seen as the engine's entities, and the same views as DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with its oracle if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {VIEWS} {sql}"
        return f

    return add


VIEWS = """
listing AS (SELECT l.*, l_extendedprice AS price, l_quantity AS acres, 'County ' || chr(65 + n_nationkey) AS county, substr(r_name, 1, 2) AS state, n_nationkey AS nk,
    'https://x.example/pid/' || l_orderkey || '-' || l_linenumber AS url FROM lineitem l JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
county AS (SELECT n_nationkey AS seq, 'County ' || chr(65 + n_nationkey) AS county, substr(r_name, 1, 2) AS state, CASE WHEN n_nationkey % 5 <> 4 THEN 600.0 + 60 * n_nationkey END AS max_cpa FROM nation JOIN region ON n_regionkey = r_regionkey),
hardp AS (SELECT *, price < 1000 OR price > 100000000 OR abs(price - round(price, 2)) >= 1e-9 OR NOT acres > 0 OR acres > 25000 OR abs(acres - round(acres, 3)) >= 1e-9 OR price = acres AS bad FROM listing),
classed AS (SELECT h.*, max_cpa, CASE WHEN price <= 0 OR acres <= 0 OR price IS NULL OR acres IS NULL THEN 'invalid' WHEN bad THEN 'implausible' WHEN acres < 40 THEN 'below_min_acres' WHEN max_cpa IS NULL THEN 'not_target'
    WHEN price / acres < 150 OR price / acres > 50000 THEN 'implausible_cpa' WHEN price / acres <= max_cpa THEN 'at_below' WHEN (price / acres - max_cpa) / max_cpa <= 0.20 THEN 'within'
    WHEN (price / acres - max_cpa) / max_cpa <= 0.30 THEN 'watch' ELSE 'over' END AS verdict FROM hardp h JOIN county ON nk = seq),
record AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'New Lead' WHEN 'O' THEN 'Watch For Price Drop' WHEN 'P' THEN CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'Not Interested' END END AS stage,
    o_totalprice AS price, 40.0 + o_custkey % 200 AS acres, o_orderdate AS created, (o_custkey % 25)::INTEGER AS nk, 'https://www.site' || (o_custkey % 11) || '.example/p/' || o_orderkey AS url FROM orders),
watch AS (SELECT user_id, event_id, ts, value * 1000 AS cur, lag(value * 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS stored, 20.0 + user_id % 80 AS acres, 100.0 + 10 * (user_id % 40) AS target, min(ts) OVER (PARTITION BY user_id) AS created FROM events WHERE event_type = 'purchase'),
fetchlog AS (SELECT user_id % 11 AS site, event_id, ts, value, CASE WHEN event_type <> 'error' THEN 'ok' WHEN value >= 60 THEN 'not_found' WHEN value >= 25 THEN 'bot_wall' ELSE 'server_error' END AS category FROM events),
place AS (SELECT p_partkey AS k, (['Wayne', 'Taylor', 'Logan', 'Lewis', 'Dewey'])[p_partkey % 5 + 1] AS county, (['KY', 'MO', 'AL', 'TN', 'OK'])[p_partkey % 5 + 1] AS st,
    (['Kentucky', 'Missouri', 'Alabama', 'Tennessee', 'Oklahoma'])[p_partkey % 5 + 1] AS stname, 20000 + p_partkey * 37 AS price, 40 + p_size + p_partkey % 400 AS acres FROM part)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))


def letter(c: str):
    return F.concat(F.lit("County "), F.chr(F.col(c) + 65))


def counties(spark: SparkSession, sf: str) -> DataFrame:
    """seq, county, state, max_cpa; every fifth county has no target."""
    k = F.col("n_nationkey")
    return nations(spark, sf).select(k.alias("seq"), letter("n_nationkey").alias("county"), F.substring("r_name", 1, 2).alias("state"), F.when(k % 5 != 4, 600.0 + 60 * k).alias("max_cpa"))


def listings(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(nations(spark, sf), F.col("s_nationkey") == F.col("n_nationkey"))
    own = [c for c in d.columns if c.startswith("l_")]
    return d.select(*own, F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("acres"), letter("n_nationkey").alias("county"), F.substring("r_name", 1, 2).alias("state"), F.col("n_nationkey").alias("nk"), F.concat(F.lit("https://x.example/pid/"), "l_orderkey", F.lit("-"), "l_linenumber").alias("url"))


#: A total order of listings, which have no key.
ARRIVAL = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def records(spark: SparkSession, sf: str) -> DataFrame:
    """id, stage, price, acres, created, nk, url of stored records."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    stage = F.when(F.col("o_orderstatus") == "F", "New Lead").when(F.col("o_orderstatus") == "O", "Watch For Price Drop").when((F.col("o_orderstatus") == "P") & (k % 3 != 0), "Not Interested")
    return o.select(k.alias("id"), stage.alias("stage"), F.col("o_totalprice").alias("price"), (40.0 + F.col("o_custkey") % 200).alias("acres"), F.col("o_orderdate").alias("created"), (F.col("o_custkey") % 25).alias("nk"), F.concat(F.lit("https://www.site"), F.col("o_custkey") % 11, F.lit(".example/p/"), k).alias("url"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def watched(spark: SparkSession, sf: str) -> DataFrame:
    """Successive purchases of a user as price observations."""
    from ..operators.pricecheck import price_changes

    e = events(spark, sf).where("event_type = 'purchase'").withColumn("current", F.col("value") * 1000)
    d = price_changes(e, price="current")
    return d.select("user_id", "event_id", "ts", "current", "stored", (20.0 + F.col("user_id") % 80).alias("acres"), (100.0 + 10 * (F.col("user_id") % 40)).alias("target"), "created", F.lit("u").alias("url"), F.lit(200).alias("http_status"))


def fetch_log(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    category = F.when(F.col("event_type") != "error", "ok").when(v >= 60, "not_found").when(v >= 25, "bot_wall").otherwise("server_error")
    return events(spark, sf).select((F.col("user_id") % 11).alias("site"), "event_id", "ts", "value", category.alias("category"))


def new_folder(spark: SparkSession, name: str) -> str:
    """A path that nothing else uses, in the folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


COUNTIES = ["Wayne", "Taylor", "Logan", "Lewis", "Dewey"]
STATES = ["KY", "MO", "AL", "TN", "OK"]
NAMES = ["Kentucky", "Missouri", "Alabama", "Tennessee", "Oklahoma"]


def places(spark: SparkSession, sf: str) -> DataFrame:
    """k, county, st, stname, price and acres of made-up properties, one a part."""
    at = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("p_partkey") % 5 + 1).cast("int"))
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(k.alias("k"), at(COUNTIES).alias("county"), at(STATES).alias("st"), at(NAMES).alias("stname"), (20000 + k * 37).alias("price"), (40 + F.col("p_size") + k % 400).alias("acres"))


#: Rows of a task that makes and reads a page for each; a row takes about a millisecond there, whatever its bytes.
PAGES_A_TASK = 10_000


def dealt_out(d: DataFrame, by: str) -> DataFrame:
    """d in partitions for work that follows its rows: tables of a few bytes a row are a partition or two, whatever they cost."""
    n, cores = d.count(), d.sparkSession.sparkContext.defaultParallelism
    return d.repartition(max(1, -(-n // PAGES_A_TASK), min(cores, n // 1000)), by)


def page_places(spark: SparkSession, sf: str) -> DataFrame:
    """places, in partitions for the readers of their pages."""
    return dealt_out(places(spark, sf), "k")


def pages_of(d: DataFrame, *parts: str, out: str = "html") -> DataFrame:
    """d with a page put together from texts in which {column} stands for a value."""
    import re

    pieces = []
    for p in re.split(r"(\{\w+\})", "".join(parts)):
        if p:
            pieces.append(F.col(p[1:-1]).cast("string") if re.fullmatch(r"\{\w+\}", p) else F.lit(p))
    return d.withColumn(out, F.concat(*pieces))
