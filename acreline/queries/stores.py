"""Sources, search plans and sinks on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys
from ..operators import dedup, lookup, pricecheck, report, spatial
from ..plans import search
from ..sources import datasource, sinks, stores
from .tables import counties, events, fetch_log, nations, new_folder, query, records, table

RAW = "SELECT seq, county, state, max_cpa FROM county UNION ALL SELECT seq + 100, county, state, NULL FROM county WHERE seq % 2 = 0 UNION ALL SELECT seq + 200, county, state, max_cpa + 1 FROM county WHERE seq % 3 = 0"


def raw_counties(spark, sf):
    """County rows as a hand-kept table has them: several name columns, currency text, keys that occur again."""
    c = counties(spark, sf)
    c = c.unionByName(c.where("seq % 2 = 0").withColumn("seq", F.col("seq") + 100).withColumn("max_cpa", F.lit(None).cast("double"))).unionByName(c.where("seq % 3 = 0").withColumn("seq", F.col("seq") + 200).withColumn("max_cpa", F.col("max_cpa") + 1))
    return c.select("seq", F.lit("").alias("Name"), F.col("county").alias("County"), F.lit(None).cast("string").alias("State"), F.col("state").alias("State (full)"), F.concat(F.lit("$"), F.format_number("max_cpa", 2)).alias("CPA Target"))


def read_counties(spark, sf):
    return stores.county_rows(raw_counties(spark, sf), ["Name", "County"], ["State", "State (full)"], ["CPA Target"])


@query(f", raw AS ({RAW}) SELECT lower(county) || '|' || upper(state) AS key, arg_max(seq, (CASE WHEN max_cpa > 0 THEN 100000 ELSE 0 END) + seq) AS seq, max(max_cpa) FILTER (max_cpa > 0 AND seq = (SELECT max(seq) FROM raw r WHERE r.county = raw.county AND r.max_cpa > 0)) AS max_cpa FROM raw GROUP BY 1")
def src01_county_dimension(spark, sf):
    return lookup.county_index(read_counties(spark, sf)).select("key", "seq", "max_cpa")


@query(f", raw AS ({RAW}) SELECT lower(county) || '|' || upper(state) AS key, arg_max(max_cpa, seq) AS max_cpa FROM raw WHERE max_cpa > 0 GROUP BY 1")
def src02_county_targets(spark, sf):
    return lookup.latest_targets(read_counties(spark, sf), keys.exact_key(F.col("county"), F.col("state")))


@query("SELECT county, state, max_cpa FROM county WHERE max_cpa > 0")
def src03_county_document(spark, sf):
    doc = counties(spark, sf).agg(F.to_json(F.struct(F.collect_list(F.struct("county", "state", F.col("max_cpa").alias("maxCPA"))).alias("counties"))).alias("value"))  # a dimension of fixed size
    return stores.counties_of_document(doc).select("county", "state", "max_cpa")


LOC = "greatest(5, floor(acres / 5 + 0.5) * 5)"
PRB = "greatest(5000, floor(price / 5000 + 0.5) * 5000)"


def county_records(spark, sf):
    return records(spark, sf).join(counties(spark, sf).withColumnRenamed("seq", "nk"), "nk")


@query(f"SELECT id AS seq, url, CASE WHEN price > 0 THEN substr(sha256(lower(chr(65 + nk)) || '|' || c.state || '|' || cast({LOC} AS bigint) || '|' || cast({PRB} AS bigint)), 1, 16) END AS fingerprint, lower(chr(65 + nk)) || '|' || c.state || '|' || cast({LOC} AS bigint) AS location_key, price FROM record JOIN county c ON nk = seq")
def src04_dedup_index(spark, sf):
    return stores.dedup_index(county_records(spark, sf))


@query("SELECT id, stage FROM record WHERE stage = 'New Lead'")
def src05_stage(spark, sf):
    return stores.of_stage(records(spark, sf), "New Lead").select("id", "stage")


@query("SELECT id, stage FROM record WHERE stage IS NULL OR stage <> 'Not Interested'")
def src06_active(spark, sf):
    return stores.active(records(spark, sf)).select("id", "stage")


@query("SELECT id, stage, price FROM record WHERE id = 7")
def src07_record_by_id(spark, sf):
    return stores.by_id(records(spark, sf), 7).select("id", "stage", "price")


@query("SELECT event_id AS id, st AS status, res AS result FROM (SELECT event_id, (['New', 'Retry', 'Needs Review', 'Done', NULL, ''])[event_id % 6 + 1] AS st, (['HTTP 403', 'gone', NULL])[event_id % 3 + 1 - event_id % 2 * (event_id % 3)] AS res FROM events) WHERE coalesce(st, '') IN ('', 'New', 'Retry') OR (st = 'Needs Review' AND res LIKE 'HTTP %')")
def src08_intake_queue(spark, sf):
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), i.cast("int"))
    e = F.col("event_id")
    rows = events(spark, sf).select(e.alias("id"), pick(["New", "Retry", "Needs Review", "Done", None, ""], e % 6 + 1).alias("status"), pick(["HTTP 403", "gone", None], e % 3 + 1 - e % 2 * (e % 3)).alias("result"))
    return stores.intake_queue(rows)


@query("SELECT county, state FROM county")
def src09_counties(spark, sf):
    return counties(spark, sf).select("county", "state")


def queue_lines(spark, sf):
    """A queue of failed writes as JSON lines; every seventh line is cut off, every eleventh empty."""
    d = records(spark, sf).withColumn("value", F.to_json(F.struct(F.lit("2024-01-01").alias("savedAt"), F.struct("url", "price", "acres").alias("listing"))))
    return d.select("id", F.when(F.col("id") % 11 == 0, "").when(F.col("id") % 7 == 0, F.substring("value", 1, 25)).otherwise(F.col("value")).alias("value"))


@query("SELECT url, price, acres FROM record WHERE id % 7 <> 0 AND id % 11 <> 0")
def src10_failed_writes(spark, sf):
    return stores.json_lines(queue_lines(spark, sf), "savedAt string, listing struct<url:string,price:double,acres:double>").select("j.listing.*")


def coverage_lines(spark, sf):
    e = events(spark, sf).where("event_type = 'signup'")
    good = F.to_json(F.struct(F.to_date("ts").cast("string").alias("date"), F.array(F.concat(F.lit("u"), F.col("user_id"))).alias("counties")))
    return e.select(F.when(F.col("event_id") % 5 == 0, '{"date": 5').when(F.col("event_id") % 7 == 0, '{"date": "2024-01-01"}').otherwise(good).alias("value"))


@query("SELECT cast(ts AS date) AS date, 'u' || user_id AS county, count(*) AS n FROM events WHERE event_type = 'signup' AND event_id % 5 <> 0 AND event_id % 7 <> 0 GROUP BY 1, 2")
def src11_coverage_log(spark, sf):
    return stores.coverage_log(coverage_lines(spark, sf)).select("date", F.explode("counties").alias("county")).groupBy("date", "county").agg(F.count("*").alias("n"))


@query("SELECT cast(id AS varchar) AS id, created AS checked FROM record WHERE id % 10 <> 0")
def src12_recheck_state(spark, sf):
    d = records(spark, sf).select(F.when(F.col("id") % 10 == 0, "[]").otherwise(F.to_json(F.create_map(F.col("id").cast("string"), F.col("created").cast("string")))).alias("value"))
    return stores.state_rows(d).withColumn("checked", F.col("checked").cast("timestamp_ntz"))


@query("SELECT id, stage FROM record WHERE stage IN ('New Lead', 'Watch For Price Drop')")
def src13_candidates(spark, sf):
    return stores.candidates(records(spark, sf), ["New Lead", "Watch For Price Drop"]).select("id", "stage")


@query("SELECT id, stage FROM record WHERE id IN (32, 7, 1, 3)")
def src14_listed_records(spark, sf):
    return stores.in_list(records(spark, sf), [32, 7, 1, 3]).select("id", "stage")


@query("SELECT id, length(html) AS n, CASE WHEN html IS NULL THEN 'no saved page in replay dir' END AS fetch_error FROM record LEFT JOIN pages ON page_id = id")
def src15_replay(spark, sf):
    saved = table(spark, sf, "pages").select(F.col("page_id").alias("id"), "html")
    none = records(spark, sf).select("id", F.lit(None).cast("int").alias("http_status"), F.lit(None).cast("string").alias("fetch_error"))
    return stores.with_saved_page(records(spark, sf), saved, none).select("id", F.length("html").cast("bigint").alias("n"), "fetch_error")


@query("SELECT * FROM (VALUES ('landwatch', 3), ('livingthedream', NULL), ('whitetail', 3), ('mossyoak', NULL), ('midwestlandgroup', NULL), ('landflip', NULL), ('nationalland', NULL), ('tuttland', NULL)) t(name, rotation)")
def src16_site_catalog(spark, sf):
    return search.catalog(spark).where("enabled").select("name", "rotation")


@query("SELECT event_id, cast(400 + value AS integer) AS http_status, value < 1 OR cast(400 + value AS integer) = 429 OR cast(400 + value AS integer) >= 500 AS retry FROM events WHERE event_type = 'error'")
def src17_fetch_retry(spark, sf):
    d = events(spark, sf).where("event_type = 'error'").select("event_id", F.lit(1).alias("attempt"), "value", F.bround(400 + F.col("value"), 0).cast("int").alias("s"))
    d = d.withColumn("http_status", F.when(F.col("value") < 1, None).otherwise(F.col("s")))
    return stores.fetch_policy(d).select("event_id", F.col("s").alias("http_status"), "retry")


@query("SELECT event_id, s IN (400, 403, 429, 503) AS refused FROM (SELECT event_id, ([200, 400, 403, 404, 429, 500, 503])[event_id % 7 + 1] AS s FROM events)")
def src18_refusal_status(spark, sf):
    s = F.element_at(F.array(*map(F.lit, (200, 400, 403, 404, 429, 500, 503))), (F.col("event_id") % 7 + 1).cast("int"))
    return events(spark, sf).select("event_id", report.refusal_status(s).alias("refused"))


@query("SELECT id, CASE WHEN id % 4 = 0 THEN NULL WHEN nk % 3 = 0 THEN 'AE' ELSE 'X' END AS zone FROM record")
def src19_flood_zone(spark, sf):
    zones = counties(spark, sf).select((30.5 + F.col("seq")).cast("double").alias("lat"), F.lit(-90.25).alias("lng"), F.when(F.col("seq") % 3 == 0, "AE").otherwise("X").alias("zone")).where("lat <= 50")
    zones = zones.unionByName(counties(spark, sf).where("seq > 19").select((30.5 + F.col("seq") - 20).alias("lat"), F.lit(-91.25).alias("lng"), F.when(F.col("seq") % 3 == 0, "AE").otherwise("X").alias("zone")))
    spot = F.when(F.col("nk") > 19, F.concat(30.5 + F.col("nk") - 20, F.lit(", -91.25"))).otherwise(F.concat(30.5 + F.col("nk"), F.lit(", -90.25")))
    return stores.with_flood_zone(records(spark, sf).withColumn("coordinates", F.when(F.col("id") % 4 == 0, "somewhere").otherwise(spot)), zones).select("id", "zone")


#: Zones around suppliers: a square with a notch in its northern side and a square hole, east of them a square without.
ZONE_SHAPES = """z AS (SELECT s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN 'ae' WHEN 1 THEN 'X' WHEN 2 THEN 'Ve' END AS zone, 25.0::DOUBLE + s_suppkey % 24 AS cy, -120.0::DOUBLE + s_nationkey * 2 AS cx FROM supplier),
e AS (SELECT k, zone, unnest([[cx - 1, cy - 1, cx + 1, cy - 1], [cx + 1, cy - 1, cx + 1, cy + 1], [cx + 1, cy + 1, cx, cy + 0.25], [cx, cy + 0.25, cx - 1, cy + 1], [cx - 1, cy + 1, cx - 1, cy - 1],
  [cx - 0.5, cy - 0.5, cx, cy - 0.5], [cx, cy - 0.5, cx, cy], [cx, cy, cx - 0.5, cy], [cx - 0.5, cy, cx - 0.5, cy - 0.5],
  [cx + 1.5, cy, cx + 2, cy], [cx + 2, cy, cx + 2, cy + 0.5], [cx + 2, cy + 0.5, cx + 1.5, cy + 0.5], [cx + 1.5, cy + 0.5, cx + 1.5, cy]]) AS e FROM z WHERE zone IS NOT NULL),
p AS (SELECT *, o_orderkey % 7 = 0 OR y > 50 AS unread FROM (SELECT o_orderkey, o_orderkey AS id, cast(printf('%.3f', 24.0::DOUBLE + (o_custkey % 1051) / 40.0::DOUBLE) AS double) AS y, cast(printf('%.3f', -123.0::DOUBLE + (o_orderkey % 2203) / 40.0::DOUBLE) AS double) AS x FROM orders)),
h AS (SELECT id, k, zone, bool_or((e[3] - e[1]) * (y - e[2]) - (e[4] - e[2]) * (x - e[1]) = 0 AND x BETWEEN least(e[1], e[3]) AND greatest(e[1], e[3]) AND y BETWEEN least(e[2], e[4]) AND greatest(e[2], e[4])) AS side,
  count(*) FILTER ((e[2] > y) <> (e[4] > y) AND x < (e[3] - e[1]) * (y - e[2]) / (e[4] - e[2]) + e[1]) AS n
  FROM p JOIN e ON e[2] < y + 3 AND e[2] > y - 3 WHERE NOT unread GROUP BY id, k, zone)"""


@query(f""", {ZONE_SHAPES} SELECT p.id, CASE WHEN unread THEN NULL ELSE coalesce(upper(b.zone), 'NONE') END AS zone
FROM p LEFT JOIN (SELECT id, arg_min(zone, (zone = 'X', k)) AS zone FROM h WHERE side OR n % 2 = 1 GROUP BY id) AS b ON p.id = b.id""")
def src19_flood_polygons(spark, sf):
    """Spots of all orders in zones with notches, holes and islands, many of them on borders."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("zone_id"), F.expr("CASE s_suppkey % 4 WHEN 0 THEN 'ae' WHEN 1 THEN 'X' WHEN 2 THEN 'Ve' END").alias("zone"), (25.0 + F.col("s_suppkey") % 24).alias("cy"), (-120.0 + F.col("s_nationkey") * 2).alias("cx"))
    ring = lambda *at: F.array(*[F.struct((F.col("cx") + a).alias("x"), (F.col("cy") + b).alias("y")) for a, b in at])
    rings = F.array(ring((-1, -1), (1, -1), (1, 1), (0, 0.25), (-1, 1)), ring((-0.5, -0.5), (0, -0.5), (0, 0), (-0.5, 0)), ring((1.5, 0), (2, 0), (2, 0.5), (1.5, 0.5)))
    o = table(spark, sf, "orders")
    lat, lng = 24.0 + (F.col("o_custkey") % 1051) / 40.0, -123.0 + (F.col("o_orderkey") % 2203) / 40.0
    spots = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 7 == 0, "by the river").otherwise(F.concat(F.format_string("%.3f", lat), F.lit(", "), F.format_string("%.3f", lng))).alias("coordinates"))
    return spatial.in_flood_zones(spots, s.withColumn("rings", rings), cell=0.25).select("id", "zone")


@query("SELECT * FROM (VALUES ('name'), ('county_link'), ('fingerprint'), ('notes')) t(field)")
def src20_missing_fields(spark, sf):
    return spark.createDataFrame([(f,) for f in stores.missing_fields(records(spark, sf))], "field string")


# ---- search plans

CTY = "(SELECT *, (['Wayne', 'Taylor', 'Logan', 'Lewis', 'Dewey'])[n_nationkey % 5 + 1] AS c, (['KY', 'MO', 'AL', 'TN', 'OK'])[n_nationkey // 5 + 1] AS s, (['kentucky', 'missouri', 'alabama', 'tennessee', 'oklahoma'])[n_nationkey // 5 + 1] AS sl FROM nation)"


def us_counties(spark, sf):
    at = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i + 1).cast("int"))
    k = F.col("n_nationkey")
    return nations(spark, sf).select(at(["Wayne", "Taylor", "Logan", "Lewis", "Dewey"], k % 5).alias("county"), at(["KY", "MO", "AL", "TN", "OK"], F.floor(k / 5)).alias("state"))


def urls(name):
    return lambda spark, sf: search.search_urls(search.SITES[name], us_counties(spark, sf)).select("url", "county", "state", "page")


def plan_query(name: str, sql: str):
    f = urls(name.split("_", 1)[1])
    f.__name__ = name
    query(sql)(f)


BY_COUNTY = f"SELECT {{url}} AS url, c AS county, s AS state, p AS page FROM {CTY}, (SELECT unnest(range(1, {{n}})) AS p)"
PASSES = f"SELECT {{url}} AS url, c AS county, s AS state, p AS page FROM {CTY}, (SELECT 40 AS m, unnest(range(1, {{a}})) AS p UNION ALL SELECT 150, unnest(range(1, {{b}})))"
BY_STATE = f"SELECT {{url}} AS url, NULL::VARCHAR AS county, s AS state, p AS page FROM (SELECT DISTINCT s, sl FROM {CTY}), (SELECT unnest(range(1, {{n}})) AS p) {{where}}"
plan_query("gen01_landwatch", BY_COUNTY.format(n=11, url="'https://www.landwatch.com/' || sl || '-land-for-sale/' || lower(c) || '-county/acres-over-40' || CASE WHEN p > 1 THEN '/page-' || p ELSE '' END"))
plan_query("gen02_landcom", PASSES.format(a=6, b=4, url="'https://www.land.com/' || upper(sl[1]) || sl[2:] || '/' || lower(c) || '-county/land-over-' || m || '-acres/all-land/date-posted/page-' || p"))
plan_query("gen03_landfarm", PASSES.format(a=4, b=3, url="'https://www.landandfarm.com/search/' || sl || '/' || lower(c) || '-county/land-for-sale?minAcres=' || m || '&sort=newest&page=' || p"))
plan_query("gen04_landsofamerica", PASSES.format(a=3, b=3, url="'https://www.landsofamerica.com/property/' || sl || '/' || lower(c) || '-county/land-for-sale?minAcres=' || m || '&sort=newest&page=' || p"))
plan_query("gen05_livingthedream", BY_STATE.format(n=3, where="WHERE s IN ('MO', 'KY')", url="'https://www.livingthedreamland.com/land-for-sale/' || sl || '/' || CASE WHEN p > 1 THEN '?pg=' || p ELSE '' END"))
plan_query("gen06_whitetail", BY_COUNTY.format(n=2, url="'https://www.whitetailproperties.com/hunting-land?state%5B%5D=' || upper(sl[1]) || sl[2:] || '&county%5B' || upper(sl[1]) || sl[2:] || '%5D%5B%5D=' || c || '&acreage_min=40'"))
plan_query("gen07_mossyoak", BY_COUNTY.format(n=3, url="'https://www.mossyoakproperties.com/land-for-sale/' || sl || '/' || lower(c) || '-county/' || CASE WHEN p > 1 THEN '?pg=' || p ELSE '' END"))
plan_query("gen08_midwestlandgroup", "SELECT 'https://midwestlandgroup.com/listings/' AS url, NULL::VARCHAR AS county, NULL::VARCHAR AS state, 1 AS page")
plan_query("gen09_landflip", BY_STATE.format(n=3, where="", url="'https://www.landflip.com/land-for-sale/' || sl || CASE WHEN p > 1 THEN '/' || p || '-p' ELSE '' END"))
plan_query("gen10_nationalland", BY_STATE.format(n=3, where="", url="'https://nationalland.com/land-for-sale/' || sl || CASE WHEN p > 1 THEN '?page=' || p ELSE '' END"))
plan_query("gen11_tuttland", BY_STATE.format(n=2, where="WHERE s IN ('AL', 'GA', 'MS', 'TN', 'FL')", url="'https://www.tuttland.com/land-sale/' || sl || '/'"))


@query(f"SELECT c || '|' || s || '|https://www.mossyoakproperties.com/land-for-sale/' || sl || '/' || lower(c) || '-county/' AS series, 2 AS pages FROM {CTY} UNION ALL SELECT c || '|' || s || '|https://www.landwatch.com/' || sl || '-land-for-sale/' || lower(c) || '-county/acres-over-40', 10 FROM {CTY}")
def gen12_series(spark, sf):
    d = urls("mossyoak")(spark, sf).unionByName(urls("landwatch")(spark, sf))
    return d.groupBy(keys.series_key(F.col("url"), F.col("county"), F.col("state")).alias("series")).agg(F.count("*").cast("int").alias("pages"))


FNV = "list_reduce([2166136261::BIGINT] || list_transform(range(1, length({x}) + 1), lambda i: ascii(substr({x}, i, 1))::BIGINT), lambda h, b: (xor(h, b)::HUGEINT * 16777619 % 4294967296)::BIGINT)"


@query(f"SELECT county, state, day FROM (SELECT county, state, {FNV.format(x="(county || '|' || state)")} % 3 AS g, unnest([0, 1, 2]) AS day FROM county) WHERE g = (date '2024-03-01' + day - date '1970-01-01') % 3")
def gen13_rotation(spark, sf):
    out = None
    for i in range(3):
        d = search.rotation(counties(spark, sf), 3, F.lit(f"2024-03-0{i + 1}").cast("date")).select("county", "state", F.lit(i).alias("day"))
        out = d if out is None else out.unionByName(d)
    return out


@query(f", turn AS (SELECT *, {FNV.format(x="(c || '|' || s)")} % 3 = (date '2024-03-01' - date '1970-01-01') % 3 AS mine FROM {CTY}) SELECT 'landwatch' AS site, 10 * count(*) AS n FROM turn WHERE mine UNION ALL SELECT 'whitetail', count(*) FROM turn WHERE mine UNION ALL SELECT 'mossyoak', 2 * count(*) FROM turn UNION ALL SELECT 'midwestlandgroup', 1 UNION ALL SELECT 'landflip', 2 * count(DISTINCT s) FROM turn UNION ALL SELECT 'nationalland', 2 * count(DISTINCT s) FROM turn UNION ALL SELECT 'livingthedream', 4 UNION ALL SELECT 'tuttland', 2")
def gen14_plan(spark, sf):
    return search.plan(us_counties(spark, sf), F.lit("2024-03-01").cast("date")).groupBy("site").agg(F.count("*").alias("n"))


@query("SELECT county, state, max_cpa FROM county WHERE seq IN (3, 1)")
def gen15_requested(spark, sf):
    named = counties(spark, sf).where("seq IN (1, 3)").agg(F.array_join(F.array_sort(F.collect_list(F.concat("county", F.lit("|"), "state"))), ",").alias("option"))  # two rows
    return search.requested(counties(spark, sf), search.requested_of(named)).select("county", "state", "max_cpa")


@query("SELECT min(url) AS url FROM record WHERE id % 3 <> 0 GROUP BY url")
def gen16_pending(spark, sf):
    r = records(spark, sf)
    have = r.where("id % 3 = 0").select(keys.evidence_name(F.col("url")).alias("file"))
    return search.pending(r.select("url", F.col("id").alias("pos")), have).select("url")


# ---- sinks


@query("SELECT url, CASE WHEN id % 4 = 0 THEN 1000000.0 ELSE price END AS price FROM record UNION ALL SELECT url || '/new', 1000000.0 FROM record WHERE id % 8 = 0")
def snk01_upsert(spark, sf):
    r = records(spark, sf)
    rows = r.where("id % 4 = 0").withColumn("price", F.lit(1000000.0)).withColumn("acres", F.lit(100.0))
    rows = rows.unionByName(rows.where("id % 8 = 0").withColumn("url", F.concat("url", F.lit("/new"))))
    wrong = rows.where("id % 8 = 4").withColumn("url", F.concat("url", F.lit("/bad"))).withColumn("acres", F.lit(0.5))
    good, _ = sinks.guarded(rows.unionByName(wrong))
    return sinks.upsert(r, good).select("url", "price")


@query("SELECT id FROM record WHERE id % 3 = 0")
def snk02_insert(spark, sf):
    r = records(spark, sf)
    return sinks.insert_new(r.where("id % 3 <> 0"), r).select("id")


@query("SELECT id, CASE WHEN id % 2 = 0 AND (stage IS NULL OR stage <> 'Not Interested') THEN 'Price Drop' ELSE stage END AS stage, CASE WHEN id % 2 = 0 AND (stage IS NULL OR stage <> 'Not Interested') THEN 5.0 ELSE price END AS price FROM record")
def snk03_protected_update(spark, sf):
    r = records(spark, sf)
    changes = r.where("id % 2 = 0").select("id", F.lit("Price Drop").alias("stage"), F.lit(5.0).alias("price"))
    return sinks.updated(r, changes, ["stage", "price"]).select("id", "stage", "price")


@query("SELECT id, CASE WHEN id % 2 = 0 THEN 'Done' ELSE stage END AS stage FROM record")
def snk04_update(spark, sf):
    r = records(spark, sf)
    return sinks.updated(r, r.where("id % 2 = 0").select("id", F.lit("Done").alias("stage")), ["stage"], protect=False).select("id", "stage")


@query("SELECT id, 4 + CASE WHEN stage IS NULL THEN 0 ELSE 1 END AS n_fields, CASE WHEN id % 2 = 0 THEN 'Has Warnings' ELSE 'Clean' END AS validation_status FROM record")
def snk05_store_fields(spark, sf):
    d = records(spark, sf).withColumn("name", F.col("id").cast("string")).withColumn("fingerprint", F.lit(None).cast("string")).withColumn("validation_errors", F.when(F.col("id") % 2 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")))
    return sinks.store_fields(d).select("id", F.size("fields").alias("n_fields"), "validation_status")


@query("SELECT count(*) AS written FROM record WHERE id % 2 = 0")
def snk06_idempotent_insert(spark, sf):
    r = records(spark, sf)
    once = r.unionByName(sinks.insert_new(r, r.where("id % 2 = 0").withColumn("url", F.concat("url", F.lit("#2")))))
    twice = sinks.insert_new(once, r.where("id % 2 = 0").withColumn("url", F.concat("url", F.lit("#2"))))
    return once.join(r.select("url"), "url", "left_anti").unionByName(twice).agg(F.count("*").alias("written"))


@query("SELECT url, 1 AS n FROM record WHERE id % 2 = 0 UNION ALL SELECT url || '/late', 1 FROM record WHERE id % 4 = 0")
def snk08_replay_archive(spark, sf):
    """Failed rows are replayed in two runs, the second with a new file; no row comes twice, and read files are archived."""
    path, r = new_folder(spark, "replay"), records(spark, sf).select("id", "url").where("id % 2 = 0")

    def write(rows, batch):
        rows.write.mode("overwrite").parquet(f"{path}/out/batch={batch}")

    for own in (r.repartition(3, "id"), r.where("id % 4 = 0").withColumn("url", F.concat("url", F.lit("/late")))):
        own.write.mode("append").json(f"{path}/failed")
        sinks.replay_failed(spark, f"{path}/failed", f"{path}/done", "id long, url string", write, f"{path}/state")
    return spark.read.schema("id long, url string").parquet(f"{path}/out").groupBy("url").agg(F.count("*").alias("n"))


@query("SELECT '2024-01-01' AS date, CASE WHEN id % 2 = 0 THEN 'even' ELSE 'odd' END AS tag, count(*) AS n, min(url) AS url FROM record GROUP BY 2")
def snk07_failed_rows(spark, sf):
    path, r = new_folder(spark, "failed"), records(spark, sf).select("id", "url")
    sinks.append_failed(r.where("id % 2 = 0"), path, "2024-01-01", "even")
    sinks.append_failed(r.where("id % 2 = 1"), path, "2024-01-01", "odd")
    return spark.read.schema("id long, url string, date string, tag string").json(path).groupBy("date", "tag").agg(F.count("*").alias("n"), F.min("url").alias("url"))


@query("SELECT coalesce(stage, 'none') AS stage, count(*) AS n_json, count(*) AS n_csv, count(*) AS n_summary FROM record GROUP BY 1")
def snk13_audit_outputs(spark, sf):
    """The three outputs of an audit, each read back and counted by stage."""
    path = new_folder(spark, "audit")
    rows = records(spark, sf).select("id", F.coalesce("stage", F.lit("none")).alias("stage"), F.array(F.lit("a"), F.lit("b, c")).alias("reasons"))
    sinks.write_report(rows, path, rows.groupBy("stage").agg(F.count("*").alias("n_summary")).orderBy(F.desc("n_summary"), "stage"))
    a = spark.read.schema("id long, stage string, reasons array<string>").json(f"{path}/json").where("size(reasons) = 2").groupBy("stage").agg(F.count("*").alias("n_json"))
    b = spark.read.option("header", True).schema("id long, stage string, reasons string").csv(f"{path}/csv").where("reasons = 'a; b, c'").groupBy("stage").agg(F.count("*").alias("n_csv"))
    c = spark.read.schema("stage string, n_summary long").json(f"{path}/summary")
    return a.join(b, "stage").join(c, "stage")


@query("SELECT site, event_id % 2 AS pass, count(*) AS n, count(*) FILTER (category <> 'ok') AS failed FROM fetchlog GROUP BY 1, 2")
def hlp31_passes(spark, sf):
    return report.per_pass(fetch_log(spark, sf).withColumn("pass", F.col("event_id") % 2))


@query("SELECT cast(ts AS date) AS date, 'u' || user_id AS county FROM events WHERE event_type = 'signup' AND cast(ts AS date) >= date '2024-01-10'")
def snk09_retention(spark, sf):
    log = events(spark, sf).where("event_type = 'signup'").select(F.to_date("ts").alias("date"), F.array(F.concat(F.lit("u"), "user_id")).alias("counties"))
    none = log.where("false")
    return sinks.retained(log, none, F.lit("2024-02-09").cast("date")).select("date", F.explode("counties").alias("county"))


@query("SELECT id, created AS checked FROM record WHERE id % 2 = 0")
def snk10_state_prune(spark, sf):
    r = records(spark, sf)
    return pricecheck.pruned_state(r.select("id", F.col("created").alias("checked")), r.where("id % 2 = 0"))


@query("SELECT page_id, length(substr(html, 1, 500000)) AS n FROM pages")
def snk11_evidence(spark, sf):
    return sinks.evidence(table(spark, sf, "pages")).select("page_id", F.length("html").cast("bigint").alias("n"))


@query("SELECT page_id, length(substr(html, 1, 500000)) AS n FROM pages")
def snk11_evidence_whole(spark, sf):
    """Snapshots with the bound of production."""
    return sinks.evidence(table(spark, sf, "pages")).select("page_id", F.length("html").cast("bigint").alias("n"))


@query("SELECT doc_id, '\"' || replace(text, '\"', '\"\"') || '\",' || lang || chr(10) AS line FROM documents WHERE regexp_matches(text, '[\",\n]') UNION ALL SELECT doc_id, coalesce(text, '') || ',' || lang || chr(10) FROM documents WHERE NOT coalesce(regexp_matches(text, '[\",\n]'), false)")
def snk12_csv(spark, sf):
    return sinks.csv_lines(table(spark, sf, "documents"), ["text", "lang"]).select("doc_id", "line")


@query("SELECT page_id, 'h' || '-' || 'p-' || page_id || '-' || substr(sha256('http://h/p/' || page_id), 1, 8) || '.html' AS file FROM pages")
def snk16_evidence_name(spark, sf):
    return table(spark, sf, "pages").select("page_id", keys.evidence_name(F.concat(F.lit("http://h/p/"), "page_id")).alias("file"))


@query("SELECT 'kept' AS outcome, count(DISTINCT url) AS n FROM record WHERE id % 2 = 1 UNION ALL SELECT 'index', count(*) FROM record WHERE id % 2 = 0")
def snk17_replay(spark, sf):
    r = records(spark, sf).withColumn("fingerprint", F.lit(None).cast("string"))
    index = r.where("id % 2 = 0").select("url", "fingerprint")
    queue = r.select(F.col("id").alias("seq"), "url", "fingerprint").unionByName(r.where("id % 2 = 1").select((F.col("id") + 10_000_000).alias("seq"), "url", "fingerprint"))
    return dedup.replay(queue, index).agg(F.count("*").alias("n")).select(F.lit("kept").alias("outcome"), "n").unionByName(index.agg(F.count("*").alias("n")).select(F.lit("index").alias("outcome"), "n"))


# ---- the store as a data source


STORED = "id long, stage string, price double, acres double, created timestamp, nk int, url string"


def stored(spark, sf):
    """The records in a store of several parts, read through the data source."""
    path = new_folder(spark, "store")
    records(spark, sf).withColumn("created", F.col("created").cast("timestamp")).repartition(4, "id").write.parquet(path)
    return datasource.load(spark, path, STORED), path


@query("SELECT id, stage FROM record WHERE stage = 'New Lead'")
def src05_stage_pushed(spark, sf):
    return stores.of_stage(stored(spark, sf)[0], "New Lead").select("id", "stage")


@query("SELECT id, stage FROM record WHERE stage IS NULL OR stage <> 'Not Interested'")
def src06_active_pushed(spark, sf):
    """Records without a stage are kept, by the store as by Spark."""
    return stores.active(stored(spark, sf)[0]).select("id", "stage")


@query("SELECT id, price FROM record WHERE id = (SELECT min(o_orderkey) + 7 FROM orders) OR id IN (3, 5, 8)")
def src07_by_id_pushed(spark, sf):
    first = table(spark, sf, "orders").agg(F.min("o_orderkey")).first()[0]
    return stored(spark, sf)[0].where(F.col("id").isin(first + 7, 3, 5, 8)).select("id", "price")


@query("SELECT stage, count(*) AS n FROM record WHERE price >= 100000 AND acres < 200 AND starts_with(stage, 'W') GROUP BY 1")
def src08_parts_pushed(spark, sf):
    """Several selections are one formula."""
    d = stored(spark, sf)[0].where((F.col("price") >= 100000) & (F.col("acres") < 200) & F.col("stage").startswith("W"))
    return d.groupBy("stage").agg(F.count("*").alias("n"))


@query("SELECT url, price FROM record UNION ALL SELECT url || '/new', 1.0 FROM record WHERE id % 8 = 0")
def snk01_store_writer(spark, sf):
    """Rows of known urls are found, new ones created, and a second run of the same rows creates nothing."""
    _, path = stored(spark, sf)
    r = records(spark, sf).withColumn("created", F.col("created").cast("timestamp")).where("id % 8 = 0")
    rows = r.unionByName(r.withColumn("url", F.concat("url", F.lit("/new"))).withColumn("price", F.lit(1.0)))
    for _ in range(2):
        datasource.append(rows, path, 4, batch=1000, failed=f"{path}-failed")
    return datasource.load(spark, path, STORED).select("url", "price")
