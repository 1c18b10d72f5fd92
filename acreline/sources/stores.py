"""Readers of the store, its logs and its queues. Each takes and gives DataFrames; paths are only opened by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import keys, numbers
from ..operators.dedup import union_first, with_keys

#: Columns that the operators expect of stored records.
RECORD_FIELDS = ["id", "name", "url", "price", "acres", "county_link", "stage", "fingerprint", "notes", "created"]


def county_rows(raw: DataFrame, names: list[str], states: list[str], targets: list[str], seq: str = "seq") -> DataFrame:
    """(seq, county, state, max_cpa): the first non-empty of the candidate columns; currency text becomes a number."""
    first = lambda cols: F.coalesce(*[numbers.text_or_null(F.trim(F.col(c).cast("string"))) for c in cols])
    return raw.select(F.col(seq).alias("seq"), first(names).alias("county"), keys.state_letters(first(states)).alias("state"), numbers.currency(first(targets)).alias("max_cpa"))


def counties_of_document(documents: DataFrame, column: str = "value") -> DataFrame:
    """(pos, county, state, max_cpa) of a JSON document {"counties": [...]}; rows without a part or a positive target are dropped."""
    kind = "struct<counties:array<struct<county:string,state:string,maxCPA:double>>>"
    d = documents.select(F.posexplode(F.from_json(column, kind)["counties"]).alias("pos", "c"))
    return d.select("pos", "c.county", "c.state", F.col("c.maxCPA").alias("max_cpa")).where("county <> '' AND state <> '' AND max_cpa > 0")


def counties_file(spark: SparkSession, path: str) -> DataFrame:
    return counties_of_document(spark.read.text(path, wholetext=True))


def dedup_index(records: DataFrame, seq: str = "id") -> DataFrame:
    """(seq, url, fingerprint, location_key, price) of all records, rejected ones too."""
    return with_keys(records.select(F.col(seq).alias("seq"), "url", "county", "state", "acres", "price")).select("seq", "url", "fingerprint", "location_key", "price")


def of_stage(records: DataFrame, stage: str) -> DataFrame:
    return records.where(F.col("stage") == stage)


def active(records: DataFrame, rejected: str = "Not Interested") -> DataFrame:
    """Records of any other stage, those without a stage too."""
    return records.where(~F.col("stage").eqNullSafe(F.lit(rejected)))


def by_id(records: DataFrame, value: object, key: str = "id") -> DataFrame:
    return records.where(F.col(key) == F.lit(value))


def intake_queue(intake: DataFrame) -> DataFrame:
    """Submitted rows that are new, to be tried again, or waiting for review because of an HTTP failure."""
    status = F.coalesce("status", F.lit(""))
    return intake.where(status.isin("", "New", "Retry") | ((status == "Needs Review") & F.coalesce(F.col("result").startswith("HTTP "), F.lit(False))))


def json_lines(lines: DataFrame, schema: str | StructType, column: str = "value") -> DataFrame:
    """lines with struct j; empty lines and those that are no JSON of the schema are dropped."""
    text = schema if isinstance(schema, str) else schema.simpleString()[7:-1]
    d = lines.where(F.trim(column) != "").withColumn("j", F.from_json(column, f"{text}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    return d.where("j._corrupt IS NULL").withColumn("j", F.col("j").dropFields("_corrupt"))


def failed_writes(spark: SparkSession, path: str, listing: str) -> DataFrame:
    """(file, saved_at, listing...) of JSON-lines files in order of their names; broken lines are left out."""
    lines = spark.read.text(path).withColumn("file", F.input_file_name())
    d = json_lines(lines, f"savedAt string, context string, listing struct<{listing}>").where("j.listing IS NOT NULL")
    return d.select("file", F.col("j.savedAt").alias("saved_at"), "j.listing.*")


def coverage_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """(date, counties) of a coverage log; a line counts if it has a date and a list."""
    d = json_lines(lines, "date string, counties array<string>", column).where("j.date IS NOT NULL AND j.counties IS NOT NULL")
    return d.select(F.col("j.date").try_cast("date").alias("date"), F.col("j.counties").alias("counties")).where("date IS NOT NULL")


def state_rows(documents: DataFrame, column: str = "value") -> DataFrame:
    """(id, checked) of a JSON object of ids and times; what is no object gives nothing."""
    return documents.select(F.explode(F.from_json(column, "map<string,timestamp>")).alias("id", "checked"))


def candidates(records: DataFrame, stages: list[str]) -> DataFrame:
    """Records of the stages, each id once, in favour of the earlier stage."""
    return union_first(*[of_stage(records, s) for s in stages])


def in_list(records: DataFrame, ids: list) -> DataFrame:
    """The records of a list of ids, in its order."""
    kind = records.schema["id"].dataType.simpleString()
    first = [(v, i) for i, v in enumerate(dict.fromkeys(ids)) if v is not None]
    wanted = records.sparkSession.createDataFrame(first, f"id {kind}, _place long")
    return records.join(F.broadcast(wanted), "id").orderBy("_place").select(*records.columns)


def with_saved_page(records: DataFrame, saved: DataFrame, fetched: DataFrame) -> DataFrame:
    """records with html, http_status and fetch_error of a replay (saved: id, html; fetched: id, http_status, fetch_error)."""
    d = records.join(saved, "id", "left").join(fetched, "id", "left")
    return d.withColumn("fetch_error", F.when(F.col("html").isNull(), F.coalesce("fetch_error", F.lit("no saved page in replay dir"))).otherwise(F.col("fetch_error")))


def saved_pages(spark: SparkSession, path: str) -> DataFrame:
    """(id, html) of whole files named id.html."""
    d = spark.read.text(path, wholetext=True).withColumn("id", F.regexp_extract(F.input_file_name(), r"([^/]+)\.html$", 1))
    return d.select("id", F.col("value").alias("html"))


def fetch_policy(log: DataFrame, most: int = 3) -> DataFrame:
    """log (url, attempt, http_status) with retry: whether the attempt is followed by another."""
    status = F.col("http_status")
    again = status.isNull() | (status == 429) | (status >= 500)
    return log.withColumn("retry", again & (F.col("attempt") < most))


def with_flood_zone(records: DataFrame, zones: DataFrame) -> DataFrame:
    """records with the zone of their coordinates (zones: lat, lng, zone); unknown is null, never safe."""
    d = records.withColumn("_p", numbers.coordinates(F.col("coordinates"))).withColumn("lat", F.col("_p.lat")).withColumn("lng", F.col("_p.lng")).drop("_p")
    return d.join(zones, ["lat", "lng"], "left")


def missing_fields(records: DataFrame, expected: list[str] = RECORD_FIELDS) -> list[str]:
    have = set(records.columns)
    return [f for f in expected if f not in have]


def of_text(c: Column) -> Column:
    return numbers.text_or_null(F.trim(c))
