"""Writers: upserts into keyed tables, retention, evidence, CSV."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import csv_row
from ..operators.classify import write_guard

MANAGED = ["New Lead", "Watch For Price Drop", "Manual Check", "Price Drop"]


def guarded(listings: DataFrame, county_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Listings that may be written, and those refused with their reason."""
    d = listings.withColumn("refusal", write_guard(F.col("price"), F.col("acres"), F.col(county_id) if county_id else None))
    return d.where("refusal IS NULL").drop("refusal"), d.where("refusal IS NOT NULL")


def upsert(store: DataFrame, rows: DataFrame, key: str = "url") -> DataFrame:
    """The store after rows were written: rows replace those of equal key. Writing the same rows twice changes nothing."""
    return store.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def insert_new(store: DataFrame, rows: DataFrame, key: str = "url") -> DataFrame:
    """The rows whose key the store does not have: what a repeated insert may still write."""
    return rows.join(store.select(key), key, "left_anti")


def write_snapshot(table: DataFrame, path: str) -> str:
    """Writes a new version below path and names it; readers of the old version are not disturbed."""
    version = f"{path}/v-{uuid.uuid4().hex}"
    table.write.parquet(version)
    return version


def write_batch(store_path: str, key: str = "url"):
    """A function for foreachBatch: writes the guarded rows that are not there yet, refused ones to a side table.

    Each batch has a folder of its own, rows/batch=n and refused/batch=n, so one that runs again replaces what it wrote.
    """

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        good, bad = guarded(rows.dropDuplicates([key]))
        bad.write.mode("overwrite").parquet(f"{store_path}/refused/batch={batch}")
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{store_path}/rows")
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            written = spark.read.schema(good.select(key).schema.add("batch", "long")).parquet(f"{store_path}/rows")
            good = insert_new(written.where(F.col("batch") != batch), good, key)
        good.write.mode("overwrite").parquet(f"{store_path}/rows/batch={batch}")

    return write


def updated(store: DataFrame, changes: DataFrame, fields: list[str], key: str = "id", protect: bool = True) -> DataFrame:
    """store with changes' non-null fields; rows whose stage someone else set are left alone if protect."""
    d = changes.select(key, *[F.col(f).alias(f"_n_{f}") for f in fields])
    free = (F.col("stage").isNull() | F.col("stage").isin(*MANAGED)) if protect else F.lit(True)
    out = store.join(d, key, "left").withColumn("_free", free)
    return out.withColumns({f: F.when(F.col("_free"), F.coalesce(f"_n_{f}", f)).otherwise(F.col(f)) for f in fields}).drop("_free", *[f"_n_{f}" for f in fields]).select(*store.columns)


def store_fields(listings: DataFrame) -> DataFrame:
    """The columns of the store, with the map of those that are set."""
    names = {"Name": "name", "URL": "url", "LP": "price", "Acres": "acres", "Stage": "stage", "Fingerprint": "fingerprint"}
    pairs = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.col(v).cast("string"))])
    return listings.withColumn("fields", F.map_filter(pairs, lambda k, v: v.isNotNull())).withColumn("validation_status", F.when(F.size("validation_errors") > 0, "Has Warnings").otherwise("Clean"))


def append_failed(listings: DataFrame, path: str, day: str, tag: str) -> None:
    """Appends listings as JSON lines below date and tag."""
    listings.withColumn("date", F.lit(day)).withColumn("tag", F.lit(tag)).write.mode("append").partitionBy("date", "tag").json(path)


def replay_failed(spark, path: str, done: str, schema: str, write, state: str) -> None:
    """Gives write(rows, batch) the JSON-lines files below path that no run with this state has had, one a micro-batch; files then move below done.

    A file is replayed once though the job runs again: the stream's state below state knows it, and it leaves path when its
    micro-batch is over, that of the last one with the next run. Rows that fail again are for write to set aside in a new
    file. Lines that are no JSON of the schema come as rows of nulls. done must lie outside of path.
    """
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("cleanSource", "archive").option("sourceArchiveDir", done)
    files.json(path).writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def retained(log: DataFrame, new: DataFrame, day: Column, days: int = 30) -> DataFrame:
    """log (date, counties) without what is older than days, and new."""
    return log.where(F.col("date") >= F.date_sub(day, days)).unionByName(new)


def evidence(issues: DataFrame, most: int = 500_000) -> DataFrame:
    """issues with their page cut to its first characters; this bound on a stored snapshot is the feature."""
    return issues.withColumn("html", F.substring("html", 1, most))


def csv_lines(rows: DataFrame, columns: list[str], out: str = "line") -> DataFrame:
    """rows with a CSV line of the columns: quoted only where needed, nulls empty."""
    return rows.withColumn(out, csv_row(*[F.col(c) for c in columns]))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)


def write_report(rows: DataFrame, path: str, summary: DataFrame) -> None:
    """The three outputs of an audit: rows as JSON, rows as CSV (arrays joined), the summary as JSON."""
    rows.write.mode("overwrite").json(f"{path}/json")
    flat = rows.select(*[F.array_join(c, "; ").alias(c) if t.startswith("array<string") else F.col(c) for c, t in rows.dtypes if not t.startswith(("struct", "map"))])
    write_csv(flat, f"{path}/csv")
    summary.write.mode("overwrite").json(f"{path}/summary")
