"""Streams: known URLs, trailing windows, price state, intake attempts, paged fetches. Each has a batch twin in operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def table_stream(spark: SparkSession, sf_dir: str, name: str, time: str | None = None, files: int | None = None) -> DataFrame:
    """A stream of the rows of a Parquet table, of so many files a micro-batch; a time column becomes a timestamp that a watermark can use."""
    r = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{name}.parquet").schema).option("pathGlobFilter", "*.parquet")
    d = (r.option("maxFilesPerTrigger", files) if files else r).parquet(f"{sf_dir}/{name}.parquet*")
    return d.withColumn(time, F.col(time).cast("timestamp")) if time else d


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and gives what it wrote, from the shared folder.

    In mode complete each micro-batch has the whole result, so the last one's is given; in mode update the rows of all.
    """
    spark = stream.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    else:

        def keep(rows: DataFrame, batch: int) -> None:
            rows.write.mode("overwrite").parquet(f"{path}/out/{'all' if mode == 'complete' else batch}")

        q = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    found = spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{path}/out")
    return found


def new_urls(listings: DataFrame, known: DataFrame, time: str, delay: str = "30 days") -> DataFrame:
    """Listings whose url neither a static table has nor the stream has seen within delay."""
    fresh = listings.join(known.select("url"), "url", "left_anti")
    return fresh.withWatermark(time, delay).dropDuplicatesWithinWatermark(["url"])


def windows(rows: DataFrame, time: str, by: list[str], size: str, slide: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """(start, by, n): rows counted in windows of a size, sliding if a slide is given, late ones within delay."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return rows.withWatermark(time, delay).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sightings(rows: DataFrame, time: str, key: Column, days: int = 7) -> DataFrame:
    """(day, key, n): sightings of a key in the days up to and with each day."""
    w = windows(rows.withColumn("key", key), time, ["key"], f"{days} days", "1 day", "0 seconds")
    return w.select(F.date_add(F.to_date("start"), days - 1).alias("day"), "key", "n")


def price_states(prices: DataFrame) -> DataFrame:
    """(id, ts, price, stored, dropped) of a stream (id, ts, price, seq): each price against the last one of its id.

    The state of an id is its last price and time; rows of a micro-batch are taken in order of ts and seq.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        out = []
        for ts, price in zip(rows["ts"], rows["price"]):
            out.append((key[0], ts, price, last, last is not None and price < last))
            last = price
        state.update((last,))
        yield pd.DataFrame(out, columns=["id", "ts", "price", "stored", "dropped"]).astype({"stored": "float64"})

    return prices.groupBy("id").applyInPandasWithState(step, "id long, ts timestamp, price double, stored double, dropped boolean", "last double", "append", GroupStateTimeout.NoTimeout)


def attempts(outcomes: DataFrame) -> DataFrame:
    """(id, seq, status) of a stream (id, seq, outcome): New to Added, Duplicate or Failed at once, to Retry at a first error and Failed at a second; a final status stays."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status = state.get[0] if state.exists else "New"
        out = []
        for seq, outcome in pd.concat(list(batches)).sort_values("seq")[["seq", "outcome"]].itertuples(index=False):
            if status in ("New", "Retry"):
                status = {"added": "Added", "duplicate": "Duplicate", "rejected": "Failed"}.get(outcome) or ("Failed" if status == "Retry" else "Retry")
            out.append((key[0], seq, status))
        state.update((status,))
        yield pd.DataFrame(out, columns=["id", "seq", "status"])

    return outcomes.groupBy("id").applyInPandasWithState(step, "id long, seq long, status string", "status string", "append", GroupStateTimeout.NoTimeout)


def fetch_loop(log: DataFrame, blocked_most: int = 5, errors_most: int = 10) -> DataFrame:
    """(source, seq, outcome, read) of a stream (source, seq, series, outcome): whether the page would still have been asked for.

    A source stops at its fill of blocked or error pages; a blocked or error page ends its series. The state of a source is
    its two counts and its ended series, at most as many as the two fills together; a source that has stopped keeps its
    counts alone. A task holds a source's rows of one micro-batch, which the stream's trigger options bound, not its log.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        blocked, errors, ended = state.get if state.exists else (0, 0, "")
        over, out = set(filter(None, ended.split("\n"))), []
        for seq, series, outcome in pd.concat(list(batches)).sort_values("seq")[["seq", "series", "outcome"]].itertuples(index=False):
            read = series not in over and blocked < blocked_most and errors < errors_most
            if read and outcome in ("blocked", "error"):
                blocked, errors = blocked + (outcome == "blocked"), errors + (outcome == "error")
                over.add(series)
                if blocked >= blocked_most or errors >= errors_most:
                    over = set()
            out.append((key[0], seq, outcome, read))
        state.update((int(blocked), int(errors), "\n".join(sorted(over))))
        yield pd.DataFrame(out, columns=["source", "seq", "outcome", "read"])

    return log.groupBy("source").applyInPandasWithState(step, "source long, seq long, outcome string, read boolean", "blocked int, errors int, ended string", "append", GroupStateTimeout.NoTimeout)
