"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, written

#: Target shares of the production mix; sources not named share what is left in equal parts.
TARGETS = {"src0": 0.2, "src1": 0.1, "src2": 0.1}

#: Up to this many sources their rates are broadcast (under 20 MB); beyond it the join deals them out by source and salt.
BROADCAST_SOURCES = 10_000
SALTS = 64
#: A mean above this is the sum of several independent draws, so no distribution has over some 170 steps.
MOST_MEAN = 64
#: Copies of a row that are made in one go.
TOGETHER = 1_000_000


def uniform(seed: int, *cols: Column) -> Column:
    """A number in (0, 1) from the MD5 of seed and columns, nulls as the word null."""
    name = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def rates(docs: DataFrame, targets: dict[str, float], total: float | None, source: str) -> DataFrame:
    """(s, rate, draws, cdf): rate is target rows over the source's rows, cdf the Poisson distribution of rate / draws from 0 up.

    The rows of each source are counted once, into a table in the shared folder.
    """
    n = written(docs.groupBy(F.coalesce(F.col(source), F.lit("")).alias("s")).agg(F.count("*").alias("n")), "sources")
    named = F.create_map(*[x for k, v in sorted(targets.items()) for x in (F.lit(k), F.lit(float(v)))]) if targets else F.create_map(F.lit(""), F.lit(0.0))
    n = n.withColumn("w", F.element_at(named, F.col("s")) if targets else F.lit(None).cast("double"))
    rows, others, given = n.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("w").isNull().cast("long")), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    left = max(0.0, 1.0 - given) / others if others else 0.0
    whole = given + left * others
    n = n.withColumn("w", F.coalesce("w", F.lit(left)) / F.lit(whole or 1.0)).withColumn("rate", F.col("w") * F.lit(float(rows if total is None else total)) / F.col("n"))
    n = n.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / MOST_MEAN)).cast("long")).withColumn("mean", F.col("rate") / F.col("draws"))
    # up to a count whose upper tail is below 1e-16 at this mean
    last = F.ceil(F.col("mean") + 10 * F.sqrt("mean") + 25).cast("int")
    cdf = F.expr("""CASE WHEN mean > 0 THEN aggregate(sequence(0, last),
        named_struct('f', 0D, 'c', 0D, 'out', cast(array() AS array<double>)),
        (a, k) -> named_struct(
            'f', a.f + ln(greatest(k, 1)),
            'c', a.c + exp(k * ln(mean) - mean - (a.f + ln(greatest(k, 1)))),
            'out', concat(a.out, array(a.c + exp(k * ln(mean) - mean - (a.f + ln(greatest(k, 1))))))),
        a -> a.out) ELSE array(1D) END""")
    return n.withColumn("last", last).withColumn("cdf", cdf).select("s", "rate", "draws", "cdf")


def mix(docs: DataFrame, targets: dict[str, float] = TARGETS, total: float | None = None, seed: int = 42, key: str = "doc_id", source: str = "source") -> DataFrame:
    """docs replicated so that each source has its target share of total rows (default: as many rows as docs), shuffled.

    Each row gets rate (its source's target rows over its rows), n_copies (the Poisson count of that mean at the row's
    hash of seed, key and source), copy (0 .. n_copies - 1) and mix_key (a hash of key, copy and seed); rows of count 0
    go. A mean above MOST_MEAN is split into equal ones, each with a hash of its own, whose counts add up: a sum of
    Poisson counts is one of the summed mean, so any rate does. The result is dealt out and sorted by mix_key, which is a
    global shuffle that a rerun repeats. Targets are relative; sources without one share what is left of 1 equally. Null
    sources are the source "". Equal keys of one source get equal counts. An empty table stays empty. Columns of docs
    with the new names are replaced; all others are kept, whatever their names.
    """
    own = ["rate", "n_copies", "copy", "mix_key"]
    rest = [F.col(c) for c in docs.columns if c not in own]
    table = rates(docs, targets, total, source)
    sources, high = table.agg(F.count("*"), F.coalesce(F.max("rate"), F.lit(0.0))).first()
    d = docs.select(F.struct(*rest).alias("row"), F.col(key).cast("string").alias("k"), F.coalesce(F.col(source), F.lit("")).alias("s"))
    if sources <= BROADCAST_SOURCES:
        d = d.join(F.broadcast(table), "s")
    else:
        d = d.withColumn("salt", F.pmod(F.xxhash64("k"), F.lit(SALTS))).join(table.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["s", "salt"])
    # the first draw's hash has no number, so that a rate of one draw needs none
    us = F.transform(F.sequence(F.lit(0).cast("long"), F.col("draws") - 1), lambda i: uniform(seed, F.col("k"), F.when(i == 0, F.col("s")).otherwise(F.concat_ws(":", "s", i.cast("string")))))
    below = lambda n, u: n + F.size(F.filter("cdf", lambda c: c < u)).cast("long")
    d = d.withColumn("n_copies", F.aggregate(us, F.lit(0).cast("long"), below)).where("n_copies > 0").drop("cdf")
    # no row is an array of all its copies, and the copies of rows with very many are made by several tasks
    d = d.withColumn("first", F.explode(F.expr(f"sequence(0L, n_copies - 1L, {TOGETHER}L)")))
    if high > TOGETHER:
        d = d.repartition(shuffle_partitions(docs.sparkSession), "k", "s", "first")
    d = d.withColumn("copy", F.explode(F.expr(f"sequence(first, least(n_copies, first + {TOGETHER}L) - 1L)")))
    d = d.withColumn("mix_key", F.substring(F.md5(F.concat_ws(":", F.lit(f"mix{seed}"), F.coalesce("k", F.lit("null")), F.col("copy").cast("string"))), 1, 16))
    return d.select("row.*", *own).repartitionByRange("mix_key").sortWithinPartitions("mix_key")
