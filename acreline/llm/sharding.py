"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shard_of(key: Column, shards: dict[int, float], seed: int = 42) -> Column:
    """The shard with the best score for the key: -ln(u) / weight, smallest, where u in (0, 1) is a hash of key and shard.

    Key and shards alone decide. A shard that is added takes rows only into itself; one that is removed gives only its
    own rows away; shards hold rows in proportion to their weights. A null key hashes as the word null.
    """
    name = F.coalesce(key.cast("string"), F.lit("null"))
    scores = []
    for shard, weight in sorted(shards.items()):
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(shard), name), 11).cast("double") + 0.5) / float(2**53)
        scores.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("score"), F.lit(shard).alias("shard")))
    return (F.least(*scores) if len(scores) > 1 else scores[0]).getField("shard")


def shard(docs: DataFrame, shards: dict[int, float] | int = 40, key: str = "doc_id", text: str = "text", seed: int = 42, rows_per_bucket: int = 100_000, drop_text: bool = False) -> DataFrame:
    """docs with size, law, shard, slot and grown_shard (columns of these names are replaced).

    size is the UTF-8 bytes of the text plus 16 (null text: 16). law is "key". slot numbers a shard's rows from 0 without
    gaps, by bucket of the key's hash and then key and text; rows equal in both are numbered in any order. grown_shard is
    the shard with one more shard of mean weight. A shard is never gathered in one task: slots are counted inside
    buckets of about rows_per_bucket rows, and a bucket's first slot is the sum of the counts before it. Repeated keys
    share a shard; null keys are one key. An empty table gives an empty one. With drop_text the text column is replaced by
    text_crc32 (unsigned, of its UTF-8) and rows of one key are numbered by their text's SHA-256, so that no text is
    dealt out.
    """
    weights = {i: 1.0 for i in range(shards)} if isinstance(shards, int) else dict(shards)
    more = weights | {max(weights) + 1: sum(weights.values()) / len(weights)}
    rows = docs.count()
    buckets = max(1, -(-rows // (rows_per_bucket * len(weights))))
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    d = docs.withColumns({
        "size": F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16,
        "law": F.lit("key"),
        "shard": shard_of(F.col(key), weights, seed),
        "grown_shard": shard_of(F.col(key), more, seed),
        "_b": F.pmod(F.xxhash64(F.lit(seed + 1), F.coalesce(F.col(key).cast("string"), F.lit("null")), crc), F.lit(buckets)),
    })
    if drop_text:
        d = d.withColumns({"text_crc32": crc, "_digest": F.unhex(F.sha2(F.col(text).cast("binary"), 256))}).drop(text)
    counts = d.groupBy("shard", "_b").agg(F.count("*").alias("_n"))
    # one row a bucket, buckets of one shard in order; their number is rows / rows_per_bucket
    first = counts.withColumn("_first", F.sum("_n").over(Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")).drop("_n")
    order = Window.partitionBy("shard", "_b").orderBy(F.col(key), F.col("_digest" if drop_text else text))
    placed = d.withColumn("_r", F.row_number().over(order)).join(first, ["shard", "_b"])
    new = [*["text_crc32"] * drop_text, "size", "law", "shard", "slot", "grown_shard"]
    rest = [c for c in docs.columns if c not in new and not (drop_text and c == text)]
    return placed.withColumn("slot", (F.col("_first") + F.col("_r") - 1).cast("long")).select(*rest, *new)
