"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from acreline.llm import decontaminate, mixing, quality, sharding, simhash
from acreline.llm.common import delete, new_dir, table, written_at


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the rule table keeps. Null and empty texts go; repeated rows are judged alike; empty stays empty."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest doc_id, of each group of texts linked by a similarity of 0.8 on 5-word shingles."""
    return simhash.drop_near_duplicates(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows without a 10-word window of a benchmark text. Null texts stay; an empty benchmark drops nothing."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), window=10)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows replicated to the sources' target shares; a null source is one of its own without a target."""
    return mixing.mix(docs, mixing.TARGETS).select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with size, law, shard, slot and grown_shard for 40 shards."""
    return sharding.shard(docs, 40)


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("benchmark passages", benchmark_passages), ("source mix", source_mix), ("shards", shards)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each but the last is written as Parquet in the shared folder, and its input then deleted."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_dir(spark, name.replace(" ", "-"))
        docs = written_at(stage(spark, docs, sf_dir), path)
        if last:
            delete(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL has no function for the XXH64 of the fingerprints.
ORACLE_SQL = None
