"""Poisson replication at rates of any size, and columns of any name."""

import math
import time

from acreline.llm import mixing


def test_ten_million_rows_from_a_hundred_and_one(spark):
    """One row of one source stands for a third of the target: counts of that mean and variance, in time."""
    docs = spark.range(101).selectExpr("id AS doc_id", "if(id = 0, 'rare', if(id < 51, 'a', 'b')) AS source")
    began = time.time()
    got = {r.source: r for r in mixing.mix(docs, {"rare": 1.0, "a": 1.0, "b": 1.0}, 10_000_000).groupBy("source").agg({"*": "count", "n_copies": "max"}).collect()}
    assert time.time() - began < 40
    for r in got.values():
        assert abs(r["count(1)"] - 10_000_000 / 3) < 5 * math.sqrt(10_000_000 / 3)
    assert got["rare"]["max(n_copies)"] == got["rare"]["count(1)"]


def test_mean_and_variance_above_one_draw(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'x' AS source")
    for rate in (63.0, 64.5, 300.0):
        n = [r.n_copies for r in mixing.mix(docs, {"x": 1.0}, 4000 * rate).select("doc_id", "n_copies").distinct().collect()]
        n += [0] * (4000 - len(n))
        mean = sum(n) / len(n)
        assert abs(mean - rate) < 5 * math.sqrt(rate / 4000)
        assert abs(sum((x - mean) ** 2 for x in n) / len(n) / rate - 1) < 0.15


def test_columns_of_any_name_are_kept(spark):
    docs = spark.createDataFrame([(1, "a", 1, 2, 3, 4, 5, 6)], "doc_id long, source string, s int, k int, row int, cdf int, first int, salt int")
    got = mixing.mix(docs, {"a": 1.0}, 5.0).collect()
    assert got and all(tuple(r)[:8] == (1, "a", 1, 2, 3, 4, 5, 6) for r in got)
    assert mixing.mix(docs, {}, 0.0).count() == 0
