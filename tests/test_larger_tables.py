"""What only larger tables show: keys past 65,535, prices of nothing."""

import duckdb
import pytest
from pyspark.sql import functions as F

from acreline.functions import numbers
from acreline.queries import ORACLES, QUERIES, texts
from acreline.queries.tables import new_folder
from acreline.streaming import jobs, lifecycle


def test_addresses_of_large_keys(spark):
    keys = [0, 255, 256, 65_535, 65_536, 119_999, 1 << 24]
    d = spark.createDataFrame([(k,) for k in keys], "k long").select("k", numbers.ipv4(texts.address_v4(F.col("k"))).alias("v4"), numbers.blocked_ipv6(texts.address_v6(F.col("k"))).alias("v6"))
    assert {(r.k, r.v4, r.v6) for r in d.collect()} == {(k, 167772160 + k, True) for k in keys}


@pytest.mark.parametrize("zeros", [True, False])
def test_price_of_zero(spark, zeros):
    """A card with a price of 0 needs no page where zeros are values, and keeps it when a page comes."""
    rows = [("a", 0, 0, "card", 0.0), ("b", 0, 1, "survivor", 0.0), ("b", 1, 2, "page", 9.0)]
    d = spark.createDataFrame(rows, "url string, ts int, seq long, stage string, price double").withColumn("ts", F.expr("timestamp '2024-01-01' + make_dt_interval(ts)"))
    d = d.select("*", F.lit(False).alias("known"), F.lit(40.0).alias("acres"), F.lit("x").alias("description"))
    got = {(r.url, r.kind, r.price) for r in jobs.drained(lifecycle.ask_once(lifecycle.in_turns(d, new_folder(spark, "turns"), 1, "url"), 2 * 24 * 60, zeros=zeros), "test").collect()}
    assert got == ({("a", "as_is", 0.0), ("b", "ask", None), ("b", "enriched", 0.0)} if zeros else {("a", "ask", None), ("b", "ask", None), ("b", "enriched", 9.0)})


def test_phrases_equal_their_sql_on_odd_texts(spark, sf, tmp_path):
    """Line ends and tabs are no gap of a phrase, and a long s is an s."""
    said = ["of the", "of\nthe", "of\tthe", "OF - the", "of\xa0the", "off the", "of the_", "licen\u017fe", "License", "licenses", "of\r\nthe", None, ""]
    spark.createDataFrame([(t, f"l{i}") for i, t in enumerate(said)], "text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted((r.lang, r.license, r.of_the) for r in QUERIES["flt08_phrases"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(ORACLES["flt08_phrases"]).fetchall()) and sum(x[1] for x in got) == 2


def test_price_watch_equals_its_sql(spark, sf, tmp_path):
    """Halves of a millisecond are rounded, in what is told and at the ends of a watch, and stored is the price of the check before; to all digits."""
    us, day = 1_000, 86_400_000_000
    prices = {  # user 0: 20 acres, 100 dollars are a change; times in microseconds, purchases of value * 1000
        0: [(us + 499, 50.0), (2 * us + 500, 50.06), (3 * us + 501, 50.09), (4 * us + 999, 50.13), (5 * us, 50.17), (6 * us, 40.0), (7 * us, 40.01)],
        80: [(500, 50.0), (10 * day + 499, 50.0), (10 * day + 500, 50.05)],  # expires on the day, by the rounded time
        160: [(us + 400, 50.0), (11 * day + us + 400, 1.0)],  # no check before the day of grace is over
        240: [(us + 400, 50.0), (11 * day + us - 501, 1.0)],
        320: [(7 * us + 600, 50.0), (8 * us, 50.02), (9 * us, 50.04)],  # a timer ends it
        400: [(25 * day, 9.0)],
    }
    rows = [(u, t, v) for u, checks in prices.items() for t, v in checks]
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    values = ", ".join(f"({i}, {u}, {t}, {v}::DOUBLE)" for i, (u, t, v) in enumerate(rows))
    con.execute(f"COPY (SELECT i::BIGINT AS event_id, TIMESTAMP '2024-01-01' + to_microseconds(t) AS ts, u::BIGINT AS user_id, 'purchase' AS event_type, v AS value FROM (VALUES {values}) r(i, u, t, v)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    name = "str04_price_watch_stream"
    got, want = sorted(map(repr, map(tuple, QUERIES[name](spark, str(tmp_path)).collect()))), sorted(map(repr, con.execute(ORACLES[name]).fetchall()))
    assert got == want and len(got) > 15
