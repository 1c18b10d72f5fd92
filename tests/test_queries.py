"""Every query of the library against its SQL on the same tables, and the rest against plain Python."""

import datetime
import decimal
import math
from collections import Counter

import duckdb
import pyarrow.parquet as pq
import pytest

from acreline.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    yield con
    con.close()


def plain(x):
    """Values that both engines give alike: numbers to nine digits, times without a zone."""
    if x is None or isinstance(x, bool):
        return x
    if isinstance(x, (int, float, decimal.Decimal)):
        return "nan" if math.isnan(x) else float(f"{float(x):.9g}")
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if hasattr(x, "asDict"):
        return tuple(map(plain, x))
    if isinstance(x, dict):
        return tuple(map(plain, x.values())) if all(isinstance(k, str) for k in x) else tuple(sorted((str(k), plain(v)) for k, v in x.items()))
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return str(x)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    got = Counter(repr(tuple(map(plain, r))) for r in df.select(*names).collect())
    found = duck.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    want = Counter(repr(tuple(plain(r[columns.index(c)]) for c in names)) for r in found.fetchall())
    assert got == want, (list((got - want).items())[:2], list((want - got).items())[:2])


def test_queries_without_sql_are_known():
    assert set(QUERIES) - set(ORACLES) == {"ded02_greedy_exact", "str07_fetch_loop_stream"}


def test_fetch_loop_stream_equals_a_loop(spark, sf):
    counts, ended, want = {}, set(), Counter()
    for r in sorted(pq.read_table(f"{sf}/events.parquet").to_pylist(), key=lambda r: r["event_id"]):
        site, series = r["user_id"] % 11, r["user_id"]
        kind = "ok" if r["event_type"] != "error" else "blocked" if 25 <= r["value"] < 60 else "error"
        blocked, errors = counts.setdefault(site, [0, 0])
        if (site, series) in ended or blocked >= 5 or errors >= 10:
            continue
        want[site] += 1
        if kind != "ok":
            counts[site][kind == "error"] += 1
            ended.add((site, series))
    got = {r.source: r.n for r in QUERIES["str07_fetch_loop_stream"](spark, sf).collect()}
    assert got == dict(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
