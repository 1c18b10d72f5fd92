"""Values at the bounds of parsers, checks and keys, and the sequential rules against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from acreline.functions import keys, numbers, text
from acreline.operators import classify, dedup
from acreline.sources import sinks, stores
from acreline.streaming import jobs


def values(spark, column, inputs, kind="string"):
    d = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in d.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_acreage(spark):
    assert values(spark, numbers.acreage, [".24", "0.24", "1,234.5", "40", "0", "-3", "junk", "", None]) == [0.24, 0.24, 1234.5, 40, None, None, None, None, None]


def test_prices(spark):
    assert values(spark, numbers.total_price, ["$2,900/acre • $1,250,000 • 431 acres", "$12,500.50 total", "$5,000 down", "", None]) == [1250000, 12500.5, None, None, None]
    assert values(spark, numbers.headline_acres, ["$873,600312 acres", "no figure", "312.5 acres, more or less"])[1:] == [None, 312.5]
    assert values(spark, numbers.currency, ["$2,900", "2900", "n/a"]) == [2900, 2900, None]


def test_plausibility_bounds(spark):
    rows = [(1000.0, 5.0, 0), (999.0, 5.0, 1), (100_000_000.0, 5000.0, 0), (5000.0, 25000.0, 0), (5000.0, 0.0, 1), (5000.0, -1.0, 1), (5000.0, 1.123, 0), (5000.0, 1.1234, 1), (5000.12, 1.0, 0), (5000.123, 1.0, 1), (5000.0, 5.5600000000000005, 0), (None, None, 0)]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, price double, acres double, want int")
    for r in d.withColumn("n", F.size(classify.hard_problems(F.col("price"), F.col("acres")))).collect():
        assert r.n == r.want, r
    per = spark.createDataFrame([(150.0, 1.0, 0), (149.0, 1.0, 1), (50_000.0, 1.0, 0), (50_001.0, 1.0, 1), (5.0, 0.0, 0)], "price double, acres double, want int")
    for r in per.withColumn("n", F.size(classify.per_acre_problems(F.col("price"), F.col("acres")))).collect():
        assert r.n == r.want, r


def test_thresholds_include_their_bounds(spark):
    counties = spark.createDataFrame([(1, "Wayne", "KY", 1000.0), (2, "Lewis", "KY", None)], "seq int, county string, state string, max_cpa double")
    rows = [("a", 100_000.0, "at_below"), ("b", 120_000.0, "within"), ("c", 130_000.0, "watch"), ("d", 130_000.01, "over"), ("e", None, "invalid"), ("f", 999.0, "implausible")]
    d = spark.createDataFrame([(u, p, 100.0, "Wayne County", "KY", v) for u, p, v in rows] + [("g", 100_000.0, 100.0, "Lewis", "KY", "not_target"), ("h", 100_000.0, 39.0, "Wayne", "Kentucky", "below_min_acres")], "url string, price double, acres double, county string, state string, want string")
    for r in classify.classify(d, counties).collect():
        assert r.verdict == r.want, r
    assert classify.classify(d.where("false"), counties).count() == 0


def test_sold_phrases(spark):
    assert values(spark, text.sold, ["SOLD - Big Ranch", "Status: Sold", "has been sold", "just sold", "tracts have sold for more"]) == [True] * 4 + [False]


def test_fnv1a(spark):
    assert values(spark, keys.fnv1a, ["a", "foobar"]) == [3826002220, 3214735720]


def greedy_loop(rows, urls, prints):
    urls, prints, out = set(urls), set(prints), {}
    in_store = set(urls), set(prints)
    for seq, url, fp in sorted(rows):
        if url in in_store[0]:
            out[seq] = "url"
        elif fp is not None and fp in in_store[1]:
            out[seq] = "fingerprint"
        elif (url or "") in urls:
            out[seq] = "url"
        elif fp is not None and fp in prints:
            out[seq] = "session"
        else:
            out[seq] = None
            urls.add(url or "")
            if fp is not None:
                prints.add(fp)
    return out


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("most", [0, 50_000])
def test_greedy_equals_the_sequential_rule(spark, seed, most):
    """Chains visited in a task, and chains resolved in rounds."""
    rnd = random.Random(seed)
    rows = [(i, f"u{rnd.randrange(60)}" if rnd.random() < 0.95 else None, f"f{rnd.randrange(60)}" if rnd.random() < 0.9 else None) for i in range(150)]
    store = [("u1", "f2"), ("u3", None), (None, "f4")]
    d, index = spark.createDataFrame(rows, "seq long, url string, fingerprint string"), spark.createDataFrame(store, "url string, fingerprint string")
    got = {r.seq: r.duplicate_of for r in dedup.greedy(d, index, chain_rows=most).collect()}
    assert got == greedy_loop(rows, [u for u, _ in store if u], [f for _, f in store if f])


def test_greedy_chain_keeps_first_and_last(spark):
    rows = [(1, "u1", "f1"), (2, "u1", "f2"), (3, "u2", "f2")]
    d = spark.createDataFrame(rows, "seq long, url string, fingerprint string")
    assert sorted(r.seq for r in dedup.greedy(d, d.where("false")).where("kept").collect()) == [1, 3]


def test_writing_twice_changes_nothing(spark):
    store = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "url string, price double")
    rows = spark.createDataFrame([("b", 3.0), ("c", 4.0)], "url string, price double")
    once = sinks.upsert(store, rows)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, sinks.upsert(once, rows).collect())) == [("a", 1.0), ("b", 3.0), ("c", 4.0)]
    assert sinks.insert_new(once, rows).count() == 0


def test_broken_log_lines_are_left_out(spark):
    lines = spark.createDataFrame([('{"date": "2024-01-02", "counties": ["a"]}',), ("",), ("{broken",), ('{"date": "2024-01-03"}',)], "value string")
    assert [(str(r.date), r.counties) for r in stores.coverage_log(lines).collect()] == [("2024-01-02", ["a"])]


def test_suspects_against_a_plain_loop(spark):
    """Every listing against the whole table, with prices at the bounds, and no pairs made by a join."""
    r = random.Random(4)
    rows = [(i, f"u{i}", None, r.choice(["a", "a", "b", None]), r.choice([100.0, 110.0, 90.9, 121.0, 1.1 * r.randint(80, 130), r.uniform(50, 200), 0.0])) for i in range(400)]
    d = spark.createDataFrame(rows, "seq long, url string, fingerprint string, location_key string, price double")
    got = dedup.against_index(d, d)
    near = lambda a, b: a[3] is not None and a[3] == b[3] and min(a[4], b[4]) > 0 and abs(a[4] - b[4]) / min(a[4], b[4]) <= 0.10
    assert {x.seq: x.suspect for x in got.collect()} == {a[0]: min((b[0] for b in rows if near(a, b)), default=None) for a in rows}
    assert "FlatMapCoGroupsInPandas" in got._jdf.queryExecution().toString()


def test_evidence_is_cut_at_its_default_bound(spark):
    d = spark.createDataFrame([(1, "x" * 2_001), (2, "y" * 500_001)], "page_id int, html string")
    assert sorted((r.page_id, len(r.html)) for r in sinks.evidence(d).collect()) == [(1, 2_001), (2, 500_000)]


def test_complete_mode_gives_the_last_result(spark, tmp_path):
    """Three files, one a micro-batch: one row for one window, not one for each micro-batch."""
    spark.range(30).selectExpr("timestamp_seconds(id) AS ts", "'a' AS k").repartition(3).write.parquet(str(tmp_path / "log.parquet"))
    stream = jobs.table_stream(spark, str(tmp_path), "log", files=1).groupBy("k").count()
    assert [(r.k, r["count"]) for r in jobs.drained(stream, "complete", "complete").collect()] == [("a", 30)]


def test_batch_writer_replaces_a_repeated_batch(spark, tmp_path):
    kind = "url string, price double, acres double"
    first = spark.createDataFrame([("a", 5000.0, 10.0), ("a", 5000.0, 10.0), ("b", 1.0, 10.0)], kind)
    second = spark.createDataFrame([("a", 5000.0, 10.0), ("c", 9000.0, 10.0)], kind)
    write = sinks.write_batch(str(tmp_path / "store"))
    for batch, rows in ((0, first), (0, first), (1, second), (1, second), (0, first)):
        write(rows, batch)
    read = lambda side: sorted(r.url for r in spark.read.parquet(str(tmp_path / "store" / side)).collect())
    assert read("rows") == ["a", "c"] and read("refused") == ["b"]


def test_records_of_a_long_id_list_come_in_its_order(spark):
    records = spark.range(5000).selectExpr("cast(id AS int) AS id", "id % 3 AS stage")
    ids = [4999, None, 7, 7, 100_000, *range(3000, 0, -1)]
    got = [r.id for r in stores.in_list(records, ids).collect()]
    assert got == [4999, 7, *[i for i in range(3000, 0, -1) if i != 7]]
    assert stores.in_list(records, []).columns == ["id", "stage"] and stores.in_list(records, []).count() == 0


def test_phrases_agree_with_their_patterns_alone(spark):
    texts = ["No  Access, off-market; LANDLOCKED creek-bottom", "no accessory, flatter", "SALE\u00a0PENDING sale-pending", "Sold - today", "unsold - ", "", None, "\u212aelvin roc\u212ay rocky LEVEL", "pond" * 9 + " pond"]
    every = [*text.UNAVAILABLE, *text.DEALBREAKERS, *text.YELLOW_FLAGS, *text.POSITIVES]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.array_compact(F.array(*[F.when(F.col("t").rlike(text.phrase_pattern(p)), F.lit(p)) for p in every]))
    assert all(r.got == r.want for r in d.select(text.present(F.col("t"), every).alias("got"), plain.alias("want")).collect())
    assert [r.a for r in d.select(text.availability(F.col("t")).alias("a")).collect()][3:7] == [["sold"], [], [], []]


def chain(n, order):
    """n listings, each sharing a url with the one before it and a fingerprint with the one after, or the other way round."""
    return [(order(i), f"u{(i + 1) // 2}", f"f{i // 2}") for i in range(n)]


@pytest.mark.parametrize("order", ["forward", "backward", "shuffled", "halves"])
def test_long_chains_take_few_rounds(spark, order, monkeypatch):
    """Chains of thousands of rows in strict order equal the loop, in rounds that grow with the logarithm of their length."""
    n = 3000
    place = list(range(n))
    random.Random(1).shuffle(place)
    by = {"forward": lambda i: i, "backward": lambda i: n - i, "shuffled": lambda i: place[i], "halves": lambda i: i if i % 2 else n + i}[order]
    rows = chain(n, by)
    written, count = dedup.Scratch.written, []
    monkeypatch.setattr(dedup.Scratch, "written", lambda self, df, name: count.append(name) or written(self, df, name))
    got = {r.k for r in dedup.in_rounds(spark.createDataFrame(rows, "k long, u string, fingerprint string")).collect()}
    assert got == {k for k, why in greedy_loop(rows, [], []).items() if why is None}
    assert count.count("nodes") <= 8 and len(count) <= 60


def test_rounds_keep_the_rule_in_dense_groups(spark):
    """Rows that wait for several others, hot keys and null fingerprints."""
    for seed in range(3):
        rnd = random.Random(seed)
        pairs = {(f"u{min(rnd.randrange(30), rnd.randrange(30))}", f"f{rnd.randrange(20)}" if rnd.random() < 0.9 else None) for _ in range(200)}
        rows = [(k, *p) for k, p in enumerate(sorted(pairs, key=lambda p: rnd.random()))]
        got = {r.k for r in dedup.in_rounds(spark.createDataFrame(rows, "k long, u string, fingerprint string")).collect()}
        assert got == {k for k, why in greedy_loop(rows, [], []).items() if why is None}
    assert dedup.in_rounds(spark.createDataFrame([], "k long, u string, fingerprint string")).count() == 0


def test_greedy_works_out_listings_once(spark, monkeypatch):
    """Rows that are the first of both keys decide without chains, and a listing is worked out once, however often it is joined."""
    monkeypatch.setattr(dedup, "components", lambda edges: pytest.fail("chains were made"))
    rows = [(k, f"u{k % 3}", f"f{k % 7}" if k % 5 else None) for k in range(200)]
    made = spark.sparkContext.accumulator(0)

    def same(u):
        made.add(1)
        return u

    d = spark.createDataFrame(rows, "seq long, url string, fingerprint string").withColumn("url", F.udf(same, "string")("url"))
    got = {r.seq: r.duplicate_of for r in dedup.greedy(d, d.where("false")).collect()}
    assert got == greedy_loop(rows, [], []) and made.value == 200
