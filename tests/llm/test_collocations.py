"""Phrases against plain Python over all words, and the SQL."""

import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from acreline.llm import collocations, oracle, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least=10, cover=50, most=2000):
    """docs: (lang, text). Rows (lang, rank, phrase, a, l, r, n, score)."""
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    cand = {k: v for k, v in f.items() if len(k) > 2 and v >= least}
    gone = {(k[0], *part) for k, v in cand.items() if len(k) == 4 for part in (k[1:3], k[2:4]) if 100 * v >= cover * cand.get((k[0], *part), 1 << 80)}
    out = {}
    for k, a in cand.items():
        if k in gone:
            continue
        score, cut = min((1000000 * a * a // (f[k[: 1 + c]] * f[(k[0], *k[1 + c :])]), c) for c in range(1, len(k) - 1))
        out.setdefault(k[0], []).append((-score, -a, " ".join(k[1:]).encode("utf-8", "surrogatepass"), f[k[: 1 + cut]], f[(k[0], *k[1 + cut :])]))
    return [(lang, i, p.decode("utf-8", "surrogatepass"), -a, left, right, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:most], 1)]


NAMES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def made(seed, n=400):
    """Repeating phrases, words with signs, pieces of one word, breaks of all kinds."""
    rng = random.Random(seed)
    words = ["New", "york", "CITY", "é", "Éa", "x-y", "<|a|>", "\x00", "\x85", "a b", "\x1c", "ß", "\U0001f600", *(f"w{i}" for i in range(30))]
    out = []
    for _ in range(n):
        t = "".join(rng.choice(["new york city", "of the", "a a a a", rng.choice(words)]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " ? ", "\x0b"]) for _ in range(rng.randrange(60)))
        out.append((rng.choice(["en", "en", "fr", None, "und", ""]), t))
    return out + [("en", None), (None, None), ("de", ""), ("de", " . ,\n"), ("en", "new york " * 20000), ("fr", "y" * 100_000)]


@pytest.mark.parametrize("seed", range(3))
def test_phrases_equal_brute_force(spark, seed):
    docs = made(seed)
    df = spark.createDataFrame([(lang, t, "clash", 1) for lang, t in docs], "lang string, text string, phrase string, f int")
    want = brute(docs)
    assert sorted(map(tuple, collocations.phrases(df).select(*NAMES).collect())) == sorted(want) and len(want) > 50


def test_small_sketch_small_chunks_and_automata(spark, monkeypatch):
    """A sketch that is all full, chunks of a text each and automata of a few phrases give the same."""
    docs = made(7, 150)
    df = spark.createDataFrame(docs, "lang string, text string")
    want = sorted(brute(docs, 3, 80, 40))
    assert sorted(map(tuple, collocations.phrases(df, least=3, cover=80, most=40, bits=16).select(*NAMES).collect())) == want
    # limits travel to the tasks with the functions' module, so they are tried here
    scan = collocations.tokens("New york, new\tyork.a\x0bB c") + collocations.tokens(None)
    assert scan == [b"new", b"york", b".", b"new", b"york", b".", b"a", b".", b"b", b"c", b".", b"."]
    monkeypatch.setattr(collocations, "CHUNK", 10)
    import pandas as pd

    got = list(collocations.chunks([pd.DataFrame({"lang": ["a", "b", "a"], "text": ["one two three", None, "four"]})]))
    assert [dict(x) for x in got] == [{"a": ["one two three"]}, {"a": ["four"]}]


def test_sketch_never_counts_too_few(spark):
    """Every phrase that reaches the least count has its bit, in sketches of any size, with counts above 255 too."""
    docs = made(9, 200)
    df = spark.createDataFrame(docs, "lang string, text string")
    for least in (3, 400):
        a, b = (sorted(map(tuple, collocations.phrases(df, least=least, bits=n).select(*NAMES).collect())) for n in (16, 22))
        assert a == b == sorted(brute(docs, least))


def test_empty_table(spark):
    assert collocations.phrases(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_ranks_and_exact_products(spark):
    """Products beyond 64 bits, ties by a and by bytes."""
    rows = [("en", None, 0, 10**13), ("en", "a b", 2, 9 * 10**12), ("en", "a", 1, 9 * 10**12), ("en", "b", 1, 9 * 10**12 + 7), ("en", "c d", 2, 50), ("en", "c", 1, 50), ("en", "d", 1, 50), ("en", "c é", 2, 50), ("en", "é", 1, 50)]
    got = collocations.top(collocations.with_scores(spark.createDataFrame(rows, "lang string, phrase string, words int, f long"), 50)).orderBy("rank").collect()
    a, b = 9 * 10**12, 9 * 10**12 + 7
    assert [(r.phrase, r.score) for r in got] == [("c d", 10**6), ("c é", 10**6), ("a b", 10**6 * a * a // (a * b))]


def test_op11_sql_and_brute_force(spark, sf):
    docs = [(r["lang"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
    got = sorted(map(tuple, queries.op11_collocations(spark, sf).collect()))
    assert got == sorted(brute(docs))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert got == sorted(con.execute(oracle.OP11).fetchall())


def test_op11_sql_on_awkward_rows(spark, tmp_path):
    docs = [(lang, t) for lang, t in made(11, 100) if t is None or len(t) < 50_000]
    pq.write_table(pa.table({"doc_id": range(len(docs)), "lang": pa.array([d[0] for d in docs], pa.string()), "text": pa.array([d[1] for d in docs], pa.string())}), tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    assert sorted(con.execute(oracle.OP11).fetchall()) == sorted(map(tuple, queries.op11_collocations(spark, str(tmp_path)).collect()))
