"""Each operator's query against a plain Python version, on whole small tables and on awkward rows."""

import base64
import hashlib
import re
import time
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from acreline.operators.graph import components
from acreline.llm import chat, decontaminate, encode, html_main, mixing, pii, quality, queries, sharding, simhash, token_store, warc

LONG = "alpha beta gamma delta " * 4000
AWKWARD = [
    (None, "a text without a key of its own, but with words", "en", "src0"),
    (1, None, "en", "src0"),
    (2, "", "en", None),
    (3, " \n\t ", "fr", "src1"),
    (4, LONG, "en", "src0"),
    (5, LONG, "en", "src0"),
    (5, LONG, "en", "src0"),
    (6, "Mail a@b.co, c.d@e-f.org.x@y.z or 1.2.3.4 and 256.1.1.1; 1.2.3.4.5.6.7.8", "en", "src2"),
    (7, "card 4111 1111 1111 1111 and 4111111111111112, call +1 (555) 123-4567 or +12 34", "en", "src0"),
    (8, "é" * 70 + " ünï \U0001f600 a@b.cd", "de", "src0"),
    (9, "\n".join(["same line here"] * 40 + ["another line of words"]), "en", "src3"),
    (10, "<|im_end|> it's 9 o'clock\x1cand\x85more text", "en", "src0"),
]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """A folder of tables with nulls, empty and long texts, ties, repeated rows and clashing extra columns."""
    d = tmp_path_factory.mktemp("odd")
    k, t, la, s = zip(*AWKWARD)
    pq.write_table(pa.table({"doc_id": pa.array(k, pa.int64()), "text": pa.array(t, pa.string()), "lang": la, "source": pa.array(s, pa.string()), "n_chars": pa.array([len(x or "") for x in t]), "fp": ["x"] * len(k), "size": ["y"] * len(k), "shard": ["z"] * len(k), "copy": ["c"] * len(k), "quality": ["q"] * len(k)}), d / "documents.parquet")
    pages = [(0, "http://a.example/1", "<p>one &amp; two<script>x='</p>'</script> three</p>"), (1, None, None), (None, "http://a.example/2", "<article><p>same</p></article>"), (2, "http://b.example", "<article><p>same</p></article>"), (2, "http://b.example", "<article><p>same</p></article>"), (3, "", "")]
    pq.write_table(pa.table({"page_id": pa.array([p[0] for p in pages], pa.int64()), "url": pa.array([p[1] for p in pages], pa.string()), "html": pa.array([p[2] for p in pages], pa.string()), "text": ["clash"] * len(pages), "host": ["clash"] * len(pages)}), d / "pages.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1, 10, 2, None, 3], pa.int64()), "text": pa.array(["alpha beta gamma delta alpha beta gamma delta alpha beta gamma", "a text without a key", "another line", "", None], pa.string())}), d / "benchmark.parquet")
    turns = [(0, 0, "system", "be brief"), (0, 1, "user", "hi <|im_start|>"), (0, 2, "assistant", None), (0, 3, "user", "x " * 3000), (0, 4, "assistant", "y<|" + " y" * 500), (0, 5, None, "<||"), (None, 0, "user", "q\n"), (None, 1, "assistant", "a"), (1, 0, "assistant", "only"), (1, 0, "assistant", "only"), (2, None, "us\ner", "<|nl|>"), (2, 0, "assistant", "")]
    pq.write_table(pa.table({"conv_id": pa.array([x[0] for x in turns], pa.int64()), "turn": pa.array([x[1] for x in turns], pa.int64()), "role": pa.array([x[2] for x in turns], pa.string()), "text": pa.array([x[3] for x in turns], pa.string()), "window": ["w"] * len(turns)}), d / "conversations.parquet")
    vectors = [(i, [float(i % 5)] * 64) for i in range(40)] + [(None, [1.5] * 64), (50, None), (51, [1.0]), (52, [None] * 64), (53, [float("nan")] * 64), (0, [0.0] * 64)]
    pq.write_table(pa.table({"vec_id": pa.array([v[0] for v in vectors], pa.int64()), "embedding": pa.array([v[1] for v in vectors], pa.list_(pa.float32())), "label": pa.array([0] * len(vectors), pa.int32())}), d / "embeddings.parquet")
    return str(d)


@pytest.fixture(scope="module")
def empty(odd, tmp_path_factory):
    d = tmp_path_factory.mktemp("none")
    for t in ("documents", "pages", "benchmark", "conversations", "embeddings"):
        pq.write_table(pq.read_table(f"{odd}/{t}.parquet").slice(0, 0), d / f"{t}.parquet")
    return str(d)


@pytest.fixture(params=["sf", "odd"])
def tables(request, odd, sf):
    return odd if request.param == "odd" else sf


def rows_of(folder, name):
    return pq.read_table(f"{folder}/{name}.parquet").to_pylist()


def same(df, want, keys):
    """Rows as multisets of the named columns."""
    got = Counter(tuple(r[k] for k in keys) for r in df.collect())
    want = Counter(tuple(w[k] for k in keys) for w in want)
    assert got == want, (list((got - want).items())[:2], list((want - got).items())[:2])


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def test_op1(spark, tables):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = sorted(rows_of(tables, "documents"), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    want, start = [], 0
    for r in docs:
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want.append({"doc_id": r["doc_id"], "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(np.array(ids, "<u4").tobytes())})
        start += len(ids)
    same(queries.op1_token_store(spark, tables), want, ["doc_id", "start", "n_tokens", "ids_crc32"])


def test_op1_absent_keys_are_not_found(spark, odd):
    import public_tokenizers

    store = token_store.token_store(spark.read.parquet(f"{odd}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    asked = spark.createDataFrame([(i,) for i in range(1000, 3000)], "doc_id long")
    assert token_store.lookup(asked, store, "doc_id").count() == 0


def test_op1_one_key_of_very_many_rows(spark):
    """A repeated key fills several shards, is one entry of the index, and all its rows come back, each from its own place."""
    from pyspark.sql import functions as F

    docs = spark.range(100_000).selectExpr("if(id % 50 = 0, id, -7) AS doc_id", "concat('row ', id % 13) AS text").repartition(8)
    store = token_store.token_store(docs, queries.word_tokenizer())
    got = token_store.read_all(docs.select("doc_id").distinct(), store)
    n = got.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("start").alias("places")).orderBy("doc_id").collect()
    assert [(r.n, r.places) for r in n] == [(98_000, 98_000)] + [(1, 1)] * 2000
    shards = token_store.lookup(spark.createDataFrame([(-7,)], "doc_id long"), store, "doc_id").groupBy("shard").count().collect()
    assert len(shards) > 4 and max(r["count"] for r in shards) < 50_000


def test_op1_ranges_of_neighbours():
    first = np.array([0, 5, 9, 9, 20, 21])
    assert token_store.runs(first, np.array([0, 1, 3, 4]), 100) == [(0, 4)]
    assert token_store.runs(first, np.array([0, 3, 4]), 100) == [(0, 1), (1, 3)]
    assert token_store.runs(first, np.array([0, 1, 2, 3]), 9) == [(0, 3), (3, 4)]
    assert token_store.runs(first, np.array([1, 1]), 1) == [(0, 1), (1, 2)]


def test_perfect_hash_is_minimal():
    h = np.unique(np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 50_000))
    mph = token_store.PerfectHash.build(h)
    assert sorted(mph.places(h)) == list(range(len(h)))


def test_op2_against_article_text(spark, sf):
    """The test pages have one article each: its blocks are what lies between its tags."""
    got = {r.page_id: r for r in queries.op2_main_text(spark, sf).collect()}
    import html

    for p in rows_of(sf, "pages"):
        article = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(b for b in blocks if b)
        assert got[p["page_id"]].text == want
        assert got[p["page_id"]].n_chars == len(want)


def test_op2_marks_and_references():
    page = """<body class="has-sidebar"><header>H</header><div id=cookie-notice>ok?</div><main><h2>T&eacute;st &lt;b&gt;</h2><p>one<b>two</b> <span class=share>tweet</span> three<p>four
    <aside>side</aside><div class="comments"><p>nice</p></div><form>f</form><ul><li>a<li>b</ul></main><footer>F</footer>"""
    assert [t for z, t in html_main.blocks(page) if z == html_main.ARTICLE] == ["Tést <b>", "onetwo three", "four", "a", "b"]
    assert html_main.blocks("<p>cut off <b") == [(html_main.FRAME, "cut off")]
    assert html_main.blocks("a <!-- x") == [(html_main.FRAME, "a")]


def test_op2_parts_of_an_article():
    page = """<article><header class="entry-header"><h1>Headline</h1></header><div class="section-header"><h2>Part</h2></div><p>a &am<b>p;</b> b &amp; c</p><p style="display: none">hid</p>
    <article class="comment"><p>nice</p></article><article class="related-card">more</article><footer>f</footer></article><header>site</header>"""
    assert [t for z, t in html_main.blocks(page) if z == html_main.ARTICLE] == ["Headline", "Part", "a &amp; b & c"]


@pytest.mark.parametrize("page", ["<a" * 500_000, "<a '" * 250_000, "</b>" * 250_000, "<b>" * 150_000 + "<p>x</p>" * 50_000, "<div>" * 200_000 + "</i>" * 200_000, "<p><b>" * 150_000, "<!--" * 200_000, "&" * 1_000_000, "<script>" * 100_000])
def test_op2_hostile_pages_are_read_once(page):
    began = time.time()
    html_main.blocks(page)
    assert time.time() - began < 10


def test_op2_repeated_frames_go_on_pages_without_article(spark):
    line = "all rights reserved by the owners of this very fine site since long"
    pages = [(i, "http://h.example/x", f"<div><p>{line}</p><p>story{i} is told only here and nowhere else at all</p></div>") for i in range(6)]
    pages += [(9, "http://other.example/", f"<p>{line}</p>")]
    got = {r.page_id: r.text for r in html_main.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[3] == "story3 is told only here and nowhere else at all"
    assert got[9] == line


def test_op2_awkward(spark, odd):
    got = Counter((r.page_id, r.text, r.n_chars) for r in queries.op2_main_text(spark, odd).collect())
    assert got == Counter([(0, "one & two three", 15), (1, "", 0), (None, "same", 4), (2, "same", 4), (2, "same", 4), (3, "", 0)])


def test_op3(spark, tables):
    got = queries.op3_rendezvous_shards(spark, tables).collect()
    docs = rows_of(tables, "documents")
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((d["doc_id"], len((d["text"] or "").encode()) + 16, zlib.crc32((d["text"] or "").encode())) for d in docs)
    by = defaultdict(list)
    for r in got:
        assert r.law == "key" and 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    for k in {r.doc_id for r in got}:
        assert len({(r.shard, r.grown_shard) for r in got if r.doc_id == k}) == 1


def test_op3_weights_and_buckets(spark):
    docs = spark.range(20000).selectExpr("id AS doc_id", "'x' AS text")
    n = Counter(r.shard for r in sharding.shard(docs, {0: 1.0, 1: 3.0}, rows_per_bucket=500).collect())
    assert abs(n[1] / 20000 - 0.75) < 0.02
    slots = [r.slot for r in sharding.shard(docs, {0: 1.0, 1: 3.0}, rows_per_bucket=500).where("shard = 1").collect()]
    assert sorted(slots) == list(range(len(slots)))


def test_op3_without_texts(spark):
    """Digests in place of texts give the same shards and gapless slots, repeated keys and null texts included."""
    docs = spark.createDataFrame([(i % 7 if i % 5 else None, None if i % 4 == 0 else "é" * (i % 3), i) for i in range(200)], "doc_id long, text string, _t long")
    full = sharding.shard(docs, 3, rows_per_bucket=10).drop("text").collect()
    bare = sharding.shard(docs, 3, rows_per_bucket=10, drop_text=True)
    assert bare.columns == ["doc_id", "_t", "text_crc32", "size", "law", "shard", "slot", "grown_shard"]
    bare = bare.collect()
    assert Counter((r.doc_id, r._t, r["size"], r.shard, r.grown_shard) for r in full) == Counter((r.doc_id, r._t, r["size"], r.shard, r.grown_shard) for r in bare)
    assert sorted((r.shard, r.slot) for r in full) == sorted((r.shard, r.slot) for r in bare)


def contaminated(docs, tests, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t or ""))
    items = [("null" if i["item_id"] is None else str(i["item_id"]), words(i["text"])) for i in tests]
    out = []
    for d in docs:
        w = words(d["text"])
        hit, found = set(), set()
        for name, iw in items:
            n = min(window, len(iw))
            own = {tuple(iw[s : s + n]) for s in range(len(iw) - n + 1)} if n else set()
            for s in range(len(w) - n + 1) if own else ():
                if tuple(w[s : s + n]) in own:
                    hit |= set(range(s, s + n))
                    found.add(name)
        out.append({"doc_id": d["doc_id"], "n_words": len(w), "n_hit": len(hit), "n_items": len(found), "items_sha256": hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), "contaminated": bool(hit)})
    return out


@pytest.mark.parametrize("block_bytes", [32 << 20, 300])
def test_op4(spark, tables, block_bytes, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes if "sf" not in tables or block_bytes > 1000 else 4000)
    want = contaminated(rows_of(tables, "documents"), rows_of(tables, "benchmark"))
    same(queries.op4_decontamination(spark, tables), want, list(want[0]))


def test_op4_longest_matches(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "x y " + " ".join(f"w{i}" for i in range(5, 25)) + " z")], "doc_id long, text string")
    tests = spark.createDataFrame([(7, item)], "item_id long, text string")
    r = decontaminate.with_matches(docs, tests).first().matched
    assert [(m.item, m.item_start, m.doc_start, m.n_words) for m in r.matches] == [("7", 5, 2, 20)]
    assert decontaminate.drop_contaminated(docs, tests).count() == 0


def test_op4_matches_of_few_words(spark, monkeypatch):
    """Texts of three words, so that every window repeats: the longest matches that lie in no other, in one block and in many."""
    rng = np.random.default_rng(4)
    draw = lambda n: ["abc"[i] for i in rng.integers(0, 3, n)]
    items = {k: draw(int(rng.integers(1, 40))) for k in range(12)}
    docs = {k: draw(int(rng.integers(0, 60))) + (["x"] if k % 3 else []) + items[k % 12][: int(rng.integers(3, 40))] for k in range(30)}
    frame = lambda x, name: spark.createDataFrame([(k, " ".join(v)) for k, v in x.items()], f"{name} long, text string")
    got = {r.doc_id: r.matched for r in decontaminate.with_matches(frame(docs, "doc_id"), frame(items, "item_id"), 5).collect()}
    for k, d in docs.items():
        starts = {p for v in items.values() for n in [min(5, len(v))] for s in range(len(v) - n + 1) for p in range(len(d) - n + 1) if d[p : p + n] == v[s : s + n]}
        reach = {p: max(n for v in items.values() for s in range(len(v)) for n in range(len(v) - s + 1) if d[p : p + n] == v[s : s + n]) for p in starts}
        want = {(p, n) for p, n in reach.items() if not any(q < p and q + m >= p + n for q, m in reach.items())}
        assert {(m.doc_start, m.n_words) for m in got[k].matches} == want
        for m in got[k].matches:
            assert items[int(m.item)][m.item_start : m.item_start + m.n_words] == d[m.doc_start : m.doc_start + m.n_words]
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 400)
    parts = {r.doc_id: r.matched for r in decontaminate.with_matches(frame(docs, "doc_id"), frame(items, "item_id"), 5).collect()}
    assert all((parts[k].words, parts[k].hits, parts[k]["items"]) == (got[k].words, got[k].hits, got[k]["items"]) for k in docs)


def test_op4_one_word_repeated(spark):
    """A megabyte of one word against an item of the same word, in seconds."""
    docs = spark.createDataFrame([(1, "same " * 200_000), (2, "same " * 9)], "doc_id long, text string")
    tests = spark.createDataFrame([(7, "same " * 2000), (8, "same " * 500)], "item_id long, text string")
    began = time.time()
    got = {r.doc_id: r.matched for r in decontaminate.with_matches(docs, tests).collect()}
    assert time.time() - began < 30
    assert len(got[1].hits) == 200_000 and got[1]["items"] == ["7", "8"] and got[2].hits == []
    assert all(m.n_words == 2000 for m in got[1].matches)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    t = t or ""
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(d := re.sub(r"\D", "", v)) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(re.sub(r"\D", "", v)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, t) if ok(m[0])]


def test_op5(spark, tables):
    want = []
    for d in rows_of(tables, "documents"):
        found = base_spans(d["text"])
        want.append({"doc_id": d["doc_id"], **{f"n_{k}": sum(x[0] == k for x in found) for k in ("email", "ip", "card", "phone")}, "base_sha256": hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()})
    df = queries.op5_pii_boosting(spark, tables).cache()
    same(df, want, list(want[0]))
    texts = {(d["doc_id"]): d["text"] or "" for d in rows_of(tables, "documents")}
    for r in df.collect():
        spans = [x.split(":") for x in r.spans.split(",")] if r.spans else []
        assert {f"{k}:{a}:{b}" for k, a, b in base_spans(texts[r.doc_id])} <= {":".join(x) for x in spans}


def test_op5_long_texts(spark):
    """Megabytes of one letter, of a piece that is almost an address, and of very many spans, each in seconds; places are exact."""
    rows = [(1, "a" * 1_000_000 + " at"), (2, "a(at) " * 150_000), (3, "b@c.de 1.2.3.4 " * 40_000), (4, "x" * 700), (5, "+1 " + " " * 500_000), (6, "1" * 500_000), (7, "a@" * 300_000)]
    pii.train(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7, "doc_id")
    began = time.time()
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    assert time.time() - began < 60
    unit, n = len("b@c.de 1.2.3.4 "), 40_000
    assert [(x.kind, x.start, x.end) for x in got[3].pii_base] == [("email", unit * i, unit * i + 6) for i in range(n)] + [("ip", unit * i + 7, unit * i + 14) for i in range(n)]
    assert not any(got[k].pii_base for k in got if k != 3)


def test_op5_planted_tokens(spark, sf):
    """Every assigned token of the corpus is found whole, and no run of letters alone is."""
    docs = {d["doc_id"]: d["text"] or "" for d in rows_of(sf, "documents")}
    got = {r.doc_id: r.spans for r in queries.op5_pii_boosting(spark, sf).collect()}
    for k, t in docs.items():
        found = {tuple(map(int, x.split(":")[1:])) for x in got[k].split(",") if x.startswith("secret:")}
        for m in re.finditer(r'token = "([0-9a-f]{40})"', t):
            assert any(a <= m.start(1) and m.end(1) <= b for a, b in found)
        assert not any(t[a:b].isalpha() and t[a:b].islower() for a, b in found)


def test_op5_held_out_accuracy(spark):
    """Examples of another seed than the trained ones."""
    trees = pii.train(spark)
    d = spark.sql(pii.examples_sql(2000, 99)).selectExpr("k", "y", "named_struct('k', k, 'v', v, 'l', l) AS x")
    d = d.selectExpr("k", "y", f"array({', '.join(pii.features('x'))}) AS f").selectExpr("k", "y", f"CASE WHEN {trees.accepted('k', '(' + trees.score() + ')')} THEN 1 ELSE 0 END AS z").collect()
    right = sum(r.y == r.z for r in d) / len(d)
    taken = [r.y for r in d if r.z]
    assert right > 0.9 and sum(taken) / len(taken) > 0.93


def test_op5_candidates_and_redaction(spark):
    rows = [(1, "Tel: (555) 123-4567 and password=1a2b3c4d5e6f7a8b9c0d"), (2, "version 1.2.3.0 of 2024-05-06, order 12 345 678"), (3, "plain words only, nothing else"), (4, "me@x.org now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert got[1] == "Tel: [PHONE] and [SECRET]"
    assert "2024-05-06" in got[2]
    assert got[3] == rows[2][1] and got[4] == "[EMAIL] now"


def test_op6(spark, tables):
    want = []
    for d in rows_of(tables, "documents"):
        t = d["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(zip(w, w[1:], w[2:]))
        rep = {p for s in range(len(w) - 2) if grams[tuple(w[s : s + 3])] > 1 for p in range(s, s + 3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want.append({"doc_id": d["doc_id"], "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(rep), "base_failed": len(w) < 50 or 100 * len(rep) > 50 * len(w)})
    same(queries.op6_quality_rules(spark, tables), want, list(want[0]))


def test_op6_rules_bind(spark):
    good = " ".join(f"the word{i} of thing{i}" for i in range(40))
    rows = [(1, good), (2, good.replace("the", "###### ######")), (3, " ".join(f"qzx{i}" for i in range(100)))]
    got = {r.doc_id: r.quality.kept for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False, 3: False}


def simhash_of(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))
    s = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(fps, bits):
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fs = sorted(parent)
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if (a ^ b).bit_count() <= bits:
                parent[root(a)] = root(b)
    return {f: root(f) for f in fs}


def test_op7(spark, tables):
    docs = rows_of(tables, "documents")
    fp = [simhash_of(d["text"]) for d in docs]
    root = grouped(fp, 4)
    low = {}
    for d, f in zip(docs, fp):
        if d["doc_id"] is not None:
            low[root[f]] = min(low.get(root[f], d["doc_id"]), d["doc_id"])
    want = [{"doc_id": d["doc_id"], "fingerprint": f"{f:016x}", "component_id": low.get(root[f])} for d, f in zip(docs, fp)]
    same(queries.op7_simhash(spark, tables), want, ["doc_id", "fingerprint", "component_id"])


@pytest.mark.parametrize("bits", [4, 8])
def test_op7_links_of_a_dense_cluster(spark, bits):
    rng = np.random.default_rng(bits)
    fps = {0, -1, 1 << 62}
    for c in [0x123456789ABCDEF0, 0, *map(int, rng.integers(0, 2**63, 40))]:
        for _ in range(25):
            x = c
            for b in rng.choice(64, rng.integers(0, bits + 1), replace=False):
                x ^= 1 << int(b)
            fps.add(x - 2**64 if x >= 2**63 else x)
    got = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), bits).collect()
    u = lambda x: x % 2**64
    assert all((u(r.a) ^ u(r.b)).bit_count() == r.bits <= bits for r in got)
    want = grouped([u(f) for f in fps], bits)
    parent = {u(f): u(f) for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in got:
        parent[root(u(r.a))] = root(u(r.b))
    classes = lambda of: {frozenset(k for k in of if of[k] == v) for v in set(of.values())}
    assert classes({k: root(k) for k in parent}) == classes(want)


def test_op7_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (-5, 1001)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 1000: -5, 1001: -5, -5: -5}


@pytest.mark.parametrize("hot", [1000, 3])
def test_components_of_stars_and_loops(spark, hot, monkeypatch):
    """Centres with the smallest, the largest and a middle name, also as nodes that are looked up by broadcast."""
    monkeypatch.setattr("acreline.operators.graph.HOT_LINKS", hot)
    edges = [(0, i) for i in range(1, 60)] + [(999, i) for i in range(100, 150)] + [(225, i) for i in range(200, 250)] + [(i, i + 1) for i in range(300, 320)] + [(7, 7), (500, None), (600, 601), (601, 600), (600, 601)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(60), 0), **dict.fromkeys([*range(100, 150), 999], 100), **dict.fromkeys(range(200, 250), 200), **dict.fromkeys(range(300, 321), 300), 600: 600, 601: 600}


def test_op7_full_buckets_are_split(spark):
    """The same links' components when a task may hold few fingerprints of a bucket only."""
    rng = np.random.default_rng(3)
    fps = sorted({int(np.bitwise_xor.reduce([0x123456789ABCDEF0] + [1 << int(b) for b in rng.choice(63, rng.integers(0, 7), replace=False)])) for _ in range(300)})
    root = grouped(fps, 4)
    low = {f: min(x for x in fps if root[x] == root[f]) for f in fps}
    got = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), 4, most=6)).collect()}
    assert {f: got.get(f, f) for f in fps} == low and len(set(low.values())) < len(fps)


def test_near_duplicate_stage(spark):
    words = [f"w{i * 7919 % 5003}" for i in range(400)]
    near = words.copy()
    near[200] = "changed"
    other = [f"v{i * 7907 % 5003}" for i in range(400)]
    rows = [(1, " ".join(words), 1), (2, " ".join(near), 2), (3, " ".join(words), 3), (4, " ".join(other), 4), (5, None, 5), (6, "", 6), (4, " ".join(other), 7), (None, " ".join(words), 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = simhash.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 4, 5]


def test_near_duplicate_stage_keeps_large_keys(spark):
    """Keys beyond the whole numbers of a double stay exact beside null keys."""
    rows = [(2**60 + i, f"text number {i % 2} has some words") for i in range(4)] + [(None, "another text")]
    got = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id or 0 for r in got.collect()) == [0, 2**60, 2**60 + 1]


def similar_groups(texts, least=0.8, width=5):
    """Components of the links of texts by brute force: {key: smallest key of its component}, and the similarities."""
    sets = {k: set(np.unique(simhash.shingle_hashes(t, width)).tolist()) for k, t in texts.items()}
    root, js = {k: k for k in texts}, {}
    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            js[a, b] = both / (len(sets[a]) + len(sets[b]) - both)
            if js[a, b] >= least and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    return root, js


def test_near_duplicate_stage_finds_far_fingerprints(spark):
    """Appended and replaced passages of J 0.80 to 0.90 and a little below, many over 8 bits apart."""
    rng, texts = np.random.default_rng(5), {}
    for k in range(60):
        n = int(rng.integers(60, 300))
        words = [f"w{x}" for x in rng.integers(0, 3000, n)]
        texts[2 * k] = " ".join(words)
        new = [f"v{x}" for x in rng.integers(0, 3000, int(n * rng.uniform(0.02, 0.25)))]
        at = int(rng.integers(0, n - len(new)))
        texts[2 * k + 1] = " ".join(words + new if k % 2 else words[:at] + new + words[at + len(new) :])
    root, js = similar_groups(texts)
    far = [p for p, j in js.items() if 0.8 <= j <= 0.9 and (simhash.fingerprint(texts[p[0]], 3) ^ simhash.fingerprint(texts[p[1]], 3)).bit_count() > 8]
    assert len(far) >= 5 and any(0.7 < j < 0.8 for j in js.values())
    got = simhash.drop_near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(root.values()))


@pytest.mark.parametrize("edits", [6, 10])
def test_near_duplicate_stage_in_dense_families(spark, edits):
    """Variants of a text of which many pairs lie below J 0.8: chains of verified links decide, not links to one head."""
    rng, texts = np.random.default_rng(edits), {}
    for family in range(4):
        words = [f"w{x}" for x in rng.integers(0, 3000, 300)]
        for v in range(40):
            own = words.copy()
            for at in rng.choice(300, rng.integers(1, edits + 1), replace=False):
                own[at] = f"v{rng.integers(0, 3000)}"
            texts[100 * family + v] = " ".join(own)
    root, js = similar_groups(texts)
    assert 4 < len(set(root.values())) < 160 and any(0.7 < j < 0.8 for j in js.values())
    got = simhash.drop_near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(root.values()))


def test_near_duplicate_blocks_meet(spark):
    """All pairs of a bucket are seen, also across blocks and sketches of different sizes."""
    rng = np.random.default_rng(9)
    words = [f"w{x}" for x in rng.integers(0, 3000, 270)]
    texts = {k: " ".join(words[: int(n)]) for k, n in enumerate(rng.integers(200, 270, 40))}
    texts = {k: t for k, t in texts.items() if t not in list(texts.values())[:k]}
    prints = simhash.shingle_sets(spark.createDataFrame(list(texts.items()), "n long, _t string"), 5).cache()
    assert len({len(r.sketch) for r in prints.collect()}) == 2
    one = prints.selectExpr("0L AS s", "n", "size", "n AS root", f"{len(texts)}L AS k", "0L AS sizes")
    root, js = similar_groups(texts)
    first = {(r.x, r.y) for r in simhash.close_links(one, prints, 0.8, False, 7).where("NOT more").collect()}
    last = {(r.x, r.y) for r in simhash.close_links(one, prints, 0.8, True, 7).collect()}
    assert last <= {p for p, j in js.items() if j >= 0.8} and len(last) >= len(texts) - len(set(root.values()))
    found = {r.node: r.root for r in components(spark.createDataFrame(sorted(last), "a long, b long")).collect()}
    assert {n: found.get(n, n) for n in texts} == root
    assert simhash.close_links(one, prints, 0.8, False, 7).where("more AND x = 0").count() or first >= {p for p, j in js.items() if j >= 0.8}
    # bounded by the sum of sizes too: a shingle a block
    assert {(r.x, r.y) for r in simhash.close_links(one.withColumn("sizes", F.lit(900_000)), prints, 0.8, True, shingles=50_000).collect()} <= {p for p, j in js.items() if j >= 0.8}


@pytest.mark.parametrize("seed", range(4))
def test_near_duplicate_stage_on_variants(spark, seed):
    """Many variants of one text just above and below the similarity: no link is lost, in whatever bucket it lies."""
    texts = {}
    rng = np.random.default_rng(seed)
    if seed < 3:
        vocabulary = [f"w{x}" for x in range(400)]
        words = list(rng.choice(vocabulary, 200))
        for v in range(300):
            own = words.copy()
            for at in rng.choice(200, rng.integers(1, 10), replace=False):
                own[at] = str(rng.choice(vocabulary))
            texts[v] = " ".join(own)
    else:
        for family in range(8):
            words = [f"w{x}" for x in rng.integers(0, 3000, 300)]
            for v in range(40):
                own = words.copy()
                for at in rng.choice(300, rng.integers(1, 12), replace=False):
                    own[at] = f"v{rng.integers(0, 3000)}"
                texts[100 * family + v] = " ".join(own)
    texts = {k: t for k, t in texts.items() if t not in {x for j, x in texts.items() if j < k}}
    root, js = similar_groups(texts)
    got = simhash.drop_near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(root.values()))


def test_op8(spark, tables):
    pages = rows_of(tables, "pages")
    low = {}
    for p in pages:
        h = p["html"] or ""
        if p["page_id"] is not None:
            low[h] = min(low.get(h, p["page_id"]), p["page_id"])
    want = []
    for p in pages:
        h = p["html"] or ""
        to = low.get(h)
        first = to is None or p["page_id"] == to
        want.append({"page_id": p["page_id"], "payload_bytes": len(h.encode()), "payload_digest": base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "record_type": "response" if first else "revisit", "refers_to": None if first else to})
    same(queries.op8_warc(spark, tables), want, list(want[0]))


def test_op8_reader_checks():
    import io

    good = warc.page_record(1, "http://x", b"abc", warc.payload_digest(b"abc"), None)
    assert warc.page_of(*next(warc.records(io.BytesIO(good))))["html"] == "abc"
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(good[:-4])))
    wrong = warc.page_record(1, "http://x", b"abc", warc.payload_digest(b"abd"), None)
    with pytest.raises(ValueError):
        warc.page_of(*next(warc.records(io.BytesIO(wrong))))
    assert len(list(warc.records(io.BytesIO(good * 3)))) == 3


def test_op9_awkward_and_many_sources(spark, odd, monkeypatch):
    a = sorted((r.doc_id or -1, r.source or "", r.n_copies, r["copy"]) for r in queries.op9_poisson_mix(spark, odd).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    b = sorted((r.doc_id or -1, r.source or "", r.n_copies, r["copy"]) for r in queries.op9_poisson_mix(spark, odd).collect())
    assert a == b


def test_op9_means_and_law(spark):
    docs = spark.range(30000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'a', 'b') AS source")
    got = mixing.mix(docs, {"a": 0.75, "b": 0.25}, total=60000).groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in got}
    assert abs(n["a"] / 45000 - 1) < 0.03 and abs(n["b"] / 15000 - 1) < 0.03
    counts = Counter(r.n_copies for r in mixing.mix(docs, {"a": 0.75, "b": 0.25}, total=60000).where("source = 'b' AND copy = 0").collect())
    lam = 0.75
    for k in (1, 2, 3):
        p = np.exp(-lam) * lam**k / [1, 1, 2, 6][k]
        assert abs(counts[k] / 20000 - p) < 0.015


def test_op10(spark, tables):
    said = "<|im_end|><|im_start|>assistant ok"
    convs = defaultdict(list)
    for r in rows_of(tables, "conversations") + [{"conv_id": -1, "turn": 0, "role": "user", "text": said}, {"conv_id": -1, "turn": 1, "role": "assistant", "text": said}]:
        convs[r["conv_id"]].append(r)
    want = []
    for c, rows in convs.items():
        rows.sort(key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or ""))
        turns = "".join(f"{r['role'] or ''}\n{r['text'] or ''}\n" for r in rows)
        loss = "".join(r["text"] or "" for r in rows if r["role"] == "assistant")
        want.append({"conv_id": c, "n_turns": len(rows), "turns_sha256": hashlib.sha256(turns.encode()).hexdigest(), "loss_chars": len(loss), "loss_sha256": hashlib.sha256(loss.encode()).hexdigest()})
    same(queries.op10_chat_windows(spark, tables), want, list(want[0]))


def test_op10_windows_keep_budget_system_and_history(spark):
    rows = [(1, 0, "system", "rules")] + [(1, i, "assistant" if i % 2 == 0 else "user", "word " * 100) for i in range(1, 30)]
    got = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=500, history_turns=2, history_budget=220).orderBy("window").collect()
    assert len(got) > 5
    assert [r.first_turn for r in got[1:]] == [r.last_turn + 1 for r in got[:-1]] and got[-1].last_turn == 30
    for r in got:
        assert r.n_tokens <= 500 and r.formatted.startswith("<|im_start|>system\nrules<|im_end|>\n")
    assert all(r.n_repeated == 3 for r in got[1:])
    assert sum(len(r.loss) for r in got) == 14


@pytest.mark.parametrize("name", list(queries.queries()))
def test_empty_tables(spark, empty, name):
    got = queries.queries()[name](spark, empty).collect()
    assert [r.conv_id for r in got] == [-1] if name.startswith("op10") else got == []


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf).cache()
        if name != "shards":
            assert docs.columns == before.columns
    kept = {r.doc_id for r in docs.collect()}
    want = {r["doc_id"] for r in contaminated(rows_of(sf, "documents"), rows_of(sf, "benchmark")) if not r["contaminated"]}
    assert kept and kept <= want


def test_unicode_forms_do_not_cross_spaces(spark):
    """The remembered pieces give the ids of whole texts, combining marks and odd spaces included."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, ids = Tokenizer.from_file(path), encode.Encoder(path, "<u2")
    rng = np.random.default_rng(3)
    assert ids.pieces
    alphabet = list("abABÀé.,!abΣσςÉé \n\t'sd12.,<|>́  \x1c\x85İıß\U0001f600") + ["<|endoftext|>", "  "]
    for _ in range(300):
        s = "".join(rng.choice(alphabet, 40))
        for form in (s, unicodedata.normalize("NFD", s)):
            assert np.frombuffer(ids.of([form])[0], "<u2").tolist() == t.encode(form, add_special_tokens=False).ids


def test_op10_budget_holds(spark):
    """Only a new turn that with its system turn is too long goes over the budget; history gives way. Counts may be given."""
    rng, rows = np.random.default_rng(10), []
    for c in range(40):
        for i in range(int(rng.integers(1, 30))):
            n = int(rng.choice([3, 40, 250, 905, 1200], p=[0.3, 0.3, 0.2, 0.15, 0.05]))
            rows.append((c, i, "system" if i == 0 and c % 2 else ["user", "assistant"][i % 2], "w " * n, n))
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, counts int")
    cost, system = {(r[0], r[1] + 1): r[4] + chat.MARKERS for r in rows}, {r[0] for r in rows if r[2] == "system"}
    for given in (None, "counts"):
        got = chat.windows(turns, 1024, tokens=given).collect()
        for w in got:
            head = cost[w.conv_id, 1] if w.conv_id in system and w.first_turn > 1 else 0
            assert w.n_tokens <= 1024 or w.first_turn == w.last_turn and w.n_repeated == (1 if head else 0) and w.n_tokens == head + cost[w.conv_id, w.first_turn]
        assert sum(w.last_turn - w.first_turn + 1 for w in got) == len(rows)


def test_op10_long_conversation(spark):
    turns = spark.range(100_000).selectExpr("0L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "repeat('word ', 20) AS text")
    began = time.time()
    assert chat.windows(turns).agg({"n_tokens": "max"}).first()[0] <= 1024
    assert time.time() - began < 30


def good(text):
    """The rule table in plain Python."""
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(w, w[1:], w[2:]))
    rep = len({p for s in range(len(w) - 2) if grams[tuple(w[s : s + 3])] > 1 for p in range(s, s + 3)})
    chars = sum(map(len, w))
    share = lambda x, n: x / n if n else 0.0
    m = {
        "n_words": len(w),
        "mean_word_chars": share(chars, len(w)),
        "symbol_ratio": share(len(re.findall(r"[#*$%&|<>]", t)), chars),
        "stop_ratio": share(sum(x.lower() in quality.STOP_WORDS for x in w), len(w)),
        "dup_line_ratio": share(len(lines) - len(set(lines)), len(lines)),
        "repeat_ratio": share(rep, len(w)),
        "ellipsis_line_ratio": share(sum(x.rstrip(" ").endswith(("...", "…")) for x in lines), len(lines)),
        "bullet_line_ratio": share(sum(x.lstrip(" ").startswith(("- ", "* ", "•")) for x in lines), len(lines)),
    }
    return len(w) >= 50 and 100 * rep <= 50 * len(w) and all(m[k] >= b if sign == ">=" else m[k] <= b for k, sign, b in quality.RULES)


def winner(key, n):
    """The shard of 0 to n - 1 with the best rendezvous score, from the public definition of XXH64."""
    scores = []
    for s in range(n):
        h = 42
        for part in (np.int32(42).tobytes(), np.int32(s).tobytes(), ("null" if key is None else str(key)).encode()):
            h = xxhash.xxh64_intdigest(part, h)
        scores.append((-np.log(((h >> 11) + 0.5) / 2**53), s))
    return min(scores)[1]


def copies(docs):
    """Rows with their Poisson count at the hash of key and source, those of count 0 left out."""
    n = Counter(d["source"] or "" for d in docs)
    left = max(0.0, 1 - sum(mixing.TARGETS.get(s, 0.0) for s in n)) / max(1, sum(s not in mixing.TARGETS for s in n))
    weight = {s: mixing.TARGETS.get(s, left) for s in n}
    for d in docs:
        s = d["source"] or ""
        rate = weight[s] / sum(weight.values()) * len(docs) / n[s]
        u = (int(hashlib.md5(f"42:{'null' if d['doc_id'] is None else d['doc_id']}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        k, term = 0, np.exp(-rate)
        below = term
        while below < u:
            k += 1
            term *= rate / k
            below += term
        yield from [d] * k


def test_op3_winners(spark, tables):
    """Each row is in the shard of the best score of all, with 40 shards and with 41."""
    best = {k: (winner(k, 40), winner(k, 41)) for k in {d["doc_id"] for d in rows_of(tables, "documents")}}
    for r in queries.op3_rendezvous_shards(spark, tables).collect():
        assert (r.shard, r.grown_shard) == best[r.doc_id]


@pytest.fixture(scope="module")
def planted(sf, tmp_path_factory):
    """The documents of sf with exact and near copies, benchmark passages and texts that the rules reject."""
    docs, tests = rows_of(sf, "documents"), rows_of(sf, "benchmark")
    fine = [d for d in docs if good(d["text"]) and len(d["text"].split()) > 80][:40]
    item = max((t["text"] for t in tests), key=len)
    top = max(d["doc_id"] for d in docs)
    add = lambda d, text: docs.append({**d, "doc_id": top + len(docs), "text": text})
    for i, d in enumerate(fine):
        words = d["text"].split(" ")
        add(d, d["text"] if i % 4 == 0 else " ".join([*words[:-3], "some", "other", "end"]) if i % 4 == 1 else d["text"] + "\n" + item if i % 4 == 2 else " ".join(words[:30]))
        add(d, " ".join([*words[:40], *[f"new{i}x{k}" for k in range(len(words) // (4 + i % 9))], *words[40:]]))
    add(fine[0], None), add(fine[0], "")
    out = tmp_path_factory.mktemp("planted")
    pq.write_table(pa.Table.from_pylist(docs, pq.read_schema(f"{sf}/documents.parquet")), out / "documents.parquet")
    pq.write_table(pq.read_table(f"{sf}/benchmark.parquet"), out / "benchmark.parquet")
    return str(out)


def test_pipeline_against_plain_python(spark, planted):
    """All rows of run(), with their numbers of copies and shards; each stage has something to do."""
    import corpus_pipeline

    docs = rows_of(planted, "documents")
    kept = [d for d in docs if good(d["text"])]
    low = {}
    for d in kept:
        low[d["text"]] = min(low.get(d["text"], d["doc_id"]), d["doc_id"])
    root, js = similar_groups({k: t for t, k in low.items()})
    one = [d for d in kept if root.get(d["doc_id"]) == d["doc_id"]]
    hit = {r["doc_id"] for r in contaminated(one, rows_of(planted, "benchmark")) if r["contaminated"]}
    clean = [d for d in one if d["doc_id"] not in hit]
    mixed = list(copies(clean))
    assert len(docs) > len(kept) > len(one) > len(clean) and any(0.8 <= j < 1 for j in js.values()) and any(0.6 < j < 0.8 for j in js.values())
    got = corpus_pipeline.run(spark, planted).collect()
    of = {d["doc_id"]: (len(d["text"].encode()) + 16, winner(d["doc_id"], 40), winner(d["doc_id"], 41)) for d in clean}
    assert Counter((r.doc_id, r.text, r.source, r["size"], r.shard, r.grown_shard) for r in got) == Counter((d["doc_id"], d["text"], d["source"], *of[d["doc_id"]]) for d in mixed)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_pipeline_on_awkward_rows(spark, odd):
    """Of the odd rows the rules keep none, as plain Python says; the stages alone take all of them."""
    import corpus_pipeline

    docs = rows_of(odd, "documents")
    kept = [d for d in docs if good(d["text"])]
    assert corpus_pipeline.run(spark, odd).count() == len(list(copies(kept))) == 0
    every = spark.read.parquet(f"{odd}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[1:]:
        got = [r.asDict() for r in stage(spark, every, odd).collect()]
        if name == "near duplicates":
            want = {}
            for d in docs:
                k = tuple(re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(d["text"] or "")))
                want[k] = min(want.get(k, (True, 0)), (d["doc_id"] is None, d["doc_id"] or 0))
            assert Counter(r["doc_id"] for r in got) == Counter(None if none else k for none, k in want.values())
        elif name == "benchmark passages":
            bad = [c["contaminated"] for c in contaminated(docs, rows_of(odd, "benchmark"))]
            assert Counter(r["doc_id"] for r in got) == Counter(d["doc_id"] for d, x in zip(docs, bad) if not x)
        elif name == "source mix":
            assert Counter(r["doc_id"] for r in got) == Counter(d["doc_id"] for d in copies(docs))
        else:
            assert len(got) == len(docs)
