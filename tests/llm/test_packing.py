"""Packing against plain Python: every id in one piece, sequences full but the last."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from acreline.llm import encode, packing, queries


def ids_of(texts, end=1):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.word_tokenizer())
    return [[*t.encode(x or "", add_special_tokens=False).ids, end] for x in texts]


def check(rows, docs, width):
    """rows of pieces against docs (key, text), which may repeat."""
    rows = [r.asDict() for r in rows]
    whole = Counter((repr(k), tuple(x)) for (k, _), x in zip(docs, ids_of(t for _, t in docs)))
    at = defaultdict(list)
    for r in rows:
        at[r["sequence_id"]].append(r)
    assert sorted(at) == list(range(len(at)))
    used = {}
    for s, own in at.items():
        place = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == place and r["length"] > 0
            place += r["length"]
        used[s] = place
    assert all(used[s] == width for s in range(len(at) - 1)) and (not at or 0 < used[len(at) - 1] <= width)
    # documents follow each other, so pieces in the order of the stream are whole documents
    stream = sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]))
    left, i = whole.copy(), 0
    while i < len(stream):
        own = [stream[i]]
        while own[-1]["start"] + own[-1]["length"] < own[-1]["doc_tokens"]:
            own.append(stream[i + len(own)])
        key, fits = repr(own[0]["doc_id"]), None
        for k, x in left:
            if k == key and len(x) == own[0]["doc_tokens"] and left[k, x] and all(r["doc_id"] == own[0]["doc_id"] and zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for r in own):
                fits = k, x
        assert fits and own[0]["start"] == 0 and all(a["start"] + a["length"] == b["start"] for a, b in zip(own, own[1:]))
        left[fits] -= 1
        i += len(own)
    assert not +left


def test_op13_equals_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
    check(queries.op13_concat_and_cut(spark, sf).collect(), docs, 2048)


AWKWARD = [(None, "no key"), (None, None), (1, ""), (1, ""), (2, "word " * 9000), (3, "é́ İstanbul  x\ty\n" * 50), (4, "<|endoftext|> it's 12 o'clock\x1cand\x85more"), (5, " \n"), (5, "twice"), (5, "twice"), (6, "́a b‍ c" * 30)]


@pytest.mark.parametrize("width, files", [(2048, 1), (7, 1), (7, 40), (64, 200), (1, 3)])
def test_awkward_rows_in_many_partitions(spark, width, files):
    """Windows over many partitions, some empty; one document over many windows."""
    df = spark.createDataFrame([(k, t, "clash", 1) for k, t in AWKWARD], "doc_id long, text string, ids string, part int").repartition(files)
    check(packing.pieces(packing.pack(df, queries.word_tokenizer(), width), width).collect(), AWKWARD, width)


def test_padding_and_records(spark):
    df = spark.createDataFrame([("a", "one two three"), ("b", "four")], "k string, body string")
    got = packing.pack(df.coalesce(1), queries.word_tokenizer(), 16, end_id=70000, pad_id=9, key="k", text="body").collect()
    want = sum(ids_of(["one two three", "four"], 70000), [])
    assert len(got) == 1 and np.frombuffer(got[0].ids, "<u4").tolist() == want + [9] * (16 - len(want)) and got[0].n_tokens == len(want)
    assert [(p.key, p.start, p.offset) for p in got[0].pieces] == [("a", 0, 0), ("b", 0, 4)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(df, queries.word_tokenizer()).count() == 0


def test_remembered_pieces_are_whole_texts(sf):
    """The ids of pieces equal those of whole texts, awkward ones too."""
    texts = [r["text"] for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()] + [t for _, t in AWKWARD]
    e = encode.Encoder(queries.word_tokenizer(), "<u2")
    assert e.pieces
    assert [np.frombuffer(x, "<u2").tolist() for x in e.of(texts)] == [x[:-1] for x in ids_of(texts)]
    assert e.of(texts) == e.of(texts)
    other = encode.Encoder(queries.word_tokenizer().replace("word_bpe_49k", "byte_bpe_50k"), "<u2")
    assert not other.pieces and len(other.of(texts)) == len(texts)
