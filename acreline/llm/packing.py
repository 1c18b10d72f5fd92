"""Packing documents into sequences of one length: concatenate and cut.

Pass one encodes each document and writes its ids with its place inside its partition; the token totals of the partitions
give, as prefix sums, the place of every document in one stream of all ids. Pass two cuts the stream at every width ids.
A window that lies inside a partition is made there; what a partition has of the windows at its two ends are fragments,
at most two a partition, and only these are dealt out and joined. A sequence has the ids and a record for each document
in it, which tell where documents begin and end.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, written
from .encode import encoder, id_type, parts


def encoded(docs: DataFrame, tokenizer: str, end_id: int, key: str, text: str) -> DataFrame:
    """(part, at, key, n, ids): the ids of each document with end_id behind them, and how many its partition has before."""
    dtype, kind = id_type(tokenizer, end_id), docs.schema[key].dataType.simpleString()

    def of(batches):
        part, at, end = TaskContext.get().partitionId(), 0, np.array([end_id], dtype).tobytes()
        width = np.dtype(dtype).itemsize
        for batch in batches:
            texts = batch["t"].tolist()
            for a, b in parts(texts):
                ids = [x + end for x in encoder(tokenizer, dtype).of(texts[a:b])]
                n = np.array([len(x) // width for x in ids], np.int64)
                yield pd.DataFrame({"part": part, "at": at + np.cumsum(n) - n, "key": batch["key"].iloc[a:b].to_numpy(), "n": n, "ids": ids})
                at += int(n.sum())

    return docs.select(F.col(key).alias("key"), F.col(text).alias("t")).mapInPandas(of, f"part int, at long, key {kind}, n long, ids binary")


def bases(tokens: DataFrame) -> DataFrame:
    """(part, base): how many ids all partitions before have. A row a partition, as many as pass one had tasks."""
    n = tokens.groupBy("part").agg(F.max(F.col("at") + F.col("n")).alias("total"))
    return n.select("part", (F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("total")).alias("base"))


PIECE = "struct<key:{}, start:bigint, length:int, offset:int, doc_tokens:bigint>"


def fragments(tokens: DataFrame, width: int, item: int) -> DataFrame:
    """(sequence_id, first, n, ids, pieces): what each run of consecutive documents has of its windows; n is width where that is all.

    tokens are rows (part, base, at, key, n, ids), a partition's in order. first is the place in the window.
    """
    kind = tokens.schema["key"].dataType.simpleString()

    def of(batches):
        # the window in work: its number, its ids so far, its pieces, and where the first of them begins
        window, held, pieces, first, place = None, [], [], 0, None
        for batch in batches:
            out = []
            for base, at, key, n, ids in zip(batch["base"], batch["at"], batch["key"], batch["n"], batch["ids"]):
                g, start = int(base) + int(at), 0
                if g != place and pieces:  # rows of another partition follow
                    out.append((window, first, b"".join(held), pieces))
                    held, pieces = [], []
                key = None if pd.isna(key) else key
                while start < n:
                    w, offset = divmod(g + start, width)
                    length = min(width - offset, int(n) - start)
                    if not pieces:
                        window, first = w, offset
                    held.append(ids[start * item : (start + length) * item])
                    pieces.append({"key": key, "start": start, "length": length, "offset": offset, "doc_tokens": int(n)})
                    start += length
                    if offset + length == width:
                        out.append((window, first, b"".join(held), pieces))
                        held, pieces = [], []
                        if len(out) >= 1000:
                            yield pd.DataFrame(out, columns=["sequence_id", "first", "ids", "pieces"])
                            out = []
                place = g + int(n)
            if out:
                yield pd.DataFrame(out, columns=["sequence_id", "first", "ids", "pieces"])
        if pieces:
            yield pd.DataFrame([(window, first, b"".join(held), pieces)], columns=["sequence_id", "first", "ids", "pieces"])

    made = tokens.mapInPandas(of, f"sequence_id long, first int, ids binary, pieces array<{PIECE.format(kind)}>")
    return made.withColumn("n", (F.octet_length("ids") / item).cast("int"))


def pack(docs: DataFrame, tokenizer: str, width: int = 2048, end_id: int = 1, pad_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(sequence_id, ids, n_tokens, pieces): all documents in sequences of width ids, numbered from 0 without gaps.

    ids are little-endian unsigned integers of 2 bytes if every id fits, else 4. n_tokens counts them without padding;
    only the last sequence is padded, with pad_id. pieces is one record (key, start, length, offset, doc_tokens) for each
    document in the sequence, by offset: start counts the document's ids before, doc_tokens all of them with the end id.
    Documents follow each other in the order of the table's partitions and rows; the order is fixed as pass one is
    written. A null text is empty and gives the end id alone; null and repeated keys and repeated rows are documents like
    any other; a very long document fills many sequences. No documents, no sequences. Only key and text are read.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    dtype = id_type(tokenizer, max(end_id, pad_id))
    item = np.dtype(dtype).itemsize
    tokens = scratch.written(encoded(docs, tokenizer, end_id, key, text), "tokens")
    # a task reads runs of rows of one or more partitions; their places tell where a run ends
    made = written(fragments(tokens.join(F.broadcast(bases(tokens)), "part").select("part", "base", "at", "key", "n", "ids"), width, item), "sequences")
    scratch.clear()
    ends = made.where(F.col("n") < width).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("first", "ids", "n", "pieces"))).alias("f"))
    joined = ends.select("sequence_id", F.expr("aggregate(f, cast('' AS binary), (s, x) -> concat(s, x.ids))").alias("ids"), F.expr("aggregate(f, 0, (s, x) -> s + x.n)").alias("n"), F.flatten("f.pieces").alias("pieces"))
    pad = F.unhex(F.repeat(F.lit(np.array([pad_id], dtype).tobytes().hex()), F.lit(width) - F.col("n")))
    joined = written(joined.withColumn("ids", F.concat("ids", pad)), "ends")
    # what lies inside a partition is read where it was written first
    return made.where(F.col("n") == width).select("sequence_id", "ids", "n", "pieces").unionByName(joined).withColumnRenamed("n", "n_tokens")


def pieces(sequences: DataFrame, width: int = 2048, key: str = "doc_id") -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece, read back from sequences of pack.

    ids_crc32 is the unsigned CRC-32 of the piece's ids as little-endian unsigned 32-bit integers.
    """
    kind = sequences.schema["pieces"].dataType.elementType["key"].dataType.simpleString()

    def of(batches):
        for batch in batches:
            out = []
            for s, ids, own in zip(batch["sequence_id"], batch["ids"], batch["pieces"]):
                ids = np.frombuffer(ids, f"<u{len(ids) // width}").astype("<u4")
                for p in own:
                    crc = zlib.crc32(ids[p["offset"] : p["offset"] + p["length"]].tobytes())
                    out.append((p["key"], p["start"], p["length"], crc, p["doc_tokens"], s, p["offset"]))
            d = pd.DataFrame(out, columns=["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            yield d.assign(key=pd.Series([x[0] for x in out], dtype=object))

    found = sequences.mapInPandas(of, f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return found.withColumnRenamed("key", key)
