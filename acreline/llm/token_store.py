"""Token-id shards with a minimal perfect hash index.

A shard file holds the ids of consecutive documents: 16 bytes of head (TOKSHARD, version, bytes an id, two spare), the ids
one after another as little-endian unsigned integers (2 bytes if the vocabulary allows, else 4), then the documents' first
places as little-endian unsigned 64-bit integers, one more than documents, and last the number of documents in 8 bytes.
An index file is a minimal perfect hash of one bucket of keys (levels of bit arrays; a key's place is the number of bits
before its own), with a stored fingerprint, shard, first row and number of rows for each place.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import file_system, new_dir, put_file, shuffle_partitions
from .encode import encoder, id_type, parts

HEAD = b"TOKSHARD"
SHARD_BYTES = 128 << 20
#: Keys of one index file.
BUCKET_KEYS = 100_000
#: Rows of one key that are made in one go, and bytes of neighbouring documents that are read in one request.
TOGETHER = 10_000
READ_BYTES = 8 << 20


def write_shards(docs: DataFrame, out: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the shards of docs in ascending order of key below out; gives the written manifest: key, h1, h2, shard, row, n_tokens.

    Every whole text is encoded by the library (encode.Encoder) and end_id appended; null is empty. Null keys come first;
    rows of equal keys keep the order of the table and may fill several shards. Shards are ranges of keys, each written by
    one task under a name that a rerun gives it again.
    """
    dtype = id_type(tokenizer, end_id)
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 16), F.lit(0)).alias("n")).first().n
    n = max(shuffle_partitions(spark), -(-int(size) // SHARD_BYTES))
    kind = docs.schema[key].dataType.simpleString()
    d = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).withColumn("m", F.monotonically_increasing_id()).repartitionByRange(n, "k", "m").sortWithinPartitions("k", "m")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, keys, first = TaskContext.get().partitionId(), [], [0]
        end = np.array([end_id], dtype).tobytes()

        def fill(f):
            f.write(HEAD + struct.pack("<HHI", 1, np.dtype(dtype).itemsize, 0))
            for batch in batches:
                texts = batch["t"].tolist()
                for a, b in parts(texts):
                    for k, own in zip(batch["k"].iloc[a:b], encoder(tokenizer, dtype).of(texts[a:b])):
                        f.write(own + end)
                        keys.append(None if pd.isna(k) else k)
                        first.append(first[-1] + len(own + end) // np.dtype(dtype).itemsize)
            f.write(np.array(first, "<u8").tobytes())
            f.write(struct.pack("<Q", len(keys)))

        put_file(f"{out}/shards/{shard:06d}.ids", fill)
        yield pd.DataFrame({"k": pd.Series(keys, dtype=object), "shard": shard, "row": np.arange(len(keys)), "n_tokens": np.diff(first)})

    rows = d.mapInPandas(write, f"k {kind}, shard int, row long, n_tokens long")
    name = F.coalesce(F.concat(F.lit("="), F.col("k").cast("string")), F.lit("null"))
    rows.withColumn("h1", F.xxhash64(name)).withColumn("h2", F.xxhash64(F.lit("fingerprint"), name)).write.parquet(f"{out}/manifest")
    return spark.read.parquet(f"{out}/manifest")


def spread(h1: np.ndarray, level: int) -> np.ndarray:
    x = h1.view(np.uint64) + np.uint64((level * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit hashes: at each level a key that is alone in its place stays there."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels, self.before, total = levels, [], 0
        for bits in levels:
            ones = np.concatenate(([0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)))
            self.before.append(ones + total)
            total += int(ones[-1])
        self.size = total

    @classmethod
    def build(cls, h1: np.ndarray, gamma: float = 1.5) -> PerfectHash:
        levels, left = [], h1
        while len(left):
            size = max(64, int(gamma * len(left)) // 64 * 64 + 64)
            place = (spread(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[place]]
            if len(levels) > 200:
                raise ValueError("equal hashes of different keys")
        return cls(levels)

    def places(self, h1: np.ndarray) -> np.ndarray:
        """Each hash's place, -1 where no level has it."""
        out, live = np.full(len(h1), -1, np.int64), np.arange(len(h1))
        for k, (bits, before) in enumerate(zip(self.levels, self.before)):
            place = (spread(h1[live], k) % np.uint64(64 * len(bits))).astype(np.int64)
            word, bit = bits[place >> 6], (place & 63).astype(np.uint64)
            on = (word >> bit) & np.uint64(1) == 1
            under = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[live[on]] = before[place[on] >> 6] + under[on]
            live = live[~on]
        return out


def buckets_of(n: int) -> int:
    return max(1, -(-n // BUCKET_KEYS))


def bucket(n: int):
    return F.pmod(F.col("h2"), F.lit(n)).cast("int")


def write_index(manifest: DataFrame, out: str) -> int:
    """Writes an index file for each bucket of keys below out; gives the number of buckets, each of about BUCKET_KEYS keys."""
    n = buckets_of(manifest.count())
    entries = manifest.groupBy("h1", "h2").agg(F.min(F.struct("shard", "row")).alias("at"), F.count("*").alias("rows")).select("h1", "h2", "at.*", "rows")

    def write(of: pd.DataFrame) -> pd.DataFrame:
        h1, b = of["h1"].to_numpy(), int(of["bucket"].iloc[0])
        mph = PerfectHash.build(h1)
        order = np.empty(len(h1), np.int64)
        order[mph.places(h1)] = np.arange(len(h1))

        def fill(f):
            held = io.BytesIO()
            own = {f"level{i}": x for i, x in enumerate(mph.levels)}
            np.savez(held, levels=len(mph.levels), fingerprint=of["h2"].to_numpy()[order].astype("<i8").view("<u8") >> np.uint64(32), shard=of["shard"].to_numpy()[order], row=of["row"].to_numpy()[order], rows=of["rows"].to_numpy()[order], **own)
            f.write(held.getvalue())

        put_file(f"{out}/index/{b:06d}.mph", fill)
        return pd.DataFrame({"bucket": [b], "keys": [len(h1)]})

    entries.withColumn("bucket", bucket(n)).groupBy("bucket").applyInPandas(write, "bucket int, keys long").agg(F.sum("keys")).first()
    return n


def lookup(keys: DataFrame, store: tuple[str, int, DataFrame], key: str) -> DataFrame:
    """(key, shard, row): where the index of store has each distinct key of keys; keys whose fingerprint differs are not there.

    A key of many rows is one entry of the index; its rows, which follow each other over one or more shards, are made from
    it piece by piece.
    """
    out, buckets, starts = store
    kind = keys.schema[key].dataType.simpleString()
    name = F.coalesce(F.concat(F.lit("="), F.col("k").cast("string")), F.lit("null"))
    d = keys.select(F.col(key).alias("k")).distinct().withColumn("h1", F.xxhash64(name)).withColumn("h2", F.xxhash64(F.lit("fingerprint"), name)).withColumn("bucket", bucket(buckets))

    def find(of: pd.DataFrame) -> pd.DataFrame:
        files, path = file_system(f"{out}/index/{int(of['bucket'].iloc[0]):06d}.mph")
        with files.open_input_stream(path, compression=None) as f:
            data = np.load(io.BytesIO(f.read()))
        mph = PerfectHash([data[f"level{i}"] for i in range(int(data["levels"]))])
        at = mph.places(of["h1"].to_numpy())
        ok = at >= 0
        ok[ok] = data["fingerprint"][at[ok]] == of["h2"].to_numpy()[ok].view(np.uint64) >> np.uint64(32)
        at = at[ok]
        return pd.DataFrame({"k": of["k"].to_numpy()[ok], "shard": data["shard"][at], "row": data["row"][at], "rows": data["rows"][at]})

    found = d.groupBy("bucket").applyInPandas(find, f"k {kind}, shard int, row long, rows long")
    found = found.join(F.broadcast(starts.select("shard", "first_row")), "shard").withColumn("place", F.col("first_row") + F.col("row"))
    found = found.withColumn("turn", F.explode(F.expr(f"sequence(0L, rows - 1L, {TOGETHER}L)"))).withColumn("turn", F.explode(F.expr(f"sequence(turn, least(rows, turn + {TOGETHER}L) - 1L)")))
    # two numbers a shard
    first = starts.select("shard", "first_row").orderBy("shard").toPandas().to_numpy(np.int64).reshape(-1, 2)
    firsts = keys.sparkSession.sparkContext.broadcast(first)

    def placed(batches):
        shard, row = firsts.value.T
        for b in batches:
            place = b["place"].to_numpy()
            i = np.searchsorted(row, place, "right") - 1
            yield pd.DataFrame({"k": b["k"], "shard": shard[i].astype(np.int32), "row": place - row[i]})

    places = found.select("k", (F.col("place") + F.col("turn")).alias("place"))
    return places.mapInPandas(placed, f"k {kind}, shard int, row long").withColumnRenamed("k", key)


def runs(first: np.ndarray, row: np.ndarray, most: int) -> list[tuple[int, int]]:
    """(a, b) of sorted rows that are read together: neighbours in the file, of most ids in all unless one has more."""
    out, a = [], 0
    for b in range(1, len(row) + 1):
        if b == len(row) or first[row[b]] > first[row[b - 1] + 1] or first[row[b] + 1] - first[row[a]] > most:
            out.append((a, b))
            a = b
    return out


def read(places: DataFrame, out: str, key: str) -> DataFrame:
    """(key, shard, row, first, n_tokens, ids_crc32) of the documents at places, read from the shard files in ranges of neighbours."""
    kind = places.schema[key].dataType.simpleString()

    def fetch(of: pd.DataFrame) -> pd.DataFrame:
        files, path = file_system(f"{out}/shards/{int(of['shard'].iloc[0]):06d}.ids")
        of = of.sort_values("row")
        with files.open_input_file(path) as f:
            size = f.size()
            head = f.read_at(16, 0)
            if head[:8] != HEAD:
                raise ValueError(f"{path} is no shard")
            width = struct.unpack("<HHI", head[8:])[1]
            n = struct.unpack("<Q", f.read_at(8, size - 8))[0]
            first = np.frombuffer(f.read_at(8 * (n + 1), size - 8 - 8 * (n + 1)), "<u8").astype(np.int64)
            row, crc = of["row"].to_numpy(), []
            for a, b in runs(first, row, READ_BYTES // width):
                low, high = int(first[row[a]]), int(first[row[b - 1] + 1])
                ids = np.frombuffer(f.read_at((high - low) * width, 16 + low * width), f"<u{width}").astype("<u4")
                crc += [zlib.crc32(ids[first[r] - low : first[r + 1] - low].tobytes()) for r in row[a:b].tolist()]
        return pd.DataFrame({"k": of["k"].to_numpy(), "shard": of["shard"].to_numpy(), "row": row, "first": first[row], "n_tokens": first[row + 1] - first[row], "ids_crc32": np.array(crc, np.int64)})

    return places.withColumnRenamed(key, "k").groupBy("shard").applyInPandas(fetch, f"k {kind}, shard int, row long, first long, n_tokens long, ids_crc32 long").withColumnRenamed("k", key)


def token_store(docs: DataFrame, tokenizer: str, end_id: int = 2, key: str = "doc_id", text: str = "text", out: str | None = None) -> tuple[str, int, DataFrame]:
    """Writes shards and index of docs below out (default: the shared folder); gives (out, number of buckets, shard starts).

    Shard starts (shard, start, first_row) count the ids and the rows of the shards before. Empty tables give shards without
    documents.
    """
    out = out or new_dir(docs.sparkSession, "tokens")
    manifest = write_shards(docs, out, tokenizer, end_id, key, text)
    buckets = write_index(manifest, out)
    totals = manifest.groupBy("shard").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("rows"))  # a row a shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = totals.select("shard", (F.sum("n").over(before) - F.col("n")).alias("start"), (F.sum("rows").over(before) - F.col("rows")).alias("first_row"))
    return out, buckets, starts


def read_all(keys: DataFrame, store: tuple[str, int, DataFrame], key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) for keys, by index and shard files; start counts all ids before the document."""
    out, _, starts = store
    found = read(lookup(keys, store, key), out, key)
    return found.join(F.broadcast(starts), "shard").select(key, (F.col("start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
