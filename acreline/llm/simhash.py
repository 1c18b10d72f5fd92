"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits. It is cut into segments; each fingerprint is entered under every value within one bit of
each of its segments (a Hamming ball of radius 1). Two fingerprints whose segments differ in two bits or fewer meet
under a common value, so with m segments every pair within 3 m - 1 bits meets somewhere. Pairs that meet are verified
on all 64 bits. A bucket gives a spanning forest of its links (closest links first), never all its pairs, and equal
fingerprints are merged before the index is built, so a group of copies of any size costs one entry.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import components
from .common import Scratch, forget, shuffle_partitions, written
from .sketch import ENTRIES, bits_for, entries, mixed, reached


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Unsigned XXH64 (seed 42) of the shingles of the text's words, repeats included, A-Z lower-cased.

    Fewer words than width give one shingle, no words none. Null is empty.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    line, n = b" ".join(words), len(words)
    if n <= width:
        return np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: n - width + 1]
    h = xxhash.xxh64_intdigest
    return np.array([h(line[a:b], 42) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())], np.uint64)


def fingerprint(text: str | None, width: int) -> int:
    """64-bit SimHash as a signed integer: a bit is 1 if it is set in over half the shingle hashes."""
    return majority(shingle_hashes(text, width))


def majority(h: np.ndarray) -> int:
    """The bits that over half of the hashes have, as a signed integer."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 65536):
        ones += np.unpackbits(h[a : a + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", width: int = 4, out: str = "fp") -> DataFrame:
    """docs with a long column of fingerprints. Null and wordless texts get 0."""

    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    return docs.withColumn(out, of(F.col(text)))


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(shift, width) of the fewest segments, no wider than 32 bits, that let every pair within max_bits meet."""
    m = max(2, -(-(max_bits + 1) // 3))
    cuts = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def spanning_links(fps: np.ndarray, max_bits: int) -> list[tuple[int, int, int]]:
    """Minimum spanning forest (i, j, bits) of the links among distinct fingerprints, compared in blocks."""
    n, out = len(fps), []
    if n == 2:
        bits = int(np.bitwise_count(fps[0] ^ fps[1]))
        return [(0, 1, bits)] if bits <= max_bits else []
    label = np.arange(n)
    near = np.empty((n, n), np.uint8) if n <= 4096 else None
    if near is not None:
        for i in range(n):
            near[i] = np.bitwise_count(fps ^ fps[i])
    for bits in range(1, max_bits + 1):
        for i in range(n - 1):
            row = near[i, i + 1 :] if near is not None else np.bitwise_count(fps[i + 1 :] ^ fps[i])
            js = np.flatnonzero(row == bits) + i + 1
            js = js[label[js] != label[i]]
            if len(js):
                firsts, at = np.unique(label[js], return_index=True)
                out += [(i, int(j), bits) for j in js[at]]
                label[np.isin(label, firsts)] = label[i]
    return out


def links(fps: DataFrame, max_bits: int, most: int = 4096) -> DataFrame:
    """(a, b, bits): links among the distinct values of column fp that connect all that a chain of links connects.

    Each bucket of the index gives its own minimum spanning forest, so rows stay below the entries of the index. A task
    holds no more than most fingerprints of a bucket: those of a fuller one are passed on and dealt out in pairs of
    blocks, so that no bucket is one task's work.
    """
    entries = []
    for tag, (shift, width) in enumerate(segments(max_bits)):
        base, part = tag << 33, f"(shiftrightunsigned(fp, {shift}) & {(1 << width) - 1}L)"
        entries.append(f"array({base}L + {part})")
        entries.append(f"transform(sequence(0, {width - 1}), i -> {base}L + ({part} ^ shiftleft(1L, i)))")
    index = fps.select("fp", F.explode(F.expr(f"concat({', '.join(entries)})")).alias("key"))
    n = shuffle_partitions(fps.sparkSession)
    index = index.repartition(n, "key").sortWithinPartitions("key")
    scratch = Scratch(fps.sparkSession, "buckets")
    first = scratch.written(index.mapInPandas(lambda batches: bucket_links(batches, max_bits, most), "a long, b long, bits int"), "links")
    # rows without bits: (key, fp) of the buckets that are too full for a task
    full = first.where("bits IS NULL").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    blocks = full.groupBy("key").agg(F.ceil(F.count("*") / (most // 2)).cast("int").alias("blocks"))
    d = full.join(blocks, "key").withColumn("b", F.expr("cast(pmod(xxhash64(fp), blocks) AS int)")).withColumn("o", F.explode(F.expr("sequence(0, blocks - 1)")))
    d = d.select(F.xxhash64("key", F.least("b", "o"), F.greatest("b", "o")).alias("key"), "fp").repartition(n, "key").sortWithinPartitions("key")
    again = d.mapInPandas(lambda batches: bucket_links(batches, max_bits, None), "a long, b long, bits int")
    out = written(first.where("bits IS NOT NULL").unionByName(again).dropDuplicates(["a", "b"]), "links")
    scratch.clear()
    return out


def bucket_links(batches, max_bits: int, most: int | None):
    """Links of the buckets of rows (key, fp) sorted by key; with most, (key, fp, null) of the rows of fuller buckets."""

    def done(key, val):
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        ends = np.append(starts[1:], len(key))
        a, b, c = [], [], []
        pair = np.flatnonzero(ends - starts == 2)
        if len(pair):
            x, y = val[starts[pair]], val[starts[pair] + 1]
            bits = np.bitwise_count((x ^ y).view(np.uint64))
            ok = bits <= max_bits
            a, b, c = [np.minimum(x, y)[ok]], [np.maximum(x, y)[ok]], [bits[ok].astype(np.int32)]
        for s in np.flatnonzero(ends - starts > 2):
            if most and ends[s] - starts[s] > most:
                yield passed(key[starts[s]], val[starts[s] : ends[s]])
                continue
            own = np.sort(val[starts[s] : ends[s]])
            if found := spanning_links(own.view(np.uint64), max_bits):
                i, j, bits = map(np.array, zip(*found))
                a.append(np.minimum(own[i], own[j])), b.append(np.maximum(own[i], own[j])), c.append(bits.astype(np.int32))
        if a:
            out = pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b), "bits": np.concatenate(c)})
            if len(out):
                yield out.drop_duplicates()

    passed = lambda key, val: pd.DataFrame({"a": np.full(len(val), key), "b": val, "bits": pd.Series([None] * len(val), dtype="Int32")})
    # a batch begins with the rest of the last bucket; its own last bucket waits for the next one
    key, val, full = np.empty(0, np.int64), np.empty(0, np.int64), None
    for batch in batches:
        key, val = np.concatenate([key, batch["key"].to_numpy()]), np.concatenate([val, batch["fp"].to_numpy()])
        if full is not None and len(key):
            cut = int(np.searchsorted(key, full, "right"))
            yield passed(full, val[:cut])
            key, val = key[cut:], val[cut:]
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1]))
        yield from done(key[:cut], val[:cut])
        key, val, full = key[cut:], val[cut:], None
        if most and len(key) > most:
            full = key[0]
            yield passed(full, val)
            key, val = key[:0], val[:0]
    yield from done(key, val)


def near_duplicates(docs: DataFrame, max_bits: int = 4, width: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id): component_id is the smallest key that a chain of links of max_bits or fewer reaches.

    Null and wordless texts have fingerprint 0 and link like any other. Equal and repeated rows share a component; rows
    with a null key count as members but never name a component unless nothing else is in it. Empty in, empty out. Other
    columns of docs are not looked at, whatever their names.
    """
    rows = written(with_fingerprint(docs.select(F.col(key).alias("doc"), F.col(text).alias("text")), "text", width).select("doc", "fp"), "fingerprints")
    lowest = written(rows.groupBy("fp").agg(F.min("doc").alias("low")), "lowest")
    found = components(links(lowest.select("fp"), max_bits))
    named = lowest.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    roots = named.groupBy("root").agg(F.min("low").alias("component_id"))
    of_fp = named.join(roots, "root").select("fp", "component_id")
    return rows.join(of_fp, "fp").select(F.col("doc").alias(key), "fp", "component_id")


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """texts (_t and others) with size, fp, sketch, shingles instead of _t: number, fingerprint, sketch and hashes of the distinct shingles.

    Bit h mod m of the sketch, of m bits, is the parity of the shingles that fall on it, so the bits in which two sketches
    differ are no more than the shingles that only one text has. shingles are sorted 64-bit hashes. Wordless texts have
    size 0.
    """

    def of(batches):
        for batch in batches:
            sizes, prints, sketches, sets = [], [], [], []
            for t in batch["_t"]:
                every = shingle_hashes(t, width)
                h = np.unique(every)
                k, m = len(h), 64
                while m < 2 * k:
                    m *= 2
                odd = np.bincount((h & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
                sizes.append(k), prints.append(majority(every)), sketches.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()), sets.append(h.tobytes())
            yield batch.drop(columns="_t").assign(size=np.array(sizes, np.int64), fp=np.array(prints, np.int64), sketch=sketches, shingles=sets)

    rest = [f"{f.name} {f.dataType.simpleString()}" for f in texts.schema if f.name != "_t"]
    return texts.mapInPandas(of, ", ".join([*rest, "size long, fp long, sketch binary, shingles binary"]))


#: Shingles are counted in 2 ** COUNTER_BITS counters, by the first bits of their hashes.
COUNTER_BITS = 18


def counted(sets: DataFrame) -> np.ndarray:
    """How many texts have the shingles of each counter, over all texts; an array of one size whatever the table's.

    It only sets the order of shingles, which decides how fast candidates are found, never which.
    """

    def of(batches):
        total = np.zeros(1 << COUNTER_BITS, np.int64)
        for batch in batches:
            for x in batch["shingles"]:
                np.add.at(total, (np.frombuffer(x, np.uint64) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"i": at.astype(np.int32), "c": total[at]})

    found = sets.select("shingles").mapInPandas(of, "i int, c long").groupBy("i").agg(F.sum("c").alias("c")).toPandas()  # a row a counter
    out = np.zeros(1 << COUNTER_BITS, np.int64)
    out[found["i"].to_numpy(np.int64)] = found["c"].to_numpy(np.int64)
    return out


def prefixes(sets: DataFrame, similar: float, scratch: Scratch) -> DataFrame:
    """(s, n, size): of the prefix of each text, its rarest 1 - similar shingles in one order for all texts, those that others may have too.

    Two texts of Jaccard similarity similar or more share a shingle of both prefixes, whatever their edits. Shingles of
    one text alone, nearly all, are left out by a sketch of all prefixes, whose counters are upper bounds. Wordless texts
    share the prefix 0.
    """
    spark = sets.sparkSession
    order = spark.sparkContext.broadcast(counted(sets))
    bits = bits_for((1 - similar) * (sets.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] or 0))

    def own(batch):
        out = [np.zeros(1, np.uint64)] * len(batch)
        for i, x in enumerate(batch["shingles"]):
            if k := len(h := np.frombuffer(x, np.uint64)):
                by = np.argsort(order.value[(h >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)], kind="stable")
                out[i] = h[by[: k - int(np.ceil(similar * k - 1e-9)) + 1]]
        return out

    counter = lambda h: (mixed(h) >> np.uint64(64 - bits)).astype(np.int64)

    def add(batches):
        for batch in batches:
            yield entries(counter(np.concatenate([np.empty(0, np.uint64), *own(batch)])), 2)

    shared = spark.sparkContext.broadcast(reached(sets.select("shingles").mapInPandas(add, ENTRIES), bits, 2, scratch))

    def of(batches):
        for batch in batches:
            rows = own(batch)
            sizes, s = [len(x) for x in rows], np.concatenate([np.empty(0, np.uint64), *rows])
            ok = shared.value[counter(s)]
            yield pd.DataFrame({"s": s.view(np.int64)[ok], "n": np.repeat(batch["n"].to_numpy(), sizes)[ok], "size": np.repeat(batch["size"].to_numpy(), sizes)[ok]})

    return sets.select("n", "size", "shingles").mapInPandas(of, "s long, n long, size long")


def shared_prefixes(index: DataFrame, similar: float, scratch: Scratch) -> DataFrame:
    """(s, n, size, head, head_size, k, sizes): the rows of prefixes whose shingle k texts have, two or more; head is one of them, sizes the sum of theirs.

    Of shingles that the very same texts have (by their number and two sums of 64-bit hashes of them) one stands for all.
    Everything about a shingle is a sum, added up before it is dealt out, so a shingle of very many texts is no task's work.
    """
    index = scratch.written(index, "prefixes")
    each = index.groupBy("s").agg(
        F.count("*").alias("k"), F.min(F.struct("n", "size")).alias("h"), F.min("size").alias("low"), F.max("size").alias("high"), F.sum("size").alias("sizes"),
        F.bit_xor(F.xxhash64("n")).alias("x"), F.sum(F.xxhash64("n", F.lit(1)).cast("decimal(38,0)")).alias("y"))
    each = each.where((F.col("k") > 2) | (F.col("k") == 2) & (F.col("low") >= similar * F.col("high") - 1e-9))
    each = each.groupBy("k", "x", "y").agg(F.min("s").alias("s"), F.first("h").alias("h"), F.first("sizes").alias("sizes"))
    return index.join(each.select("s", "h", "k", "sizes"), "s").select("s", "n", "size", F.col("h.n").alias("head"), F.col("h.size").alias("head_size"), "k", "sizes")


def fingerprint_pairs(sets: DataFrame, max_bits: int) -> DataFrame:
    """(x, y): texts with equal fingerprints, each with one of them, and one text of each of two linked fingerprints."""
    low = sets.groupBy("fp").agg(F.min("n").alias("x"))
    equal = sets.join(low, "fp").where("n <> x").select("x", F.col("n").alias("y"))
    found = links(low.select("fp"), max_bits)
    linked = found.join(low.select(F.col("fp").alias("a"), F.col("x").alias("m")), "a").join(low.select(F.col("fp").alias("b"), F.col("x").alias("o")), "b")
    return equal.unionByName(linked.select(F.least("m", "o").alias("x"), F.greatest("m", "o").alias("y")))


def whole_buckets(batches, names: list[str]):
    """Rows sorted by the columns names, as frames that each end with the last row of a bucket."""
    held, last = [], None
    for batch in batches:
        if not len(batch):
            continue
        own = batch[names].to_numpy()
        if last is not None and (own[0] == last).all() and (own[-1] == last).all():
            held.append(batch)
            continue
        d = pd.concat([*held, batch], ignore_index=True)
        last = own[-1]
        more = np.flatnonzero((d[names].to_numpy() != last).any(axis=1))
        cut = int(more[-1]) + 1 if len(more) else 0
        if cut:
            yield d.iloc[:cut].reset_index(drop=True)
        held = [d.iloc[cut:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def bounds(d: pd.DataFrame, names: list[str]) -> list[tuple[int, int]]:
    """(first, end) of the buckets of two rows or more."""
    own = d[names].to_numpy()
    starts = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]).any(axis=1))))
    ends = np.append(starts[1:], len(own))
    return [(int(a), int(b)) for a, b in zip(starts, ends) if b - a > 1]


def could_be(total, apart, similar: float):
    """Whether texts of total shingles, apart or more of them in one text only, can have the similarity."""
    return total - apart >= similar * (total + apart) - 1e-9


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """Sketches (one a row, of 64-bit words) as those of size words."""
    while sketch.shape[-1] > size:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


#: Up to this many numbers of texts are broadcast (under 32 MB).
BROADCAST_TEXTS = 500_000
#: A text that is in over so many pairs as x is dealt out in parts.
PAIRS = 256
#: So many of such texts are broadcast with their parts; with more of them the limit above grows.
HOT_TEXTS = 100_000


def verified(pairs: DataFrame, sets: DataFrame, similar: float, scratch: Scratch, closest: bool = False) -> DataFrame:
    """(a, b): pairs (x, y) whose texts have the similarity. Sketches rule out most others before shingles are read.

    All such pairs, or with closest enough of them to connect what they connect: first the closest pair of each y, then
    those whose texts are still in different components. A text that is in very many pairs as x is dealt out in several
    parts, its sketch and its shingles too, so that no task has all pairs of a text.
    """

    @F.pandas_udf(T.LongType())
    def apart(a: pd.Series, b: pd.Series, p: pd.Series, q: pd.Series) -> pd.Series:
        out = []
        for i, j, x, y in zip(a, b, p, q):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            m = min(len(x), len(y))
            n = max(abs(i - j), int(np.bitwise_count(folded(x, m) ^ folded(y, m)).sum()))
            out.append(n if could_be(i + j, n, similar) else -1)
        return pd.Series(out, dtype="int64")

    @F.pandas_udf(T.BooleanType())
    def alike(p: pd.Series, q: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(p, q):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            out.append(similarity(x, y) >= similar)
        return pd.Series(out, dtype="bool")

    pairs = scratch.written(pairs, "pairs")
    most = max(PAIRS, pairs.count() // HOT_TEXTS)
    hot = pairs.groupBy("x").agg(F.ceil(F.count("*") / most).cast("int").alias("parts")).where("parts > 1")
    hot = F.broadcast(scratch.written(hot, "hot"))
    pairs = pairs.join(hot, "x", "left").select("x", "y", F.expr("cast(pmod(xxhash64(y), coalesce(parts, 1)) AS int)").alias("part"))
    of_x = lambda d, *cols: d.select(F.col("n").alias("x"), *cols).join(hot, "x", "left").withColumn("part", F.explode(F.expr("sequence(0, coalesce(parts, 1) - 1)"))).drop("parts")
    named = lambda k: [F.col("size").alias(f"size_{k}"), F.col("sketch").alias(f"sketch_{k}")]
    both = pairs.join(of_x(sets, *named("x")), ["x", "part"]).join(sets.select(F.col("n").alias("y"), *named("y")), "y")
    left = scratch.written(both.select("x", "y", "part", apart("size_x", "size_y", "sketch_x", "sketch_y").alias("apart")).where("apart >= 0"), "candidates")

    def checked(left: DataFrame) -> DataFrame:
        # if the candidates' texts are few, by a count, the shingles of all others need not be dealt out
        asked = left.select(F.explode(F.array("x", "y")).alias("n")).distinct()
        own = sets.join(F.broadcast(asked), "n", "left_semi") if asked.count() <= BROADCAST_TEXTS else sets
        both = left.join(of_x(own, F.col("shingles").alias("p")), ["x", "part"]).join(own.select(F.col("n").alias("y"), F.col("shingles").alias("q")), "y")
        return scratch.written(both.where(alike("p", "q")).select(F.col("x").alias("a"), F.col("y").alias("b")), "similar")

    if not closest:
        return checked(left)
    first = scratch.written(left.groupBy("y").agg(F.min(F.struct("apart", "x", "part")).alias("m")).select("m.x", "y", "m.part"), "closest")
    true = checked(first)
    root = lambda k: roots.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}"))
    roots = components(true)
    rest = left.join(root("x"), "x", "left").join(root("y"), "y", "left").where(F.coalesce("root_x", "x") != F.coalesce("root_y", "y"))
    rest = rest.select("x", "y", "part").join(first.select("x", "y"), ["x", "y"], "left_anti")
    return true.unionByName(checked(scratch.written(rest, "rest")))


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; 1 for two empty ones."""
    same = len(np.intersect1d(x, y, assume_unique=True))
    return same / (len(x) + len(y) - same) if len(x) + len(y) else 1.0


def of_several(shared: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """(s, n, size, root, k, sizes): the rows of shared with the component of each text, of shingles whose texts are not all in one."""
    d = scratch.written(shared.join(roots.withColumnRenamed("node", "n"), "n", "left").select("s", "n", "size", F.coalesce("root", "n").alias("root"), "k", "sizes"), "rooted")
    several = d.groupBy("s").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("s")
    return d.join(several, "s", "left_semi")


#: Pairs of a block, to one of its rows, that are given as rows.
PAIRS_A_ROW = 8


def close_links(found: DataFrame, sets: DataFrame, similar: float, exact: bool, block: int = 512, shingles: int = 512_000, every: bool = False) -> DataFrame:
    """(x, y, more) of the buckets of found (as of of_several): pairs x, y of different components that join them.

    A bucket is dealt out in pairs of blocks of about block texts and shingles shingles, whose rows meet inside a task.
    Of the pairs whose sketches allow the similarity the closest that join all components of a block are given; a row
    with more, its x a bucket's s, tells that there were others. With every, all pairs are given of a block that has no more
    than PAIRS_A_ROW for each of its rows, and none but more of a fuller one. With exact, pairs are told by the texts' own
    shingles instead, and given if they have the similarity: the closest first, until all components are joined or no pair
    is left. Either way a block's rows are bounded by the number of its texts.
    """
    more = ["sketch", "shingles"] if exact else ["sketch"]
    d = found.join(sets.select("n", *more), "n").withColumn("blocks", F.expr(f"cast(greatest(ceil(k / {block}), ceil(sizes / {shingles})) AS int)"))
    d = d.withColumn("b", F.expr("cast(pmod(hash(n), blocks) AS int)")).withColumn("o", F.explode(F.expr("sequence(0, blocks - 1)")))
    d = d.select("s", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "n", "size", "root", *more)
    names = ["s", "i", "j"]
    d = d.repartition(shuffle_partitions(found.sparkSession), *names).sortWithinPartitions(*names)

    def near(n, size, root, b, across, sketch):
        """(at, at, apart) of the pairs of one bucket, by the sizes of their sketches."""
        words, out = np.array([len(x) // 8 for x in sketch]), []
        for m in np.unique(words):
            low = np.flatnonzero(words == m)
            own = np.stack([np.frombuffer(sketch[k], np.uint64) for k in low])
            for other in np.unique(words[words >= m]):
                # a text of twice the size or more has a sketch of up to four times the words and is out of reach
                if other > 2 * m:
                    continue
                high = np.flatnonzero(words == other)
                their = own if other == m else np.stack([folded(np.frombuffer(sketch[k], np.uint64), m) for k in high])
                for r, x in enumerate(low):
                    ys, rows = (high[r + 1 :], their[r + 1 :]) if other == m else (high, their)
                    ok = (root[ys] != root[x]) & (n[ys] != n[x]) & ((b[ys] != b[x]) | (not across))
                    ys, rows = ys[ok], rows[ok]
                    if len(ys):
                        apart = np.maximum(np.abs(size[ys] - size[x]), np.bitwise_count(rows ^ own[r]).sum(axis=1, dtype=np.int64))
                        ok = could_be(size[ys] + size[x], apart, similar)
                        out.append(np.stack([np.full(ok.sum(), x), ys[ok], apart[ok]]))
        return np.concatenate(out, axis=1).T if out else np.empty((0, 3), np.int64)

    def joining(pairs, root, shingle):
        """The pairs, closest first, that join components; of those whose shingles are given only similar ones."""
        up, tree = {}, []
        for x, y, _ in pairs[np.argsort(pairs[:, 2], kind="stable")].tolist():
            ends = []
            for r in (root[x], root[y]):
                while r in up:
                    up[r] = r = up.get(up[r], up[r])
                ends.append(r)
            if ends[0] != ends[1] and (shingle is None or similarity(shingle[x], shingle[y]) >= similar):
                up[ends[0]] = ends[1]
                tree.append((x, y))
        return tree

    def of(batches):
        for d in whole_buckets(batches, names):
            n, size, root, b, i, j, s = (d[k].to_numpy() for k in ("n", "size", "root", "b", "i", "j", "s"))
            sketch, links, rest = d["sketch"].to_numpy(), [], []
            shingle = [np.frombuffer(x, np.uint64) for x in d["shingles"]] if exact else None
            for first, end in bounds(d, names):
                if end - first == 2 and (root[first] == root[first + 1] or not could_be(size[first] + size[first + 1], abs(size[first] - size[first + 1]), similar)):
                    continue
                k = slice(first, end)
                if (root[k] == root[first]).all():
                    continue
                pairs = near(n[k], size[k], root[k], b[k], i[first] != j[first], sketch[k])
                if every:
                    tree = pairs[:, :2].tolist() if len(pairs) <= PAIRS_A_ROW * (end - first) else []
                else:
                    tree = joining(pairs, root[k].tolist(), shingle[k] if exact else None)
                links += [(n[first + x], n[first + y]) for x, y in tree]
                if len(tree) < len(pairs) and not exact:
                    rest.append(s[first])
            # 64-bit numbers: no column may have both numbers and nulls here
            if links:
                x, y = np.array(links, np.int64).T
                yield pd.DataFrame({"x": np.minimum(x, y), "y": np.maximum(x, y), "more": np.zeros(len(x), bool)}).drop_duplicates()
            if rest:
                rest = np.unique(np.array(rest, np.int64))
                yield pd.DataFrame({"x": rest, "y": rest, "more": np.ones(len(rest), bool)})

    return d.mapInPandas(of, "x long, y long, more boolean").distinct()


#: Texts, or pairs of texts, that a Python worker gets at a time.
BATCH, TEXTS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000


def numbered_sets(base: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """shingle_sets of the different texts, with a number for each that is fixed as the table is written."""
    texts = base.groupBy("_g").agg(F.first("_t").alias("_t")).withColumn("n", F.monotonically_increasing_id())
    return scratch.written(shingle_sets(texts, width), "sets")


def similar_pairs(sets: DataFrame, similar: float, max_bits: int, scratch: Scratch) -> DataFrame:
    """(a, b): pairs of similar texts that connect all that similar pairs connect."""
    spark = sets.sparkSession
    shared = scratch.written(shared_prefixes(prefixes(sets, similar, scratch), similar, scratch), "shared")
    pairs = shared.where("n <> head").where(F.least("size", "head_size") >= similar * F.greatest("size", "head_size") - 1e-9)
    pairs = pairs.select(F.col("head").alias("x"), F.col("n").alias("y")).unionByName(fingerprint_pairs(sets, max_bits)).distinct()
    true = verified(pairs, sets, similar, scratch, closest=True)
    del pairs
    forget(spark)
    # buckets of several components: first the closest pairs that would join them
    found = scratch.written(close_links(of_several(shared, components(true), scratch), sets, similar, False), "close")
    true = true.unionByName(verified(found.where("NOT more").select("x", "y"), sets, similar, scratch))
    forget(spark)
    # then all pairs of what is still open, and where these are very many, inside the blocks by the shingles themselves
    left = shared.join(found.where("more").select(F.col("x").alias("s")), "s", "left_semi")
    found = scratch.written(close_links(of_several(left, components(true), scratch), sets, similar, False, every=True), "every")
    true = true.unionByName(verified(found.where("NOT more").select("x", "y"), sets, similar, scratch, closest=True))
    left = left.join(found.where("more").select(F.col("x").alias("s")), "s", "left_semi")
    last = scratch.written(close_links(of_several(left, components(true), scratch), sets, similar, True), "last")
    return true.unionByName(last.select(F.col("x").alias("a"), F.col("y").alias("b")))


def drop_near_duplicates(docs: DataFrame, similar: float = 0.8, width: int = 5, max_bits: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of near-duplicates: the one with the smallest key.

    A link counts if the distinct shingles of width words of two texts have a Jaccard similarity of at least similar.
    First come candidates by multi-index hashing: texts whose fingerprints lie within max_bits. As such similarity often
    leaves more bits apart, all texts that share a shingle of their prefixes, which every similar pair does, are compared
    as well: the head of each shingle's texts with the others, then in each shingle's texts the closest that verified
    links do not yet connect, in the end all such pairs block by block, so that no failed candidate stands for another. Equal texts
    always count, null as empty, and of rows with equal text and key one stays. Rows with a null key come after all
    others. All columns of docs are kept, whatever their names but _t, _g and _id.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "similar")
    named = lambda doc, g: F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.col(doc).cast("string"), F.lit("null")), F.hex(g)), 256))
    base = docs.withColumn("_t", F.coalesce(text, F.lit(""))).withColumn("_g", F.unhex(F.sha2("_t", 256))).withColumn("_id", named(key, "_g"))
    # a row of Python's work is a whole text or its shingles
    rows = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(TEXTS))
    try:
        sets = numbered_sets(base, width, scratch)
        forget(spark)
        true = similar_pairs(sets, similar, max_bits, scratch)
    finally:
        spark.conf.set(BATCH, rows)
    lowest = base.select("_g", F.col(key).alias("doc")).groupBy("_g").agg(F.min("doc").alias("doc"))
    grouped = sets.select("n", "_g").join(lowest, "_g").join(components(true).withColumnRenamed("node", "n"), "n", "left").withColumn("root", F.coalesce("root", "n"))
    kept = grouped.groupBy("root").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "_g")).alias("k"))
    kept = written(kept.select("k.doc", "k._g").select(named("doc", "_g").alias("_id")), "kept")
    scratch.clear()
    forget(spark)
    return base.join(kept, "_id", "left_semi").dropDuplicates(["_id"]).select(*docs.columns)
