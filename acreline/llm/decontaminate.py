"""Benchmark decontamination with training suffix arrays.

Every task makes suffix arrays of the documents it reads (one for each batch of words), and every different test suffix is
looked up in each of them by binary search. Words are numbered by the test texts; a word that no test text has is 0 and
matches nothing, so suffixes that meet such a word before the shortest window ends are left out of the array: no search
could end at them. Suffixes are sorted to the depth of the window. Where a document is hit, the longest match from each
place comes from a binary search of that place in the suffix array of the test texts, so that a text and an item that
repeat one word cost no product of their places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, written

#: Words of one suffix array; a longer document gets an array of its own.
SHARD_WORDS = 2_000_000
#: Test texts are searched in blocks of about so many bytes; a block is what a task holds.
BLOCK_BYTES = 16 << 20

_MAP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased, as UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_MAP).split() if text else []


class Tests:
    """A block of test texts: their words' numbers, their different windows by length, and their suffix array."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.names, self.vocabulary, texts = [], {}, []
        number = self.vocabulary.setdefault
        for name, text in items:
            ids = np.array([number(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int64)
            if len(ids):
                self.names.append(name)
                texts.append(ids)
        self.window, lengths = window, np.array([len(x) for x in texts], np.int64)
        self.bits = max(1, len(self.vocabulary)).bit_length()
        self.per_key = max(1, 63 // self.bits)
        # the texts one after another, each followed by a 0
        self.starts = np.cumsum(lengths + 1) - lengths - 1
        self.stream = np.concatenate([np.append(x, 0) for x in texts] or [np.zeros(0, np.int64)])
        self.windows, self.owners = {}, []
        sets: dict[tuple, int] = {}
        for n in sorted(set(np.minimum(lengths, window).tolist())):
            who = np.flatnonzero(np.minimum(lengths, window) == n)
            counts = lengths[who] - n + 1
            item = np.repeat(who, counts)
            at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + self.starts[item]
            keys = np.stack(self.keys(self.stream, at, n))
            different, which = np.unique(keys, axis=1, return_inverse=True)
            which = which.reshape(-1)
            # the items of a window, as the number of that set of items
            own = np.unique(np.stack((which, item)), axis=1)
            cuts = np.flatnonzero(np.diff(own[0])) + 1
            of = np.array([sets.setdefault(tuple(x.tolist()), len(sets)) for x in np.split(own[1], cuts)], np.int64)
            self.windows[n] = (list(different), of)
        self.owners = [np.array(x, np.int64) for x in sets]
        self.least = min(self.windows, default=0)
        self.array()

    def array(self) -> None:
        """blocks: the numbers of the runs of 2**k words at each place, 0 where a text ends within; order: the suffix array."""
        m = len(self.stream)
        self.blocks, self.known, rank, k = [self.stream], [], self.stream, 0
        while True:
            half, last = 1 << k, self.blocks[-1]
            ahead = np.append(last[half:], np.zeros(min(half, m), np.int64))[:m]
            ok = (last > 0) & (ahead > 0)
            rank = np.unique(rank * (m + 2) + np.append(rank[half:] + 1, np.zeros(min(half, m), np.int64))[:m], return_inverse=True)[1].reshape(-1)
            if not ok.any():
                break
            known, at = np.unique(last[ok] * (m + 1) + ahead[ok], return_inverse=True)
            new = np.zeros(m, np.int64)
            new[ok] = at.reshape(-1) + 1
            self.blocks.append(new), self.known.append(known)
            k += 1
        self.order = np.argsort(rank, kind="stable")

    def keys(self, ids: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
        """The n words from each place on, packed into as few integers as hold them; their order is that of the words."""
        out = []
        for a in range(0, n, self.per_key):
            key = np.zeros(len(at), np.int64)
            for i in range(a, min(n, a + self.per_key)):
                key = (key << self.bits) | ids[at + i]
            out.append(key)
        return out

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owners, place in ids, words): the occurrences of windows. ids: words' numbers, 0 between documents."""
        none = (np.empty(0, np.int64),) * 3
        if not self.windows:
            return none
        ids = np.concatenate((ids, np.zeros(self.window, np.int64)))
        gaps = np.concatenate(([0], np.cumsum(ids == 0)))
        m = len(ids) - self.window
        found = []
        for n, (sought, owners) in self.windows.items():
            places = np.flatnonzero(gaps[n : n + m] == gaps[:m])
            if not len(places):
                continue
            keys = self.keys(ids, places, n)
            order = np.lexsort(keys[::-1])
            keys = [k[order] for k in keys]  # the suffix array's order
            # binary search of the test suffixes: the range of equal first keys, then within it that of the next
            low, high = np.searchsorted(keys[0], sought[0], "left"), np.searchsorted(keys[0], sought[0], "right")
            for key, want in zip(keys[1:], sought[1:]):
                low, high = bisect(key, want, low, high, True), bisect(key, want, low, high, False)
            count = high - low
            if count.any():
                at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
                found.append((np.repeat(owners, count), places[order[at]], np.full(len(at), n)))
        return tuple(map(np.concatenate, zip(*found))) if found else none

    def longest(self, ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, place in stream) of the longest match of ids from each of places on. ids: one document's numbers."""
        n = len(ids)
        blocks = [np.append(ids, 0)]
        for k, known in enumerate(self.known):
            half, last = 1 << k, blocks[-1]
            ahead = np.append(last[half:], np.zeros(min(half, n + 1), np.int64))[: n + 1]
            key = last * (len(self.stream) + 1) + ahead
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            blocks.append(np.where((last > 0) & (ahead > 0) & (known[at] == key), at + 1, 0))

        def common(at: np.ndarray) -> np.ndarray:
            length = np.zeros(len(places), np.int64)
            for k in range(len(blocks) - 1, -1, -1):
                mine, theirs = blocks[k][np.minimum(places + length, n)], self.blocks[k][np.minimum(at + length, len(self.stream) - 1)]
                length += np.where((mine > 0) & (mine == theirs), 1 << k, 0)
            return length

        low, high = np.zeros(len(places), np.int64), np.full(len(places), len(self.order))
        while (live := low < high).any():
            mid = (low + high) // 2
            at = self.order[np.minimum(mid, len(self.order) - 1)]
            length = common(at)
            up = live & (self.stream[np.minimum(at + length, len(self.stream) - 1)] < blocks[0][np.minimum(places + length, n)])
            low, high = np.where(up, mid + 1, low), np.where(live & ~up, mid, high)
        best, where = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        for k in (low, low - 1):
            ok = (k >= 0) & (k < len(self.order))
            at = self.order[np.clip(k, 0, len(self.order) - 1)]
            length = np.where(ok, common(at), 0)
            where = np.where(length > best, at, where)
            best = np.maximum(best, length)
        return best, where


def bisect(key: np.ndarray, want: np.ndarray, low: np.ndarray, high: np.ndarray, left: bool) -> np.ndarray:
    """For each wanted value the bound in key[low:high], all at once."""
    low, high = low.copy(), high.copy()
    while (live := low < high).any():
        mid = (low + high) // 2
        v = key[np.minimum(mid, len(key) - 1)]
        up = live & ((v < want) if left else (v <= want))
        low, high = np.where(up, mid + 1, low), np.where(live & ~up, mid, high)
    return low


RESULT = "words long, hits array<int>, items array<string>, matches array<struct<item:string,item_start:int,doc_start:int,n_words:int>>"


def search_block(items: list[tuple[str | None, str | None]], window: int, spark):
    """A pandas function of a text column with the fields of RESULT, and the broadcast tests that it reads."""
    shared = spark.sparkContext.broadcast(Tests([("null" if i is None else i, t) for i, t in items], window))

    @F.pandas_udf(RESULT)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            parts, lists, held = [], [], 0
            for x in batch:
                ws = words_of(x)
                if lists and held + len(ws) > SHARD_WORDS:
                    parts.append(search_shard(known, lists))
                    lists, held = [], 0
                lists.append(ws)
                held += len(ws)
            if lists or not parts:
                parts.append(search_shard(known, lists))
            yield pd.concat(parts, ignore_index=True)

    return search, shared


def search_shard(known: Tests, lists: list[list[bytes]]) -> pd.DataFrame:
    """RESULT for each of a shard's documents, given as words."""
    number = known.vocabulary.get
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    starts = np.cumsum(lengths + 1) - lengths - 1
    ids = np.zeros(int(lengths.sum()) + len(lists), np.int64)
    for s, ws in zip(starts.tolist(), lists):
        ids[s : s + len(ws)] = np.fromiter((number(w, 0) for w in ws), np.int64, len(ws))
    owners, place, n = known.search(ids)
    hits, items, matches = [[] for _ in lists], [[] for _ in lists], [[] for _ in lists]
    if len(place):
        cover = np.zeros(len(ids) + 1, np.int64)
        np.add.at(cover, place, 1), np.add.at(cover, place + n, -1)
        hit = np.flatnonzero(np.cumsum(cover) > 0)
        of_hit, of_place = np.searchsorted(starts, hit, "right") - 1, np.searchsorted(starts, place, "right") - 1
        own = np.unique(np.stack((of_place, owners)), axis=1)
        for k in np.unique(of_place).tolist():
            a, b = np.searchsorted(of_hit, k), np.searchsorted(of_hit, k, "right")
            hits[k] = (hit[a:b] - starts[k]).tolist()
            a, b = np.searchsorted(own[0], k), np.searchsorted(own[0], k, "right")
            items[k] = sorted({known.names[i] for x in own[1, a:b] for i in known.owners[x].tolist()})
            begins = np.unique(place[of_place == k]) - starts[k]
            words, at = known.longest(ids[starts[k] : starts[k] + lengths[k]], begins)
            ends = begins + words
            new = np.flatnonzero(ends > np.concatenate(([-1], np.maximum.accumulate(ends)[:-1])))
            which = np.searchsorted(known.starts, at[new], "right") - 1
            matches[k] = [{"item": known.names[i], "item_start": s, "doc_start": p, "n_words": w} for i, s, p, w in zip(which.tolist(), (at[new] - known.starts[which]).tolist(), begins[new].tolist(), words[new].tolist())]
    return pd.DataFrame({"words": lengths, "hits": hits, "items": items, "matches": matches})


def with_matches(docs: DataFrame, tests: DataFrame, window: int = 10, text: str = "text", item: str = "item_id", item_text: str = "text", out: str = "matched") -> DataFrame:
    """docs with a struct column out: words, hits (places of hit words), items, matches.

    A window is window consecutive words of a test text, or all words of a shorter one; a document word inside any
    occurrence is hit. items: names of the test texts with occurring windows, sorted as strings; null names are "null".
    matches: the longest verbatim matches that begin with a window and lie in no other one, each with its places (in
    words) in the document and in one of the items that have it. Null and wordless texts have nothing; test texts without
    words are never found; equal and repeated rows are judged alike; empty tables give empty results or no hits.

    What is broadcast is a block of test texts of about BLOCK_BYTES. With more of them each block's matches are written
    as narrow rows by document, without the documents, of those that have some; in the end they are added up by document
    and joined once. The tests are read once, into one table of all blocks.
    """
    spark = docs.sparkSession
    t = tests.select(F.col(item).cast("string").alias("i"), F.col(item_text).alias("t"))
    size = t.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("t"), F.lit(0)) + 64), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-int(size) // BLOCK_BYTES))
    rest = [c for c in docs.columns if c != out]
    if blocks == 1:
        search, _ = search_block([(r.i, r.t) for r in t.toLocalIterator()], window, spark)
        return docs.select(*rest, search(F.col(text)).alias(out))
    scratch = Scratch(spark, "blocks")
    t = scratch.written(t.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(blocks))), "tests")
    # a row is known by its text's digest: equal texts have equal matches
    d = docs.select(F.struct(*rest).alias("row"), F.col(text).alias("t"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("g"))
    found = None
    for b in range(blocks):
        search, shared = search_block([(r.i, r.t) for r in t.where(F.col("b") == b).select("i", "t").toLocalIterator()], window, spark)
        own = scratch.written(d.select("g", search(F.col("t")).alias("m")).where("size(m.hits) > 0").select("g", "m.*"), "matches")
        own = own.dropDuplicates(["g"])
        found = own if found is None else found.unionByName(own)
        shared.unpersist()
    every = lambda f: F.flatten(F.collect_list(f))
    found = found.groupBy("g").agg(F.array_sort(F.array_distinct(every("hits"))).alias("hits"), F.array_sort(F.array_distinct(every("items"))).alias("items"), every("matches").alias("matches"))
    found = written(found, "matched")
    scratch.clear()
    search, _ = search_block([], window, spark)
    none = d.withColumn("m", search(F.col("t"))).join(found, "g", "left")
    both = lambda f: F.coalesce(F.col(f), F.col(f"m.{f}")).alias(f)
    return none.select("row.*", F.struct(F.col("m.words").alias("words"), both("hits"), both("items"), both("matches")).alias(out))


def drop_contaminated(docs: DataFrame, tests: DataFrame, window: int = 10, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows that hold a window of a test text, with the columns of docs, whatever their names; with one block of tests nothing is shuffled."""
    out = "matched"
    while out in docs.columns:
        out += "_"
    return with_matches(docs, tests, window, text, item, item_text, out).where(F.size(f"{out}.hits") == 0).select(*docs.columns)
