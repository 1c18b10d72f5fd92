"""Phrase collocations: candidates from sketch upper bounds, counted by automata.

A first pass adds the hashes of all words and pairs of words to a sketch, whose counters are upper bounds of their counts; a
second one those of the triples whose pairs may be frequent, and of the words of such pairs. Of a sketch only one bit a
counter is kept: whether it reaches the least count. A last pass scans the texts in chunks: the phrases of a chunk that all
bits allow are compiled into automata, which count all their overlapping occurrences; chunks' counts, and those of the
pairs' words, are summed. Every occurrence of a phrase that reaches the least count is counted, as its bits are set; one
that does not is dropped by its exact count afterwards.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from operator import itemgetter

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, written
from .sketch import ENTRIES, Bits, bits_for, entries, mixed, reached

#: Characters of texts that make a chunk; a longer text is a chunk of its own.
CHUNK = 6_000_000
#: Phrases of one automaton (some 100 MB); a chunk with more is scanned by several.
PHRASES = 150_000
#: Words that a task remembers between chunks.
REMEMBERED = 300_000
#: Bytes that end a piece become BREAK, which no word has.
BREAK = b"."
_PIECES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + BREAK * 10)


def tokens(text: str | None) -> list[bytes]:
    """The text's words, A-Z lower-cased, with BREAK between pieces and at the end."""
    return ((text or "").encode("utf-8", "surrogatepass").translate(_PIECES) + BREAK).replace(BREAK, b" . ").split()


class Numbers(dict):
    """Numbers of a language's words, from 1 on; 0 stands for BREAK alone. hashes has 64 bits for each number, 0 for BREAK."""

    def __init__(self, lang: str):
        self.seed, self.known = zlib.crc32(lang.encode("utf-8", "surrogatepass")), [0]
        self[BREAK] = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.known)
        self.known.append(xxhash.xxh64_intdigest(word, self.seed) or 1)
        return n

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, hashes) of words."""
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return ids, np.array(self.known, np.uint64)[ids]


def numbers_of(lang: str, known: dict[str, Numbers]) -> Numbers:
    """A task's numbers of a language, from its earlier chunks; with more than REMEMBERED words in all they begin anew."""
    if sum(map(len, known.values())) > REMEMBERED:
        known.clear()
    return known.setdefault(lang, Numbers(lang))


def counters(h: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The counter of the n words that begin at each place but the last n - 1; of those over a break too."""
    x = mixed(h[: len(h) - n + 1] + np.uint64(n))
    for i in range(1, n):
        x = mixed(x * np.uint64(3) + h[i : len(h) - n + 1 + i])
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def unbroken(h: np.ndarray, n: int) -> np.ndarray:
    """Whether the n words that begin at each place but the last n - 1 are words of one piece."""
    ok = h[: len(h) - n + 1] != 0
    for i in range(1, n):
        ok &= h[i : len(h) - n + 1 + i] != 0
    return ok


def chunks(batches):
    """{lang: [text, ...]} of about CHUNK characters at a time; a null lang is und."""
    held, n = defaultdict(list), 0
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            if text:
                held[lang].append(text)
                n += len(text)
                if n >= CHUNK:
                    yield held
                    held, n = defaultdict(list), 0
    if held:
        yield held


def words_of(texts: list[str]) -> list[bytes]:
    out = []
    for t in texts:
        out += tokens(t)
    return out


def sketched(docs: DataFrame, least: int, bits: int, lower: Bits | None, scratch: Scratch) -> Bits:
    """The bits of a sketch of words and pairs, or, with the bits of that one, of the triples whose pairs it allows."""
    shared = docs.sparkSession.sparkContext.broadcast(lower)

    def add(batches):
        low, known = shared.value, {}
        for chunk in chunks(batches):
            every, sure = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for lang, texts in chunk.items():
                _, h = numbers_of(lang, known).of(words_of(texts))
                if low is None:
                    every += [counters(h, n, bits)[unbroken(h, n)] for n in (1, 2)]
                elif len(h) > 2:
                    pair = unbroken(h, 2)
                    pair[pair] = low[counters(h, 2, low.bits)[pair]]
                    every.append(counters(h, 3, bits)[pair[:-1] & pair[1:]])
                    sure.append(np.unique(counters(h, 1, bits)[covered(len(h), np.flatnonzero(pair), 2)]))
            yield entries(np.concatenate(every), least, np.concatenate(sure))

    return reached(docs.mapInPandas(add, ENTRIES), bits, least, scratch)


def covered(size: int, at: np.ndarray, n: int) -> np.ndarray:
    """Whether each of size places lies in one of the n places from those of at on."""
    out = np.zeros(size, bool)
    for i in range(n):
        out[at + i] = True
    return out


def allowed(h: np.ndarray, pairs: Bits, triples: Bits) -> list[np.ndarray]:
    """Where pairs and triples begin that every sketch allows."""
    one = unbroken(h, 1)
    one[one] = pairs[counters(h, 1, pairs.bits)[one]]
    two = one[:-1] & one[1:]
    two[two] = pairs[counters(h, 2, pairs.bits)[two]] if len(h) > 1 else False
    three = two[:-1] & two[1:]
    three[three] = triples[counters(h, 3, triples.bits)[three]] if len(h) > 2 else False
    return [np.flatnonzero(two), np.flatnonzero(three)]


def different(ids: np.ndarray, at: list[np.ndarray]) -> list[tuple[int, int]]:
    """(place, n) of one occurrence of each different pair and triple of numbers that begins at places at."""
    two, three = at
    size = int(ids.max(initial=0)) + 1
    _, first = np.unique(ids[two] * size + ids[two + 1], return_index=True)
    _, rank = np.unique(ids[three] * size + ids[three + 1], return_inverse=True)
    _, other = np.unique(rank * size + ids[three + 2], return_index=True)
    return [(int(i), 2) for i in two[first]] + [(int(i), 3) for i in three[other]]


def counted(docs: DataFrame, pairs: Bits, triples: Bits) -> DataFrame:
    """(lang, phrase, words, f): occurrences of the pairs and triples that the sketches allow, and of the words of pairs; phrase null: all words."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((pairs, triples))

    def of(batches):
        (low, high), seen = shared.value, {}
        for chunk in chunks(batches):
            for lang, texts in chunk.items():
                words = words_of(texts)
                numbers = numbers_of(lang, seen)
                ids, h = numbers.of(words)
                yield pd.DataFrame({"lang": lang, "phrase": [None], "words": 0, "f": int((h != 0).sum())})
                # words of pairs that may be frequent, wherever they are
                known = np.array(numbers.known, np.uint64)
                counts = np.bincount(ids, minlength=len(known))
                counts[0] = 0
                some = np.flatnonzero((counts > 0) & high[counters(known, 1, high.bits)])
                names = list(numbers)
                if len(some):
                    yield pd.DataFrame({"lang": lang, "phrase": [names[i].decode("utf-8", "surrogatepass") for i in some], "words": np.ones(len(some), np.int32), "f": counts[some]})
                at = allowed(h, low, high)
                found = [b" ".join(words[i : i + n]).decode("utf-8", "surrogatepass") for i, n in different(ids, at)]
                # what lies in no phrase becomes a delimiter
                inside = covered(len(h), at[0], 2)
                kept = np.flatnonzero(inside | np.concatenate(([False], inside[:-1])))
                line = f" {b' '.join([words[i] if inside[i] else BREAK for i in kept.tolist()]).decode('utf-8', 'surrogatepass')} "
                for first in range(0, len(found), PHRASES):
                    own = found[first : first + PHRASES]
                    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
                    for i, p in enumerate(own):
                        automaton.add_word(f" {p} ", i)
                    automaton.make_automaton()
                    f = np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(line)), np.int64), minlength=len(own))
                    yield pd.DataFrame({"lang": lang, "phrase": own, "words": np.array([p.count(" ") + 1 for p in own], np.int32), "f": f})

    found = docs.mapInPandas(of, "lang string, phrase string, words int, f long")
    return found.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))


def phrases(docs: DataFrame, least: int = 10, cover: int = 50, most: int = 2000, bits: int | None = None, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, rank, phrase, words, a, l, r, n, score): each lang's first phrases of two and three words that occur least times or more and that no longer one covers.

    A text's A-Z are lower-cased; it is cut into pieces at . , ; : ! ? and bytes 0A to 0D, and pieces into words at
    spaces and tabs. Everything counts by lang, a null lang being und and a null text empty; n counts all words, a the
    occurrences of the phrase, overlaps included. A cut after the first k words gives l and r, the occurrences of both
    parts, and the score floor(1000000 a a / (l r)), in decimals of 38 digits; the cut of the lowest score counts, of
    equal ones the first. A phrase goes if it lies inside a longer one that occurs least times or more and whose
    occurrences are cover percent of its own or more. Of the rest each lang's most first ones are given (see top). Repeated rows count each. No texts, no rows. bits is the power of
    two of the sketches' counters, by default from the texts' size.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    if bits is None:
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        bits = bits_for(size // 8)
    scratch = Scratch(spark, "phrases")
    pairs = sketched(docs, least, bits, None, scratch)
    triples = sketched(docs, least, bits, pairs, scratch)
    f = scratch.written(counted(docs, pairs, triples).where(f"words = 0 OR f >= {int(least)}"), "counts")
    found = top(with_scores(f, cover), most)
    found = written(found.join(f.where("words = 0").select("lang", F.col("f").alias("n")), "lang"), "phrases")
    scratch.clear()
    return found.select("lang", "rank", "phrase", "words", "a", "l", "r", "n", "score")


def with_scores(f: DataFrame, cover: int) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of counts (as of counted), without covered phrases."""
    long = f.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    head, tail = F.substring_index("phrase", " ", 1), F.substring_index("phrase", " ", -1)
    behind, before = F.expr("substring(phrase, length(substring_index(phrase, ' ', 1)) + 2)"), F.expr("substring(phrase, 1, length(phrase) - length(substring_index(phrase, ' ', -1)) - 1)")
    # a pair is covered by the most frequent triple around it
    around = long.where("words = 3").select("lang", F.explode(F.array(before, behind)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    free = long.join(around, ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * longer < {int(cover)} * a").drop("longer")
    cut = lambda k, x, y: F.struct(F.lit(k).alias("k"), x.alias("x"), y.alias("y"))
    cuts = F.when(F.col("words") == 2, F.array(cut(1, head, tail))).otherwise(F.array(cut(1, head, behind), cut(2, before, tail)))
    part = lambda x, n: f.where("words IN (1, 2)").select("lang", F.col("phrase").alias(x), F.col("f").alias(n))
    d = free.select("*", F.explode(cuts).alias("c")).select("lang", "phrase", "words", "a", "c.*")
    d = d.join(part("x", "l"), ["lang", "x"]).join(part("y", "r"), ["lang", "y"])
    exact = lambda c: f"cast({c} AS decimal(18,0))"
    d = d.withColumn("score", F.expr(f"(1000000BD * {exact('a')} * {exact('a')}) div ({exact('l')} * {exact('r')})"))
    lowest = d.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    return lowest.select("lang", "phrase", "words", "a", "m.l", "m.r", "m.score")


def top(found: DataFrame, most: int = 2000, salts: int = 16) -> DataFrame:
    """The first most of each lang by score and a, both descending, then phrase by its UTF-8 bytes, with rank from 1.

    Parts of a lang are ranked first, so that no task sorts all phrases of one.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    d = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    d = d.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= most)
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most).drop("salt")
