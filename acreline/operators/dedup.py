"""Duplicates of listings against a store and among themselves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..scratch import Scratch, written
from .graph import components


def with_keys(listings: DataFrame) -> DataFrame:
    """listings with fingerprint and location_key."""
    c = [F.col(x) for x in ("county", "state", "acres", "price")]
    return listings.withColumn("fingerprint", keys.fingerprint(*c)).withColumn("location_key", keys.location_key(*c[:3]))


def against_index(listings: DataFrame, index: DataFrame, key: str = "seq", tolerance: float = 0.10) -> DataFrame:
    """listings (with keys) with duplicate_of: url, fingerprint or null, and suspect: the first index row near in price.

    index: seq, url, fingerprint, location_key, price. A suspect has the same location key and a price within tolerance
    of the lower price; it only flags. The index is reduced to its first row of each location and price; each location
    and price band is sorted by price in a task and gives the first row of a price range at once, so pairs are never
    made. Listings of a large band are dealt out in salts, each with the band's reduced index.
    """
    urls = index.select("url").where("url IS NOT NULL").distinct().withColumn("_u", F.lit(True))
    prints = index.select("fingerprint").where("fingerprint IS NOT NULL").distinct().withColumn("_f", F.lit(True))
    d = listings.join(urls, "url", "left").join(prints, "fingerprint", "left")
    d = d.withColumn("duplicate_of", F.when(F.col("_u"), "url").when(F.col("_f"), "fingerprint")).drop("_u", "_f")
    # prices within the tolerance lie in the same or the next band of width ln(1 + tolerance)
    band = lambda p: F.floor(F.log(p) / F.log1p(F.lit(tolerance)))
    price = F.col("price").cast("double").alias("_p")
    left = listings.where("price > 0 AND location_key IS NOT NULL").select(F.col(key).alias("_k"), "location_key", price, band(F.col("price")).alias("_b"))
    salts = left.groupBy("location_key", "_b").agg(F.ceil(F.count("*") / 20_000).cast("int").alias("_n"))
    left = left.join(salts, ["location_key", "_b"]).withColumn("_s", F.expr("cast(pmod(xxhash64(_k), _n) AS int)")).drop("_n")
    right = index.where("price > 0 AND seq IS NOT NULL").groupBy("location_key", price).agg(F.min("seq").alias("seq"))
    right = right.withColumn("_b", F.explode(F.array(*(band(F.col("_p")) + i for i in (-1, 0, 1))))).join(salts, ["location_key", "_b"])
    right = right.withColumn("_s", F.explode(F.expr("sequence(0, _n - 1)")))
    right = right.select(F.col("location_key").alias("_l"), F.col("_b").alias("_c"), F.col("_s").alias("_t"), F.col("_p").alias("_q"), F.col("seq").alias("_i"))

    def suspects(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"_k": a["_k"].iloc[:0], "suspect": b["_i"].iloc[:0]})
        b = b.sort_values("_i", ignore_index=True)
        order = np.argsort(b["_q"].to_numpy(), kind="stable")
        prices, own, n = b["_q"].to_numpy()[order], a["_p"].to_numpy(), len(order)
        near = lambda at: np.abs(own - prices[at]) / np.minimum(own, prices[at]) <= tolerance
        low, high = np.searchsorted(prices, own / (1 + tolerance)), np.searchsorted(prices, own * (1 + tolerance), "right")
        # the bounds by multiplication may be off by the last bits, the quotient decides
        low, high = np.maximum(low - 2, 0), np.minimum(high + 2, n)
        for _ in range(4):
            low = np.where((low < high) & ~near(np.minimum(low, n - 1)), low + 1, low)
            high = np.where((low < high) & ~near(np.maximum(high - 1, 0)), high - 1, high)
        least = [order]
        while 2 ** len(least) <= n:
            half = 2 ** (len(least) - 1)
            least.append(np.minimum(least[-1][:-half], least[-1][half:]))
        some = np.flatnonzero(low < high)
        low, high = low[some], high[some]
        power = np.floor(np.log2(high - low)).astype(int)
        first = np.array([min(least[p][x], least[p][y - 2**p]) for x, y, p in zip(low, high, power)], dtype=int)
        return pd.DataFrame({"_k": a["_k"].to_numpy()[some], "suspect": b["_i"].to_numpy()[first]})

    kinds = f"_k {listings.schema[key].dataType.simpleString()}, suspect {index.schema['seq'].dataType.simpleString()}"
    first = left.groupBy("location_key", "_b", "_s").cogroup(right.groupBy("_l", "_c", "_t")).applyInPandas(suspects, kinds).groupBy("_k").agg(F.min("suspect").alias("suspect"))
    return d.join(first, F.col(key) == F.col("_k"), "left").drop("_k")


def first_of(rows: DataFrame, keys_: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order; rows with a null key are all kept."""
    known = F.lit(True)
    for k in keys_:
        known = known & F.col(k).isNotNull()
    # a row with a null key is a partition of its own, so such rows meet in no task and are all first
    alone = F.when(~known, F.monotonically_increasing_id()).otherwise(F.lit(-1))
    r = F.row_number().over(Window.partitionBy(*keys_, "_alone").orderBy(*order))
    return rows.withColumn("_alone", alone).withColumn("_r", r).where("_r = 1").drop("_r", "_alone")


def greedy_fast(listings: DataFrame, index: DataFrame, order: list[Column]) -> DataFrame:
    """Kept listings where urls are unique in the batch: not in the index by url or fingerprint, first of their fingerprint."""
    new = listings.join(index.select("url").where("url IS NOT NULL"), "url", "left_anti").join(index.select("fingerprint").where("fingerprint IS NOT NULL"), "fingerprint", "left_anti")
    return first_of(new, ["fingerprint"], order)


def with_firsts(rows: DataFrame, by: str) -> DataFrame:
    """rows with how many of the rows of by come before (0, 1, or 2 for more) and the first of them; nulls share nothing."""
    one = rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.min("k").alias("_1"))
    two = rows.join(one, by).where("k > _1").groupBy(by).agg(F.min("k").alias("_2"))
    before = F.when(F.col("_1").isNull() | (F.col("k") == F.col("_1")), 0).when(F.col("k") == F.col("_2"), 1).otherwise(2)
    return rows.join(one.join(two, by, "left"), by, "left").withColumn(f"before_{by}", before).withColumnRenamed("_1", f"first_{by}").drop("_2")


def at_anchors(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(k, to, odd) of nodes (k, waits, parent): the row at which a line of single parents ends, and whether it has an odd number of steps.

    Each round doubles the steps, so a line of n rows takes about log2(n) rounds. Rows at their end leave the rounds.
    """
    now = nodes.select("k", F.coalesce("parent", "k").alias("to"), F.col("parent").isNotNull().alias("odd"))
    ended, going = now.where("k = to"), now.where("k <> to")
    while not going.isEmpty():
        step = now.select(F.col("k").alias("to"), F.col("to").alias("next"), F.col("odd").alias("more"))
        d = scratch.written(going.join(step, "to").select("k", F.col("next").alias("to"), (F.col("odd") != F.col("more")).alias("odd"), (F.col("next") == F.col("to")).alias("done")), "steps")
        ended = ended.unionByName(d.where("done").select("k", "to", "odd"))
        going = d.where("NOT done").select("k", "to", "odd")
        now = ended.unionByName(going)
    return ended


def in_rounds(rows: DataFrame) -> DataFrame:
    """rows (k, u, fingerprint) that the sequential rule keeps, by joins alone.

    A row waits for the rows before it that share its url or fingerprint. One that waits for none is kept; one that waits
    for a single row is kept if that one is not, so a line of such rows is kept in turns from its first row on, and all of
    a line is decided at once by the number of steps to it. A round keeps these rows and drops all that share a key with
    them. A chain in strict order of any length takes one round of some log2(length) joins, rows in arbitrary order few
    rounds; no row is gathered with its chain. Pairs of url and fingerprint must be different.
    """
    scratch = Scratch(rows.sparkSession, "rounds")
    left, kept = scratch.written(rows.select("k", "u", "fingerprint"), "left"), None
    while not left.isEmpty():
        d = with_firsts(with_firsts(left, "u"), "fingerprint").withColumn("waits", F.col("before_u") + F.col("before_fingerprint"))
        parent = F.when(F.col("waits") == 1, F.when(F.col("before_u") == 1, F.col("first_u")).otherwise(F.col("first_fingerprint")))
        nodes = scratch.written(d.select("k", "u", "fingerprint", "waits", parent.alias("parent")), "nodes")
        first = nodes.where("waits = 0").select(F.col("k").alias("to"))
        chosen = at_anchors(nodes.select("k", "waits", "parent"), scratch).where("NOT odd").join(first, "to", "left_semi")
        now = scratch.written(nodes.join(chosen.select("k"), "k").select("k", "u", "fingerprint"), "kept")
        kept = now if kept is None else kept.unionByName(now)
        left = scratch.written(left.join(now.select("u"), "u", "left_anti").join(now.where("fingerprint IS NOT NULL").select("fingerprint"), "fingerprint", "left_anti").select("k", "u", "fingerprint"), "left")
    out = written(left.limit(0) if kept is None else kept, "kept")
    scratch.clear()
    return out


def firsts_of(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Of rows (u, fingerprint, k): those kept for being the first of their url and fingerprint, and the rows left open.

    A row that is the first of both is kept, as nothing before it has its keys, and all others with one of its keys come
    later and are dropped. What is left is told the same way for as long as a round leaves at most half of the rows. Pairs
    of url and fingerprint must be different.
    """
    left, kept = scratch.written(rows.select("u", "fingerprint", "k"), "left"), []
    n = left.count()
    while n:
        first = left.groupBy("u").agg(F.min(F.struct("k", "fingerprint")).alias("r")).select("u", "r.fingerprint", "r.k")
        of_print = left.where("fingerprint IS NOT NULL").groupBy("fingerprint").agg(F.min("k").alias("_k"))
        now = scratch.written(first.join(of_print, "fingerprint", "left").where("_k IS NULL OR k = _k").select("u", "fingerprint", "k"), "firsts")
        rest = left.join(now.select("u"), "u", "left_anti").join(now.where("fingerprint IS NOT NULL").select("fingerprint"), "fingerprint", "left_anti")
        left, before = scratch.written(rest.select("u", "fingerprint", "k"), "left"), n
        kept, n = [*kept, now], left.count()
        if 2 * n > before:
            break
    out = left.limit(0)
    for x in kept:
        out = out.unionByName(x)
    return out, left


def in_chains(pair: DataFrame, chain_rows: int) -> DataFrame:
    """Of rows (u, fingerprint, k) those that the sequential rule keeps: short chains are visited in a task each, long ones resolved in rounds."""
    first_url, first_print = pair.groupBy("u").agg(F.min("k").alias("a")), pair.where("fingerprint IS NOT NULL").groupBy("fingerprint").agg(F.min("k").alias("a"))
    edges = pair.join(first_url, "u").select("a", F.col("k").alias("b")).unionByName(pair.join(first_print, "fingerprint").select("a", F.col("k").alias("b"))).where("a <> b")
    chains = components(edges)
    linked = written(pair.join(chains, F.col("k") == F.col("node")).select("root", "k", "u", "fingerprint"), "chains")
    long = linked.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > chain_rows).select("root")
    kind = pair.schema["k"].dataType.simpleString()

    def visit(of: pd.DataFrame) -> pd.DataFrame:
        seen_urls, seen_prints, out = set(), set(), []
        for r in of.sort_values("k").itertuples():
            why = "url" if r.u in seen_urls else "session" if pd.notna(r.fingerprint) and r.fingerprint in seen_prints else None
            if why is None:
                seen_urls.add(r.u)
                if pd.notna(r.fingerprint):
                    seen_prints.add(r.fingerprint)
            out.append((r.k, why))
        return pd.DataFrame(out, columns=["k", "why"])

    fate = linked.join(long, "root", "left_anti").groupBy("root").applyInPandas(visit, f"k {kind}, why string")
    chosen = fate.where("why IS NULL").select("k").unionByName(in_rounds(linked.join(long, "root", "left_semi").select("k", "u", "fingerprint")).select("k"))
    alone = pair.join(linked.select("k"), "k", "left_anti").select("u", "fingerprint", "k")
    return alone.unionByName(pair.join(chosen, "k").select("u", "fingerprint", "k"))


def greedy(listings: DataFrame, index: DataFrame, key: str = "seq", chain_rows: int = 1_000) -> DataFrame:
    """listings with kept and duplicate_of (url, fingerprint, session): the sequential rule, exact for any batch.

    In order of key a listing is kept if neither its url nor its fingerprint is in the index or was kept before; only kept
    ones register. A dropped row's other key stays free, so this is no ranking. Rows that repeat both url and fingerprint
    of an earlier row cost one row, whatever their number. Rows that are the first of both their url and fingerprint
    decide first (firsts_of). Of the rest those that share a url or fingerprint form chains. Chains of up to chain_rows
    rows are visited in order, each in one task; longer ones are resolved in rounds of joins. What is read twice, listings
    and their pairs, is written, so that listings are worked out once.
    """
    scratch = Scratch(listings.sparkSession, "greedy")
    urls = index.select("url").where("url IS NOT NULL").distinct().withColumn("_u", F.lit(True))
    prints = index.select("fingerprint").where("fingerprint IS NOT NULL").distinct().withColumn("_f", F.lit(True))
    d = listings.join(urls, "url", "left").join(prints, "fingerprint", "left")
    d = written(d.withColumn("duplicate_of", F.when(F.col("_u"), "url").when(F.col("_f"), "fingerprint")).drop("_u", "_f"), "listings")
    fresh = d.where("duplicate_of IS NULL").select(F.col(key).alias("k"), F.coalesce("url", F.lit("")).alias("u"), "fingerprint")
    firsts, pair = firsts_of(fresh.groupBy("u", "fingerprint").agg(F.min("k").alias("k")), scratch)
    kept = written(firsts if pair.isEmpty() else firsts.unionByName(in_chains(pair, chain_rows)), "kept")
    scratch.clear()
    by_url, by_print = kept.select(F.col("u").alias("_p"), F.col("k").alias("_ku")), kept.where("fingerprint IS NOT NULL").select("fingerprint", F.col("k").alias("_kf"))
    out = d.withColumn("_p", F.coalesce("url", F.lit(""))).join(by_url, "_p", "left").join(by_print, "fingerprint", "left")
    why = F.coalesce("duplicate_of", F.when(F.col("_ku") < F.col(key), "url"), F.when(F.col("_kf") < F.col(key), "session"))
    return out.withColumn("duplicate_of", why).withColumn("kept", F.col("duplicate_of").isNull()).drop("_p", "_ku", "_kf")


def replay(queue: DataFrame, index: DataFrame, key: str = "seq") -> DataFrame:
    """The queued listings that a replay writes: greedy against the index, earlier queue rows counting as written."""
    return greedy(queue, index, key).where("kept").drop("kept", "duplicate_of")


def anchors(links: DataFrame) -> DataFrame:
    """(page, canonical, href): the first raw href of each canonical one. links: page, pos, href."""
    d = links.withColumn("href", F.regexp_replace("href", r"[#?].*$", "")).where("href <> ''")
    return d.groupBy("page", keys.canonical_url(F.col("href")).alias("canonical")).agg(F.min_by("href", "pos").alias("href"))


def union_first(*parts: DataFrame, key: str = "id") -> DataFrame:
    """Rows of several tables, of equal keys the one of the first table."""
    both = None
    for i, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(i))
        both = p if both is None else both.unionByName(p)
    return first_of(both, [key], [F.col("_part")]).drop("_part")


def batches(rows: Iterator, size: int = 10) -> Iterator[list]:
    """Lists of size rows at most."""
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
