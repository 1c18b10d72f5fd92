"""Sketches: counters that are upper bounds of counts, of which one bit is kept, whether the least count is reached."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import Scratch, shuffle_partitions

#: Counters come in blocks of 2 ** BLOCK_BITS, each summed in one task.
BLOCK_BITS = 16
#: A sketch has at most 2 ** MOST_BITS counters, a bit of each (64 MB) is broadcast. It prunes as long as the least count
#: is above the number of entries to a counter.
MOST_BITS = 29
ENTRIES = "block int, places binary, counts binary"


def bits_for(entries: int) -> int:
    """The power of two of counters for so many entries, about one or two to a counter, within the bounds."""
    return min(MOST_BITS, max(BLOCK_BITS, int(entries).bit_length()))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Bits:
    """One bit a counter: whether it reaches the least count."""

    def __init__(self, bits: int, packed: np.ndarray):
        self.bits, self.packed = bits, packed

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return (self.packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def entries(at: np.ndarray, least: int, sure: np.ndarray | None = None) -> pd.DataFrame:
    """Rows (block, places, counts) of the counters at, repeats counted: 3 bytes for each different one. Those of sure count as the least."""
    at, n = np.unique(at, return_counts=True)
    if sure is not None:
        both = np.union1d(at, sure)
        count = np.zeros(len(both), np.int64)
        count[np.searchsorted(both, at)] = n
        count[np.searchsorted(both, np.unique(sure))] = least
        at, n = both, count
    # beyond the least a count tells nothing more; one over 255 goes as several
    n = np.minimum(n, least)
    times = -(-n // 255)
    rest = n - 255 * (times - 1)
    at, n = np.repeat(at, times), np.full(int(times.sum()), 255, np.int64)
    n[np.cumsum(times) - 1] = rest
    block, first = np.unique(at >> BLOCK_BITS, return_index=True)
    parts = lambda x: [p.tobytes() for p in np.split(x, first[1:])][: len(block)]
    return pd.DataFrame({"block": block.astype(np.int32), "places": parts((at & ((1 << BLOCK_BITS) - 1)).astype("<u2")), "counts": parts(n.astype(np.uint8))})


def reached(rows: DataFrame, bits: int, least: int, scratch: Scratch) -> Bits:
    """The bits of the sketch that rows (as of entries) add up to. Blocks are summed one after another in their task; the driver gets a bit a counter."""
    size = 1 << BLOCK_BITS

    def sums(batches):
        now, total = None, None
        done = lambda: pd.DataFrame({"block": [now], "bits": [np.packbits(total >= least, bitorder="little").tobytes()]})
        for batch in batches:
            own = batch["block"].to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.empty(0, np.int64)
            for first, end in zip(starts, [*starts[1:], len(own)]):
                if now != own[first]:
                    if now is not None:
                        yield done()
                    now, total = int(own[first]), np.zeros(size, np.int64)
                places = np.frombuffer(b"".join(batch["places"].iloc[first:end]), "<u2")
                total += np.bincount(places, np.frombuffer(b"".join(batch["counts"].iloc[first:end]), np.uint8), size).astype(np.int64)
        if now is not None:
            yield done()

    parts = rows.repartition(shuffle_partitions(rows.sparkSession), "block").sortWithinPartitions("block")
    packed = np.zeros((1 << bits) // 8, np.uint8)
    for r in scratch.written(parts.mapInPandas(sums, "block int, bits binary"), "bits").collect():
        packed[r.block * size // 8 : (r.block + 1) * size // 8] = np.frombuffer(r.bits, np.uint8)
    return Bits(bits, packed)
