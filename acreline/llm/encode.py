"""Token ids of whole texts by the tokenizers library."""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

#: Pieces whose ids a worker remembers; beyond it the memory begins anew.
REMEMBERED = 1_000_000
#: Characters of texts that are encoded together.
TOGETHER = 2_000_000


def splits_at_spaces(path: str) -> bool:
    """Whether pieces between white space are independent: the tokenizer's file drops white space before it forms words."""
    with open(path, encoding="utf-8") as f:
        pre = json.load(f).get("pre_tokenizer") or {}
    parts = pre.get("pretokenizers", [pre])
    return any(p.get("type") in ("Whitespace", "WhitespaceSplit") or p.get("type") == "Split" and p.get("behavior") == "Removed" and p.get("invert") for p in parts)


def id_type(path: str, end_id: int) -> str:
    """The smaller of 2 and 4 bytes that holds every id."""
    from tokenizers import Tokenizer

    words = Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
    return "<u2" if max(words, end_id + 1) <= 65536 else "<u4"


class Encoder:
    """Ids of whole texts, without special tokens around them.

    Every id comes from the library. Where white space parts independent pieces, a piece is given to the library once and
    its ids are remembered; otherwise the library gets each text as one.
    """

    def __init__(self, path: str, dtype: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype, self.pieces = Tokenizer.from_file(path), dtype, splits_at_spaces(path)
        self.known: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.dtype).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def apart(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece. A thousand of them at a time are one text for the library; offsets tell whose ids are whose."""
        groups, out = [pieces[i : i + 1000] for i in range(0, len(pieces), 1000)], []
        for group, x in zip(groups, self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)):
            starts = np.cumsum([0, *[len(p) + 1 for p in group]])
            ids, at = np.array(x.ids, self.dtype), np.array([a for a, _ in x.offsets], np.int64)
            cuts = np.searchsorted(at, starts)
            out += [ids[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        return out

    def of(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as bytes; null is empty."""
        texts = [t or "" for t in texts]
        if not self.pieces:
            return self.whole(texts)
        cut = [t.replace("\n", " ").replace("\t", " ").split(" ") for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = list(set().union(*cut).difference(self.known))
        self.known.update(zip(new, self.apart(new)))
        out = [b"".join(map(self.known.__getitem__, c)) for c in cut]
        for p in new:
            if len(p) > 64:
                del self.known[p]
        return out


@lru_cache(maxsize=2)
def encoder(path: str, dtype: str) -> Encoder:
    """One for each worker process, so that a task begins with what the last one has seen."""
    return Encoder(path, dtype)


def parts(texts: list[str | None]):
    """(first, end) of runs of texts of about TOGETHER characters, so that memory does not follow the batch."""
    first, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t or "")
        if n >= TOGETHER:
            yield first, i + 1
            first, n = i + 1, 0
    if first < len(texts):
        yield first, len(texts)
