"""Main text of web pages, with suffix arrays of the hosts' page frames.

A page is cut into blocks. Text inside an article or main element is the article, unless an element or its name marks it
as something else (menu, advert, comments and so on). All other text is the page's frame. The frames of a host's pages are
one token stream, whose suffixes are sorted; neighbours with min_tokens equal tokens or more on min_pages distinct pages
are runs, which are boilerplate. On a page without article or main element the text is what runs leave of the unmarked
frame; elements of an article whose names are in doubt go where they are runs as a whole.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

# Element names of HTML.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
OTHER = frozenset("nav header footer aside form menu dialog button select svg canvas object audio video math head".split())
MAIN = frozenset(("article", "main"))
# Words that mark an element by its class, id or role.
MARKS = frozenset("ad ads adsense advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion related respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split())

# Words of these that are words of articles too: inside one they mark a container alone, named so or with one of HELPERS.
PLAIN_WORDS = frozenset("alert banner complementary header login menu notice notices pager promotion respond search share sharing signup skip social subscribe subscription toolbar widget".split())
HELPERS = frozenset("area bar block box btn button buttons container form icon icons inner item items link links list menu nav panel row section slot tools widget widgets wrap wrapper".split())
# Elements that hold an article's own text, whatever their names.
TEXTS = frozenset("a abbr b blockquote cite code dd dt em figcaption h1 h2 h3 h4 h5 h6 i li mark p pre q s small strong sub sup td th u".split())

# Words of these that mark an article element: others are often layout.
ARTICLE_MARKS = frozenset("ad ads advert adverts advertisement advertising comment comments promo promotion related sponsor sponsored".split())

# Possessive, so that a cut or broken tag is read once.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
NAMES = re.compile(r"(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
ENDS = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for x in RAW}

ARTICLE, FRAME, MARKED = 0, 1, 2
NONE, DOUBTFUL, SURE = 0, 1, 2


def marked(name: str, attributes: str, inside: bool) -> int:
    """SURE if an element is marked as no part of the article; inside: it lies in one, where headers hold headlines.

    DOUBTFUL inside an article, if a name has one of the words but may as well be the article's own.
    """
    if name in OTHER and not (inside and name == "header"):
        return SURE
    if not attributes or name in ("main", "body", "html"):
        return NONE
    marks, doubt = ARTICLE_MARKS if name == "article" else MARKS, NONE
    for m in NAMES.finditer(attributes):
        kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if kind == "hidden" or kind == "aria-hidden" and value == "true" or kind == "style" and "display:none" in "".join(value.split()):
            return SURE
        if kind in ("class", "id", "role"):
            for one in value.split():
                tokens = re.split(r"[^a-z0-9]+", one)
                words = marks.intersection(tokens)
                if not words or inside and words == {"header"}:
                    continue
                if not inside or not words <= PLAIN_WORDS or name not in TEXTS and PLAIN_WORDS.union(HELPERS).issuperset(tokens):
                    return SURE
                doubt = DOUBTFUL
    return doubt


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(zone, text) of the blocks in page order, without empty ones; white space is one space, references are decoded."""
    return [(zone, text) for zone, text, _ in doubted(page)]


def doubted(page: str | None) -> list[tuple[int, str, int]]:
    """blocks, and for those of an article the number of the innermost doubtful block element that they lie in, else 0.

    References are decoded in each piece of text between tags. The page is read once from start to end whatever its tags:
    open elements are counted by name, and the innermost open block is known.
    """
    out, parts, stack, pos, page = [], [], [], 0, page or ""
    mark = main = 0  # open elements that are marked, and that are article or main
    names: dict[str, int] = {}  # open elements of each name
    opened: list[int] = []  # places of the open blocks in stack
    doubts: list[tuple[int, int]] = []  # (place in stack, number) of the open doubtful elements
    doubtful = 0

    def add(text: str) -> None:
        parts.append(entities.unescape(text) if "&" in text else text)

    def close() -> None:
        if text := " ".join("".join(parts).split()):
            zone = MARKED if mark else ARTICLE if main else FRAME
            out.append((zone, text, doubts[-1][1] if doubts and zone == ARTICLE else 0))
        parts.clear()

    def pop():
        nonlocal mark, main, parts
        name, was, held = stack.pop()
        names[name] -= 1
        if opened and opened[-1] == len(stack):
            opened.pop()
        if held is not None:
            close()
            parts = held
        if doubts and doubts[-1][0] == len(stack):
            doubts.pop()
        mark -= was
        main -= name in MAIN

    while m := TAG.search(page, pos):
        add(page[pos : m.start()])
        pos = m.end()
        if not (name := (m[2] or m[5] or "").lower()):
            continue
        ends = m[1] or m[4]
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCKS:
            close()
        if ends:
            if names.get(name):
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in RAW:
            e = ENDS[name].search(page, pos)
            pos = e.end() if e else len(page)
            continue
        if name in BLOCKS:
            # a block ends an open paragraph
            if opened and stack[opened[-1]][0] == "p":
                end = opened[-1]
                while len(stack) > end:
                    pop()
        if name in VOID or (m[3] or m[6] or "").rstrip().endswith("/") and name not in BLOCKS:
            continue
        found = marked(name, m[3] or m[6] or "", main > 0)
        was = found == SURE
        held = None
        if was and not mark and name not in BLOCKS:
            # a marked piece inside a block: the block goes on after it
            held, parts = parts, []
        if name in BLOCKS:
            opened.append(len(stack))
            if found == DOUBTFUL:
                doubtful += 1
                doubts.append((len(stack), doubtful))
        stack.append((name, was, held))
        names[name] = names.get(name, 0) + 1
        mark += was
        main += name in MAIN
    add(page[pos:])
    while stack:
        close()
        pop()
    close()
    return out


def host_of(url: str | None) -> str:
    return re.sub(r"^[a-z][a-z0-9+.-]*://", "", (url or "").strip().lower()).split("/")[0].split("?")[0].split("#")[0].rpartition("@")[2]


def number_of(text: str) -> int:
    """64 bits of a text, for joins."""
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def heads_of(tokens: list[str], width: int) -> list[int]:
    """The number of the first width tokens of each suffix that has as many."""
    return [number_of(" ".join(tokens[i : i + width])) for i in range(len(tokens) - width + 1)]


class Suffixes:
    """The suffix array of some pages' token streams, put one behind the other.

    Each page is closed by a number of its own, so that no two suffixes are equal beyond a page's end. Suffixes are
    sorted to their whole length, by doubling; the order of tokens is that of their first places.
    """

    def __init__(self, pages: list[list[str]]):
        sizes = np.array([len(p) for p in pages], np.int64)
        codes, words = pd.factorize(np.array([t for p in pages for t in p], dtype=object))
        self.ends = np.cumsum(sizes + 1) - 1
        self.stream = np.full(int((sizes + 1).sum()), -1, np.int64)
        self.stream[self.ends] = len(words) + np.arange(len(pages))
        self.stream[self.stream < 0] = codes
        self.order = self._sorted()
        self.page = np.searchsorted(self.ends, self.order)

    def _sorted(self) -> np.ndarray:
        rank, n, depth = self.stream, len(self.stream), 1
        while True:
            after = np.zeros(n, np.int64)
            after[: max(n - depth, 0)] = rank[depth:] + 1
            order = np.lexsort((after, rank))
            a, b = rank[order], after[order]
            new = np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))])
            if new[-1] == n - 1:
                return order
            rank = np.empty(n, np.int64)
            rank[order] = new
            depth *= 2

    def runs(self, width: int) -> np.ndarray:
        """For each place of the order the number of its run: neighbours with width equal tokens; -1 where a page ends before."""
        n = len(self.order)
        same = np.ones(n - 1, bool)
        for i in range(width):
            s = self.stream[np.minimum(self.order + i, n - 1)]
            same &= s[1:] == s[:-1]
        run = np.concatenate([[0], np.cumsum(~same)])
        run[self.ends[self.page] - self.order < width] = -1
        return run


def run_heads(pages: list[list[str]], sources: np.ndarray, doubts: list[list[tuple[int, int]]], width: int, least: int, alone: bool) -> pd.DataFrame:
    """(doubt, head, source) of the runs of width tokens: of each run at most least sources of either kind.

    doubt: it begins in one of the page's doubtful ranges. alone: these are all pages of the host, and runs of fewer
    sources are left out.
    """
    array = Suffixes(pages)
    doubtful = np.zeros(len(array.stream), np.int64)
    for end, tokens, ranges in zip(array.ends.tolist(), pages, doubts):
        for begin, stop in ranges:
            doubtful[end - len(tokens) + begin : end - len(tokens) + stop] = 1
    run = array.runs(width)
    of_source, code = np.unique(sources, return_inverse=True)
    at = np.flatnonzero(run >= 0)
    seen, first = np.unique((run[at] * 2 + doubtful[array.order[at]]) * len(of_source) + code[array.page[at]], return_index=True)
    kind = seen // len(of_source)
    begins = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]])) if len(kind) else kind
    keep = np.arange(len(kind)) - np.repeat(begins, np.diff(np.append(begins, len(kind)))) < least
    if alone and len(kind):
        # a source of both kinds counts twice here, so no run is left out that should stay
        keep &= np.bincount(kind // 2)[kind // 2] >= least
    kind, source, places = kind[keep], of_source[(seen % len(of_source))[keep]], array.order[at[first[keep]]]
    heads: dict[int, int] = {}
    for r, place, i in zip((kind // 2).tolist(), places.tolist(), np.searchsorted(array.ends, places).tolist()):
        if r not in heads:
            begin = place - int(array.ends[i]) + len(pages[i])
            heads[r] = number_of(" ".join(pages[i][begin : begin + width]))
    return pd.DataFrame({"doubt": (kind % 2).astype(bool), "head": np.array([heads[r] for r in (kind // 2).tolist()], np.int64), "source": source.astype(np.int64)})


def hidden_by(places, width: int) -> set[int]:
    """The places of tokens in runs, given by the first places of width tokens."""
    return {int(p) + i for p in places for i in range(width)}


def uncovered(frame: list, hidden: set[int]) -> str:
    """The unmarked frame blocks without the hidden tokens."""
    out, place = [], 0
    for zone, text in frame:
        tokens = text.split(" ")
        if zone == FRAME and (left := [t for i, t in enumerate(tokens, place) if i not in hidden]):
            out.append(" ".join(left))
        place += len(tokens)
    return "\n".join(out)


def main_text(pages: DataFrame, html: str = "html", url: str = "url", min_tokens: int = 10, min_pages: int = 3, out: str = "text", runs: str | None = None, part_tokens: int = 1 << 14) -> DataFrame:
    """pages with column out: the main text of the whole html, blocks joined by one newline, "" if there is none.

    Null html is empty; a null url is the host "". The frames of a host's pages, and the doubtful elements of their
    articles, are its suffix array, in parts of some part_tokens tokens. A run is min_tokens tokens or more that min_pages
    pages share; of pages with equal articles (without an article: equal unmarked frames) one counts, so that copies do
    not remove each other.

    * Without article or main elements the text is what runs leave of the unmarked frame.
    * Inside an article a doubtful element goes where both signals say so: it is wholly in runs of the doubtful elements
      of min_pages different articles. Text without any mark stays though pages repeat it, as copies and quotations are
      part of an article.

    runs: name of a long column with the number of different runs of min_tokens tokens that the page's host has: with 0
    there was no second signal. Without it only hosts with a page in question get an array.

    An empty table stays empty. Columns of pages named out or runs are replaced, all others stay; their names must not
    begin with an underscore.
    """
    cols = [c for c in pages.columns if c not in (out, runs)]
    # equal pages have equal results, so a page's key is its own digest
    of_url = F.coalesce(F.col(url).cast("string"), F.lit(""))
    digest = F.unhex(F.md5(F.concat_ws(" ", F.length(of_url), of_url, F.coalesce(F.col(html), F.lit("")))))
    own = pages.select(*cols).withColumn("_html", F.col(html)).withColumn("_url", F.col(url).cast("string")).withColumn("_key", digest)

    @F.pandas_udf("open boolean, host string, source long, stream string, n int, frame array<struct<zone:int,text:string>>, doubts array<struct<id:int,begin:int,stop:int>>")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for urls, texts in batches:
            rows = []
            for u, t in zip(urls, texts):
                article, frame, doubts, n = [], [], [], 0
                for zone, x, doubt in doubted(t):
                    if zone == ARTICLE:
                        article.append(x)
                    if zone != ARTICLE or doubt:
                        frame.append((zone, x))
                        size = x.count(" ") + 1
                        if doubt:
                            doubts.append({"id": doubt, "begin": n, "stop": n + size})
                        n += size
                stream = " ".join(x for _, x in frame)
                source = number_of("\n".join(article or [x for zone, x in frame if zone == FRAME]) or stream)
                rows.append((not article, host_of(u), source, stream, n, None if article else [{"zone": z, "text": x} for z, x in frame], doubts))
            yield pd.DataFrame(rows, columns=["open", "host", "source", "stream", "n", "frame", "doubts"])

    # written: the frames of all pages, and of pages without an article their columns and a number, which is fixed thereby
    parts = [F.col(f"_p.{c}").alias(f"_{c}") for c in ("open", "host", "source", "stream", "n", "frame", "doubts")]
    parsed = written(own.withColumn("_p", cut("_url", "_html")).select(*[F.when(F.col("_p.open"), F.col(c)).alias(c) for c in cols], "_key", *parts).withColumn("_row", F.monotonically_increasing_id()), "frames")
    asking = parsed.where("_open OR size(_doubts) > 0")

    # the pages of each host's array; a host of fewer than min_pages sources has no runs
    streams = parsed.where(F.col("_n") >= min_tokens).select("_host", "_source", "_stream", "_doubts", "_n").distinct()
    if not runs:
        streams = streams.join(asking.select("_host").distinct(), "_host", "left_semi")
    sized = streams.groupBy("_host", "_source").agg(F.sum("_n").alias("n")).groupBy("_host").agg(F.sum("n").alias("n"), F.count("*").alias("sources")).where(F.col("sources") >= min_pages)
    hosts = written(sized.select("_host", F.ceil(F.col("n") / part_tokens).alias("_parts")), "hosts")
    arrays = streams.join(hosts, "_host").withColumn("_part", F.expr("pmod(xxhash64(_stream), _parts)")).drop("_n")

    def heads_in(key: tuple, frames: pd.DataFrame) -> pd.DataFrame:
        ranges = [[(d["begin"], d["stop"]) for d in x] for x in frames["_doubts"]]
        return run_heads([s.split(" ") for s in frames["_stream"]], frames["_source"].to_numpy(), ranges, min_tokens, min_pages, key[1] == 1).assign(_host=key[0])

    heads = arrays.groupBy("_host", "_parts", "_part").applyInPandas(heads_in, "_host string, doubt boolean, head long, source long")
    of_source = heads.groupBy("_host", "head", "source").agg(F.max(F.col("doubt").cast("int")).alias("doubt"))
    counted = of_source.groupBy("_host", "head").agg(F.count("*").alias("pages"), F.sum("doubt").alias("doubtful")).where(F.col("pages") >= min_pages)
    found = written(counted.select("_host", "head", (F.col("doubtful") >= min_pages).alias("doubtful")), "runs")

    # the places of pages that begin min_tokens tokens of a run
    @F.pandas_udf("array<long>")
    def suffixes(streams: pd.Series) -> pd.Series:
        return pd.Series([heads_of(s.split(" "), min_tokens) for s in streams], dtype=object)

    asked = asking.where(F.col("_n") >= min_tokens).join(hosts.select("_host"), "_host", "left_semi").select("_row", "_host", F.posexplode(suffixes("_stream")).alias("place", "head"))
    doubtful = F.collect_list(F.when(F.col("doubtful"), F.col("place"))).alias("_doubtful")
    covered = written(asked.join(found, ["_host", "head"]).groupBy("_row").agg(F.collect_list("place").alias("_covered"), doubtful), "covered")  # at most a page's tokens

    @F.pandas_udf("text string, gone array<int>")
    def judge(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for frame, doubts, places, doubtful in zip(*batch):
                hidden = set() if places is None else hidden_by(places, min_tokens)
                gone = []
                if len(doubts):
                    starts = {i for d in doubts for i in range(d["begin"], d["stop"])}
                    sure = set() if doubtful is None else hidden_by((p for p in doubtful if int(p) in starts), min_tokens)
                    stay = {d["id"] for d in doubts if not sure.issuperset(range(d["begin"], d["stop"]))}
                    gone = sorted({d["id"] for d in doubts} - stay)
                rows.append((None if frame is None else uncovered([(x["zone"], x["text"]) for x in frame], hidden), gone))
            yield pd.DataFrame(rows, columns=["text", "gone"])

    judged = asking.join(covered, "_row", "left").withColumn("_j", judge("_frame", "_doubts", "_covered", "_doubtful"))
    # by the pages' keys: equal pages are one
    gone = judged.where("NOT _open").select("_key", F.col("_j.gone").alias("_gone")).where("size(_gone) > 0")
    dropped = written(gone.dropDuplicates(["_key"]), "gone")

    @F.pandas_udf("text string, host string")
    def article(urls: pd.Series, texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        rows = []
        for u, t, g in zip(urls, texts, gone):
            found, g = [(x, doubt) for zone, x, doubt in doubted(t) if zone == ARTICLE], set() if g is None else set(map(int, g))
            rows.append(("\n".join(x for x, doubt in found if doubt not in g) if found else None, host_of(u)))
        return pd.DataFrame(rows, columns=["text", "host"])

    # not deterministic: else Spark puts it in place of its name and reads each page twice, for the filter and the column
    article = article.asNondeterministic()
    have = own.join(dropped, "_key", "left").withColumn("_a", article("_url", "_html", "_gone")).where("_a.text IS NOT NULL")
    have_not = judged.where("_open").select(*cols, F.col("_j.text").alias(out), "_host")
    all_ = have.select(*cols, F.col("_a.text").alias(out), F.col("_a.host").alias("_host")).unionByName(have_not)
    if not runs:
        return all_.drop("_host")
    of_host = written(found.groupBy("_host").agg(F.count("*").alias("_n")), "host-runs")
    return all_.join(of_host, "_host", "left").select(*cols, out, F.coalesce("_n", F.lit(0)).cast("long").alias(runs))
