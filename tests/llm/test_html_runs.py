"""Suffix arrays of the hosts' page frames, and what they decide together with the marks."""

import random
from collections import Counter

import pytest

from acreline.llm import html_main
from acreline.llm.html_main import ARTICLE, FRAME, Suffixes, blocks, doubted, host_of, main_text

SHARE = "share this story with your friends on all of the networks"
QUOTE = "nothing in this wide world is ever quite as old as it looks"
HEADLINE = "the mayor of the old town has left for the sea with all the keys"


def rows_of(spark, pages, **how):
    rows = main_text(spark.createDataFrame(pages, "page_id long, url string, html string"), **how).collect()
    assert len(rows) == len(pages)
    return {r.page_id: r for r in rows}


def texts(spark, pages, **how):
    return {k: r.text for k, r in rows_of(spark, pages, **how).items()}


def page(n, article="", frame=""):
    return f"<article><h1>Story {n}</h1><p>told number {n}</p>{article}</article>{frame}"


@pytest.mark.parametrize("part_tokens", [1 << 14, 5])
def test_runs_and_marks_decide_together_on_pages_with_article(spark, part_tokens):
    url = "http://h.example/x"
    share = f'<p class="share">{SHARE}</p>'
    pages = [(i, url, page(i, f'{share}<p>{QUOTE}</p><p class="share">Share price of number {i} rose in the very last hour of trading</p>', f"<footer>{SHARE} {i}</footer>")) for i in range(3)]
    pages += [(3, url, page(3, f"<p>{SHARE}</p>"))]
    pages += [(i, url, page(i, frame=f"<aside>{HEADLINE}</aside>")) for i in range(4, 8)]
    pages += [(8, url, page(8, f'<div class="banner-2024"><h2>{HEADLINE}</h2></div>'))]
    pages += [(9, "http://other.example", page(9, share))]
    got = rows_of(spark, pages, part_tokens=part_tokens, runs="runs")
    # marked in doubt and a run of three articles: goes; a quotation has no mark, the last block is no run but for its number
    assert got[1].text == f"Story 1\ntold number 1\n{QUOTE}\nShare price of number 1 rose in the very last hour of trading"
    assert got[3].text == f"Story 3\ntold number 3\n{SHARE}"
    # lists of other pages have the headline, but no other article
    assert got[8].text == f"Story 8\ntold number 8\n{HEADLINE}"
    assert got[9].text == f"Story 9\ntold number 9\n{SHARE}"
    assert got[0].runs > 0 == got[9].runs and {k: (r.text, r.runs) for k, r in got.items()} == brute(pages, 10, 3)
    assert {k: r.text for k, r in got.items()} == texts(spark, pages, part_tokens=part_tokens)


def test_an_element_in_doubt_goes_as_a_whole(spark):
    pages = [(i, "http://h.example", page(i, f'<div class="notice-of-1901"><p>{QUOTE}</p><p>found in volume {i}</p></div><div class="share-2024"><p>{SHARE}</p><p>{QUOTE}</p></div>')) for i in range(4)]
    assert texts(spark, pages)[2] == f"Story 2\ntold number 2\n{QUOTE}\nfound in volume 2"


def test_copies_do_not_remove_each_other(spark):
    line = "a page of one story that is here again and again word for word"
    pages = [(i, "http://h.example", f"<div class=ad>buy {i}</div><div><p>{line}</p></div><footer>{i}</footer>") for i in range(5)]
    comment = f"<div class=comments><p>{line}</p></div>"
    pages += [(i, "http://g.example", f"<article><p>{line}</p></article>{comment}<footer>{i}</footer>") for i in range(5, 10)]
    assert set(texts(spark, pages).values()) == {line}


def test_suffixes_are_sorted_to_their_end():
    rng = random.Random(3)
    for _ in range(60):
        pages = [[rng.choice("ab") for _ in range(rng.randint(1, 12))] for _ in range(rng.randint(1, 6))]
        array = Suffixes(pages)
        keys = [array.stream[i:].tolist() for i in array.order]
        assert keys == sorted(keys) and len(keys) == sum(map(len, pages)) + len(pages)
        for width in (1, 3):
            run = array.runs(width)
            of = {}
            for r, p in zip(run, array.order):
                i = list(array.page[array.order == p])[0]
                begin = p - (array.ends[i] - len(pages[i]))
                tokens = tuple(pages[i][begin : begin + width])
                assert (r < 0) == (len(tokens) < width)
                if r >= 0:
                    assert of.setdefault(r, tokens) == tokens
            assert len(set(of.values())) == len(of)
        assert len(array.order) == len(set(array.order.tolist()))


def test_a_page_cut_off_inside_its_article():
    assert doubted("<body><article><p>one</p><p>two") == [(ARTICLE, "one", 0), (ARTICLE, "two", 0)]
    assert doubted("<body><article><p>one <span class=ad>buy") == [(2, "buy", 0), (ARTICLE, "one", 0)]
    assert doubted("<article><p>one</p><div class=share-2024><p>two") == [(ARTICLE, "one", 0), (ARTICLE, "two", 1)]


def brute(pages, w, m):
    cut = []
    for k, url, html in pages:
        found = doubted(html)
        article = [x for z, x, _ in found if z == ARTICLE]
        stream = [(t, z, d, n) for n, (z, x, d) in enumerate(found) if z != ARTICLE or d for t in x.split()]
        tokens = [t for t, *_ in stream]
        grams = [(tuple(tokens[i : i + w]), stream[i][2] > 0) for i in range(len(tokens) - w + 1)]
        source = "\n".join(article or [x for z, x, _ in found if z == FRAME]) or " ".join(tokens)
        cut.append((k, host_of(url), found, stream, grams, source, bool(article)))
    out = {}
    for k, host, found, stream, grams, _, article in cut:
        peers, hidden, sure = [c for c in cut if c[1] == host], set(), set()
        for i, (g, doubt) in enumerate(grams):
            if len({c[5] for c in peers if any(x == g for x, _ in c[4])}) >= m:
                hidden |= set(range(i, i + w))
            if doubt and len({c[5] for c in peers if (g, True) in c[4]}) >= m:
                sure |= set(range(i, i + w))
        stay = {d for i, (_, _, d, _) in enumerate(stream) if i not in sure}
        if article:
            text = "\n".join(x for z, x, d in found if z == ARTICLE and (not d or d in stay))
        else:
            lines = [" ".join(t for i, (t, z, _, at) in enumerate(stream) if at == n and z == FRAME and i not in hidden) for n in range(len(found))]
            text = "\n".join(x for x in lines if x)
        counts = Counter(g for _, g in {(c[5], g) for c in peers for g, _ in c[4]})
        out[k] = (text, sum(n >= m for n in counts.values()))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcd") for _ in range(rng.randint(2, 5))) for _ in range(12)]
    some = lambda tag, n: "".join(f"<{tag}>{rng.choice(pool)}</{tag.split()[0]}>" for _ in range(rng.randint(0, n)))
    pages = []
    for k in range(150):
        article = f"<article>{some('p', 2)}{some('p class=share', 2)}<div class=menu-2024>{some('p', 2)}</div></article>" if rng.random() < 0.6 else ""
        pages.append((k, f"http://{rng.choice(['x', 'x', 'x', 'y', 'z' + str(k)])}.example/{k}", f"{some('nav', 1)}{article}{some('div', 2)}{some('footer', 2)}"))
    want = brute(pages, 3, 3)
    assert sum("\n".join(x for z, x in blocks(h) if z == ARTICLE) != want[k][0] for k, _, h in pages if "<article><p" in h) > 5
    part_tokens = [1 << 14, 40, 7][seed]
    got = rows_of(spark, pages, min_tokens=3, part_tokens=part_tokens, runs="runs")
    assert {k: (r.text, r.runs) for k, r in got.items()} == want
    assert texts(spark, pages, min_tokens=3, part_tokens=part_tokens) == {k: x[0] for k, x in want.items()}


def test_numbers_of_suffixes():
    assert html_main.heads_of("a b c".split(), 2) == [html_main.number_of("a b"), html_main.number_of("b c")] and html_main.heads_of(["a"], 2) == []
