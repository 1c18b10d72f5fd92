"""Trees of pages are made once, and tables of few bytes are dealt out for work that follows their rows."""

import pytest
from pyspark.sql import functions as F

from acreline.extract import cards, dom, subject
from acreline.functions import numbers
from acreline.queries import tables


def test_walk_is_page_order_below_an_element():
    root = dom.parse("<div class='a b'><p>x<b>y</b></p><br></div><i><u>z</u></i><p>end")
    assert [n.tag for n in root.walk()] == ["div", "p", "b", "br", "i", "u", "p"]
    div = root.first(dom.cls("b", "none"))
    assert [n.tag for n in div.walk()] == ["p", "b", "br"] and div.has("a", "b") and not div.has("c") and div.text() == "xy"
    assert list(root.find(dom.tag("u"))[0].walk()) == []


def test_a_page_is_parsed_once(monkeypatch):
    """All sites' readers and the reading of a page without a cut look into one tree."""
    made = []
    real = dom.Builder.close
    monkeypatch.setattr(dom.Builder, "close", lambda self: (made.append(1), real(self)))
    page = "<html><body><p class='price'>$ 5,000</p><p>once only</p></body></html>"
    cards.detail(page)
    for f in cards.SEARCH.values():
        f(page)
    assert len(made) == 1


def test_rows_of_pages_are_dealt_out(spark):
    d = tables.dealt_out(spark.range(25_000).coalesce(1), "id")
    assert d.rdd.getNumPartitions() >= 3 and d.count() == 25_000


def test_fields_cost_their_own_work(monkeypatch):
    """A price of the JSON-LD needs no tree, nor does a title, panel or shown price that the page cannot have."""
    monkeypatch.setattr(cards, "parse", lambda html: pytest.fail("a tree was made"))
    page = '<script type="application/ld+json">{"offers": {"price": "$5,000"}}</script><p>land</p>'
    assert cards.detail(page, ["offer_price", "ld_price"]) == {"offer_price": 5000.0, "ld_price": 5000.0}
    page = "<div><p>land</p></div>"
    assert cards.detail(page, ["title", "h1", "panel", "labels", "price_texts"]) == {"title": "", "h1": "", "panel": [], "labels": {}, "price_texts": [""] * 6}


def test_fields_alone_equal_all_fields():
    """Also where references stand for letters of a class, or a part is cut away."""
    pages = [
        '<html><head><meta property="og:title" content="A"><TITLE>t</TITLE></head><body><H1>Farm</H1><p class="pric&#101;">$ 5,000</p><h2>Similar</h2><p class="price">$ 9,000</p></body></html>',
        '<aside class="tl-property&#45;panel"><p class="tl-property-stat"><strong>Sold</strong></p></aside><b itemprop="price">$ 7,000</b>',
        '<p class="listings-detail&lowbar;_item"><span>Price:</span><b class="listings-detail__info">$ 5</b></p>',
        "",
        None,
    ]
    for p in pages:
        assert cards.detail(p) == {f: cards.detail(p, [f])[f] for f in cards.READ}
    first, second, third = map(cards.detail, pages[:3])
    assert (first["title"], first["h1"], first["price_texts"][2]) == ("A", "Farm", "$ 5,000")
    assert second["panel"] == ["Sold"] and second["price_texts"][5] == "$ 7,000" and third["labels"] == {"price": "$ 5"}


def test_sites_are_read_for_what_they_need(spark):
    d = spark.createDataFrame([("a", "<h1>x</h1>"), ("b", "<h1>x</h1>")], "site string, html string")
    r = d.select("site", cards.detail_of(F.col("html"), "title", "panel", site=F.col("site"), needs={"a": ("panel",)}).alias("d")).select("site", "d.*")
    assert sorted(map(tuple, r.collect())) == [("a", None, []), ("b", "x", [])]


def test_acreages_are_worked_out_once(spark):
    """Refining a headline names the list of acreages once, not once for each of its uses in each step."""
    d = spark.createDataFrame([("40 acres, 40.25 acres, $ 40.5 acres", "39.75 acres 40.251 acres"), ("none", ""), (None, None)], "a string, b string")
    found = numbers.refined_acres(numbers.headline_acres(F.col("a")), F.col("b"))
    assert [r[0] for r in d.select(found).collect()] == [40.251, None, None]
    plan = d.select(found.alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all") == 2


def test_a_selection_by_subject_reads_a_page_once(spark):
    """A filter on what was read names the texts of a page as often as the reading alone, not once for each use of them."""
    d = spark.createDataFrame([("https://www.tuttland.com/land-sale/kentucky/wayne-county/x", "<p>Explore the Property now $50,000 40 acres Active</p>"), ("https://www.landwatch.com/x", "<p>no listing</p>")], "url string, html string")
    read = subject.subjects(d)
    times = lambda x: x._jdf.queryExecution().optimizedPlan().toString().count("</script>")
    chosen = read.where("subject.ok")
    assert times(chosen) <= times(read)
    assert [(r.url.split("/")[2], r.subject.price) for r in chosen.collect()] == [("www.tuttland.com", 50000.0)]
