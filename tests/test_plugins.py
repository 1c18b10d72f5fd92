"""A site that is registered from outside."""

import re

import pytest

from acreline.extract import plugins


def lots(html):
    if "broken" in html:
        raise KeyError("lot")
    return [{"name": m[1], "acres_text": m[2], "lot": int(m[3])} for m in re.finditer(r"<li>(\w+) (\d+ acres) lot (\d+)</li>", html)]


@pytest.fixture(scope="module")
def site():
    s = plugins.register(plugins.Site("lots", lots, more="lot int", newest_first=True))
    yield s
    del plugins.REGISTRY["lots"]


def test_new_site_without_touching_the_readers(spark, site):
    pages = spark.createDataFrame([(1, "<li>Hill 40 acres lot 7</li><li>Dale 9 acres lot 8</li>", "clash"), (2, "broken", "clash"), (3, None, "clash"), (4, "", "clash")], "page int, html string, error string")
    got = plugins.read_pages(pages, "lots").select("page", "name", "acres_text", "lot", "url", "error").collect()
    assert sorted(map(tuple, got), key=str) == [(1, "Dale", "9 acres", 8, None, None), (1, "Hill", "40 acres", 7, None, None), (2, None, None, None, None, "KeyError: 'lot'")]
    assert {r.name for r in plugins.catalog(spark).where("newest_first").collect()} == {"lots"}
    with pytest.raises(ValueError):
        plugins.register(plugins.Site("lots", lots))


def test_registered_readers_give_their_cards(spark):
    html = '<article class="tl-tile"><a class="tl-hit" href="/x">T</a><span class="tl-tile-title">Tract</span></article>'
    pages = spark.createDataFrame([(1, html)], "page int, html string")
    r = plugins.read_pages(pages, "tuttland").collect()[0]
    assert (r.name, r.url, r.error) == ("Tract", "https://www.tuttland.com/x", None)
