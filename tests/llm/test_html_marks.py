"""Names that mark an element, inside an article and outside of it."""

import time

import pytest

from acreline.llm.html_main import ARTICLE, blocks


def article(inner):
    return [text for zone, text in blocks(f"<article><p>first</p>{inner}<p>last</p></article>") if zone == ARTICLE][1:-1]


@pytest.mark.parametrize("inner, kept", [
    ('<p class="share">Share price rose</p>', ["Share price rose"]),
    ('<div id="search-results"><p>We found ten.</p></div>', ["We found ten."]),
    ('<p>see <a class="social-security" href="/x">the act</a> now</p>', ["see the act now"]),
    ('<li class="menu">soup of the day</li>', ["soup of the day"]),
    ('<div class="notice-of-1901">text</div>', ["text"]),
    ('<div class="share">f t in</div>', []),
    ('<div class="share-buttons">f t in</div>', []),
    ('<ul class="social links"><li>f</li></ul>', []),
    ('<div class="widget notice">n</div>', []),
    ('<p class="ad">buy</p>', []),
    ('<p>x <span class="ad">buy <b>now</b></span> y</p>', ["x y"]),
    ('<section class="comments-area"><p>c</p></section>', []),
    ('<header class="entry-header"><h2>Head</h2></header>', ["Head"]),
])
def test_marks_inside_an_article(inner, kept):
    assert [x for x in article(inner)] == kept


def test_marks_outside_of_an_article():
    page = '<div class="search-results">r</div><div class="social-security">s</div><p class="share">t</p><div class="story">u</div>'
    assert [(zone, text) for zone, text in blocks(page)] == [(2, "r"), (2, "s"), (2, "t"), (1, "u")]


def test_many_marked_pieces_are_read_in_line():
    began = time.time()
    assert article("<p>" + 'w <span class="ad">x</span> ' * 40_000 + "</p>") == [" ".join(["w"] * 40_000)]
    assert time.time() - began < 2
