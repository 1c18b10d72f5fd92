"""Search pages to listing rows, and detail pages to readings.

A page function gives plain dicts; search_listings and detail_readings apply the one of a page's site in Arrow batches.
Numbers inside a card's texts are left to the native functions: what comes out of Python is text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys, numbers
from ..functions import text as T
from .dom import HIDDEN, Node, cls, json_ld, meta, nodes, number, parse, tag

CARD = "name string, price_text string, acres_text string, county string, state string, url string, description string, coordinates string, status string, own_text string"
FIELDS = [f.split()[0] for f in CARD.split(", ")]


def card(**k) -> dict:
    return dict.fromkeys(FIELDS) | k


def absolute(href: str, base: str) -> str:
    return href if href.startswith("http") else f"{base}{'' if href.startswith('/') else '/'}{href}"


def bare(href: str) -> str:
    return re.split("[#?]", href or "", maxsplit=1)[0].strip()


def canonical(href: str, base: str) -> str:
    return absolute(bare(href), base).rstrip("/").lower()


JUNK = re.compile(r"^(?:click|tap)\b|\b(?:view|see)\s+(?:more|photos?|details?|listing)|^\d+\s+photos?$", re.I)


def junk(t: str) -> bool:
    return len(t.strip()) < 3 or t.strip().lower() in T.JUNK_WORDS or bool(JUNK.search(t.strip()))


def linked_cards(root: Node, base: str, wanted: str, unwanted: str | None = None) -> list[dict]:
    """A card for each detail link: the nearest of four ancestors with a price and acres that holds no other listing's link.

    Links of one canonical address are one listing. Its name is the longest text of its links that is no call to action,
    else a heading.
    """
    want, not_want = re.compile(wanted, re.I), re.compile(unwanted, re.I) if unwanted else None
    ok = lambda h: bool(bare(h)) and bool(want.search(h)) and not (not_want and not_want.search(h))
    links, out = {}, []
    for a in root.find(tag("a")):
        if ok(a.attrs.get("href", "")):
            links.setdefault(canonical(a.attrs["href"], base), []).append(a)
    for address, group in links.items():
        box = text = None
        for a in group:
            n = a.parent
            for _ in range(4):
                if n is None or any(x.tag == "a" and ok(x.attrs.get("href", "")) and canonical(x.attrs["href"], base) != address for x in n.walk()):
                    break
                t = n.text(spaced=True, skip=HIDDEN)
                if re.search(r"\$\s?[\d,]{4,}", t) and re.search("acres?", t, re.I):
                    box, text = n, t
                    break
                n = n.parent
            if box:
                break
        if box is None:
            continue
        names = [t for t in (a.text(spaced=True, skip=HIDDEN) for a in group) if not junk(t)]
        heading = box.first_text(tag("h1", "h2", "h3", "h4", "h5", "h6"))
        name = max(names, key=len, default="") or (heading if not junk(heading) else "")
        out.append(card(name=name[:200] or None, url=absolute(bare(group[0].attrs["href"]), base), description=text[:400], own_text=text))
    return out


def first_href(n: Node, *parts: str) -> str:
    a = n.first(lambda x: x.tag == "a" and any(p in x.attrs.get("href", "") for p in parts))
    return bare(a.attrs["href"]) if a else ""


def selected_cards(root: Node, base: str, boxes: Callable[[Node], bool], title: Callable, price: Callable, acres: Callable, links: tuple[str, ...], about: Callable, at: tuple[str, str] | None = None) -> list[dict]:
    """A card for each box, with the texts of its named parts."""
    out = []
    for n in root.find(boxes):
        href = first_href(n, *links)
        where = ", ".join(n.attrs.get(k, "") for k in at) if at and all(n.attrs.get(k) for k in at) else None
        out.append(card(name=n.first_text(title) or None, price_text=n.first_text(price), acres_text=n.first_text(acres), url=absolute(href, base) if href else None, description=n.first_text(about), coordinates=where))
    return out


def landwatch(html: str) -> list[dict]:
    """Linked cards; the acreage text of the page's JSON-LD goes along for refinement."""
    said = {}
    for data in json_ld(html):
        for n in nodes(data, 12):
            url = n.get("url") if isinstance(n.get("url"), str) else n.get("@id")
            if isinstance(url, str) and isinstance(n.get("description"), str) and re.search(r"/pid/\d+", url, re.I):
                said.setdefault(bare(url).rstrip("/").lower(), n["description"])
    found = linked_cards(parse(html), "https://www.landwatch.com", r"/pid/\d+")
    return [c | {"acres_text": said.get(bare(c["url"]).rstrip("/").lower())} for c in found]


def whitetail(html: str) -> list[dict]:
    return linked_cards(parse(html), "https://www.whitetailproperties.com", r"/hunting-land/[^/]+/[^/]+/[^/?#]+")


def mossyoak(html: str) -> list[dict]:
    return linked_cards(parse(html), "https://www.mossyoakproperties.com", r"/property/|/listings?/|/land-for-sale/[^/]+/[^/]+/[^/?#]+", r"-county/?$|/land-for-sale/[^/]+/?$")


def landcom(html: str) -> list[dict]:
    heads = lambda *c: lambda n: cls(*c)(n) or n.tag in ("h2", "h3")
    return selected_cards(parse(html), "https://www.land.com", lambda n: cls("property-card", "listing-item")(n) or "data-listing-id" in n.attrs, heads("property-title", "listing-name"), cls("property-price", "price"), cls("property-acres", "acres"), ("/listing/", "/property/"), cls("property-description", "description"), ("data-latitude", "data-longitude"))


def landfarm(html: str) -> list[dict]:
    heads = lambda n: cls("result-title", "listing-title")(n) or n.tag in ("h2", "h3")
    return selected_cards(parse(html), "https://www.landandfarm.com", cls("search-result", "listing-card", "property-result"), heads, cls("result-price", "price"), cls("result-acres", "acres", "acreage"), ("/property/", "/land/"), cls("result-description", "description"))


def landsofamerica(html: str) -> list[dict]:
    heads = lambda n: cls("property-name", "listing-title")(n) or n.tag in ("h2", "h3")
    return selected_cards(parse(html), "https://www.landsofamerica.com", lambda n: n.attrs.get("data-testid") == "property-card" or cls("property-card", "listing-card")(n), heads, cls("property-price", "price"), cls("property-acres", "acres"), ("/property/",), cls("property-description", "description"), ("data-lat", "data-lon"))


def livingthedream(html: str) -> list[dict]:
    out = []
    for n in parse(html).find(cls("rs-listing-card")):
        title = n.first(cls("card-title"))
        a = title and title.first(lambda x: x.tag == "a" and x.attrs.get("href", "").strip())
        if not a:
            continue
        place = n.first(cls("location"))
        spans = [s.text().rstrip(", ") for s in place.find(tag("span"))] if place else []
        county = re.fullmatch(r"(.*\S)\s+(?:County|Co)\.?", spans[0], re.I) if spans else None
        url = absolute(a.attrs["href"].strip(), "https://www.livingthedreamland.com")
        out.append(card(name=(a.text() or url)[:200], price_text=n.first_text(cls("label--price")), acres_text=n.first_text(cls("label--acre")), county=county[1].strip() if county else (spans[0] if spans and spans[0] else None), state=spans[1] if len(spans) > 1 else None, url=url, description=n.first_text(cls("description"))[:400], coordinates=f"{n.attrs.get('data-lat', '')}, {n.attrs.get('data-lng', '')}"))
    return out


def midwestlandgroup(html: str) -> list[dict]:
    out = []
    for n in parse(html).find(lambda x: x.tag == "div" and x.has("listings-archive", "row") and not x.has("hidden")):
        heads = [a for h in n.find(cls("listings-archive__title")) for a in h.find(tag("a"))]
        own = [bare(a.attrs.get("href", "")) for a in heads + n.find(tag("a"))]
        href = next((h for h in own if re.fullmatch(r"(?:https?://[^/]+)?/listings/(?!feed/?$)[^/]+/?", h, re.I)), None)
        if href is None:
            continue
        part = lambda kind, n=n: n.first_text(lambda x: x.has("listings-archive__item", f"item--{kind}"))
        out.append(card(name=(n.first_text(cls("listings-archive__title")) or f"{part('county') or 'Midwest Land Group'} Land")[:200], price_text=part("price"), acres_text=part("acre"), county=part("county") or None, state=part("state") or None, url=absolute(href, "https://midwestlandgroup.com"), description=n.first_text(cls("listings-archive__description"))[:400]))
    return out


def landflip(html: str) -> list[dict]:
    out = []
    for n in parse(html).find(lambda x: x.tag == "article" and x.has("list-block")):
        info = n.first(cls("list-info"))
        head = info and info.first(tag("h4"))
        a = head and head.first(tag("a"))
        hrefs = [bare(a.attrs.get("href", "")) if a else "", bare(n.attrs.get("data-url", ""))]
        href = next((h for h in hrefs if re.fullmatch(r"(?:https?://[^/]+)?/land/\d+/?", h, re.I)), None)
        if href is None:
            continue
        tagged = re.search(rf"({numbers.ACREAGE})\s*acres?\s*:\s*\$\s*({numbers.ACREAGE})", n.first_text(cls("price-ac")), re.I)
        parts = [p for p in (x.strip() for x in (info.first_text(tag("p")) if info else "").split(":")) if p]
        county = next((m[1].strip() for p in parts if (m := re.fullmatch(r"(.*\S)\s+(?:Co|County)", p, re.I))), None) if len(parts) > 1 else None
        url = absolute(href, "https://www.landflip.com")
        out.append(card(name=((a.text() if a else "") or url)[:200], price_text=tagged[2] if tagged else "", acres_text=tagged[1] if tagged else "", county=county, state=parts[-1] if len(parts) > 1 else None, url=url, description=n.first_text(cls("excerpt"))[:400]))
    return out


def nationalland(html: str) -> list[dict]:
    out = []
    for n in parse(html).find(lambda x: "data-property" in x.attrs and x.attrs.get("data-slug", "").strip()):
        g = lambda k, n=n: " ".join(n.attrs.get(k, "").split())
        url = f"https://nationalland.com/listing/{g('data-slug')}"
        out.append(card(name=(g("data-property") or url)[:200], price_text=g("data-price"), acres_text=g("data-acres"), county=g("data-county") or None, url=url, description="", status=g("data-status")))
    return out


def tuttland(html: str) -> list[dict]:
    out = []
    for n in parse(html).find(lambda x: x.tag == "article" and x.has("tl-tile")):
        a = n.first(lambda x: x.tag == "a" and x.has("tl-hit") and x.attrs.get("href", "").strip())
        if not a:
            continue
        price = n.first(lambda x: x.tag == "meta" and x.attrs.get("itemprop") == "price")
        sub = n.first(cls("tl-subtitle"))
        place = re.search(r"\bin\s+(.+?)\s+County,\s*([A-Za-z]{2})\b", sub.first_text(lambda x: x.attrs.get("itemprop") == "name") if sub else "", re.I)
        name = n.first_text(cls("tl-tile-title")) or f"{place[1] if place else 'Tutt Land'} Land"
        out.append(card(name=name[:200], price_text=(price.attrs.get("content", "") if price else "") or n.first_text(lambda x: x.has("tl-badge", "tl-price")), acres_text=n.first_text(lambda x: x.has("tl-line", "tl-county")), county=" ".join(place[1].split()) if place else None, state=place[2].upper() if place else None, url=absolute(a.attrs["href"].strip(), "https://www.tuttland.com"), description="", status=n.first_text(lambda x: x.has("tl-badge", "tl-status"))))
    return out


#: Plug-ins by site; linked ones take price and acres from the card's whole text.
SEARCH: dict[str, Callable[[str], list[dict]]] = {f.__name__: f for f in (landwatch, landcom, landfarm, landsofamerica, livingthedream, whitetail, mossyoak, midwestlandgroup, landflip, nationalland, tuttland)}
LINKED = ("landwatch", "whitetail", "mossyoak")
COMPLETE = ("landcom", "landfarm", "landsofamerica")


def cards_of(site: Column, html: Column) -> Column:
    """array<card> of search pages, [] where the page cannot be read."""

    @F.pandas_udf(f"array<struct<{', '.join(f.replace(' ', ':') for f in CARD.split(', '))}>>")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sites, pages in batches:
            out = []
            for s, p in zip(sites, pages):
                try:
                    out.append(SEARCH[s](p or "") if s in SEARCH else [])
                except (ValueError, RecursionError):
                    out.append([])
            yield pd.Series(out, dtype=object)

    return read(site, html)


def search_listings(pages: DataFrame, site: str = "site", html: str = "html") -> DataFrame:
    """The listings of search pages: pages' columns but html, with name, price, acres, county, state, url, description, coordinates, status.

    pages: site, html and optionally county and state of the search, which fill in what a card does not say. Cards whose
    status is not available are dropped; sites with named parts need price, acres and a link; linked cards need both
    numbers and must not name another county only.
    """
    from ..operators.lookup import mentions_other_county

    have = [c for c in pages.columns if c != html]
    d = pages.withColumn("_c", F.explode(cards_of(F.col(site), F.col(html))))
    c = lambda f: F.col(f"_c.{f}")
    linked, whole = F.col(site).isin(*LINKED), F.col(site).isin(*COMPLETE)
    acres = F.when(linked, numbers.refined_acres(numbers.headline_acres(c("own_text")), c("acres_text"))).otherwise(numbers.acres(c("acres_text")))
    price = F.when(linked, numbers.total_price(c("own_text"))).otherwise(numbers.price(c("price_text")))
    searched = lambda k: F.col(k) if k in have else F.lit(None).cast("string")
    county = F.when(linked | whole, searched("county")).otherwise(c("county"))
    state = F.when(linked | whole, searched("state")).otherwise(F.coalesce(keys.known_state(c("state")), F.upper(searched("state"))))
    d = d.withColumns({"_price": price, "_acres": acres, "_county": county, "_state": state})
    ok = ~T.unavailable_status(F.coalesce(c("status"), F.lit("")))
    ok = ok & F.when(linked | whole, (F.col("_price") > 0) & (F.col("_acres") > 0) & c("url").isNotNull()).otherwise(True)
    ok = ok & ~F.coalesce(F.col(site).isin("landwatch", "whitetail", "mossyoak") & F.col("_county").isNotNull() & mentions_other_county(c("own_text"), F.col("_county")), F.lit(False))
    spot = numbers.coordinates(c("coordinates"))
    where = F.when(whole, c("coordinates")).when(spot.isNotNull(), F.concat(spot["lat"].cast("string"), F.lit(", "), spot["lng"].cast("string")))
    keep = [k for k in have if k not in ("county", "state")]
    return d.where(ok).select(*keep, F.coalesce(c("name"), F.concat(F.coalesce("_county", "_state"), F.lit(" Land"))).alias("name"), F.col("_price").alias("price"), F.col("_acres").alias("acres"), F.col("_county").alias("county"), F.col("_state").alias("state"), c("url").alias("url"), c("description").alias("description"), where.alias("coordinates"), c("status").alias("status"))


# ---- detail pages


WIDGET = re.compile(r'"(?:other|nearby|related|similar)[-_]?listings"\s*:\s*(?=[\[{])', re.I)
# Fixed value: words that begin the part of a page that is about other listings.
BOUNDARY = r"nearby|similar|related|recommended|also-?\s*like|other-?\s*listings"


def bracket_end(s: str, at: int) -> int:
    """The place of the bracket that closes the one at a place, those inside strings left out; -1 if none does."""
    depth = 0
    for m in re.compile(r'"(?:[^"\\]|\\.)*"|[\[{]|[\]}]', re.S).finditer(s, at):
        if m[0] in "[{":
            depth += 1
        elif m[0] in "]}":
            depth -= 1
            if depth == 0:
                return m.start()
    return -1


def scoped(html: str | None) -> tuple[str, bool]:
    """The page without what is about other listings, and whether there was any: JSON lists of them, and all from a heading or element named so."""
    html, found = html or "", False
    body = re.search(r"<body[^>]*>", html, re.I)
    start = body.end() if body else 0
    while m := WIDGET.search(html, start):
        end = bracket_end(html, m.end())
        if end < 0:
            break
        html, found = html[: m.start()] + html[end + 1 :], True
    region = re.sub(r"<style.*?</style>", lambda m: " " * len(m[0]), html, flags=re.I | re.S)
    heads = (m.start() for m in re.finditer(r"<h[1-6][^>]*>(.*?)</h[1-6]>", region[start:], re.I | re.S) if re.search(BOUNDARY, re.sub("<[^>]+>", " ", m[1]), re.I))
    named = (m.start() for m in re.finditer(r"<[a-z][a-z0-9]*\b[^>]*\b(?:class|id)\s*=\s*[\"']([^\"']*)[\"'][^>]*>", region[start:], re.I) if re.search(BOUNDARY, m[1], re.I))
    cuts = [x for x in (next(heads, None), next(named, None)) if x is not None]
    return (html[: start + min(cuts)], True) if cuts else (html, found)


def offer_price(data: object, least: float = 1000) -> float | None:
    """The first price above least of an object's offers, itself, or its graph."""
    for item in data if isinstance(data, list) else [data]:
        if not isinstance(item, dict):
            continue
        offers = item.get("offers")
        for o in [*(offers if isinstance(offers, list) else [offers]), item]:
            if isinstance(o, dict) and o.get("price") and (p := number(re.sub(r"[^0-9.]", "", str(o["price"])))) is not None and p > least:
                return p
        if item.get("@graph") and (p := offer_price(item["@graph"], least)) is not None:
            return p
    return None


def ld_reading(said: list) -> dict:
    """availability, price above 1,000 and a name with acres: the first of each in a page's JSON-LD."""
    out = {"availability": None, "ld_price": None, "ld_name": None}
    for data in said:
        for n in nodes(data, 12):
            if n.get("availability") and not out["availability"]:
                out["availability"] = str(n["availability"])
            if n.get("price") is not None and out["ld_price"] is None and (p := number(n["price"])) is not None and p > 1000:
                out["ld_price"] = p
            if isinstance(n.get("name"), str) and not out["ld_name"] and "acre" in n["name"].lower():
                out["ld_name"] = n["name"]
    return out


def geo(said: list) -> str | None:
    """Latitude and longitude of the first object in a page's JSON-LD that has both."""
    for data in said:
        for n in nodes(data, 8):
            lat, lng = number(n.get("latitude")), number(n.get("longitude"))
            if lat is not None and lng is not None:
                return f"{lat}, {lng}"
    return None


PROSE = frozenset("p div section article li td blockquote main".split())
ASIDE = frozenset("script style noscript nav header footer aside svg form template".split())


def largest_prose(n: Node, share: float = 0.65) -> str:
    """The text of the block that holds most of the text, found by going down as long as one child has share of it."""
    size = len(n.text(skip=ASIDE))
    for _ in range(100):
        if not size:
            break
        children = [(len(c.text(skip=ASIDE)), i, c) for i, c in enumerate(n.children) if isinstance(c, Node) and c.tag in PROSE]
        best = max(children, key=lambda x: (x[0], -x[1]), default=None)
        if not best or best[0] < share * size:
            break
        size, n = best[0], best[2]
    return n.text(skip=ASIDE)


def description(root: Node, html: str, most: int = 2000) -> str:
    """The descriptions of the head and the largest prose, without those that another contains."""
    body = root.first(tag("main")) or root.first(tag("article")) or root.first(tag("body"))
    parts = [" ".join(p.split()) for p in (meta(root, "og:description"), meta(root, "description"), largest_prose(body) if body else "") if p]
    kept = [p for i, p in enumerate(parts) if not any(j != i and len(q) > len(p) and p in q for j, q in enumerate(parts))]
    return " ".join(kept)[:most]


#: Pages over these bounds are not parsed into a tree; the native description by pattern is used instead.
MOST_CHARS, MOST_TAGS = 1_000_000, 15_000

PRICE_PLACES = [cls("property-price"), cls("listing-price"), cls("price"), lambda n: n.attrs.get("data-testid") == "price", cls("detail-price"), lambda n: n.attrs.get("itemprop") == "price"]

DETAIL = "title string, description string, scoped_html string, boundary boolean, h1 string, availability string, ld_price double, ld_name string, offer_price double, price_texts array<string>, geo string, labels map<string,string>, panel array<string>, too_large boolean"


TITLES, H1 = re.compile("<(?:h1|title)", re.I), re.compile("<h1", re.I)


class Page:
    """A detail page; what several fields need is worked out once, and only if one of them is asked for."""

    def __init__(self, html: str | None):
        self.html = html or ""

    @cached_property
    def too_large(self) -> bool:
        return len(self.html) > MOST_CHARS or self.html.count("<") > MOST_TAGS

    @cached_property
    def scoped(self) -> tuple[str, bool]:
        return scoped(self.html)

    @cached_property
    def said(self) -> list:
        return list(json_ld(self.html))

    @cached_property
    def ld(self) -> dict:
        return ld_reading(self.said)

    @cached_property
    def root(self) -> Node:
        return parse(self.html)

    @cached_property
    def scope(self) -> Node:
        return self.root if self.scoped[0] == self.html else parse(self.scoped[0])

    def may_have(self, *words: str) -> bool:
        """Whether an attribute may hold one of the words; a reference in the page may stand for any letter."""
        return "&" in self.html or any(w in self.html for w in words)

    def title(self) -> str:
        if not (self.may_have("og:title") or TITLES.search(self.html)):
            return ""
        return meta(self.root, "og:title") or self.root.first_text(tag("h1")) or self.root.first_text(tag("title"))

    def h1(self) -> str:
        return self.scope.first_text(tag("h1")) if H1.search(self.scoped[0]) else ""

    def price_texts(self) -> list[str]:
        """The first text of each of PRICE_PLACES, all of which have the word price."""
        return [self.scope.first_text(x) for x in PRICE_PLACES] if self.may_have("price") else [""] * len(PRICE_PLACES)

    def offer_price(self) -> float | None:
        said = self.said if not self.said or self.scoped[0] == self.html else json_ld(self.scoped[0])
        return next((p for data in said if (p := offer_price(data)) is not None), None)

    def labels(self) -> dict:
        if not self.may_have("listings-detail__item"):
            return {}
        items = {n.first_text(tag("span")).rstrip(": ").lower(): n.first_text(cls("listings-detail__info")) for n in self.root.find(cls("listings-detail__item"))}
        return {k: v for k, v in items.items() if k and v}

    def panel(self) -> list[str]:
        if not self.may_have("tl-property-panel"):
            return []
        panels = [s for p in self.root.find(lambda n: n.tag == "aside" and n.has("tl-property-panel")) for s in p.find(cls("tl-property-stat"))]
        return [t for t in (x.text() for s in panels for x in s.find(tag("strong"))) if t and not re.search(r"\bacres?\b", t, re.I)]

    def description(self) -> str:
        block = re.sub(r"(?i)^property description\s*", "", self.root.first_text(cls("listing-description")))[:2000] if self.may_have("listing-description") else ""
        return block or description(self.root, self.html)


#: What gives each field of DETAIL; those of TREE look into the page's tree, and a page that is too large has none of them.
READ: dict[str, Callable[[Page], object]] = {
    "title": Page.title,
    "description": Page.description,
    "scoped_html": lambda p: p.scoped[0],
    "boundary": lambda p: p.scoped[1],
    "h1": Page.h1,
    "availability": lambda p: p.ld["availability"],
    "ld_price": lambda p: p.ld["ld_price"],
    "ld_name": lambda p: p.ld["ld_name"],
    "offer_price": Page.offer_price,
    "price_texts": Page.price_texts,
    "geo": lambda p: geo(p.said),
    "labels": Page.labels,
    "panel": Page.panel,
    "too_large": lambda p: p.too_large,
}
TREE = {"title": None, "description": None, "h1": None, "price_texts": [], "labels": {}, "panel": []}


def detail(html: str | None, fields: Iterable[str] = tuple(READ)) -> dict:
    """What a detail page says in the fields, as texts and numbers by place; a page that is too large gives its JSON-LD alone."""
    p = Page(html)
    return {f: TREE[f] if f in TREE and p.too_large else READ[f](p) for f in fields}


def detail_of(html: Column, *fields: str, site: Column | None = None, needs: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Struct of the fields of DETAIL (all if none are named) of detail pages.

    A field costs its own work, so name those that are used. needs tells for some sites which of them their pages are read
    for; the others are null there.
    """
    kinds = dict(re.findall(r"(\w+) (\w+(?:<[^>]*>)?)", DETAIL))
    names = list(fields or kinds)
    some = {k: tuple(f for f in names if f in v) for k, v in (needs or {}).items()}

    @F.pandas_udf(", ".join(f"{f} {kinds[f]}" for f in names))
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for pages, sites in batches:
            found = [detail(p, some.get(s, names)) for p, s in zip(pages, sites)]
            yield pd.DataFrame([[x.get(f) for f in names] for x in found], columns=names, dtype=object)

    return read(html, F.lit(None).cast("string") if site is None else site)
