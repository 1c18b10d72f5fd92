"""Sites as plug-ins: a table function for each, whose columns and flags the plug-in states."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import cards


@dataclass(frozen=True)
class Site:
    """What a site's plug-in states.

    read gives the cards of a search page as dicts of the columns of cards.CARD and of more, absent ones null. The flags
    say whether pages need a browser, come newest first, and are searched by county.
    """

    name: str
    read: Callable[[str], list[dict]]
    more: str = ""
    browser: bool = False
    newest_first: bool = False
    by_county: bool = True


REGISTRY: dict[str, Site] = {}


def register(site: Site) -> Site:
    """Adds a site; a name is given once."""
    if REGISTRY.setdefault(site.name, site) is not site:
        raise ValueError(f"there is a site {site.name} already")
    return site


for _name, _read in cards.SEARCH.items():
    register(Site(_name, _read))


def columns(site: Site) -> str:
    return ", ".join(filter(None, [cards.CARD, site.more, "error string"]))


def reader(site: Site):
    """The table function of a site: a row a card; a page on which the reader fails is one row with error alone."""
    schema, read = StructType.fromDDL(columns(site)), site.read
    names = schema.names

    class Reader:
        @staticmethod
        def analyze(html: AnalyzeArgument) -> AnalyzeResult:
            if html.dataType.simpleString() not in ("string", "void"):
                raise ValueError("a page is a string")
            return AnalyzeResult(schema)

        def eval(self, html: str):
            try:
                found = read(html or "")
            except Exception as e:  # whatever a plug-in raises concerns its page alone
                yield (*[None] * (len(names) - 1), f"{type(e).__name__}: {e}"[:500])
                return
            for c in found:
                yield tuple(c.get(n) for n in names[:-1]) + (None,)

    return F.udtf(Reader)


def read_pages(pages: DataFrame, name: str, html: str = "html") -> DataFrame:
    """pages without html, a row for each card of each page with the columns of the site's table function.

    A page without cards gives no row, one on which the reader fails a row with error. Columns of pages with a name of the
    table function's are replaced.
    """
    site = REGISTRY[name]
    own = set(StructType.fromDDL(columns(site)).names)
    d = pages.select(F.struct(*[c for c in pages.columns if c not in own and c != html] or [F.lit(0).alias("_")]).alias("page"), F.col(html).alias("html"))
    found = d.lateralJoin(reader(site)(F.col("html").outer())).drop("html")
    rest = [c for c in pages.columns if c not in own and c != html]
    return found.select(*[F.col(f"page.{c}").alias(c) for c in rest], *[c for c in found.columns if c != "page"])


def catalog(spark: SparkSession) -> DataFrame:
    """(name, browser, newest_first, by_county) of the registered sites."""
    return spark.createDataFrame([(s.name, s.browser, s.newest_first, s.by_county) for s in REGISTRY.values()], "name string, browser boolean, newest_first boolean, by_county boolean")
