"""Points in polygons by equality joins on grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers
from ..functions.pages import high_risk_zone
from ..scratch import written

#: Rows of cells that one row of a table is exploded into at a time; a side or polygon of more is dealt out in pieces.
PIECE = 10_000
#: Cells in a row that make a block; a polygon's cells are entered by block, and its sides tell what lies inside one.
BLOCK = 64


def spread(d: DataFrame, low: str, high: str, out: str) -> DataFrame:
    """d with a row for each whole number out from low to high, never as one array of all of them."""
    d = d.withColumn("_first", F.explode(F.expr(f"sequence({low}, {high}, {PIECE}L)")))
    return d.withColumn(out, F.explode(F.expr(f"sequence(_first, least({high}, _first + {PIECE - 1}L))"))).drop("_first")


def sides(polygons: DataFrame) -> DataFrame:
    """(k, x1, y1, x2, y2) of polygons (k, rings): the sides of all rings; the last corner is joined to the first."""
    d = polygons.select("k", F.explode("rings").alias("ring")).where("size(ring) > 0")
    ends = "transform(sequence(0, size(ring) - 1), i -> named_struct('a', ring[i], 'b', ring[cast(pmod(i + 1, size(ring)) AS int)]))"
    d = d.select("k", F.explode(F.expr(ends)).alias("e"))
    return d.select("k", *[F.col(f"e.{p}.{c}").cast("double").alias(f"{c}{i}") for i, p in ((1, "a"), (2, "b")) for c in ("x", "y")])


def on_side() -> Column:
    """Whether (x, y) lies on the side from (x1, y1) to (x2, y2)."""
    turn = (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) - (F.col("y2") - F.col("y1")) * (F.col("x") - F.col("x1"))
    return (turn == 0) & F.col("x").between(F.least("x1", "x2"), F.greatest("x1", "x2")) & F.col("y").between(F.least("y1", "y2"), F.greatest("y1", "y2"))


def crossed() -> Column:
    """Whether a ray from (x, y) to the east crosses the side."""
    at = (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    return F.coalesce(((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (F.col("x") < at), F.lit(False))


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: float = 0.01, x: str = "lng", y: str = "lat", key: str = "zone_id", rings: str = "rings") -> DataFrame:
    """(x, y, key, border): the polygons that hold each different point of points; border if it lies on a side or corner.

    polygons: key, rings: an array of rings, each an array of structs (x, y). A point is in a polygon if a ray to the east
    crosses an odd number of its sides, so a ring inside another is a hole and one inside that is land again; a point on a
    side, of a hole too, is in it. Polygons may overlap. Rows with one key are one polygon. Null or non-finite points and
    sides and empty rings match nothing.

    A side is entered under the rows of grid cells that it crosses. A polygon is entered under blocks of cells between its
    first and last side of each row, so one of any size is spread over many narrow rows, and a point asks only polygons
    that reach to both sides of its block. Both joins are equality joins; crossings are added up before they are dealt out.
    """
    ok = lambda *cs: [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < 1e12 * cell) for c in cs]

    def only(d: DataFrame, *cs: str) -> DataFrame:
        for c in ok(*cs):
            d = d.where(c)
        return d

    number = lambda c, n=1: F.floor(c / (cell * n)).cast("long")
    p = only(points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")), "x", "y").distinct()
    p = p.withColumn("row", number(F.col("y"))).withColumn("block", number(F.col("x"), BLOCK))
    e = only(sides(polygons.select(F.col(key).alias("k"), F.col(rings).alias("rings"))), "x1", "y1", "x2", "y2")
    e = e.withColumn("low", number(F.least("y1", "y2"))).withColumn("high", number(F.greatest("y1", "y2")))
    e = spread(e, "low", "high", "row").drop("low", "high")
    reach = e.groupBy("k", "row").agg(F.min(F.least("x1", "x2")).alias("first"), F.max(F.greatest("x1", "x2")).alias("last"))
    reach = spread(reach.withColumn("west", number(F.col("first"), BLOCK)).withColumn("east", number(F.col("last"), BLOCK)), "west", "east", "block").drop("west", "east")
    # a point west of all sides of its row crosses an even number of them, one east of all none
    near = p.join(reach, ["row", "block"]).where("x BETWEEN first AND last").drop("first", "last")
    d = near.join(e, ["k", "row"]).groupBy("x", "y", "k").agg(F.sum(crossed().cast("int")).alias("n"), F.max(on_side()).alias("border"))
    return d.where("border OR n % 2 = 1").select(F.col("x").alias(x), F.col("y").alias(y), F.col("k").alias(key), "border")


def shapes(zones: DataFrame, order: Column) -> DataFrame:
    """(shape, rings, zone_id, zone) of zones: those of equal rings are one, named by the first in order; one of several rows is not joined with others.

    Zones over the same ground are asked once, so that work follows different shapes and not how often each occurs.
    """
    rows = zones.where("rings IS NOT NULL").select("zone_id", "zone", "rings")
    n = rows.groupBy("zone_id").agg(F.count("*").alias("n"))
    d = rows.join(n, "zone_id").withColumn("shape", F.when(F.col("n") == 1, F.sha2(F.col("rings").cast("string"), 256)).otherwise(F.concat(F.lit("zone "), F.col("zone_id").cast("string"))))
    several = d.where("n > 1").select("shape", "rings", "zone_id", "zone")
    one = d.where("n = 1").groupBy("shape").agg(F.min_by(F.struct("rings", "zone_id", "zone"), order).alias("z")).select("shape", "z.*")
    return one.unionByName(several)


def in_flood_zones(records: DataFrame, zones: DataFrame, cell: float = 0.01) -> DataFrame:
    """records with lat, lng and zone: the flood zone that holds their coordinates.

    zones: zone_id, zone, rings; of several that hold a point the first of high risk counts, else the first, in order of
    zone_id; names are given in upper case and null ones do not count. A point in no zone is NONE; a record whose
    coordinates cannot be read, or lie outside of the country, is null: unknown, never safe. All records are kept; columns
    named lat, lng and zone are replaced.
    """
    # exploded, as the optimizer would put the whole reading in place of each lat and lng, and in every filter on them
    d = records.drop("lat", "lng", "zone").select("*", F.explode(F.array(numbers.coordinates(F.col("coordinates")))).alias("_p"))
    d = d.withColumn("lat", F.col("_p.lat")).withColumn("lng", F.col("_p.lng")).drop("_p")
    order = F.struct(~F.coalesce(high_risk_zone(F.col("zone")), F.lit(False)), F.col("zone_id"))
    zones = written(shapes(zones.where("zone IS NOT NULL AND zone <> ''").withColumn("zone", F.upper("zone")), order), "shapes")
    found = points_in_polygons(d.select("lat", "lng"), zones, cell, key="shape").join(zones.select("shape", "zone_id", "zone").distinct(), "shape")
    best = found.groupBy("lat", "lng").agg(F.min_by("zone", order).alias("zone"))
    # rows without a spot are not dealt out by it: they would be one task's
    has = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    d = d.where(has).join(best, ["lat", "lng"], "left").unionByName(d.where(~has).withColumn("zone", F.lit(None).cast("string")), allowMissingColumns=False)
    return d.withColumn("zone", F.when(F.col("lat").isNotNull() & F.col("lng").isNotNull(), F.coalesce("zone", F.lit("NONE")))).select(*[c for c in records.columns if c not in ("lat", "lng", "zone")], "lat", "lng", "zone")
