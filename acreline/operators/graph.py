"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch, written

#: A node with over so many links is looked up from a broadcast; there are twice the links over this of them at most.
HOT_LINKS = 1_000
#: So many broadcast rows at most (16 bytes each): with more links the bound above grows.
HOT_NODES = 100_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node of its component.

    Rounds of large-star and small-star. A round's table of nodes tells exactly whether only stars are left. Every round is
    written to the shared folder, so a lost executor costs a round at most; all but the result is deleted. Links of a node
    with very many of them are not dealt out by that node: its smallest neighbour comes to them by a broadcast of bounded
    size. Loops and repeated edges do no harm; no edges give no rows; null ends are ignored.
    """
    scratch = Scratch(edges.sparkSession, "components")
    now = scratch.written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a IS NOT NULL AND b IS NOT NULL AND u <> v").distinct(), "edges")
    while True:
        # of each node: the smallest of it and its neighbours, and how many neighbours are smaller and larger
        ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("m"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.col("v").alias("m"), F.lit(0).alias("up"))))
        nodes = now.select(ends.alias("e")).select("e.*").groupBy("node").agg(F.min("m").alias("m"), F.sum("up").alias("up"), F.sum(1 - F.col("up")).alias("down"))
        nodes = scratch.written(nodes, "nodes")
        if nodes.where("up > 1 OR up = 1 AND down > 0").isEmpty():
            break
        links = nodes.agg(F.sum("up")).first()[0]
        hot = nodes.where(F.col("down") > max(HOT_LINKS, links // HOT_NODES)).select(F.col("node").alias("v"), "m")
        rest = now.join(F.broadcast(hot.select("v")), "v", "left_anti").join(nodes.select(F.col("node").alias("v"), "m"), "v")
        large = now.join(F.broadcast(hot), "v").select("u", "m").unionByName(rest.select("u", "m")).distinct()
        low = large.groupBy("u").agg(F.min("m").alias("v"))
        both = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("m").alias("u"), "v")))
        now = scratch.written(large.join(low, "u").select(both.alias("e")).select("e.*").where("u <> v").distinct(), "edges")
    out = written(nodes.select("node", F.col("m").alias("root")), "roots")
    scratch.clear()
    return out
