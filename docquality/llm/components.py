"""Connected components of a graph by alternating star operations, all of it distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _toward_least(links: DataFrame, of: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """links (u, v), made of a kept table, with the least of u and its neighbours, as m; and the table of m, to be dropped. It is written first,
    so that both sides of the join are plain shuffles, of which Spark can split a hub's."""
    least = scratch.keep(links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), (of,))
    return links.join(least, "u"), least


def _settled(links: DataFrame) -> bool:
    """Whether every node points to one other at most, and none to a node that points on."""
    each = links.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("points")), F.struct(F.col("v").alias("x"), F.lit(0).alias("points")))).alias("e"))
    g = each.groupBy("e.x").agg(F.sum("e.points").alias("out"), F.count(F.lit(1)).alias("n"))
    return g.filter((F.col("out") > 1) | (F.col("out") == 1) & (F.col("n") > 1)).isEmpty()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (a, b) of long ids → (node, root): root is the least node that its links reach. Nodes without links are left out.

    Every round points neighbours to the least one they know (large star, then small star), which takes about log(n)
    rounds; each round's links are written to shared storage. A hub's links are spread by the join, not gathered.
    """
    now = scratch.keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _settled(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        joined, least = _toward_least(both, now, scratch)
        large = scratch.keep(joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), (now,))
        scratch.drop(least)
        small, least = _toward_least(large, large, scratch)
        new = scratch.keep(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct(), (large,))
        scratch.drop(large, now, least)
        now = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
