"""Connected components over an edge table, by alternating large-star and small-star rounds.

Each round is a handful of joins and partial aggregations over the edges; no
neighbour list is gathered. The smallest neighbours that the edges look up are
broadcast, or those of the hubs are if they are many, so that no task gets all
edges of a hub. Each round's edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, looked_up, saved


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on edges (a, b) with a > b, saved."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = saved(both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("many")), "least")
    met = looked_up(both, least, ["a"], "many")
    if large:
        m = F.least("a", "m")
        out = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), m.alias("b"))
    else:
        out = met.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
    out = saved(out.where(F.col("a") != F.col("b")).distinct(), "edges")
    discard(least)
    return out


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one smaller node that hangs on none: each component is done."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    seen = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return seen.where((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0))).isEmpty()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for every node on an edge; the root is its component's smallest node.

    Loops, repeats and either direction are fine; null ends are ignored; no
    edges give an empty table.
    """
    now = saved(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges"
    )
    while not _are_stars(now):
        wide = _stars(now, True)
        after = _stars(wide, False)
        discard(now, wide)
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
