"""Candidate pairs within blocks, without all pairs of a block.

A block is a key that several nodes share. Nodes that links connect already
need no pair. In a block with few nodes outside its largest group, these are
held against all of the block; a block with more is divided by the caller,
by a rule that keeps every pair that could be a link.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, looked_up, saved, small_side

#: Nodes of a block outside its largest group that are held against all of the block; more of them divide it.
OPEN = 64


def ordered(x: Column | str, y: Column | str) -> list[Column]:
    return [F.greatest(x, y).alias("a"), F.least(x, y).alias("b")]


#: Whether two rows can be a link at all, from their columns by name.
Fits = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


def ends(rows: DataFrame, name: str, fits: Callable[[Column, Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs ``(a, b)`` of each node of a block with the block's first and last node, and ``(key, many)`` of blocks of three nodes or more.

    ``rows`` has distinct ``(key, node)``; pairs that do not ``fit`` are left out.
    """
    of = saved(rows.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("many")).where("lo < hi"), f"{name}-ends")
    held = looked_up(rows, of, ["key"], "many").select("node", F.explode(F.array("lo", "hi")).alias("e")).where("node <> e")
    if fits is not None:
        held = held.where(fits(F.col("node"), F.col("e")))
    out = saved(held.select(*ordered("node", "e")).distinct(), f"{name}-star")
    return out, of.where("many > 2").select("key", "many")


def fitting(pairs: DataFrame, marks: DataFrame, fits: Fits) -> DataFrame:
    """The pairs that fit, by the ``marks`` of their nodes."""
    out = pairs
    for side in "ab":
        out = out.join(small_side(marks.select(*[F.col(c).alias(side if c == "node" else f"{c}_{side}") for c in marks.columns])), side)
    return out.where(fits(lambda c: F.col(f"{c}_a"), lambda c: F.col(f"{c}_b"))).select("a", "b")


def pairs(rows: DataFrame, fits: Fits | None = None, main: bool = False) -> DataFrame:
    """Pairs of one key and different roots that fit, each once; with ``main``, one of them at least is not in the key's largest group."""
    others = [c for c in rows.columns if c not in ("key", "main", "rest", "many")]
    a = rows.select("key", *[F.col(c).alias(f"{c}_x") for c in others], *[F.col("main")] * main)
    b = (rows.where("root <> main") if main else rows).select("key", *[F.col(c).alias(f"{c}_y") for c in others])
    apart = (F.col("node_x") < F.col("node_y")) | (F.col("root_x") == F.col("main")) if main else F.col("node_x") < F.col("node_y")
    met = (F.col("root_x") != F.col("root_y")) & apart
    if fits is not None:
        met &= fits(lambda c: F.col(f"{c}_x"), lambda c: F.col(f"{c}_y"))
    return a.join(b, "key").where(met).select(*ordered("node_x", "node_y"))


def crossing(rows: DataFrame, roots: DataFrame, marks: DataFrame, fits: Fits, divided: Callable[[DataFrame], DataFrame], name: str, limit: int, close: Fits | None = None) -> DataFrame:
    """Pairs ``(a, b)`` of one block that ``roots``, ``(node, root)``, does not connect, and whose ``marks``, ``(node, ...)``, fit.

    ``divided`` gets the ``(key, node, root, ...)`` of blocks with more than
    ``limit`` nodes outside the largest group, and returns them under finer keys;
    by their columns ``close`` says whether two of these fit, else ``fits`` does.
    """
    named = saved(rows.join(small_side(roots.select("node", "root")), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), f"{name}-keys")
    of = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    per = of.groupBy("key").agg(F.count(F.lit(1)).alias("roots"), F.max_by("root", "c").alias("main"), F.sum("c").alias("many"), (F.sum("c") - F.max("c")).alias("rest"))
    per = saved(per.where("roots > 1").select("key", "main", "many", "rest"), f"{name}-open")
    apart = saved(looked_up(named, per, ["key"], "many").join(small_side(marks), "node"), f"{name}-apart")
    out = pairs(apart.where(F.col("rest") <= limit), fits, True)
    large = apart.where(F.col("rest") > limit)
    if not large.isEmpty():
        out = out.unionByName(pairs(divided(large), close or fits))
    out = saved(out.distinct(), f"{name}-cross")
    discard(named, per, apart)
    return out


def rarest(each: DataFrame, keys: list[str], share: float, name: str) -> DataFrame:
    """``(node, *keys, part)`` of the parts of each node that are rarest among nodes of the same ``keys``.

    ``each`` has ``(node, size, part, *keys)``, parts being distinct in a node.
    Nodes that are alike have all but a ``share`` of their parts in common, so
    that the first common one, rarest first, is among the first ``share * size``
    + 1 of both. Parts that only one node has count, but are not returned.
    """
    each = saved(each, f"{name}-parts")
    spread = saved(each.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("many")), f"{name}-spread")
    told = looked_up(each, spread, [*keys, "part"], "many")
    # The parts of one node: its own size bounds them.
    ranked = told.groupBy("node", "size", *keys).agg(F.sort_array(F.collect_list(F.struct("many", "part"))).alias("_parts"))
    first = F.slice("_parts", F.lit(1), (F.floor(F.col("size") * share + 1e-9) + 1).cast("int"))
    return ranked.select("node", *keys, F.explode(first).alias("_p")).where("_p.many > 1").select("node", *keys, "_p.part")
