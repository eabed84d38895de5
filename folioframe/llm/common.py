"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import saved, shared_dir  # noqa: F401  the operators take them from here

#: The white space of the word definition; a word is a run of anything else.
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a bound variable.

    Inside a lambda an outer expression is evaluated again for every element;
    binding it keeps nested array code linear.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text, in order; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def shingle_hashes(hashes: Column, size: int) -> Column:
    """Hash every run of ``size`` consecutive word hashes; shorter sequences give one hash, none gives none."""
    return let(
        hashes,
        lambda a: F.when(F.size(a) == 0, F.array().cast("array<bigint>"))
        .when(F.size(a) <= size, F.array(F.xxhash64(a)))
        .otherwise(F.transform(F.sequence(F.lit(1), F.size(a) - (size - 1)), lambda i: F.xxhash64(F.slice(a, i, size)))),
    )


def discard(*tables: DataFrame) -> None:
    """Delete what ``saved`` wrote, once nothing reads it any more."""
    for df in tables:
        spark, path = df.sparkSession, getattr(df, "_saved_path", None)
        if path:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Rows of a few numbers each that may be broadcast: about 32 to 64 MB.
BROADCAST_ROWS = 1_000_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a saved table of narrow rows if its counted size allows it; else leave the join to the planner."""
    return F.broadcast(df) if df.count() <= rows else df


def looked_up(rows: DataFrame, side: DataFrame, keys: list[str], many: str) -> DataFrame:
    """``rows`` joined with a saved table that has each key once and, as ``many``, the rows that have it.

    The table is broadcast if it is small. Else its hot keys are: those that more
    than a ten-thousandth of all rows have, which are 10,000 at most; the others
    are dealt by key, none of them large.
    """
    if side.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(side), keys)
    most = max(1_000, (side.agg(F.sum(many)).first()[0] or 0) // 10_000)
    hot = F.broadcast(side.where(F.col(many) > most))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(side.where(F.col(many) <= most), keys)
    return rows.join(hot, keys).unionByName(rest)


def masked(docs: DataFrame, needed: tuple[str, ...]):
    """``docs`` with all but the ``needed`` columns under neutral names, and a function that undoes it.

    Operators may then add columns of any name without touching the input's.
    """
    names = [(c, c if c in needed else f"_c{i}") for i, c in enumerate(docs.columns)]
    inner = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names])
    return inner, lambda out: out.select(*[F.col(n).alias(c) for c, n in names])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies; ``FOLIO_TOKENIZERS`` may name another folder."""
    folder = os.environ.get("FOLIO_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)
