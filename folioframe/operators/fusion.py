"""Reciprocal rank fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value.
K = 60


def fuse(*arms: DataFrame, k: int = K) -> DataFrame:
    """``(query_id, key, score, rank, rank_1, rank_2, ...)`` from ranked arms ``(query_id, key, rank)``.

    Ties go to the better rank in the first arm, then in the next.
    """
    named = [a.select("query_id", "key", *[(F.col("rank") if i == j else F.lit(None)).cast("int").alias(f"rank_{j + 1}") for j in range(len(arms))]) for i, a in enumerate(arms)]
    every = reduce(DataFrame.unionByName, named)
    ranks = [f"rank_{j + 1}" for j in range(len(arms))]
    term = reduce(lambda x, y: x + y, [F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(r)), F.lit(0.0)) for r in ranks])
    summed = every.groupBy("query_id", "key").agg(*[F.min(r).alias(r) for r in ranks]).withColumn("score", term)
    order = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), *[F.asc_nulls_last(r) for r in ranks], "key")
    return summed.withColumn("rank", F.row_number().over(order))
