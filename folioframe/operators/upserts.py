"""Upserts over append-only tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], version: str) -> DataFrame:
    """The row of the highest version for each key."""
    order = Window.partitionBy(*key).orderBy(F.col(version).desc())
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def insert_absent(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The rows of ``new`` whose key ``old`` lacks; the first of each key."""
    return new.dropDuplicates(key).join(old.select(*key), key, "left_anti")


def upsert_keeping(old: DataFrame, new: DataFrame, key: list[str], keep: list[str]) -> DataFrame:
    """``new`` over ``old``: new rows win, but for columns in ``keep``, which stay as they were where they are set."""
    before = old.select(*key, *[F.col(c).alias(f"_old_{c}") for c in keep])
    merged = new.join(before, key, "left")
    merged = merged.withColumns({c: F.coalesce(f"_old_{c}", c) for c in keep}).select(*new.columns)
    return merged.unionByName(old.join(new.select(*key), key, "left_anti").select(*new.columns))


def delete_where(rows: DataFrame, column: str, value) -> DataFrame:
    return rows.where(F.coalesce(F.col(column) != value, F.lit(True)))


def resolve_identity(books: DataFrame, incoming: DataFrame) -> DataFrame:
    """What to do with incoming ``(slug, content_hash)``: insert, keep (same content) or conflict (other content)."""
    known = books.select("slug", F.col("content_hash").alias("_have"))
    act = F.when(F.col("_have").isNull(), F.lit("insert")).when(F.col("_have") == F.col("content_hash"), F.lit("keep")).otherwise(F.lit("conflict"))
    return incoming.join(known, "slug", "left").withColumn("action", act).drop("_have")
