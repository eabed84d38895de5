"""Mixing sources to target weights by hash-threshold histograms.

Tokens are summed by source and hash bucket. A source's budget falls into one
bucket; only that bucket is split further, level by level, until the threshold
is as fine as a few documents. Documents below the threshold are taken: no
sort, and the budgets are nested, since a larger one only moves the threshold.

Edge cases: null text has size 0; null is a source of its own, last in order;
rows repeated exactly share a hash and are taken together; an empty table
gives an empty mix; columns named like the operator's own are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, small_side, table, words

WEIGHTS, CAP, BITS, LEVELS = (5, 2, 1), 3, 12, 3
HASH_BITS = 63


def sized(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """Adds ``size`` (words), ``_key`` (the source, null included) and ``_h`` (a 63-bit hash of id and text)."""
    return docs.withColumns(
        {
            "size": F.size(words(F.col(text_col))).cast("long"),
            "_key": F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")),
            "_h": F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(text_col)), 1),
        }
    )


def targets(rows: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """A row for each source: its size, its target, whole ``copies`` of it, and the ``budget`` of one more pass.

    The level at which weights times level, cut at the caps, fill the total is
    found among the sources in order of cap by weight; these are as many rows
    as there are sources.
    """
    sums = rows.groupBy("_key").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("_key") == "n", "_key")
    ranked = Window.orderBy("_ratio", "_key")
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    after = ranked.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    picked = F.get(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights))
    filled = (
        sums.withColumn("_w", picked)
        .withColumn("_cap", F.col("source_size").cast("double") * cap)
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_level", (F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after))
        .withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_key", "_level"))).over(everything)["_level"])
        .withColumn("target", F.least("_cap", F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap"))))
    )
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return filled.withColumn("copies", copies).select("_key", "source_size", "target", "copies", F.greatest(F.col("target") - F.col("copies") * F.col("source_size"), F.lit(0.0)).alias("budget"))


def cuts(rows: DataFrame, weights=WEIGHTS, cap: int = CAP, bits: int = BITS, levels: int = LEVELS) -> DataFrame:
    """``targets`` with ``cut``: documents whose hash is below it get one copy more. ``rows`` is read once per level."""
    state = saved(targets(rows, weights, cap).withColumn("below", F.lit(0).cast("long")).withColumn("prefix", F.lit(0).cast("long")), "mix-targets")
    for level in range(1, levels + 1):
        shift = HASH_BITS - bits * level
        known = small_side(state.select("_key", F.col("prefix").alias("_prefix")))
        inside = rows.select("_key", "size", "_h").join(known, "_key").where(F.shiftright("_h", shift + bits) == F.col("_prefix"))
        sums = inside.groupBy("_key", F.shiftright("_h", shift).alias("_bucket")).agg(F.sum("size").alias("_sum"))
        upto = F.sum("_sum").over(Window.partitionBy("_key").orderBy("_bucket"))
        running = sums.withColumn("_upto", upto).join(small_side(state), "_key").where(F.col("below") + F.col("_upto") > F.col("budget"))
        edge = running.groupBy("_key").agg(F.min(F.struct("_bucket", (F.col("below") + F.col("_upto") - F.col("_sum")).alias("_before"), "_sum")).alias("e"))
        joined = state.join(small_side(saved(edge, "mix-edge")), "_key", "left")
        last = level == levels
        nearer = F.when(F.col("e._before") + F.col("e._sum") - F.col("budget") < F.col("budget") - F.col("e._before"), F.lit(1)).otherwise(F.lit(0)) if last else F.lit(0)
        state = saved(
            joined.select(
                "_key", "source_size", "target", "copies", "budget",
                F.coalesce("e._before", "below").alias("below"),
                F.coalesce(F.col("e._bucket") + nearer, F.shiftleft("prefix", bits)).cast("long").alias("prefix"),
            ),
            "mix-level",
        )
    cut = F.when(F.col("budget") > 0, F.shiftleft("prefix", HASH_BITS - bits * levels)).otherwise(F.lit(0).cast("long"))
    return state.select("_key", "source_size", "target", "copies", cut.alias("cut"))


def mixed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` (of ``sized``) with the source's figures and ``times``, how often the mix takes the document."""
    out = rows.join(small_side(found), "_key")
    return out.withColumn("times", F.col("copies") + F.when(F.col("_h") < F.col("cut"), F.lit(1)).otherwise(F.lit(0))).drop("copies", "cut", "_key", "_h")


def op7_mix_sources(spark, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = saved(sized(docs).drop("text"), "mix-sizes")
    out = mixed(rows, cuts(rows))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))
