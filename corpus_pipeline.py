"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again.

Every stage takes all rows its predecessor kept. All but the last return the
columns of ``documents``; the last returns ids and decoded text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm import language, lines, mixing, pieces, resemblance
from folioframe.llm.common import masked, saved, shared_dir, small_side

#: Words of a shingle, the bits that two fingerprints of candidates may differ in, and the resemblance of near-duplicate documents.
SHINGLE, RADIUS, RESEMBLANCE = 5, 2, 0.8


def _given_back(spark: SparkSession) -> None:
    """Executors return heap that they no longer use to the system: it grows to its limit in the line stage and does not shrink by itself.

    Tasks of a tenth of a second, two for each core, so that every executor gets
    some. No stage's result depends on it.
    """
    tasks = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).selectExpr("reflect('java.lang.System', 'gc') AS done").collect()


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; those without text or letters go.

    Null ids and labels are not learned from; repeated rows are judged alike.
    """
    _given_back(spark)
    inner, restored = masked(docs, ("doc_id", "text", "lang"))
    return restored(language.identified(inner, language.learn(inner)).where(F.col("lang_pred") != language.UNKNOWN))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier document, or an earlier line, has already; ``n_chars`` follows.

    A text that loses every line stays as an empty one; null stays null.
    """
    inner, restored = masked(docs, ("doc_id", "text", "n_chars"))
    out = lines.deduplicated(inner)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return restored(out)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, linked by a resemblance of 0.8 or more: that of the smallest id.

    Null ids come last; rows that repeat both id and text are one document;
    texts without words are one group.
    """
    _given_back(spark)
    inner, restored = masked(docs, ("doc_id", "text"))
    keyed = inner.withColumn("_key", F.xxhash64("doc_id", "text"))
    groups = resemblance.near_duplicates(keyed.select("_key", "text"), "_key", "text", SHINGLE, RADIUS, RESEMBLANCE)
    rows = saved(groups.join(keyed.select("_key", "doc_id").distinct(), "_key"), "near-groups")
    first = rows.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key")).alias("first"))
    kept = first.select(F.col("first._key").alias("_key"))
    gone = saved(rows.select("_key").distinct().join(kept, "_key", "left_anti"), "near-gone")
    again = saved(rows.groupBy("_key").count().where("count > 1").select("_key").join(kept, "_key", "left_semi"), "near-again")
    left = keyed.join(small_side(gone), "_key", "left_anti")  # texts are shuffled only beyond the broadcast bound
    once, repeated = left.join(small_side(again), "_key", "left_anti"), left.join(small_side(again), "_key", "left_semi")
    return restored(once.unionByName(repeated.dropDuplicates(["_key"])))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, up to three times.

    Null is a source; texts without words weigh nothing and follow their hash.
    """
    _given_back(spark)
    inner, restored = masked(docs, ("doc_id", "text", "source"))
    sizes = saved(mixing.sized(inner.select("doc_id", "text", "source")).drop("text"), "mix-sizes")
    rows = mixing.mixed(mixing.sized(inner), mixing.cuts(sizes)).where(F.col("times") > 0)
    return restored(rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text and their decoding; null counts as empty."""
    _given_back(spark)
    out = pieces.encoded(docs.select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: Fingerprints, automata and piece merging are not expressible in SQL; tests hold every stage against a plain version on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
