"""Keyword index and BM25."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import index_terms, query_terms

# Fixed values.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Words asked in a batch of questions that are looked up as a list and broadcast; more are joined.
LISTED = 5_000


@dataclass
class KeywordIndex:
    """``postings(key, term, tf, dl[, places])`` and one row of ``stats(n_docs, avg_dl)``; ``key`` may be a struct.

    ``dl`` is the length of the whole row in terms, ``places`` where the term
    stands in it. Phrases need places; without them each term of a question is
    asked for by itself. Columns are a place apart, so that no phrase runs from
    one into the next.
    """

    postings: DataFrame
    stats: DataFrame


def tokenized(rows: DataFrame, key: str, *texts: str) -> DataFrame:
    """``(key, terms, dl)``: the terms of all columns, with an empty one between columns."""
    own = [index_terms(F.col(t)) for t in texts]
    parts = [p for t in own for p in (F.array(F.lit("")), t)][1:]
    return rows.select(F.col(key).alias("key"), F.concat(*parts).alias("terms")).withColumn("dl", (F.size("terms") - (len(own) - 1)).cast("long"))


def postings(rows: DataFrame, key: str, *texts: str, places: bool = False) -> DataFrame:
    each = tokenized(rows, key, *texts).select("key", "dl", F.posexplode("terms").alias("place", "term")).where(F.col("term") != "")
    more = [F.sort_array(F.collect_list("place")).alias("places")] if places else []  # a text's own size bounds it
    return each.groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl"), *more)


def build_index(rows: DataFrame, key: str, *texts: str, places: bool = False, keep: Callable[[DataFrame], DataFrame] | None = None) -> KeywordIndex:
    """An index over all text columns together. ``keep`` stores the postings, so that texts are tokenized once."""
    found = postings(rows, key, *texts, places=places)
    if keep is None:
        stats = lengths(rows, key, *texts).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_dl"))
        return KeywordIndex(found, stats)
    found = keep(found)
    total = found.agg(F.sum("tf").alias("total"))
    stats = rows.agg(F.count(F.lit(1)).alias("n_docs")).join(F.broadcast(total))  # one row each
    return KeywordIndex(found, stats.select("n_docs", (F.coalesce("total", F.lit(0)) / F.nullif("n_docs", F.lit(0))).alias("avg_dl")))


def lengths(rows: DataFrame, key: str, *texts: str) -> DataFrame:
    return tokenized(rows, key, *texts).select("key", "dl")


def document_frequency(index: KeywordIndex) -> DataFrame:
    return index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("doc_freq"))


def idf(n_docs, doc_freq):
    raw = F.ln((n_docs - doc_freq + 0.5) / (doc_freq + 0.5))
    return F.when(raw > 0, raw).otherwise(F.lit(LEAST_IDF))


def asked_phrases(questions: DataFrame, query_id: str, text: str) -> DataFrame:
    """``(query_id, phrase, qn)``: each word of a question as the terms it has in the index, and how often it is asked."""
    words = questions.select(F.col(query_id).alias("query_id"), F.explode(query_terms(F.col(text))).alias("word"))
    return words.select("query_id", index_terms(F.col("word")).alias("phrase")).where(F.size("phrase") > 0).groupBy("query_id", "phrase").agg(F.count(F.lit(1)).alias("qn"))


def asked_terms(questions: DataFrame, query_id: str, text: str) -> DataFrame:
    """As ``asked_phrases``, with each term of a question by itself."""
    terms = questions.select(F.col(query_id).alias("query_id"), F.explode(index_terms(F.col(text))).alias("term"))
    return terms.groupBy("query_id", F.array("term").alias("phrase")).agg(F.count(F.lit(1)).alias("qn"))


def _occurrences(found: DataFrame, phrases: DataFrame) -> DataFrame:
    """``(phrase, key, tf, dl)`` of phrases of several terms: where these stand one after the other."""
    each = phrases.where(F.size("phrase") > 1).select("phrase", F.posexplode("phrase").alias("i", "term"))
    starts = each.join(found, "term").select("phrase", "key", "dl", "i", F.explode("places").alias("place")).groupBy("phrase", "key", "dl", (F.col("place") - F.col("i")).alias("start"))
    whole = starts.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == F.size("phrase"))
    return whole.groupBy("phrase", "key", "dl").agg(F.count(F.lit(1)).alias("tf")).select("phrase", "key", "tf", "dl")


def bm25(index: KeywordIndex, questions: DataFrame, query_id: str, text: str) -> DataFrame:
    """``(query_id, key, score)`` for every document that shares a phrase; a repeated question word counts again.

    A word of the question whose index form has several terms (an underscore
    separates them) is a phrase of adjacent ones if the index has places, else
    its terms count alone. Statistics are those of the whole index. The terms asked for decide which postings are read: a short list
    of them reaches the scan of stored postings as a filter, a long one is joined.
    """
    placed = "places" in index.postings.columns
    asked = (asked_phrases if placed else asked_terms)(questions, query_id, text)
    listed = [r[0] for r in asked.select("phrase").limit(LISTED + 1).collect()]
    few = len(listed) <= LISTED
    if few:
        used = index.postings.where(F.col("term").isin(sorted({t for p in listed for t in p})))
        asked = F.broadcast(asked)
    else:
        used = index.postings.join(asked.select(F.explode("phrase").alias("term")).distinct(), "term", "left_semi")
    hits = used.select(F.array("term").alias("phrase"), "key", "tf", "dl")
    if placed and (not few or any(len(p) > 1 for p in listed)):
        hits = hits.unionByName(_occurrences(used, asked.select("phrase").distinct()))
    weights = hits.groupBy("phrase").agg(F.count(F.lit(1)).alias("doc_freq"))
    weighed = asked.join(F.broadcast(weights) if few else weights, "phrase").join(F.broadcast(index.stats))  # stats: one row
    part = F.col("qn") * idf(F.col("n_docs"), F.col("doc_freq")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    matched = hits.join(F.broadcast(weighed) if few else weighed, "phrase")
    return matched.groupBy("query_id", "key").agg(F.sum(part).alias("score"))


def top(scored: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """The best ``k`` of each query with ``rank``: by score rounded to ``digits``, then by key."""
    order = Window.partitionBy("query_id").orderBy(F.round("score", digits).desc_nulls_last(), "key")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
