"""Hybrid search over an embedded library, for a batch of questions in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import keyword as K
from . import vector as V
from .fusion import K as FUSION_K
from .fusion import fuse

# Fixed values.
MODES = ("hybrid", "vector")
TOP_K, POOL = 5, 50
KEY = ("book_id", "chapter_index", "section_index", "chunk_index")
NOTHING = "No embedded chunks found. Run `ingest` first."


@dataclass(frozen=True)
class Filters:
    """Exact matches; what is None is not filtered. A null author matches nothing."""

    book_id: int | None = None
    author: str | None = None
    source_type: str | None = None

    def apply(self, rows: DataFrame) -> DataFrame:
        for name, value in vars(self).items():
            if value is not None:
                rows = rows.where(F.col(name) == value)
        return rows


def search_rows(books: DataFrame, chapters: DataFrame, sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """Embedded chunks with the names of what holds them; chunks without parents go."""
    own = chunks.where(F.col("embedding").isNotNull())
    named = own.join(books.select("book_id", F.col("name").alias("book_name"), "author", "source_type"), "book_id")
    named = named.join(chapters.select("book_id", "chapter_index", F.col("title").alias("chapter_title")), ["book_id", "chapter_index"])
    return named.join(sections.select("book_id", "chapter_index", "section_index", F.col("title").alias("section_title")), ["book_id", "chapter_index", "section_index"])


def chunk_key() -> Column:
    return F.struct(*KEY)


def search(rows: DataFrame, questions: DataFrame, mode: str = "hybrid", filters: Filters | None = None, top_k: int | None = None, pool: int = POOL, fusion_k: int = FUSION_K, sections: DataFrame | None = None, index: K.KeywordIndex | None = None, arms: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Ranked, cited excerpts for questions ``(query_id, text, vector)``.

    ``index`` is the stored keyword index of all rows, by ``chunk_key``; without
    one the rows are tokenized. Filters apply to both arms after its statistics.
    Keys are ranked first, and texts fetched for the winners alone. With
    ``sections`` each result carries its section's whole text. Further ranked
    ``arms``, ``(query_id, key, rank)``, are fused with these two.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}, not {mode!r}")
    top_k = top_k or TOP_K
    pool = max(top_k, pool)
    keyed = rows.withColumn("_key", chunk_key())
    wanted = (filters or Filters()).apply(keyed)
    nearest = V.top_k(wanted, "_key", "embedding", questions, "query_id", "vector", pool)
    if mode == "vector":
        ranked = nearest.where(F.col("rank") <= top_k).select("query_id", "key", "score", "rank")
    else:
        if index is None:
            index = K.build_index(keyed, "_key", "raw_text", "context", places=True)
        scored = K.bm25(index, questions, "query_id", "text")
        if filters is not None:
            scored = scored.join(wanted.select(F.col("_key").alias("key")), "key", "left_semi")
        ranked = fuse(nearest, K.top(scored, pool), *arms, k=fusion_k).where(F.col("rank") <= top_k).select("query_id", "key", "score", "rank")
    won = ranked.select("query_id", "rank", "score", *[F.col(f"key.{k}").alias(k) for k in KEY])
    out = won.join(rows.drop("embedding"), list(KEY))
    cols = ["query_id", "rank", "score", *KEY, "book_name", "chapter_title", "section_title", "page_start", "raw_text", "context"]
    if sections is None:
        return out.select(*cols)
    texts = sections.select("book_id", "chapter_index", "section_index", F.col("text").alias("section_text"))
    return out.select(*cols).join(texts, ["book_id", "chapter_index", "section_index"], "left").select(*cols, "section_text")


def cited(results: DataFrame) -> DataFrame:
    """``(query_id, rank, citation)``: a header with the place and score, and the excerpt, or the section if it is there."""
    section = F.when(F.coalesce("section_title", F.lit("")) != "", F.concat(F.lit(", "), "section_title")).otherwise(F.lit(""))
    body = F.coalesce("section_text", "raw_text") if "section_text" in results.columns else F.col("raw_text")
    header = F.concat(F.lit("["), "book_name", F.lit(" -- "), "chapter_title", section, F.lit(", p."), F.col("page_start").cast("string"), F.lit("] (score="), F.format_string("%.3f", "score"), F.lit(")"))
    return results.select("query_id", "rank", F.concat(header, F.lit("\n"), body).alias("citation"))


def report(results: DataFrame) -> DataFrame:
    """``(query_id, report)``: a question's citations in rank order."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "citation")))
    return cited(results).groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["citation"]), "\n\n---\n\n").alias("report"))
