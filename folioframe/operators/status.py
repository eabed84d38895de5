"""Work states, counts, listings and outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import approx_tokens, section_title

# The states of a chunk, in order.
STATES = ("pending", "contextualized", "embedded")
CHUNK_KEY = ["book_id", "chapter_index", "section_index", "chunk_index"]


def with_status(chunks: DataFrame, contexts: DataFrame, vectors: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Chunks with context, embedding and the state that these imply."""
    key = key or CHUNK_KEY
    both = chunks.join(contexts, key, "left").join(vectors, key, "left")
    state = F.when(F.col("embedding").isNotNull(), F.lit(STATES[2])).when(F.col("context").isNotNull(), F.lit(STATES[1])).otherwise(F.lit(STATES[0]))
    return both.withColumn("status", state)


def counts_by_status(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A column for each state, zero where there is none."""
    return rows.groupBy(*(by or [])).agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATES])


def library_status(books: DataFrame, chapters: DataFrame, sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per book: chapters, sections and chunks by state, in one plan."""
    n_chapters = chapters.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_chapters"))
    n_sections = sections.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_sections"))
    out = books.join(n_chapters, "book_id", "left").join(n_sections, "book_id", "left").join(counts_by_status(chunks, ["book_id"]), "book_id", "left")
    return out.fillna(0, ["n_chapters", "n_sections", *[f"n_{s}" for s in STATES]])


def outline(chapters: DataFrame, sections: DataFrame) -> DataFrame:
    """Chapters with an array of their sections' titles, places and sizes, without texts; empty where there are none."""
    described = sections.select(
        "book_id", "chapter_index",
        F.struct("section_index", section_title(F.col("title"), F.col("text"), F.col("section_index")).alias("title"), "page_start", approx_tokens(F.col("text")).alias("approx_tokens")).alias("s"),
    )
    nested = described.groupBy("book_id", "chapter_index").agg(F.array_sort(F.collect_list("s")).alias("sections"))
    out = chapters.join(nested, ["book_id", "chapter_index"], "left")
    return out.select("book_id", "chapter_index", "title", "page_start", F.coalesce("sections", F.array()).alias("sections"))


def pending(rows: DataFrame, done: DataFrame, key: list[str], limit: int | None = None) -> DataFrame:
    """Rows without a counterpart in ``done``, in key order, at most ``limit``."""
    out = rows.join(done.select(*key), key, "left_anti").orderBy(*key)
    return out if limit is None else out.limit(limit)


def stage_batch(rows: DataFrame, status: str, key: list[str], limit: int | None = None) -> DataFrame:
    """Rows in one state, in key order, at most ``limit``."""
    out = rows.where(F.col("status") == status).orderBy(*key)
    return out if limit is None else out.limit(limit)
