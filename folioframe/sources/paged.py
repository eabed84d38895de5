"""Paged books (PDF): decoding is pluggable, structure is not.

``decode`` turns a file's bytes into page texts, an outline and metadata. The
built-in one needs PyMuPDF, which need not be installed; ``set_decoder`` takes
another. Everything after it is page-level work on DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_page
from ..operators import pages as P
from ..operators import sections as S
from ..storage import saved
from .registry import PARAGRAPHS, SECTIONED, register

#: (page texts, [(level, title, page)], title, author)
Decoded = tuple[list[str], list[tuple[int, str, int]], str | None, str | None]
_RAW = "path string, content_hash string, title string, author string, page_count int, pages array<string>, outline array<struct<level:int,title:string,page:int>>"


def decode_pdf(content: bytes) -> Decoded:
    try:
        import fitz
    except ImportError as e:
        raise RuntimeError("reading PDF files needs PyMuPDF, or another decoder") from e
    with fitz.open(stream=content, filetype="pdf") as book:
        meta = book.metadata or {}
        named = [(meta.get(k) or "").strip() or None for k in ("title", "author")]
        return [page.get_text("text") for page in book], [(x[0], x[1], x[2]) for x in book.get_toc()], *named


_decoder: Callable[[bytes], Decoded] = decode_pdf


def set_decoder(decoder: Callable[[bytes], Decoded]) -> None:
    global _decoder
    _decoder = decoder


def decoded(files: DataFrame) -> DataFrame:
    """One row for each book, with its pages and outline."""
    decode = _decoder

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                texts, outline, title, author = decode(bytes(content))
                rows = [{"level": a, "title": b, "page": c} for a, b, c in outline]
                yield pd.DataFrame([(path, hashlib.sha256(bytes(content)).hexdigest(), title, author, len(texts), texts, rows)], columns=["path", "content_hash", "title", "author", "page_count", "pages", "outline"])

    return files.select("path", "content").mapInPandas(run, _RAW)


def page_rows(books: DataFrame) -> DataFrame:
    """``(doc_id, page_no, text)`` of decoded books."""
    return books.select(F.col("path").alias("doc_id"), F.posexplode("pages").alias("_i", "text")).select("doc_id", (F.col("_i") + 1).alias("page_no"), "text")


def _bounds(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.col("chapter_index").cast("int").alias("chapter_index"), "title", F.col("page_start").cast("int").alias("page_start"), F.col("page_end").cast("int").alias("page_end"))


def resolved(stripped: DataFrame, toc: DataFrame) -> DataFrame:
    """Chapter bounds from contents entries ``(doc_id, entries)``; books whose entries do not all resolve, in order, have none."""
    counts = stripped.groupBy("doc_id").agg(F.max("page_no").alias("_n"))
    asked = toc.where(P.valid_entries(F.col("entries"))).join(P.toc_region(stripped), "doc_id").select("doc_id", "entries", (F.col("last") + 1).alias("search_from"))
    found = saved(P.resolve_pages(stripped, asked), "resolved-pages")
    whole = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chapter_index", "page_start"))).alias("b")).join(counts, "doc_id")
    return _bounds(found.join(whole.where(P.valid_bounds(F.col("b"), F.col("_n"))).select("doc_id"), "doc_id", "left_semi"))


def model_contents(files: DataFrame, ask: Callable[[], Callable[[str], str]]) -> DataFrame:
    """``(doc_id, content_hash, bounds)`` that a model reads from the contents pages of books without an outline; ``bounds`` is empty where that fails."""
    books = saved(decoded(files).where(~F.exists("outline", lambda o: o["level"] == 1)), "decoded-books")
    stripped = saved(P.strip_running_lines(page_rows(books)), "stripped-pages")
    found = resolved(stripped, saved(P.model_toc(stripped, P.toc_region(stripped), ask), "model-contents"))
    listed = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chapter_index", "title", "page_start", "page_end"))).alias("_b"))
    named = books.select(F.col("path").alias("doc_id"), "content_hash").join(listed, "doc_id", "left")
    kind = "array<struct<title:string,page_start:int,page_end:int>>"
    return named.select("doc_id", "content_hash", F.coalesce(F.transform("_b", lambda x: F.struct(x["title"], x["page_start"], x["page_end"])), F.array()).cast(kind).alias("bounds"))


def chapters(raw_pages: DataFrame, outline: DataFrame, contents: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Chapter bounds and cleaned pages; bounds from the outline, else the known contents, else headings.

    ``raw_pages``: (doc_id, page_no, text); ``outline``: (doc_id, level, title, page, pos, page_count); ``contents``:
    (doc_id, chapter_index, title, page_start, page_end).
    """
    clean = saved(P.strip_running_lines(raw_pages).withColumn("text", clean_page(F.col("text"))), "clean-pages")
    found = _bounds(S.outline_bounds(outline))
    if contents is not None:
        found = found.unionByName(_bounds(contents).join(found.select("doc_id").distinct(), "doc_id", "left_anti"))
    rest = clean.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
    return saved(found.unionByName(_bounds(S.heading_bounds(rest))), "chapter-bounds"), clean


class _PdfReader:
    source_type, extensions, takes_contents = "pdf", (".pdf",), True

    def read(self, files: DataFrame, contents: DataFrame | None = None) -> DataFrame:
        """Paragraphs of pages; where the outline has entries below a chapter, one text for each of these, as a section with its title."""
        books = saved(decoded(files), "decoded-books")  # files are decoded once
        outline = books.select(F.col("path").alias("doc_id"), "page_count", F.posexplode("outline").alias("pos", "o")).select("doc_id", "o.level", "o.title", "o.page", "pos", "page_count")
        bounds, clean = chapters(page_rows(books), outline, contents)
        known = S.entry_sections(S.sub_entries(outline, bounds), clean)
        known = known.select("doc_id", "chapter_index", "section_index", F.col("title").alias("section_title"), F.col("page_start").alias("loc"), "text")
        parts = clean.select(F.col("doc_id").alias("_d"), "page_no", F.posexplode(S.paragraphs_of(F.col("text"))).alias("_k", "text"))
        loose = bounds.join(known.select("doc_id", "chapter_index").distinct(), ["doc_id", "chapter_index"], "left_anti")
        loose = loose.join(parts, (F.col("doc_id") == F.col("_d")) & F.col("page_no").between(F.col("page_start"), F.col("page_end")), "left")
        loose = loose.select("doc_id", "chapter_index", F.lit(None).cast("int").alias("section_index"), F.lit(None).cast("string").alias("section_title"), F.coalesce("page_no", "page_start").alias("loc"), "text")
        info = books.select(F.col("path").alias("doc_id"), "content_hash", F.col("title").alias("_book"), "author")
        of = bounds.select("doc_id", "chapter_index", F.col("title").alias("chapter_title"), F.col("page_start").cast("long").alias("chapter_start"))
        out = loose.unionByName(known).join(of, ["doc_id", "chapter_index"]).join(info, "doc_id")
        out = out.withColumns({"path": F.col("doc_id"), "title": F.col("_book"), "source_type": F.lit("pdf"), "chapter_index": F.col("chapter_index").cast("int"), "loc": F.col("loc").cast("long")})
        return out.select(*[c.split()[0] for c in f"{PARAGRAPHS}, {SECTIONED}".split(", ")])


PDF = register(_PdfReader())
