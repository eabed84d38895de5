"""Plain text and markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sections import WHOLE, markdown_chapters, paragraphs_of
from .registry import PARAGRAPHS, identity, register


class _TextReader:
    def __init__(self, source_type: str, extensions: tuple[str, ...], headings: bool):
        self.source_type, self.extensions, self.headings = source_type, extensions, headings

    def read(self, files: DataFrame) -> DataFrame:
        """Paragraphs between blank lines; bytes that are not UTF-8 are replaced."""
        text = F.col("content").cast("string")
        rows = files.select("path", identity(F.col("content")).alias("content_hash"), paragraphs_of(F.regexp_replace(F.make_valid_utf8(text), "\r\n?", "\n")).alias("_p"))
        whole = F.array(F.struct(F.lit(WHOLE).alias("title"), F.lit(0).alias("body_start"), F.size("_p").alias("body_end")))
        none = F.array().cast("array<struct<title:string,body_start:int,body_end:int>>")
        bounds = markdown_chapters(F.col("_p")) if self.headings else F.when(F.size("_p") > 0, whole).otherwise(none)
        chapters = rows.select("path", "content_hash", "_p", F.posexplode(bounds).alias("chapter_index", "_c"))
        own = F.slice(F.col("_p"), F.col("_c.body_start") + 1, F.col("_c.body_end") - F.col("_c.body_start"))
        lines = chapters.select("path", "content_hash", "chapter_index", "_c", F.posexplode_outer(own).alias("_i", "text"))
        null = F.lit(None).cast("string")
        out = lines.select(
            "path", "content_hash", null.alias("title"), null.alias("author"), F.lit(self.source_type).alias("source_type"), "chapter_index", F.col("_c.title").alias("chapter_title"),
            (F.col("_c.body_start") + 1).cast("long").alias("chapter_start"), (F.col("_c.body_start") + 1 + F.coalesce("_i", F.lit(0))).cast("long").alias("loc"), "text",
        )
        return out.select(*[c.split()[0] for c in PARAGRAPHS.split(", ")])


MARKDOWN = register(_TextReader("markdown", (".md", ".markdown"), True))
TEXT = register(_TextReader("text", (".txt",), False))
