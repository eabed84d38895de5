"""Which reader takes a file, by its suffix."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that every reader gives: (path, content_hash, title, author, source_type, chapter_index, chapter_title, loc, text);
#: one for each paragraph in order, ``text`` null for a chapter without any.
PARAGRAPHS = "path string, content_hash string, title string, author string, source_type string, chapter_index int, chapter_title string, chapter_start long, loc long, text string"

#: Columns that a reader may add, for files whose sections are known: rows of one section share them.
SECTIONED = "section_index int, section_title string"


def with_sections(rows: DataFrame) -> DataFrame:
    """Paragraph rows with the columns of known sections, null where a reader has none."""
    wanted = [c.split() for c in SECTIONED.split(", ")]
    return rows.withColumns({name: F.lit(None).cast(kind) for name, kind in wanted if name not in rows.columns})


class SourceReader(Protocol):
    """A reader of one kind of file; new kinds are added with ``register``."""

    source_type: str
    extensions: tuple[str, ...]

    def read(self, files: DataFrame) -> DataFrame:
        """Paragraph rows from rows of Spark's ``binaryFile`` source."""


_READERS: list[SourceReader] = []


def register(reader: SourceReader) -> SourceReader:
    _READERS.append(reader)
    return reader


def readers() -> list[SourceReader]:
    from . import epub, paged, plain  # noqa: F401  they register themselves

    return list(_READERS)


def supported() -> list[str]:
    return sorted({e for r in readers() for e in r.extensions})


def reader_for(path: str) -> SourceReader:
    """The first reader whose extensions hold the path's suffix, in lower case."""
    dot = path.rfind(".")
    suffix = path[dot:].lower() if dot > path.rfind("/") else ""
    for reader in readers():
        if suffix in reader.extensions:
            return reader
    raise ValueError(f"unsupported file type {suffix!r}; supported: {', '.join(supported())}")


def source_type(path: Column) -> Column:
    """The same choice within a plan; an unsupported suffix is an error when evaluated."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    out = F.raise_error(F.concat(F.lit("unsupported file type "), suffix)).cast("string")
    for reader in reversed(readers()):
        out = F.when(suffix.isin(*reader.extensions), F.lit(reader.source_type)).otherwise(out)
    return out


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Paragraph rows of all files under a path, each kind by its reader."""
    files = spark.read.format("binaryFile").load(path)
    return read_binary(files)


def read_binary(files: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """Paragraph rows of files; ``contents`` has chapter bounds that are known for paged books, by path."""
    typed = files.withColumn("_type", source_type(F.col("path")))
    own = lambda r: typed.where(F.col("_type") == r.source_type).drop("_type")
    parts = [with_sections(r.read(own(r), contents) if getattr(r, "takes_contents", False) else r.read(own(r))) for r in readers()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def identity(content: Column) -> Column:
    """SHA-256 of a file's bytes."""
    return F.sha2(content, 256)
