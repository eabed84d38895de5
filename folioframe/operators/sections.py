"""Chapter bounds and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CHAPTER_HEADING, CHARS_PER_TOKEN, MARKDOWN_HEADING, strip

# Fixed values.
SECTION_TOKENS = 3000
WHOLE, LEADING = "Full Document", "Untitled"


def pack(paragraphs: Column, budget_chars: int) -> Column:
    """Sections of an ordered array of ``(loc, text)``: paragraphs are added while the budget lasts.

    A paragraph counts its length and two; one beyond the budget stands alone.
    Gives an array of ``(section_index, text, page_start)``.
    """
    kind = "struct<done:array<struct<loc:long,text:string>>,now:array<string>,loc:long,size:long>"
    start = F.struct(F.array().alias("done"), F.array().alias("now"), F.lit(None).alias("loc"), F.lit(0).alias("size")).cast(kind)
    close = lambda s: F.concat(s["done"], F.array(F.struct(s["loc"].alias("loc"), F.array_join(s["now"], "\n\n").alias("text"))))

    def step(s: Column, p: Column) -> Column:
        size = F.length(p["text"]).cast("long") + 2
        full = (F.size(s["now"]) > 0) & (s["size"] + size > budget_chars)
        new = full | (F.size(s["now"]) == 0)
        return F.struct(
            F.when(full, close(s)).otherwise(s["done"]).alias("done"),
            F.when(new, F.array(p["text"])).otherwise(F.concat(s["now"], F.array(p["text"]))).alias("now"),
            F.when(new, p["loc"].cast("long")).otherwise(s["loc"]).alias("loc"),
            F.when(new, size).otherwise(s["size"] + size).alias("size"),
        )

    found = F.aggregate(paragraphs, start, step, lambda s: F.when(F.size(s["now"]) > 0, close(s)).otherwise(s["done"]))
    return F.transform(found, lambda x, i: F.struct(i.alias("section_index"), x["text"].alias("text"), x["loc"].alias("page_start")))


def pack_rows(paragraphs: DataFrame, chapter: list[str], loc: str, text: str, budget_tokens: int = SECTION_TOKENS) -> DataFrame:
    """Sections of every chapter: rows ``(*chapter, section_index, text, page_start)``. A chapter is one group of rows."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(loc).cast("long").alias("loc"), F.col(text).alias("text"))))
    packed = paragraphs.groupBy(*chapter).agg(pack(ordered, budget_tokens * CHARS_PER_TOKEN).alias("_s"))
    return packed.select(*chapter, F.explode("_s").alias("_s")).select(*chapter, "_s.*")


def paragraphs_of(text: Column) -> Column:
    """Stripped, filled paragraphs between blank lines."""
    return F.filter(F.transform(F.split(text, "\n\n", -1), strip), lambda x: x != "")


def markdown_chapters(paragraphs: Column) -> Column:
    """``(title, body_start, body_end)`` of each chapter over an array of paragraphs (positions from 0, end excluded).

    A heading's whole paragraph belongs to no body.
    """
    first = lambda p: F.get(F.split(p, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", -1), F.lit(0))
    marked = F.transform(paragraphs, lambda p, i: F.struct(F.when(first(p).rlike(MARKDOWN_HEADING), F.regexp_extract(first(p), MARKDOWN_HEADING, 1)).alias("title"), i.alias("at")))
    heads = F.filter(marked, lambda x: x["title"].isNotNull())
    n = F.size(paragraphs)
    bound = lambda title, begin, end: F.struct(title.alias("title"), begin.cast("int").alias("body_start"), end.cast("int").alias("body_end"))
    own = F.transform(heads, lambda h, i: bound(h["title"], h["at"] + 1, F.coalesce(F.get(heads, i + 1)["at"], n)))
    lead = F.when(F.get(heads, F.lit(0))["at"] > 0, F.array(bound(F.lit(LEADING), F.lit(0), F.get(heads, F.lit(0))["at"])))
    none = F.array().cast("array<struct<title:string,body_start:int,body_end:int>>")
    return F.when(n == 0, none).when(F.size(heads) == 0, F.array(bound(F.lit(WHOLE), F.lit(0), n))).otherwise(F.concat(F.coalesce(lead, none), own))


def outline_bounds(outline: DataFrame, book: str = "doc_id") -> DataFrame:
    """``(book, chapter_index, title, page_start, page_end)`` from level-1 entries ``(level, title, page, pos, page_count)``."""
    order = Window.partitionBy(book).orderBy("pos")
    start = F.greatest(F.lit(1), F.col("page"))
    end = F.coalesce(F.lead("page").over(order) - 1, F.col("page_count"))
    return outline.where("level = 1").select(
        book, (F.row_number().over(order) - 1).alias("chapter_index"), strip(F.col("title")).alias("title"),
        start.alias("page_start"), F.greatest(start, F.least(end, F.col("page_count"))).alias("page_end"),
    )


def heading_bounds(pages: DataFrame, book: str = "doc_id") -> DataFrame:
    """Chapters from headings in the first three lines of pages ``(book, page_no, text)``; one for the whole book without any."""
    title = F.get(F.filter(F.transform(F.slice(F.split("text", "\n", -1), 1, 3), strip), lambda x: x.rlike(CHAPTER_HEADING)), F.lit(0))
    counts = pages.groupBy(book).agg(F.max("page_no").alias("page_count"))
    heads = pages.select(book, "page_no", title.alias("title")).where("title is not null").join(counts, book)
    order = Window.partitionBy(book).orderBy("page_no")
    end = F.coalesce(F.lead("page_no").over(order) - 1, F.col("page_count"))
    found = heads.select(book, (F.row_number().over(order) - 1).alias("chapter_index"), "title", F.col("page_no").alias("page_start"), F.greatest("page_no", end).alias("page_end"))
    whole = counts.join(heads.select(book).distinct(), book, "left_anti")
    return found.unionByName(whole.select(book, F.lit(0).alias("chapter_index"), F.lit(WHOLE).alias("title"), F.lit(1).cast(pages.schema["page_no"].dataType).alias("page_start"), F.col("page_count").alias("page_end")))


def choose_bounds(*tiers: Column) -> Column:
    """The first array of bounds that is neither null nor empty."""
    return F.coalesce(*[F.when(F.size(t) > 0, t) for t in tiers])


def sub_entries(outline: DataFrame, bounds: DataFrame, book: str = "doc_id") -> DataFrame:
    """Deeper outline entries within each chapter's pages, the first for each page."""
    deep = outline.where("level >= 2").select(book, F.col("title").alias("_t"), "page", "pos")
    joined = bounds.select(book, "chapter_index", "page_start", "page_end").join(deep, book).where("page between page_start and page_end")
    first = joined.groupBy(book, "chapter_index", "page_start", "page_end", "page").agg(F.min_by("_t", "pos").alias("_t"))
    return first.select(book, "chapter_index", "page_start", "page_end", strip(F.col("_t")).alias("title"), "page")


def entry_sections(entries: DataFrame, pages: DataFrame, book: str = "doc_id") -> DataFrame:
    """Sections that begin at sub-entries, with an untitled one before the first if it begins later."""
    first = entries.groupBy(book, "chapter_index", "page_start", "page_end").agg(F.min("page").alias("_first"))
    lead = first.where("_first > page_start").select(book, "chapter_index", "page_start", "page_end", F.lit(None).cast("string").alias("title"), F.col("page_start").alias("page"))
    order = Window.partitionBy(book, "chapter_index").orderBy("page")
    every = entries.unionByName(lead).select(
        book, "chapter_index", (F.row_number().over(order) - 1).alias("section_index"), "title", F.col("page").alias("start"),
        F.greatest(F.col("page"), F.coalesce(F.lead("page").over(order) - 1, F.col("page_end"))).alias("end"),
    )
    own = pages.where("text <> ''").select(book, F.col("page_no").cast("long").alias("page_no"), "text")
    dealt = every.withColumn("page_no", F.explode(F.sequence(F.col("start").cast("long"), F.col("end").cast("long"))))
    joined = dealt.join(own, [book, "page_no"], "left")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("page_no", "text")))), lambda x: x["text"]), "\n\n")
    return joined.groupBy(book, "chapter_index", "section_index", "title", F.col("start").alias("page_start")).agg(text.alias("text"))
