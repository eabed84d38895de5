"""Page-level structure of paged books: running heads, contents pages, chapter pages.

Pages are rows ``(doc_id, page_no, text)``, numbered from 1.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as T

# Fixed values.
SCAN_PAGES, REGION_PAGES, DENSITY = 50, 50, 0.3
BATCH_PAGES, MOST_ENTRIES = 2, 100
MATCH, RADII = 0.85, (5, 15, 40)
NUMBER_RADIUS, NUMBER_TOLERANCE = 20, 1


def strip_running_lines(pages: DataFrame) -> DataFrame:
    """Pages without first and last lines that repeat through the book, or are running page numbers.

    Books of fewer than three pages stay as they are. A bare number goes if it
    is roman, if no page within ``NUMBER_RADIUS`` tells the printed number, or
    if it is within ``NUMBER_TOLERANCE`` of what the nearest such page implies.
    """
    lines = F.split("text", "\n", -1)
    rows = pages.select("doc_id", "page_no", "text", lines.alias("_l")).withColumns({"_first": T.strip(F.get("_l", F.lit(0))), "_last": T.strip(F.element_at("_l", -1))})
    counts = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))

    def repeated(line: str, name: str) -> DataFrame:
        return rows.where(F.col(line) != "").groupBy("doc_id", F.col(line).alias(name)).agg(F.count(F.lit(1)).alias("_c")).join(counts, "doc_id").where(F.col("_c") >= F.greatest(F.lit(3), F.floor(F.col("_n") / 2))).select("doc_id", name, F.lit(True).alias(f"{name}_rep"))

    number = F.coalesce(T.embedded_number(F.get("_l", F.lit(0))), T.embedded_number(F.element_at("_l", -1)))
    evidence = rows.select("doc_id", F.col("page_no").alias("_p"), number.alias("_num")).where("_num is not null")
    # Evidence within the radius: each piece is filed under the two page blocks that it can reach.
    span = 2 * NUMBER_RADIUS
    block = F.floor(F.col("page_no") / span)
    reach = F.array_distinct(F.array(F.floor((F.col("_p") - NUMBER_RADIUS) / span), F.floor((F.col("_p") + NUMBER_RADIUS) / span)))
    near = rows.select("doc_id", "page_no", block.alias("_b")).join(evidence.withColumn("_b", F.explode(reach)), ["doc_id", "_b"])
    distance = F.abs(F.col("page_no") - F.col("_p"))
    expected = near.where(distance <= NUMBER_RADIUS).groupBy("doc_id", "page_no").agg(F.min_by(F.col("_num") + F.col("page_no") - F.col("_p"), F.struct(distance, F.col("_p"))).alias("_want"))
    known = (
        rows.join(counts, "doc_id")
        .join(repeated("_first", "_first"), ["doc_id", "_first"], "left")
        .join(repeated("_last", "_last"), ["doc_id", "_last"], "left")
        .join(expected, ["doc_id", "page_no"], "left")
    )

    def running(line: Column) -> Column:
        bare = T.strip(line)
        digits = F.regexp_extract(bare, r"(\d+)", 1)
        far = F.abs(digits.try_cast("long") - F.col("_want")) > NUMBER_TOLERANCE
        return bare.rlike(T.PAGE_NUMBER) & ((digits == "") | F.col("_want").isNull() | ~F.coalesce(far, F.lit(True)))

    def drop_first(a: Column, when: Column) -> Column:
        return F.when((F.size(a) > 0) & when, F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(a)

    def drop_last(a: Column, when: Column) -> Column:
        return F.when((F.size(a) > 0) & when, F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(a)

    no = F.lit(False)
    head = lambda a: F.get(a, F.lit(0))
    tail = lambda a: F.get(a, F.size(a) - 1)
    out = known.withColumn("_a", drop_first(F.col("_l"), F.coalesce("_first_rep", no)))
    # The last line of a page of one repeated line is gone already.
    out = out.withColumn("_a", drop_last(F.col("_a"), F.coalesce("_last_rep", no)))
    out = out.withColumn("_a", drop_first(F.col("_a"), F.coalesce(running(head(F.col("_a"))), no)))
    out = out.withColumn("_a", drop_last(F.col("_a"), F.coalesce(running(tail(F.col("_a"))), no)))
    return out.select("doc_id", "page_no", F.when(F.col("_n") < 3, F.col("text")).otherwise(F.array_join("_a", "\n")).alias("text"))


def toc_region(pages: DataFrame) -> DataFrame:
    """``(doc_id, first, last)`` of the contents pages; books without a contents header have no row.

    From the first page with the header, as long as pages look like contents or repeat the header.
    """
    marked = pages.select("doc_id", "page_no", T.has_toc_header(F.col("text")).alias("_h"), T.toc_density(F.col("text")).alias("_d"))
    anchor = marked.where(F.col("_h") & (F.col("page_no") <= SCAN_PAGES)).groupBy("doc_id").agg(F.min("page_no").alias("first"))
    after = marked.join(anchor, "doc_id").where((F.col("page_no") > F.col("first")) & (F.col("page_no") < F.col("first") + REGION_PAGES))
    reach = after.groupBy("doc_id", "first").agg(F.min(F.when((F.col("_d") < DENSITY) & ~F.col("_h"), F.col("page_no"))).alias("_stop"), F.max("page_no").alias("_end"))
    return anchor.join(reach.drop("first"), "doc_id", "left").select("doc_id", "first", F.coalesce(F.col("_stop") - 1, F.col("_end"), F.col("first")).alias("last"))


def parse_toc_reply(raw: Column) -> Column:
    """Entries ``(title, declared_page)`` of a model's JSON reply; null if it is no list. Fences go; bad entries are skipped."""
    bare = T.strip(F.regexp_replace(T.strip(raw), "(?im)^```(?:json)?|```$", ""))
    parsed = F.when(F.substring(bare, 1, 1) == "[", F.from_json(bare, "array<string>", {"mode": "PERMISSIVE"}))
    kind = "struct<title:string,declared_page:string>"
    items = F.transform(parsed, lambda x: F.struct(F.when(F.substring(x, 1, 1) == "{", F.from_json(x, kind)).alias("o"), F.regexp_extract(x, r'"title"\s*:\s*(.)', 1).alias("q")))
    named = F.filter(items, lambda x: x["o"]["title"].isNotNull() & (x["q"] == '"') & (T.strip(x["o"]["title"]) != "") & F.regexp_replace(x["o"]["declared_page"], r"\.\d+$", "").try_cast("int").isNotNull())
    return F.transform(named, lambda x: F.struct(T.strip(x["o"]["title"]).alias("title"), F.regexp_replace(x["o"]["declared_page"], r"\.\d+$", "").try_cast("int").alias("declared_page")))


def valid_entries(entries: Column) -> Column:
    """Whether declared entries are some, not too many, and in page order."""
    pages = F.transform(entries, lambda x: x["declared_page"])
    return F.coalesce((F.size(entries) > 0) & (F.size(entries) <= MOST_ENTRIES) & (F.array_sort(pages) == pages), F.lit(False))


def valid_bounds(bounds: Column, page_count: Column) -> Column:
    """Whether chapter starts lie in the book and strictly increase."""
    starts = F.transform(bounds, lambda x: x["page_start"])
    return F.forall(starts, lambda s: (s >= 1) & (s <= page_count)) & (F.array_sort(F.array_distinct(starts)) == starts)


def drop_edge_repeats(entries: DataFrame) -> DataFrame:
    """Entries ``(doc_id, batch, pos, title, declared_page)`` without those that repeat the one before them in another batch."""
    order = Window.partitionBy("doc_id").orderBy("batch", "pos")
    title = T.normalize_title(F.col("title"))
    same = (F.lag(title).over(order) == title) & (F.lag("batch").over(order) != F.col("batch"))
    return entries.withColumn("_same", F.coalesce(same, F.lit(False))).where(~F.col("_same")).drop("_same")


@F.pandas_udf(DoubleType())
def _ratio(titles: pd.Series, tops: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, t or "", (p or "")[: len(t or "") + 20]).ratio() for t, p in zip(titles, tops, strict=True)])


def title_similarity(title: Column, page: Column) -> Column:
    """0 to 1: how much a page's top resembles a title; only pairs that no exact tier decides reach Python."""
    tier = T.similarity_tiers(title, page)
    return F.coalesce(tier, _ratio(F.when(tier.isNull(), T.normalize_title(title)), F.when(tier.isNull(), T.normalize_title(T.page_top(page)))))


def first_match(titles: DataFrame, pages: DataFrame) -> DataFrame:
    """``(doc_id, title, page_no)``: the first page within ``[start, end]`` of each title row whose top resembles it.

    Pages that divide parts are passed over unless the title is a part's.
    """
    own = pages.select("doc_id", "page_no", "text", T.is_part_divider(F.col("text")).alias("_div"))
    # Each title is dealt to the pages of its window, so that the join is on equal keys.
    dealt = titles.where("start <= end").select("doc_id", "title", F.explode(F.sequence(F.col("start").cast("long"), F.col("end").cast("long"))).alias("page_no"))
    both = dealt.join(own.withColumn("page_no", F.col("page_no").cast("long")), ["doc_id", "page_no"])
    both = both.where(~F.col("_div") | T.normalize_title(F.col("title")).rlike(T.PART_DIVIDER))
    return both.where(title_similarity(F.col("title"), F.col("text")) >= MATCH).groupBy("doc_id", "title").agg(F.min("page_no").alias("page_no"))


# One book at a time, where each step needs the one before it.


def _normal(text: str) -> str:
    return " ".join("".join(c if c.isascii() and (c.isalnum() or c.isspace()) else " " for c in text.lower()).split())


def similarity(title: str, page: str) -> float:
    """``title_similarity`` for one pair."""
    import re

    own = _normal(title)
    top = _normal(" ".join([x.strip() for x in page.split("\n") if x.strip()][:4]))
    if not own or not top:
        return 0.0
    forms = {own, re.sub(T.PART_PREFIX, "", own)} - {""}
    if any(f in top for f in forms):
        return 1.0
    if any(" " in f and not set(f.split()) - set(top.split()) for f in forms):
        return 0.95
    return difflib.SequenceMatcher(None, own, top[: len(own) + 20]).ratio()


def _find(title: str, pages: list[str], start: int, end: int) -> int | None:
    import re

    part = re.compile(T.PART_DIVIDER)
    of_part = part.match(_normal(title))
    for number in range(start, end + 1):
        divides = any(part.match(x.strip()) for x in pages[number - 1].split("\n"))
        if (of_part or not divides) and similarity(title, pages[number - 1]) >= MATCH:
            return number
    return None


def resolve(entries: list[tuple[str, int]], pages: list[str], search_from: int) -> list[tuple[str, int, int]] | None:
    """Physical bounds of declared entries: each is looked for around the page that the last one's offset implies."""
    found: list[int] = []
    for k, (title, declared) in enumerate(entries):
        if k == 0:
            windows = [(search_from, len(pages))]
        else:
            guess = declared + found[-1] - entries[k - 1][1]
            windows = [(max(found[-1] + 1, guess - r), min(len(pages), guess + r)) for r in RADII]
        page = next((p for a, b in windows if a <= b and (p := _find(title, pages, a, b)) is not None), None)
        if page is None:
            return None
        found.append(page)
    ends = [*(x - 1 for x in found[1:]), len(pages)]
    return [(t, a, max(a, b)) for (t, _), a, b in zip(entries, found, ends, strict=True)]


def resolve_pages(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """``(doc_id, chapter_index, title, page_start, page_end)`` for books whose every entry is found.

    ``entries``: ``(doc_id, entries, search_from)`` with an array of ``(title, declared_page)``. One book is one group.
    """
    kind = pages.schema["doc_id"].dataType.simpleString()

    def one(book: pd.DataFrame) -> pd.DataFrame:
        book = book.sort_values("page_no")
        declared = [(e["title"], int(e["declared_page"])) for e in book["entries"].iloc[0]]
        out = resolve(declared, list(book["text"]), int(book["search_from"].iloc[0])) or []
        rows = [(book["doc_id"].iloc[0], i, t, a, b) for i, (t, a, b) in enumerate(out)]
        return pd.DataFrame(rows, columns=["doc_id", "chapter_index", "title", "page_start", "page_end"])

    joined = pages.select("doc_id", "page_no", "text").join(entries, "doc_id")
    return joined.groupBy("doc_id").applyInPandas(one, f"doc_id {kind}, chapter_index int, title string, page_start int, page_end int")


def extract_entries(texts: list[str], ask: Callable[[str], str]) -> list[tuple[str, int]]:
    """Contents entries from pages, two at a time; a reply that is broken or too short halves its range.

    ``ask`` sends a text to the model. Entries that repeat the last one at a batch's edge are dropped.
    """
    import json
    import re

    top = re.compile(T.TOC_TOP_LEVEL)

    def parse(raw: str) -> list[tuple[str, int]] | None:
        bare = re.sub("(?im)^```(?:json)?|```$", "", raw.strip()).strip()
        try:
            data = json.loads(bare)
        except ValueError:
            return None
        if not isinstance(data, list):
            return None
        out = []
        for item in data:
            title = item.get("title") if isinstance(item, dict) else None
            try:
                page = int(item.get("declared_page")) if isinstance(title, str) and title.strip() else None
            except (TypeError, ValueError):
                page = None
            if page is not None:
                out.append((title.strip(), page))
        return out

    def of(start: int, end: int) -> list[tuple[str, int]]:
        text = "\n\n".join(texts[start:end])
        found = parse(ask(text))
        want = sum(bool(top.match(x.strip())) for x in text.split("\n"))
        if end - start > 1 and (found is None or len(found) < want):
            middle = (start + end) // 2
            return joined(of(start, middle), of(middle, end))
        return found or []

    def joined(a: list, b: list) -> list:
        return a + (b[1:] if a and b and _normal(a[-1][0]) == _normal(b[0][0]) else b)

    out: list[tuple[str, int]] = []
    for start in range(0, len(texts), BATCH_PAGES):
        out = joined(out, of(start, min(len(texts), start + BATCH_PAGES)))
    return out


def model_toc(pages: DataFrame, region: DataFrame, client: Callable[[], Callable[[str], str]]) -> DataFrame:
    """``(doc_id, entries)`` from a model over each book's contents pages; ``client()`` makes the caller on the executor."""
    kind = pages.schema["doc_id"].dataType.simpleString()
    inside = pages.join(region, "doc_id").where(F.col("page_no").between(F.col("first"), F.col("last")))

    def one(book: pd.DataFrame) -> pd.DataFrame:
        book = book.sort_values("page_no")
        got = extract_entries(list(book["text"]), client())
        return pd.DataFrame([(book["doc_id"].iloc[0], [{"title": t, "declared_page": p} for t, p in got])], columns=["doc_id", "entries"])

    return inside.select("doc_id", "page_no", "text").groupBy("doc_id").applyInPandas(one, f"doc_id {kind}, entries array<struct<title:string,declared_page:int>>")

