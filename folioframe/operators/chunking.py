"""The recursive splitter with overlap, as one column expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CHARS_PER_TOKEN, strip

# Separators in the order they are tried, and default sizes in tokens.
SEPARATORS = ("\n\n", "\n", ". ", " ")
CHUNK_TOKENS, OVERLAP_TOKENS = 600, 80


def pieces(text: Column, max_chars: int) -> Column:
    """Parts of at most ``max_chars``, cut at the coarsest separator that is enough; joined they are the text again.

    Going level by level is the same as recursion: a part without the current
    separator passes unchanged.
    """
    out = F.filter(F.array(strip(text)), lambda x: x != "")
    for mark in SEPARATORS:
        pattern = mark.replace(".", r"\.")

        def cut(x: Column, mark: str = mark, pattern: str = pattern) -> Column:
            # As a bound variable the split text is there for every part; otherwise each part would split it again.
            marked = lambda parts: F.transform(parts, lambda p, i: F.when(i < F.size(parts) - 1, F.concat(p, F.lit(mark))).otherwise(p))
            split = F.get(F.transform(F.array(F.split(x, pattern, -1)), lambda parts: F.filter(marked(parts), lambda p: p != "")), F.lit(0))
            return F.when(F.length(x) <= max_chars, F.array(x)).otherwise(split)

        step = cut
        out = F.flatten(F.transform(out, lambda x: step(x)))  # noqa: B023
    last = lambda x: F.when(F.length(x) <= max_chars, F.array(x)).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(x), F.lit(max_chars)), lambda i: F.substring(x, i, F.lit(max_chars)))
    )
    return F.flatten(F.transform(out, lambda x: last(x)))


def merge(parts: Column, max_chars: int, overlap_chars: int) -> Column:
    """Parts joined greedily up to ``max_chars``; each chunk carries the end of the one before if it still fits."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(s: Column, piece: Column) -> Column:
        joined = F.concat(s["now"], piece)
        tail = F.when(F.length(s["now"]) <= overlap_chars, s["now"]).otherwise(F.right(s["now"], F.lit(overlap_chars))) if overlap_chars else F.lit("")
        carried = F.concat(tail, piece)
        fits = F.length(joined) <= max_chars
        done = F.when(fits | (s["now"] == ""), s["done"]).otherwise(F.concat(s["done"], F.array(strip(s["now"]))))
        now = F.when(fits, joined).when(F.length(carried) <= max_chars, carried).otherwise(piece)
        return F.struct(done.alias("done"), now.alias("now"))

    return F.aggregate(parts, start, step, lambda s: F.when(s["now"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(strip(s["now"])))))


def chunks(text: Column, chunk_tokens: int = CHUNK_TOKENS, overlap_tokens: int = OVERLAP_TOKENS) -> Column:
    """A text's overlapping chunks, in order."""
    most = chunk_tokens * CHARS_PER_TOKEN
    return merge(pieces(text, most), most, overlap_tokens * CHARS_PER_TOKEN)


def chunk_rows(sections: DataFrame, text_col: str = "text", chunk_tokens: int = CHUNK_TOKENS, overlap_tokens: int = OVERLAP_TOKENS) -> DataFrame:
    """A row ``(chunk_index, raw_text)`` for each chunk, beside the section's other columns."""
    return sections.select(*[c for c in sections.columns if c != text_col], F.posexplode(chunks(F.col(text_col), chunk_tokens, overlap_tokens)).alias("chunk_index", "raw_text"))
