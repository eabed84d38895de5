"""Blocks and headings of HTML, by the standard library's parser."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

# Fixed values.
BLOCK_TAGS = frozenset("p li h1 h2 h3 h4 h5 h6 blockquote".split())
HEADING_TAGS = ("h1", "h2", "h3", "h4")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening tag ends when it is still open.
_ENDS = {"p": ("p",), "li": ("li", "p"), **{h: ("p",) for h in (*HEADING_TAGS, "h5", "h6", "blockquote", "ul", "ol", "div", "table", "section", "article", "pre", "header", "footer", "nav", "aside", "form", "hr")}}


class _Blocks(HTMLParser):
    """Collects every block's text; a block within a block counts for both."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[str] | None]] = []
        self.found: list[tuple[str, list[str]]] = []

    def handle_starttag(self, tag, attrs):
        ends = _ENDS.get(tag, ())
        while ends and (at := next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k][0] in ends), None)) is not None:
            if any(name in ("ul", "ol", "blockquote", "div", "td") for name, _ in self.open[at + 1 :]):
                break
            del self.open[at:]
        if tag in _VOID:
            return
        parts: list[str] | None = [] if tag in BLOCK_TAGS else None
        if parts is not None:
            self.found.append((tag, parts))
        self.open.append((tag, parts))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        for _, parts in self.open:
            if parts is not None:
                parts.append(data)


def blocks_of(html: str | None) -> tuple[list[str], str | None]:
    """Texts of all blocks in document order, and the first heading of the highest rank that has one."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    texts = [(tag, " ".join("".join(parts).split())) for tag, parts in parser.found]
    heading = None
    for rank in HEADING_TAGS:
        first = next((t for tag, t in texts if tag == rank), None)
        if first:
            heading = first
            break
    return [t for _, t in texts if t], heading


@F.pandas_udf(StructType().add("blocks", ArrayType(StringType())).add("heading", StringType()))
def html_blocks(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([blocks_of(x) for x in html], columns=["blocks", "heading"])
