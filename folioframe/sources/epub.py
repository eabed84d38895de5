"""EPUB: spine order, navigation titles, one chapter for each document with text."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterable, Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

from .html import blocks_of
from .registry import PARAGRAPHS, register

# Fixed value: room for the paragraphs of a chapter.
STRIDE = 100_000
_OPF, _DC, _NCX = "{http://www.idpf.org/2007/opf}", "{http://purl.org/dc/elements/1.1/}", "{http://www.daisy.org/z3986/2005/ncx/}"
_X, _EPUB = "{http://www.w3.org/1999/xhtml}", "{http://www.idpf.org/2007/ops}"


def _titles(book: zipfile.ZipFile, names: dict[str, tuple[str, str, str]], base: str) -> dict[str, str]:
    """Navigation titles by file; the first for each file counts."""
    out: dict[str, str] = {}
    for path, kind, properties in names.values():
        folder = posixpath.dirname(path)
        try:
            if "nav" in properties.split():
                root = ElementTree.fromstring(book.read(path))
                toc = next((n for n in root.iter(f"{_X}nav") if n.get(f"{_EPUB}type", "toc") == "toc"), None)
                pairs = [(a.get("href", ""), "".join(a.itertext())) for a in toc.iter(f"{_X}a")] if toc is not None else []
            elif kind == "application/x-dtbncx+xml":
                root = ElementTree.fromstring(book.read(path))
                pairs = [(p.find(f"{_NCX}content").get("src", ""), "".join(p.find(f"{_NCX}navLabel").itertext())) for p in root.iter(f"{_NCX}navPoint")]
            else:
                continue
        except (KeyError, AttributeError, ElementTree.ParseError):
            continue
        for href, title in pairs:
            out.setdefault(posixpath.normpath(posixpath.join(folder, unquote(href.split("#")[0]))), " ".join(title.split()))
    return out


def parse(content: bytes) -> tuple[str | None, str | None, list[tuple[str, list[str]]]]:
    """Title, author and (chapter title, paragraphs) in reading order."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        container = ElementTree.fromstring(book.read("META-INF/container.xml"))
        opf = next(x.get("full-path") for x in container.iter() if x.tag.endswith("rootfile"))
        package, base = ElementTree.fromstring(book.read(opf)), posixpath.dirname(opf)
        text = lambda tag: next((x.text.strip() for x in package.iter(tag) if x.text and x.text.strip()), None)
        names = {i.get("id"): (posixpath.normpath(posixpath.join(base, unquote(i.get("href", "")))), i.get("media-type", ""), i.get("properties", "")) for i in package.iter(f"{_OPF}item")}
        titles, chapters = _titles(book, names, base), []
        for ref in package.iter(f"{_OPF}itemref"):
            path, kind, properties = names.get(ref.get("idref"), ("", "", ""))
            if kind != "application/xhtml+xml" or "nav" in properties.split():
                continue
            paragraphs, heading = blocks_of(book.read(path).decode("utf-8", "replace"))
            if paragraphs:
                chapters.append((titles.get(path) or heading or f"Chapter {len(chapters) + 1}", paragraphs))
        return text(f"{_DC}title"), text(f"{_DC}creator"), chapters


class _EpubReader:
    source_type, extensions = "epub", (".epub",)

    def read(self, files: DataFrame) -> DataFrame:
        def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import hashlib

            names = [c.split()[0] for c in PARAGRAPHS.split(", ")]
            for batch in batches:
                for path, content in zip(batch["path"], batch["content"], strict=True):
                    title, author, chapters = parse(bytes(content))
                    digest = hashlib.sha256(bytes(content)).hexdigest()
                    rows = [
                        (path, digest, title, author, "epub", k, name, (k + 1) * STRIDE, (k + 1) * STRIDE + i, text)
                        for k, (name, paragraphs) in enumerate(chapters)
                        for i, text in enumerate(paragraphs)
                    ]
                    yield pd.DataFrame(rows, columns=names)

        return files.select("path", "content").mapInPandas(run, PARAGRAPHS)


EPUB = register(_EpubReader())
