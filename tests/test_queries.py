import collections
import html
import re

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from folioframe.functions import text as T
from folioframe.operators import pages
from folioframe.plans import catalog
from oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, con, name):
    statement = catalog.oracle_sql().get(name)
    if statement is None:
        assert catalog.queries()[name](spark, SF).count() > 0
    else:
        assert compare(spark, con, SF, catalog.queries()[name], statement) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_search_for_more_words_than_are_listed(spark, con, monkeypatch):
    monkeypatch.setattr(catalog.keyword, "LISTED", 1)
    assert compare(spark, con, SF, catalog.queries()["bm25_topk"], catalog.oracle_sql()["bm25_topk"]) is None


def test_searches_with_compound_words(spark, tmp_path):
    """Questions with underscores, marks and superscripts, which are several terms or none of their own in the index."""
    odd = ["der_die und_oder", "the_{0} a", "x\u00b2 {0}_{0}", "e\u0301t\u0301e {0}", "__ _", ""]
    for t in ("documents", "embeddings", "conversations"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    bm = pd.read_parquet(f"{SF}/benchmark.parquet")
    bm["text"] = [odd[k % len(odd)].format(t.split()[k % 3]) + " " + t.replace(" ", "_", 3) * (k % 6 < 4) for k, t in enumerate(bm.text)]
    bm.to_parquet(tmp_path / "benchmark.parquet", index=False)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
    for name in ("bm25_topk", "bm25_topk_filtered", "bm25_two_fields", "rrf_hybrid", "rrf_single_arm", "rrf_three_arms", "hybrid_cited", "hybrid_expand", "library_search", "library_search_filtered"):
        assert compare(spark, con, str(tmp_path), catalog.queries()[name], catalog.oracle_sql()[name]) is None, name


# Queries that SQL cannot express, against plain versions over the whole table.


def _books():
    """Pages by source, as the page queries build them."""
    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    return {s: [f"{s}\n{t}\n{k + 3}" for k, t in enumerate(part.text)] for s, part in docs.groupby("source")}


def _embedded(line):
    found = re.search(r"\d{1,4}", line.strip())
    return None if re.match(T.PAGE_NUMBER, line.strip()) or not found else int(found[0])


def _stripped(pages):
    lines = [p.split("\n") for p in pages]
    n = len(pages)
    if n < 3:
        return pages
    often = max(3, n // 2)
    heads, tails = (collections.Counter(x[k].strip() for x in lines) for k in (0, -1))
    numbers = [a if (a := _embedded(x[0])) is not None else _embedded(x[-1]) for x in lines]
    out = []
    for k, own in enumerate(lines):
        near = min(((abs(j - k), j) for j in range(max(0, k - 20), min(n, k + 21)) if numbers[j] is not None), default=None)
        want = None if near is None else numbers[near[1]] + k - near[1]

        def running(line, want=want):
            digits = re.search(r"\d+", line.strip())
            return bool(re.match(T.PAGE_NUMBER, line.strip())) and (digits is None or want is None or abs(int(digits[0]) - want) <= 1)

        first, last, left = own[0].strip(), own[-1].strip(), list(own)
        if first and heads[first] >= often:
            left = left[1:]
        if left and last and tails[last] >= often:
            left = left[:-1]
        if left and running(left[0]):
            left = left[1:]
        if left and running(left[-1]):
            left = left[:-1]
        out.append("\n".join(left))
    return out


def test_header_footer_strip_by_hand(spark):
    got = {(r.doc_id, r.page_no): r.text for r in catalog.queries()["header_footer_strip"](spark, SF).collect()}
    assert got == {(s, k): t for s, book in _books().items() for k, t in enumerate(_stripped(book), 1)}


def test_first_match_page_by_hand(spark):
    got = {(r.doc_id, r.title): r.page_no for r in catalog.queries()["first_match_page"](spark, SF).collect()}
    want = {}
    for s, book in _books().items():
        for k, page in enumerate(book, 1):
            title = page.split("\n")[1]
            divided = lambda p: any(re.match(T.PART_DIVIDER, x.strip()) for x in p.split("\n"))
            hits = [j for j in range(max(1, k - 3), min(len(book), k + 3) + 1) if not divided(book[j - 1]) and pages.similarity(title, book[j - 1]) >= pages.MATCH]
            if hits:
                want[s, title] = min(hits[0], want.get((s, title), hits[0]))
    assert got == want


def _plain_blocks(page):
    """Blocks of the tables' pages, in which no block holds another."""
    bare = re.sub(r"(?s)<(script|style)\b.*?</\1>|<!--.*?-->", "", page)
    found, now = [], None
    for tag in re.finditer(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)[^>]*>|([^<]+)", bare):
        if tag[3]:
            if now is not None:
                now.append(tag[3])
        elif tag[2] in ("p", "li", "h1"):
            now = None if tag[1] else []
            if now is not None:
                found.append((tag[2], now))
        elif tag[2] in ("article", "footer", "nav", "ul", "div", "body"):
            now = None
    return [(name, text) for name, parts in found if (text := " ".join(html.unescape("".join(parts)).split()))]


def test_html_queries_by_hand(spark):
    rows = pd.read_parquet(f"{SF}/pages.parquet")
    want = {i: _plain_blocks(h) for i, h in zip(rows.page_id, rows.html, strict=True)}
    got = {(r.page_id, r.pos): r.text for r in catalog.queries()["html_block_rows"](spark, SF).collect()}
    assert got == {(i, k): text for i, found in want.items() for k, (_, text) in enumerate(found)}
    heads = {r.page_id: r.heading for r in catalog.queries()["first_heading"](spark, SF).collect()}
    assert heads == {i: next((t for name, t in found if name == "h1"), None) for i, found in want.items()}
