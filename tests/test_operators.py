import pytest
from pyspark.sql import functions as F

from folioframe.functions import text as T
from folioframe.functions.vectors import cosine
from folioframe.operators import chunking, fusion, keyword, pages, sections, status, upserts, vector
from folioframe.plans import catalog


def _value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_chunks_limits_and_overlap(spark):
    words = " ".join(f"w{k:03d}" for k in range(300))
    got = _value(spark, chunking.chunks(F.lit(words), 10, 2))
    assert all(len(c) <= 40 for c in got) and all(a.split()[-1] in b.split()[:3] for a, b in zip(got, got[1:], strict=False))
    assert "".join(_value(spark, chunking.pieces(F.lit(words), 40))) == words
    assert _value(spark, chunking.chunks(F.lit("One short sentence."), 10, 2)) == ["One short sentence."]
    assert _value(spark, chunking.chunks(F.lit("  "), 10, 2)) == []
    assert _value(spark, chunking.chunks(F.lit("x" * 95), 10, 0)) == ["x" * 40, "x" * 40, "x" * 15]


def test_pack(spark):
    rows = spark.createDataFrame([(1, 1, "aaaa"), (1, 2, "b" * 50), (1, 3, "cc"), (1, 4, "dd")], "ch int, loc long, text string")
    got = [(r.section_index, r.text, r.page_start) for r in sections.pack_rows(rows, ["ch"], "loc", "text", 5).orderBy("section_index").collect()]
    assert got == [(0, "aaaa", 1), (1, "b" * 50, 2), (2, "cc\n\ndd", 3)]


def test_markdown(spark):
    text = "before\n\n# One\nlost\n\nbody\n\n###### Two  \n\nx\n\ny"
    found = _value(spark, sections.markdown_chapters(sections.paragraphs_of(F.lit(text))))
    assert [tuple(x) for x in found] == [("Untitled", 0, 1), ("One", 2, 3), ("Two", 4, 6)]


def test_fusion(spark):
    arm = lambda keys: spark.createDataFrame([(0, k, i + 1) for i, k in enumerate(keys)], "query_id int, key string, rank int")
    got = [(r.key, r.score) for r in fusion.fuse(arm("abc"), arm("cad")).orderBy("rank").collect()]
    assert [k for k, _ in got] == ["a", "c", "b", "d"] and got[0][1] == pytest.approx(1 / 61 + 1 / 62)
    assert fusion.fuse(arm("")).count() == 0


def test_vectors(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.7071, 0.7071]), (3, [0.0, 0.0]), (4, None)], "k int, v array<float>")
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "q int, v array<float>")
    assert [r.key for r in vector.top_k(rows, "k", "v", asked, "q", "v", 3).orderBy("rank").collect()] == [0, 2, 1]
    assert [r.key for r in vector.top_k(rows, "k", "v", asked, "q", "v", 9).orderBy("rank").collect()][-1] == 3
    assert rows.where("k = 3").select(cosine(F.col("v"), F.col("v")).alias("c")).first().c is None
    assert vector.top_k(rows.limit(0), "k", "v", asked, "q", "v", 3).count() == 0


def test_pairs_are_all_ranked_and_leave_the_jvm(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, 1.0]), (4, [2.0, 0.0]), (5, [0.0, 0.0])], "k int, v array<float>")
    asked = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 0.0]), (9, None)], "q int, v array<float>")
    found = vector.top_pairs(rows, "k", "v", asked, "q", "v", 5)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.key, None if r.score is None else round(r.score, 6)))
    none = [(k, None) for k in range(5)]
    assert got == {7: [(0, 1.0), (4, 1.0), (3, 0.707107), (1, None), (2, None)], 8: none, 9: none}
    plan = catalog.queries()["vector_pairs_jvm"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "MapInArrow" in plan  # products of matrices; a comparison of pairs in the JVM took 23 s for 10,256 rows


def test_bm25_equals_sqlite(spark):
    import sqlite3

    texts = ["the cat sat on the mat", "Café au lait und Käse", "cat cat dog", "a bird in the hand", "nothing here"]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(t)")
    con.executemany("INSERT INTO f VALUES (?)", [(t,) for t in texts])
    index = keyword.build_index(spark.createDataFrame(list(enumerate(texts, 1)), "k int, t string"), "k", "t")
    for question in ("cat mat", "cafe dog", "hand hand"):
        want = dict(con.execute("SELECT rowid, -bm25(f) FROM f WHERE f MATCH ?", (" OR ".join(f'"{w}"' for w in question.split()),)))
        got = {r.key: r.score for r in keyword.bm25(index, spark.createDataFrame([(0, question)], "q int, t string"), "q", "t").collect()}
        assert got == pytest.approx(want)


def test_text_functions(spark):
    assert _value(spark, T.slugify(F.lit(" Hello,  Wörld! "))) == "hello-w-rld" and _value(spark, T.slugify(F.lit("!!"))) == "book"
    assert _value(spark, T.section_title(F.lit(None).cast("string"), F.lit(""), F.lit(2))) == "Section 3"
    assert _value(spark, T.clean_page(F.lit("a hyphen-\nated  word\nnext\n\n\npara "))) == "a hyphenated word next\n\npara"
    assert _value(spark, T.strip_reasoning(F.lit("<THINK>x\ny</think> ok"))) == "ok"
    assert _value(spark, T.embedded_number(F.lit("398 | CHAPTER"))) == 398 and _value(spark, T.embedded_number(F.lit("398"))) is None
    assert _value(spark, T.query_terms(F.lit("naïve snake_case, a-b"))) == ["naïve", "snake_case", "a", "b"]


def _pages(spark, texts):
    return spark.createDataFrame([(1, k, t) for k, t in enumerate(texts, 1)], "doc_id int, page_no int, text string")


def test_running_lines(spark):
    texts = [f"My Book\nbody {k}\n{k + 10} | Head" for k in range(1, 7)]
    texts[2] = "My Book\n7\nOpener\nbody"
    texts[4] = "My Book\nbody\n15"
    got = [r.text for r in pages.strip_running_lines(_pages(spark, texts)).orderBy("page_no").collect()]
    assert got[0] == "body 1\n11 | Head" and got[2] == "7\nOpener\nbody" and got[4] == "body"
    two = ["x\n1", "x\n2"]
    assert [r.text for r in pages.strip_running_lines(_pages(spark, two)).orderBy("page_no").collect()] == two


def test_toc_region(spark):
    texts = ["Title", "Contents\nOne .... 1\nTwo .... 5", "CONTENTS\nsub\nsub", "Three .... 9\nFour . 12", "Real text\nof a chapter"]
    row = pages.toc_region(_pages(spark, texts)).first()
    assert (row["first"], row["last"]) == (2, 4) and pages.toc_region(_pages(spark, ["a", "b"])).count() == 0


def test_toc_replies(spark):
    reply = '```json\n[{"title": " A ", "declared_page": "3"}, {"title": "", "declared_page": 1}, {"title": 5, "declared_page": 1}, {"title": "B", "declared_page": null}, 7, {"title": "C", "declared_page": 9}]\n```'
    assert [tuple(x) for x in _value(spark, pages.parse_toc_reply(F.lit(reply)))] == [("A", 3), ("C", 9)]
    assert _value(spark, pages.parse_toc_reply(F.lit("no json"))) is None
    calls = []

    def ask(text):
        calls.append(text)
        return "broken" if len(calls) == 1 else '[{"title": "Chapter 1", "declared_page": 1}]' if "Chapter 1" in text else '[{"title": "chapter 1", "declared_page": 1}, {"title": "Chapter 2", "declared_page": 4}]'

    assert pages.extract_entries(["Chapter 1 .. 1", "Chapter 2 .. 4"], ask) == [("Chapter 1", 1), ("Chapter 2", 4)] and len(calls) == 3


def test_offsets(spark):
    texts = ["cover", "Contents", "Part I\nStart\nMiddle", "preface", "Start\ntext", "more", "Middle\ntext", "End of it\ntext", "see the Middle"]
    entries = spark.createDataFrame([(1, [("Start", 1), ("Middle", 3), ("End of it", 4)], 3)], "doc_id int, entries array<struct<title:string,declared_page:int>>, search_from int")
    got = [(r.title, r.page_start, r.page_end) for r in pages.resolve_pages(_pages(spark, texts), entries).orderBy("chapter_index").collect()]
    assert got == [("Start", 5, 6), ("Middle", 7, 7), ("End of it", 8, 9)]
    windows = spark.createDataFrame([(1, "Middle", 1, 9)], "doc_id int, title string, start int, end int")
    assert pages.first_match(windows, _pages(spark, texts)).first().page_no == 7


def test_similarity(spark):
    both = [("PART V: C++ Tools", "C++ Tools\nlist"), ("Appendices", "Big Appendices"), ("Alpha Beta", "beta and alpha"), ("Designing with Classes", "Designing with Glasses"), ("x", "")]
    got = [r.s for r in spark.createDataFrame(both, "t string, p string").select(pages.title_similarity(F.col("t"), F.col("p")).alias("s")).collect()]
    assert got[:3] == [1.0, 1.0, 0.95] and 0.85 < got[3] < 1 and got[4] == 0
    assert got == pytest.approx([pages.similarity(t, p) for t, p in both])


def test_bounds_and_sections(spark):
    outline = spark.createDataFrame([(1, 1, "A ", 1, 0, 6), (1, 2, "A.1", 2, 1, 6), (1, 2, "A.1 again", 2, 2, 6), (1, 2, "A.2", 3, 3, 6), (1, 1, "B", 4, 4, 6)], "doc_id int, level int, title string, page int, pos int, page_count int")
    bounds = sections.outline_bounds(outline)
    assert [(r.title, r.page_start, r.page_end) for r in bounds.orderBy("chapter_index").collect()] == [("A", 1, 3), ("B", 4, 6)]
    rows = sections.entry_sections(sections.sub_entries(outline, bounds), _pages(spark, [f"p{k}" for k in range(1, 7)]))
    assert [(r.title, r.page_start, r.text) for r in rows.orderBy("chapter_index", "section_index").collect()] == [(None, 1, "p1"), ("A.1", 2, "p2"), ("A.2", 3, "p3")]
    heads = sections.heading_bounds(_pages(spark, ["intro", "Chapter 1\nx", "y", "PART II\nz"]))
    assert [(r.title, r.page_start, r.page_end) for r in heads.orderBy("chapter_index").collect()] == [("Chapter 1", 2, 3), ("PART II", 4, 4)]
    assert sections.heading_bounds(_pages(spark, ["a", "b"])).first().title == "Full Document"


def test_upserts_and_states(spark):
    old = spark.createDataFrame([(1, "keep", "t"), (2, None, "t")], "k int, summary string, title string")
    new = spark.createDataFrame([(1, None, "new"), (3, "s", "new")], "k int, summary string, title string")
    got = {r.k: (r.summary, r.title) for r in upserts.upsert_keeping(old, new, ["k"], ["summary"]).collect()}
    assert got == {1: ("keep", "new"), 2: (None, "t"), 3: ("s", "new")}
    assert [r.k for r in upserts.insert_absent(old, new, ["k"]).collect()] == [3]
    rows = spark.createDataFrame([("pending",), ("embedded",)], "status string")
    assert tuple(status.counts_by_status(rows).first()) == (1, 0, 1)
    assert [r.k for r in status.pending(new, old, ["k"]).collect()] == [3]
