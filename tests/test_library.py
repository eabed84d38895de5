import io
import zipfile

import pytest
from pyspark.sql import functions as F

from folioframe.enrich import FakeClient, retried, same_model, strip_reasoning
from folioframe.library import Library
from folioframe.operators import keyword, search
from folioframe.operators.search import Filters, report
from folioframe.sources import paged
from folioframe.sources.registry import read_binary, reader_for
from folioframe.streaming.ingest import watch

ZOO = "# Cats\n\nCats purr softly at night.\n\nThey like fish.\n\n# Dogs\n\nDogs bark at the postman."


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "zoo.md").write_text(ZOO)
    (tmp_path / "in" / "notes.TXT").write_text("# not a heading\n\nplain words here")
    return tmp_path


def test_dispatch():
    assert [reader_for(p).source_type for p in ("a/b.md", "x.MARKDOWN", "y.txt", "z.EPUB", "w.pdf")] == ["markdown", "markdown", "text", "epub", "pdf"]
    with pytest.raises(ValueError, match=r"\.docx"):
        reader_for("a.docx")


def test_ingest_resume_search_delete(spark, folder):
    lib = Library(spark, str(folder / "lib"))
    ids = lib.ingest_files(spark.read.format("binaryFile").load(str(folder / "in")), FakeClient)
    assert sorted(ids) == [1, 2]
    status = {r.slug: r for r in lib.status().collect()}
    assert status["zoo"].n_chapters == 2 and status["zoo"].n_embedded == 2 and status["zoo"].n_pending == 0
    again = lib.ingest(str(folder / "in" / "zoo.md"), FakeClient)
    assert again == status["zoo"].book_id and lib.chunks().count() == 3
    vector = lib.search(["Dogs bark"], FakeClient, mode="vector").collect()
    assert len(vector) == 3 and [r.rank for r in sorted(vector, key=lambda r: r.rank)] == [1, 2, 3]
    found = lib.search(["postman"], FakeClient, expand=True)
    assert found.count() == 3
    text = report(found.where("rank <= 2")).first().report
    assert "[zoo -- " in text and "score=" in text
    only = lib.search(["words"], FakeClient, filters=Filters(source_type="text")).collect()
    assert {r.book_name for r in only} == {"notes"}
    assert lib.search(["words"], FakeClient, filters=Filters(author="nobody")).count() == 0
    with pytest.raises(ValueError, match="mode"):
        lib.search(["x"], FakeClient, mode="none")
    with pytest.raises(ValueError, match="vectors of"):
        lib.search(["x"], FakeClient, model="other")
    outline = lib.outline(status["zoo"].book_id).collect()
    assert [c.title for c in outline] == ["Cats", "Dogs"] and "text" not in outline[0].sections[0].asDict()
    assert outline[0].sections[0].title.startswith("Section 1 -- Cats purr")
    assert lib.section(status["zoo"].book_id, 1, 0).text == "Dogs bark at the postman."
    with pytest.raises(ValueError):
        lib.section(99, 0, 0)
    assert lib.rebuild_keyword_index() == 3 and lib.rebuild_keyword_index(status["zoo"].book_id) == 2
    (folder / "in" / "zoo.md").write_text(ZOO + "\n\nMore.")
    with pytest.raises(ValueError, match="already"):
        lib.ingest(str(folder / "in" / "zoo.md"), FakeClient)
    new = lib.ingest(str(folder / "in" / "zoo.md"), FakeClient, force=True)
    assert new == 3
    lib.delete("zoo")
    assert [r.slug for r in lib.books().collect()] == ["notes"]
    assert lib.table("vectors").select("book_id").distinct().count() == 1
    with pytest.raises(KeyError):
        lib.delete("zoo")
    lib.put_toc("h", [("a", 1, 2)])
    lib.put_toc("h", [("b", 1, 3)])
    assert lib.get_toc("h") == [("b", 1, 3)] and lib.get_toc("x") is None


def _failing(word, late=False):
    """A client that fails on one text; ``late``: only when it embeds."""

    class Failing(FakeClient):  # within a function, so that it travels to the workers by value
        def generate(self, model, system, prompt):
            if word in prompt and not late:
                raise OSError("the model is gone")
            return f"note {prompt[-60:]}"

        def embed(self, model, texts):
            if any(word in t for t in texts):
                raise OSError("the model is gone")
            return super().embed(model, texts)

    return Failing


def test_interrupted_stages_go_on(spark, folder):
    (folder / "in" / "long.md").write_text("".join(f"# C{k}\n\nanimal{k} walks here.\n\n" for k in range(5)))
    lib = Library(spark, str(folder / "lib"))
    lib.guard("embedding")
    lib.load(read_binary(spark.read.format("binaryFile").load(str(folder / "in" / "long.md"))))
    with pytest.raises(Exception, match="gone"):
        lib.enrich(_failing("animal3"), commit_rows=1)
    summaries = lib.table("summaries").count()
    lib.enrich(FakeClient)
    assert summaries < 5 == lib.table("summaries").count() == lib.table("contexts").count()
    lib2 = Library(spark, str(folder / "lib2"))
    lib2.load(read_binary(spark.read.format("binaryFile").load(str(folder / "in" / "long.md"))))
    with pytest.raises(Exception, match="gone"):
        lib2.enrich(_failing("animal3", late=True), commit_rows=2)
    done = lib2.table("vectors").count()
    assert done < 5 and lib2.table("contexts").count() == 5
    assert lib2.table("totals").agg(F.sum("n_docs")).first()[0] in (done, None)  # postings come with the vectors
    lib2.enrich(FakeClient)
    assert lib2.table("vectors").count() == 5 == lib2.table("totals").agg(F.sum("n_docs")).first()[0]
    assert lib2.table("postings").where("term = 'walks'").count() == 5


def test_stored_index_answers(spark, folder):
    lib = Library(spark, str(folder / "lib"))
    (folder / "in" / "code.txt").write_text("call snake_case here\n\nthe case of a snake\n\nsnake and case, snake case")
    lib.ingest_files(spark.read.format("binaryFile").load(str(folder / "in")), FakeClient)
    index = lib.keyword_index()
    asked = spark.createDataFrame([(0, "snake_case"), (1, "postman dogs")], "query_id int, text string")
    rows = lib.chunks().withColumn("_key", search.chunk_key())
    fresh = keyword.build_index(rows, "_key", "raw_text", "context", places=True)
    found = [sorted((r.query_id, r.key, round(r.score, 9)) for r in keyword.bm25(i, asked, "query_id", "text").collect()) for i in (index, fresh)]
    assert found[0] == found[1] and {q for q, _, _ in found[0]} == {0, 1}
    assert index.stats.first() == fresh.stats.first()
    plan = keyword.bm25(index, asked, "query_id", "text")._jdf.queryExecution().toString()
    assert "raw_text" not in plan and "/chunks/" not in plan and "In(term" in plan.replace("PushedFilters: [", "")
    lib.delete("code")
    after = keyword.bm25(lib.keyword_index(), asked, "query_id", "text").collect()
    assert {r.query_id for r in after} == {1} and lib.keyword_index().stats.first().n_docs == 3
    assert lib.search(["postman"], FakeClient).where("rank = 1").first().raw_text.startswith("Dogs")


def test_manifests(spark, folder):
    lib = Library(spark, str(folder / "lib"))
    lib.guard("embedding")
    number, manifest = lib._read()
    lib._swap(number, manifest | {"next_book_id": 7})
    with pytest.raises(RuntimeError, match="another writer"):
        lib._swap(number, manifest | {"next_book_id": 9})
    assert lib.manifest()["next_book_id"] == 7
    for _ in range(30):
        lib._swap(*lib._read())
    assert len(lib._numbers()) <= 21 and lib.manifest()["next_book_id"] == 7


def test_stream(spark, folder):
    lib = Library(spark, str(folder / "lib"))
    query = watch(lib, str(folder / "in"), str(folder / "ck"), FakeClient)
    query.awaitTermination()
    assert lib.books().count() == 2 and lib.chunks().where(F.col("status") == "embedded").count() == 3


def _epub() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/c.opf"/></rootfiles></container>')
        z.writestr("OEBPS/c.opf", '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>My Book</dc:title><dc:creator>A. Writer</dc:creator></metadata><manifest><item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><item id="e" href="e.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="n"/><itemref idref="a"/><itemref idref="e"/><itemref idref="b"/></spine></package>')
        z.writestr("OEBPS/nav.xhtml", '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><ol><li><a href="a.xhtml#x">First</a></li><li><a href="a.xhtml">Again</a></li></ol></nav></body></html>')
        z.writestr("OEBPS/a.xhtml", "<html><body><h1>Head</h1><p>One <b>two</b></p></body></html>")
        z.writestr("OEBPS/e.xhtml", "<html><body></body></html>")
        z.writestr("OEBPS/b.xhtml", "<html><body><h2>Second</h2><p>Three</p></body></html>")
    return out.getvalue()


def test_epub(spark, tmp_path):
    (tmp_path / "b.epub").write_bytes(_epub())
    lib = Library(spark, str(tmp_path / "lib"))
    lib.ingest(str(tmp_path / "b.epub"), FakeClient)
    book = lib.books().first()
    assert (book.name, book.author, book.source_type, book.page_count) == ("My Book", "A. Writer", "epub", 2)
    chapters = lib.table("chapters").orderBy("chapter_index").collect()
    assert [(c.title, c.page_start) for c in chapters] == [("First", 100_000), ("Second", 200_000)]
    assert lib.section(1, 0, 0).text == "Head\n\nOne two"


def _with_decoder(decode):
    paged.set_decoder(decode)
    return lambda: paged.set_decoder(paged.decode_pdf)


def test_pdf_outline_gives_titled_sections(spark, tmp_path):
    (tmp_path / "b.pdf").write_bytes(b"outlined")
    texts = [f"page {k} of the book" for k in range(1, 7)]
    undo = _with_decoder(lambda content: (texts, [(1, "One", 1), (2, "One A", 2), (2, "One B", 3), (1, "Two", 5)], "Outlined", "An Author"))
    try:
        lib = Library(spark, str(tmp_path / "lib"))
        lib.ingest(str(tmp_path / "b.pdf"), FakeClient)
    finally:
        undo()
    rows = [(r.chapter_index, r.section_index, r.title, r.page_start, r.text) for r in lib.table("sections").orderBy("chapter_index", "section_index").collect()]
    assert [r[:4] for r in rows] == [(0, 0, None, 1), (0, 1, "One A", 2), (0, 2, "One B", 3), (1, 0, None, 5)]
    assert rows[2][4] == f"{texts[2]}\n\n{texts[3]}" and rows[3][4] == f"{texts[4]}\n\n{texts[5]}"
    assert lib.table("chunks").count() == 4 == lib.table("vectors").count()


def test_pdf_contents_by_a_model_once(spark, tmp_path):
    (tmp_path / "b.pdf").write_bytes(b"contents")
    calls = tmp_path / "calls"
    calls.mkdir()
    texts = ["cover", "Contents\nStart .... 1\nMiddle .... 3", "Start\nfirst words", "more", "Middle\nlast words"]

    class Reads(FakeClient):
        def generate(self, model, system, prompt):
            if "contents pages" in system:
                (calls / str(len(list(calls.iterdir())))).touch()
                return '[{"title": "Start", "declared_page": 1}, {"title": "Middle", "declared_page": 3}]'
            return super().generate(model, system, prompt)

    undo = _with_decoder(lambda content: (texts, [], "Read", None))
    try:
        lib = Library(spark, str(tmp_path / "lib"))
        lib.ingest(str(tmp_path / "b.pdf"), Reads)
        asked = len(list(calls.iterdir()))
        assert asked >= 1 and [(c.title, c.page_start) for c in lib.table("chapters").orderBy("chapter_index").collect()] == [("Start", 3), ("Middle", 5)]
        lib.delete("read")
        lib.ingest(str(tmp_path / "b.pdf"), Reads)
        assert len(list(calls.iterdir())) == asked  # from the cache
        assert lib.get_toc(lib.table("books").first().content_hash) == [("Start", 3, 4), ("Middle", 5, 5)]
    finally:
        undo()


def test_client_helpers():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return 7

    waits = []
    assert retried(flaky, sleep=waits.append) == 7 and waits == [1.0, 2.0]
    with pytest.raises(ZeroDivisionError):
        retried(lambda: 1 / 0, sleep=waits.append)
    assert strip_reasoning("<think>a\nb</think> yes ") == "yes"
    assert same_model("m", "m:latest") and same_model("m:1", "m:1") and not same_model("m:1", "m:latest")
