import pytest
from pyspark.sql import types as T

LONG = "word%d " * 30_000
DOCS = T.StructType().add("doc_id", "long").add("text", "string").add("lang", "string").add("source", "string").add("n_chars", "long").add("size", "string").add("score", "string").add("_words", "string").add("fp", "string").add("times", "string").add("line", "string").add("n_lines", "string")
PAGES = T.StructType().add("page_id", "long").add("url", "string").add("html", "string").add("host", "string").add("text", "string").add("verdict", "string")
LABELS = T.StructType().add("doc_id", "long").add("quality", "integer").add("toxic", "integer").add("bad", "string")

PROSE = {
    "en": "the quick brown fox jumps over the lazy dog while the old keeper of the house watches",
    "de": "der schnelle braune fuchs springt über den faulen hund und die alte katze schläft dort",
}


def _docs():
    extra = ["x"] * 7
    rows = []
    for k in range(40):
        lang = "en" if k % 2 else "de"
        rows.append((k, f"{PROSE[lang]} {k * k} {PROSE[lang][: 5 + k]}\nline number {k} of this little text here\nthe same line stands in many documents", lang, f"s{k % 3}", 100, *extra))
    rows += [(100, rows[0][1], "de", "s0", 1, *extra), (100, rows[0][1], "de", "s0", 1, *extra)]  # a copy, repeated as a row
    rows += [(101, None, "en", None, None, *extra), (102, "", None, "s1", 0, *extra), (103, " \t\n ", "en", "s1", 4, *extra), (104, "12 34 !!", "en", "s2", 8, *extra)]
    rows += [(None, "a text without an id that has some more words", "en", "s2", 10, *extra), (None, None, None, None, None, *extra)]
    rows += [(105, " ".join(f"word{i % 997}x{i}" for i in range(30_000)), "en", "s1", 1, *extra), (106, "a" * 200_000, "en", "s1", 1, *extra)]
    return rows


def _pages():
    page = "<html><body><nav><a href=/>Home %d</a></nav><article><h1>Title %d</h1><p>Body of the page %d &amp; more</p></article><footer>Foot</footer></body></html>"
    rows = [(k, f"http://www.site.example.com/en/{k}", page % (k, k, k), "h", "t", "v") for k in range(8)]
    rows += [(8, None, None, None, None, None), (9, "nourl", "", "", "", ""), (None, "http://b.example.net/de/1", "<p>x" * 5000, "h", "t", "v"), (0, rows[0][1], rows[0][2], "h", "t", "v")]
    return rows


def write(spark, folder, docs, pages, labels):
    spark.createDataFrame(docs, DOCS).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(pages, PAGES).write.mode("overwrite").parquet(f"{folder}/pages.parquet")
    spark.createDataFrame(labels, LABELS).write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def edge_dir(spark, tmp_path_factory):
    labels = [(k, k % 4 > 0, k % 9 == 0, "x") for k in range(40)] + [(None, 1, 0, "x"), (3, None, None, "x"), (5, 1, 1, "x")]
    labels = [(a, None if b is None else int(b), None if c is None else int(c), d) for a, b, c, d in labels]
    return write(spark, tmp_path_factory.mktemp("edge"), _docs(), _pages(), labels)


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [], [], [])
