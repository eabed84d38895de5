"""Every operator and stage over nulls, empty and long texts, copies, repeated rows, clashing columns, and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioframe.llm import catalog

DOC_OPS = [n for n in catalog.queries() if n not in ("op1_url_filters", "op5_html_extraction")]


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_empty_tables(spark, empty_dir, name):
    assert catalog.queries()[name](spark, empty_dir).count() == 0


@pytest.mark.parametrize("name", DOC_OPS)
def test_one_row_for_each_document(spark, edge_dir, name):
    out = catalog.queries()[name](spark, edge_dir).collect()
    assert len(out) == spark.read.parquet(f"{edge_dir}/documents.parquet").count()
    by = {r.doc_id: r.asDict() for r in out if r.doc_id is not None}
    assert by[100].keys() == by[0].keys()
    if name == "op2_simhash_near_dedup":
        assert by[100]["component_id"] == 0 == by[0]["component_id"]
        assert {by[k]["fingerprint"] for k in (101, 102, 103)} == {"0" * 16} and {by[k]["component_id"] for k in (101, 102, 103)} == {101}
    if name == "op3_sentencepiece":
        assert by[101]["n_tokens"] == by[102]["n_tokens"] == 0 and by[106]["n_tokens"] > 1000
    if name == "op4_document_fingerprints":
        assert by[0]["fingerprint"] == by[100]["fingerprint"] and by[101]["fingerprint"] == "0:" and by[105]["near_edited"] > 0.5
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    if name == "op6_language_id":
        assert by[101]["lang_pred"] == by[103]["lang_pred"] == by[104]["lang_pred"] == "und" and by[1]["lang_pred"] == "en" and by[2]["lang_pred"] == "de"
    if name == "op7_mix_sources":
        assert by[101]["size"] == by[101]["taken"] == 0 and all(r.taken <= 3 * r["size"] for r in out)
    if name == "op8_quality_rules":
        assert by[101]["base_failed"] and not by[101]["kept"] and by[105]["n_words"] == 30_000 and not by[0]["base_failed"]
    if name == "op9_quality_classifier":
        assert all(0 <= r.score <= 1 for r in out)
    if name == "op10_line_dedup":
        assert by[101]["text"] is None and by[100]["text"] == "" and by[0]["n_removed"] == 0
        assert "the same line" in by[0]["text"] and "the same line" not in by[1]["text"]


def test_pages(spark, edge_dir):
    n = spark.read.parquet(f"{edge_dir}/pages.parquet").count()
    urls = catalog.queries()["op1_url_filters"](spark, edge_dir).collect()
    assert len(urls) == n
    by = {r.page_id: r for r in urls}
    assert (by[8].host, by[8].path, by[8].rule, by[8].verdict) == ("", "", None, "allow") and (by[1].rule, by[1].verdict) == ("com/en/", "block") and by[7].rule == "example.com/en/7"
    texts = {r.page_id: r for r in catalog.queries()["op5_html_extraction"](spark, edge_dir).collect()}
    assert texts[3].text == "Title 3\n\nBody of the page 3 & more" and texts[8].text == "" and texts[9].n_chars == 0


@pytest.mark.parametrize("folder", ["edge_dir", "empty_dir"])
def test_stages(spark, folder, request, tmp_path):
    sf_dir = request.getfixturevalue(folder)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        assert k == len(corpus_pipeline.STAGES) - 1 or out.dtypes == docs.dtypes, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        ids[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    if folder == "empty_dir":
        assert not any(ids.values())
        return
    assert not {101, 102, 103, 104} & set(ids["language_id"]) and None in ids["language_id"] and ids["language_id"].count(100) == 2
    assert sorted(map(str, ids["line_dedup"])) == sorted(map(str, ids["language_id"]))
    assert ids["near_dedup"].count(100) <= 1 and 0 in ids["near_dedup"] and len(ids["near_dedup"]) < len(ids["line_dedup"])
    assert max(map(ids["mix_sources"].count, ids["mix_sources"])) <= 3
    assert docs.where("decoded like 'x%'").count() == 0 and sorted(map(str, ids["encode"])) == sorted(map(str, ids["mix_sources"]))


def test_lines_of_the_same_words_in_another_order_are_no_candidates(spark):
    import random

    from folioframe.llm import lines

    draw, rows = random.Random(7), []
    for k in range(300):
        a = [draw.getrandbits(31) for _ in range(draw.randint(5, 60))]
        b = list(a)
        for _ in range(len(a) // 5):  # as many edits as 0.8 allows, of any kind
            at, kind = draw.randrange(len(b)), draw.randrange(3)
            b[at : at + (kind != 0)] = [draw.getrandbits(31)] * (kind != 1)
        allowed = max(len(a), len(b)) // 5 >= len(a) // 5
        rows.append((k, a, b, allowed))
        rows.append((1000 + k, a, draw.sample(a, len(a)), None))
    marked = spark.createDataFrame(rows, "k int, a array<int>, b array<int>, alike boolean")
    for side in "ab":
        n, parity, order = lines._marks(F.col(side))
        marked = marked.withColumns({f"{side}_n": n, f"{side}_parity": parity, f"{side}_order": order})
    named = {"n": "n", "p": "parity.p", "q": "parity.q", "r": "order.p", "s": "order.q"}
    fits = lines._near(0.8)(lambda c: F.col(f"a_{named[c]}"), lambda c: F.col(f"b_{named[c]}"))
    got = marked.select("k", "alike", fits.alias("fits")).collect()
    assert all(r.fits for r in got if r.alike) and sum(r.fits for r in got if r.k >= 1000) < 30
