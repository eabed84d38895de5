"""Registered queries of the engine's own operators over the driver tables, and their SQL.

The tables stand in for a library: sources are books, documents chapters,
``embeddings`` the vectors of documents of the same id, ``benchmark`` the
questions, ``conversations`` ordered paragraphs, ``labels`` a sparse attribute.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import hash_vector
from ..operators import chunking, fusion, keyword, pages, search, sections, status, upserts, vector
from ..operators.search import POOL, TOP_K
from ..sources.html import html_blocks
from ..storage import saved
from . import sql


def _table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tables(spark, sf_dir, *names):
    return [_table(spark, sf_dir, n) for n in names]


def _question_vectors(emb: DataFrame) -> DataFrame:
    """The stated query set: vectors whose id is divisible by 20."""
    return emb.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _asked_vectors(emb: DataFrame, bm: DataFrame) -> DataFrame:
    """A vector for each benchmark question: that of the same id."""
    return emb.join(F.broadcast(bm.select(F.col("item_id").alias("vec_id"))), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _ranked(found: DataFrame) -> DataFrame:
    return found.select("query_id", F.col("key").alias("doc_id"), F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"))


# Vector arm.


def vector_topk(spark, d):
    (emb,) = _tables(spark, d, "embeddings")
    return _ranked(vector.top_k(emb, "vec_id", "embedding", _question_vectors(emb), "query_id", "vector", 10))


def vector_batch_topk(spark, d):
    emb, bm = _tables(spark, d, "embeddings", "benchmark")
    return _ranked(vector.top_k(emb, "vec_id", "embedding", _asked_vectors(emb, bm), "query_id", "vector", TOP_K))


def vector_topk_filtered(spark, d):
    emb, docs = _tables(spark, d, "embeddings", "documents")
    rows = emb.join(docs.where("lang = 'en' AND source = 'src3'").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    return _ranked(vector.top_k(rows, "vec_id", "embedding", _question_vectors(emb), "query_id", "vector", TOP_K))


def vector_pairs_jvm(spark, d):
    """All pairs, with those that have no cosine. Its name is older than its method: the JVM needs microseconds for a pair."""
    (emb,) = _tables(spark, d, "embeddings")
    return _ranked(vector.top_pairs(emb, "vec_id", "embedding", _question_vectors(emb), "query_id", "vector", TOP_K))


# Keyword arm.


def tokenize_terms(spark, d):
    (docs,) = _tables(spark, d, "documents")
    return keyword.postings(docs, "doc_id", "text").select(F.col("key").alias("doc_id"), "term", "tf")


def doc_length(spark, d):
    (docs,) = _tables(spark, d, "documents")
    return keyword.lengths(docs, "doc_id", "text").select(F.col("key").alias("doc_id"), "dl")


def term_df(spark, d):
    (docs,) = _tables(spark, d, "documents")
    return keyword.document_frequency(keyword.build_index(docs, "doc_id", "text"))


def corpus_stats(spark, d):
    (docs,) = _tables(spark, d, "documents")
    return keyword.build_index(docs, "doc_id", "text").stats.select("n_docs", F.round("avg_dl", 6).alias("avg_dl"))


def _indexed(rows, *texts):
    """An index whose postings are stored, as a library's are: texts are tokenized once."""
    return keyword.build_index(rows, "doc_id", *texts, keep=lambda p: saved(p, "postings"))


def _bm25(docs, bm):
    return keyword.bm25(_indexed(docs, "text"), bm, "item_id", "text")


def bm25_topk(spark, d):
    docs, bm = _tables(spark, d, "documents", "benchmark")
    return _ranked(keyword.top(_bm25(docs, bm), TOP_K))


def bm25_topk_filtered(spark, d):
    docs, bm = _tables(spark, d, "documents", "benchmark")
    scored = _bm25(docs, bm).join(docs.where("lang = 'en'").select(F.col("doc_id").alias("key")), "key", "left_semi")
    return _ranked(keyword.top(scored, TOP_K))


def bm25_two_fields(spark, d):
    docs, bm = _tables(spark, d, "documents", "benchmark")
    index = _indexed(docs.withColumn("context", F.concat_ws(" ", "lang", "source")), "text", "context")
    asked = bm.withColumn("q", F.concat(F.col("text"), F.lit(" src7 de")))
    return _ranked(keyword.top(keyword.bm25(index, asked, "item_id", "q"), TOP_K))


# Fusion.


def _embedded(docs, emb):
    return docs.join(emb.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")


def _arms(spark, d):
    docs, emb, bm = _tables(spark, d, "documents", "embeddings", "benchmark")
    rows = _embedded(docs, emb)
    near = vector.top_k(rows, "doc_id", "embedding", _asked_vectors(emb, bm), "query_id", "vector", POOL)
    return rows, near, keyword.top(_bm25(rows, bm), POOL)


def _fused(found: DataFrame, k: int) -> DataFrame:
    return found.where(F.col("rank") <= k).select("query_id", F.col("key").alias("doc_id"), F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"))


def rrf_hybrid(spark, d):
    _, near, words = _arms(spark, d)
    return _fused(fusion.fuse(near, words), TOP_K)


def rrf_single_arm(spark, d):
    _, near, _ = _arms(spark, d)
    return _fused(fusion.fuse(near), TOP_K)


def rrf_three_arms(spark, d):
    rows, near, words = _arms(spark, d)
    asked = near.select("query_id").distinct()
    longest = rows.select(F.col("doc_id").alias("key"), "n_chars").orderBy(F.col("n_chars").desc(), "key").limit(POOL)  # the same for every question
    longest = longest.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n_chars").desc(), "key")))
    newest = asked.join(F.broadcast(longest))  # POOL rows
    return _fused(fusion.fuse(near, words, newest), TOP_K)


def hybrid_cited(spark, d):
    rows, near, words = _arms(spark, d)
    won = fusion.fuse(near, words).where(F.col("rank") <= TOP_K).select("query_id", F.col("key").alias("doc_id"), "rank", "score")
    named = won.join(rows.select("doc_id", "source", "lang", "text"), "doc_id")
    header = F.format_string("[%s -- %s, p.%d] (rank=%d)", "source", "lang", "doc_id", "rank")
    return named.select("query_id", F.col("rank").cast("long").alias("rank"), F.concat(header, F.lit("\n"), "text").alias("citation"))


def hybrid_expand(spark, d):
    rows, near, words = _arms(spark, d)
    (conv,) = _tables(spark, d, "conversations")
    won = fusion.fuse(near, words).where(F.col("rank") <= TOP_K).select("query_id", F.col("key").alias("doc_id"), F.col("rank").cast("long").alias("rank"))
    first = conv.where("turn = 0").groupBy(F.col("conv_id").alias("doc_id")).agg(F.min("text").alias("section_text"))
    return won.join(first, "doc_id", "left").select("query_id", "doc_id", "rank", "section_text")


# The library's search, with documents as chunks.


def _found(spark, d, **options):
    docs, emb, bm = _tables(spark, d, "documents", "embeddings", "benchmark")
    zero = F.lit(0)
    rows = _embedded(docs, emb).select(
        *[zero.alias(k) for k in ("book_id", "chapter_index", "section_index")], F.col("doc_id").alias("chunk_index"), F.col("source").alias("book_name"), F.col("lang").alias("chapter_title"),
        F.lit(None).cast("string").alias("section_title"), F.col("doc_id").alias("page_start"), F.col("text").alias("raw_text"), F.lit(None).cast("string").alias("context"), "embedding", F.col("lang").alias("author"),
    )
    asked = bm.select(F.col("item_id").alias("query_id"), "text").join(_asked_vectors(emb, bm), "query_id", "left")
    index = keyword.build_index(rows.withColumn("_key", search.chunk_key()), "_key", "raw_text", "context", keep=lambda p: saved(p, "postings"))
    return search.search(rows, asked, index=index, **options)


def _excerpts(found: DataFrame) -> DataFrame:
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"), F.col("chunk_index").alias("doc_id"), "book_name", "chapter_title", "raw_text")


def library_search(spark, d):
    return _excerpts(_found(spark, d))


def library_search_vector(spark, d):
    return _excerpts(_found(spark, d, mode="vector"))


def library_search_filtered(spark, d):
    return _excerpts(_found(spark, d, filters=search.Filters(author="en")))


def library_report(spark, d):
    return search.report(_found(spark, d))


# Splitting and sections.


def _chunked(docs, size, overlap):
    return chunking.chunk_rows(docs.select("doc_id", "text"), "text", size, overlap).withColumn("chunk_index", F.col("chunk_index").cast("long"))


def chunk_documents(spark, d):
    return _chunked(_table(spark, d, "documents"), 600, 80)


def chunk_overlap_small(spark, d):
    return _chunked(_table(spark, d, "documents"), 40, 8)


def chunk_stats(spark, d):
    n = F.length("raw_text")
    return chunk_documents(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.max(n).cast("long").alias("longest"), F.sum(n).cast("long").alias("total"))


def pack_sections(spark, d):
    out = sections.pack_rows(_table(spark, d, "conversations").dropDuplicates(["conv_id", "turn"]), ["conv_id"], "turn", "text", 30)
    return out.select("conv_id", F.col("section_index").cast("long").alias("section_index"), "text", "page_start")


def sections_in_chapter(spark, d):
    return pack_sections(spark, d).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_sections"), F.max(F.length("text")).cast("long").alias("longest"))


def running_chapters(spark, d):
    conv = _table(spark, d, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn")
    return conv.select("conv_id", "turn", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(order).alias("chapter_index"))


def chapter_bounds(spark, d):
    conv = _table(spark, d, "conversations")
    counts = conv.groupBy(F.col("conv_id").alias("doc_id")).agg(F.max("turn").alias("page_count"))
    outline = conv.select(F.col("conv_id").alias("doc_id"), F.when(F.col("role") == "user", 1).otherwise(2).alias("level"), "role", F.col("turn").alias("page"), F.col("turn").alias("pos")).join(counts, "doc_id")
    out = sections.outline_bounds(outline.withColumnRenamed("role", "title"))
    return out.select(*[F.col(c).cast("long").alias(c) if c != "title" else c for c in out.columns])


# Scalar functions.


def slugify_names(spark, d):
    return _table(spark, d, "customer").select("c_custkey", T.slugify(F.concat("c_name", F.lit(" & "), "c_mktsegment")).alias("slug"))


def section_titles(spark, d):
    docs = _table(spark, d, "documents")
    title = F.when(F.col("doc_id") % 3 == 0, F.col("source"))
    return docs.select("doc_id", T.section_title(title, F.col("text"), (F.col("doc_id") % 7).cast("int")).alias("title"))


def approx_tokens(spark, d):
    return _table(spark, d, "documents").select("doc_id", T.approx_tokens(F.col("text")).cast("long").alias("tokens"))


def query_terms(spark, d):
    terms = F.posexplode(T.query_terms(F.col("text"))).alias("pos", "term")
    return _table(spark, d, "benchmark").select("item_id", terms).select("item_id", F.col("pos").cast("long").alias("pos"), "term")


def content_hash(spark, d):
    return _table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


def fake_embedding(spark, d):
    v = hash_vector(F.col("text"), 4)
    return _table(spark, d, "benchmark").select("item_id", F.posexplode(v).alias("i", "x")).select("item_id", F.col("i").cast("long").alias("i"), F.round(F.col("x").cast("double"), 6).alias("x"))


def clean_pages(spark, d):
    return _table(spark, d, "documents").select("doc_id", T.clean_page(F.col("text")).alias("text"))


def toc_line_density(spark, d):
    return _table(spark, d, "documents").select("doc_id", F.round(T.toc_density(F.col("text")), 9).alias("density"), T.has_toc_header(F.col("text")).alias("has_header"), T.top_level_lines(F.col("text")).cast("long").alias("top_level"))


def prompts(spark, d):
    docs, labels = _tables(spark, d, "documents", "labels")
    note = labels.groupBy("doc_id").agg(F.max("quality").alias("q")).select("doc_id", F.concat(F.lit("quality "), F.col("q").cast("string")).alias("summary"))
    joined = docs.join(note, "doc_id", "left")
    return joined.select("doc_id", T.chunk_prompt(F.col("summary"), F.col("text")).alias("prompt"))


# Status, upserts, filters.


def _states(docs, emb, labels):
    own = docs.select("source", "doc_id")
    vectors = emb.select(F.col("vec_id").alias("doc_id"), "embedding")
    contexts = labels.groupBy("doc_id").agg(F.max("quality").cast("string").alias("context"))
    return status.with_status(own, contexts, vectors, ["doc_id"])


def library_status(spark, d):
    docs, emb, labels = _tables(spark, d, "documents", "embeddings", "labels")
    return status.counts_by_status(_states(docs, emb, labels), ["source"])


def status_totals(spark, d):
    docs, emb, labels = _tables(spark, d, "documents", "embeddings", "labels")
    return status.counts_by_status(_states(docs, emb, labels))


def book_listing(spark, d):
    docs = _table(spark, d, "documents")
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_chapters"), F.countDistinct("lang").alias("n_langs"), F.sum("n_chars").alias("n_chars"), F.min("doc_id").alias("first_id"))


def outline_nested(spark, d):
    docs = _table(spark, d, "documents").withColumns({"book_id": F.expr("cast(substr(source, 4) as bigint)"), "chapter_index": F.col("lang")})
    chapters = docs.select("book_id", "chapter_index").distinct().withColumns({"title": F.col("chapter_index"), "page_start": F.lit(0)})
    parts = docs.select("book_id", "chapter_index", F.col("doc_id").cast("int").alias("section_index"), F.lit(None).cast("string").alias("title"), "text", F.col("doc_id").alias("page_start"))
    flat = status.outline(chapters, parts).select("book_id", "chapter_index", F.explode("sections").alias("s"))
    return flat.select("book_id", "chapter_index", F.col("s.section_index").cast("long").alias("section_index"), F.col("s.title").alias("title"), F.col("s.approx_tokens").cast("long").alias("approx_tokens"))


def search_rows(spark, d):
    docs, emb, conv = _tables(spark, d, "documents", "embeddings", "conversations")
    first = conv.where("turn = 0").groupBy(F.col("conv_id").alias("doc_id")).agg(F.min("role").alias("chapter_title"))
    return _embedded(docs, emb).join(first, "doc_id").select("doc_id", "source", "lang", "chapter_title")


def pending_work(spark, d):
    docs, labels = _tables(spark, d, "documents", "labels")
    return docs.join(labels.select("doc_id"), "doc_id", "left_anti").select("doc_id", "source")


def stage_batch(spark, d):
    docs, emb, labels = _tables(spark, d, "documents", "embeddings", "labels")
    return status.stage_batch(_states(docs, emb, labels), "pending", ["doc_id"], 16).select("doc_id", "source", "status")


def identity_resolution(spark, d):
    docs = _table(spark, d, "documents")
    named = docs.select("doc_id", F.concat("source", F.lit("-"), (F.col("doc_id") % 500).cast("string")).alias("slug"), F.sha2("text", 256).alias("content_hash"))
    have = named.join(_table(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi")  # what is labelled is known already
    have = have.groupBy("slug").agg(F.min("content_hash").alias("content_hash"))
    return upserts.resolve_identity(have, named).select("doc_id", "slug", "action")


def idempotent_load(spark, d):
    docs, labels = _tables(spark, d, "documents", "labels")
    return upserts.insert_absent(labels.select("doc_id"), docs.select("doc_id", "source"), ["doc_id"])


def upsert_keep_summary(spark, d):
    docs, labels = _tables(spark, d, "documents", "labels")
    old = labels.groupBy("doc_id").agg(F.max("quality").cast("string").alias("summary")).withColumn("title", F.lit("old"))
    new = docs.select("doc_id", F.lit(None).cast("string").alias("summary"), F.col("source").alias("title"))
    return upserts.upsert_keeping(old, new, ["doc_id"], ["summary"])


def latest_wins(spark, d):
    events = _table(spark, d, "events").select("user_id", "event_id", "event_type")
    return upserts.latest(events, ["user_id"], "event_id")


def delete_book(spark, d):
    return upserts.delete_where(_table(spark, d, "documents").select("doc_id", "source"), "source", "src4")


def reindex(spark, d):
    docs, emb = _tables(spark, d, "documents", "embeddings")
    postings = keyword.build_index(_embedded(docs, emb), "doc_id", "text").postings
    return postings.groupBy(F.col("key").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_terms"), F.sum("tf").alias("n_tokens"))


# Pages and files.


def _page_rows(spark, d):
    docs = _table(spark, d, "documents")
    order = Window.partitionBy("source").orderBy("doc_id")
    number = F.row_number().over(order)
    return docs.select(F.col("source").alias("doc_id"), number.alias("page_no"), F.concat("source", F.lit("\n"), "text", F.lit("\n"), (number + 2).cast("string")).alias("text"))


def header_footer_strip(spark, d):
    out = pages.strip_running_lines(_page_rows(spark, d))
    return out.select("doc_id", F.col("page_no").cast("long").alias("page_no"), "text")


def first_match_page(spark, d):
    rows = _page_rows(spark, d)
    lines = F.get(F.split("text", "\n"), F.lit(1))
    titles = rows.select("doc_id", lines.alias("title"), F.greatest(F.lit(1), F.col("page_no") - 3).alias("start"), (F.col("page_no") + 3).alias("end"))
    return pages.first_match(titles, rows).select("doc_id", "title", F.col("page_no").cast("long").alias("page_no"))


def toc_json_parse(spark, d):
    docs = _table(spark, d, "documents")
    reply = F.concat(F.lit('```json\n[{"title": " '), "source", F.lit('", "declared_page": '), F.col("doc_id").cast("string"), F.lit('}, {"title": "", "declared_page": 3}, 7, {"title": "x", "declared_page": "no"}]\n```'))
    parsed = docs.select("doc_id", F.explode(pages.parse_toc_reply(reply)).alias("e"))
    return parsed.select("doc_id", F.col("e.title").alias("title"), F.col("e.declared_page").cast("long").alias("declared_page"))


def html_block_rows(spark, d):
    rows = _table(spark, d, "pages").select("page_id", html_blocks("html").alias("b"))
    return rows.select("page_id", F.posexplode("b.blocks").alias("pos", "text"))


def first_heading(spark, d):
    return _table(spark, d, "pages").select("page_id", html_blocks("html")["heading"].alias("heading"))


QUERIES = {
    f.__name__: f
    for f in (
        vector_topk, vector_batch_topk, vector_topk_filtered, vector_pairs_jvm, tokenize_terms, doc_length, term_df, corpus_stats,
        bm25_topk, bm25_topk_filtered, bm25_two_fields, rrf_hybrid, rrf_single_arm, rrf_three_arms, hybrid_cited, hybrid_expand,
        library_search, library_search_vector, library_search_filtered, library_report,
        chunk_documents, chunk_overlap_small, chunk_stats, pack_sections, sections_in_chapter, running_chapters, chapter_bounds,
        slugify_names, section_titles, approx_tokens, query_terms, content_hash, fake_embedding, clean_pages, toc_line_density, prompts,
        library_status, status_totals, book_listing, outline_nested, search_rows, pending_work, stage_batch, identity_resolution,
        idempotent_load, upsert_keep_summary, latest_wins, delete_book, reindex, header_footer_strip, first_match_page, toc_json_parse,
        html_block_rows, first_heading,
    )
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return sql.statements()
