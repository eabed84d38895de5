"""The registered queries as SQL (DuckDB's dialect)."""

from __future__ import annotations

from ..functions import text as T
from ..operators.chunking import SEPARATORS

BLANK = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{BLANK}+', ' ', 'g'))"


def _terms(x: str) -> str:
    old, new = T.accent_map()
    return rf"regexp_extract_all(translate(lower({x}), '{old}', '{new}'), '[\p{{L}}\p{{N}}]+')"


def _cosine(a: str, b: str) -> str:
    return f"list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def _vector(rows: str, asked: str, k: int) -> str:
    return f"""
    SELECT query_id, doc_id, rank, round(score, 9) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC NULLS LAST, doc_id) AS rank FROM (
        SELECT q.vec_id AS query_id, r.vec_id AS doc_id, {_cosine("r.embedding", "q.embedding")} AS score FROM ({rows}) r, (SELECT * FROM embeddings WHERE {asked}) q))
    WHERE rank <= {k}"""


def _bm25(rows: str, asked: str) -> str:
    """Common table expressions up to ``bm(query_id, doc_id, score)``."""
    return f"""
    d AS ({rows}), t AS (SELECT doc_id, {_terms("text")} AS w FROM d), p0 AS (SELECT doc_id, unnest(w) AS term FROM t),
    p AS (SELECT doc_id, term, count(*) AS tf FROM p0 GROUP BY ALL), l AS (SELECT doc_id, len(w) AS dl FROM t),
    st AS (SELECT count(*) AS n_docs, avg(dl) AS avg_dl FROM l), df AS (SELECT term, count(*) AS doc_freq FROM p GROUP BY term),
    q0 AS (SELECT item_id AS query_id, unnest({_terms("text")}) AS term FROM ({asked})), q AS (SELECT query_id, term, count(*) AS qn FROM q0 GROUP BY ALL),
    bm AS (SELECT query_id, p.doc_id, sum(qn * (CASE WHEN ln((n_docs - doc_freq + 0.5) / (doc_freq + 0.5)) > 0 THEN ln((n_docs - doc_freq + 0.5) / (doc_freq + 0.5)) ELSE 1e-6 END)
             * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))) AS score
           FROM q JOIN p USING (term) JOIN df USING (term) JOIN l ON l.doc_id = p.doc_id, st GROUP BY ALL)"""


def _top(name: str, k: int) -> str:
    return f"SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank, score FROM {name} QUALIFY rank <= {k}"


def _ranked_bm25(rows: str, asked: str, where: str = "true") -> str:
    return f"WITH {_bm25(rows, asked)}, f AS (SELECT * FROM bm WHERE doc_id IN (SELECT doc_id FROM d WHERE {where})), r AS ({_top('f', 5)}) SELECT query_id, doc_id, rank, round(score, 9) AS score FROM r"


_ROWS = "SELECT d.*, e.embedding FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id"
_ARMS = f"""
    {_bm25(_ROWS, "SELECT * FROM benchmark")}, k AS ({_top("bm", 50)}),
    v0 AS (SELECT q.vec_id AS query_id, d.doc_id, {_cosine("d.embedding", "q.embedding")} AS score FROM d, (SELECT * FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)) q), v AS ({_top("v0", 50)})"""


def _fused(arms: list[str]) -> str:
    union = " UNION ALL ".join("SELECT query_id, doc_id, " + ", ".join(f"{'rank' if i == j else 'NULL'} AS r{j}" for j in range(len(arms))) + f" FROM {a}" for i, a in enumerate(arms))
    ranks = [f"r{j}" for j in range(len(arms))]
    score = " + ".join(f"coalesce(1.0 / (60 + {r}), 0.0)" for r in ranks)
    order = ", ".join(f"{r} NULLS LAST" for r in ranks)
    return f"""u AS ({union}), g AS (SELECT query_id, doc_id, {", ".join(f"min({r}) AS {r}" for r in ranks)} FROM u GROUP BY query_id, doc_id),
    s AS (SELECT *, {score} AS score FROM g), won AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, {order}, doc_id) AS rank FROM s QUALIFY rank <= 5)"""


def _found(where: str = "true", arms: tuple[str, ...] = ("v", "k")) -> str:
    """Common table expressions up to ``hit``: fused results with what is shown of them."""
    named = f"""d0 AS ({_ROWS}), vf AS (SELECT * FROM v0 WHERE doc_id IN (SELECT doc_id FROM d0 WHERE {where})), bf AS (SELECT * FROM bm WHERE doc_id IN (SELECT doc_id FROM d0 WHERE {where})),
    v AS ({_top("vf", 50)}), k AS ({_top("bf", 50)})"""
    base = _ARMS.replace(f", k AS ({_top('bm', 50)})", "").replace(f", v AS ({_top('v0', 50)})", "")
    won = _fused(list(arms)) if len(arms) > 1 else "won AS (SELECT * FROM v WHERE rank <= 5)"
    return f"{base}, {named}, {won}, hit AS (SELECT query_id, rank, score, doc_id, source AS book_name, lang AS chapter_title, text AS raw_text FROM won JOIN d USING (doc_id))"


_ENGLISH = "lang = 'en'"
_HITS = "SELECT query_id, rank, round(score, 9) AS score, doc_id, book_name, chapter_title, raw_text FROM hit"
_WON = "SELECT query_id, doc_id, rank, round(score, 9) AS score FROM won"


def _chunks(size: int, overlap: int) -> str:
    most, carry = size * 4, overlap * 4
    out = f"SELECT doc_id, list_filter([{_strip('text')}], lambda x: x <> '') AS p FROM documents"
    for mark in SEPARATORS:
        m = "chr(10)" if mark == "\n" else "chr(10) || chr(10)" if mark == "\n\n" else f"'{mark}'"
        cut = f"list_filter(list_transform(string_split(x, {m}), lambda y, i: CASE WHEN i < len(string_split(x, {m})) THEN y || {m} ELSE y END), lambda y: y <> '')"
        out = f"SELECT doc_id, flatten(list_transform(p, lambda x: CASE WHEN length(x) <= {most} THEN [x] ELSE {cut} END)) AS p FROM ({out})"
    out = f"SELECT doc_id, flatten(list_transform(p, lambda x: CASE WHEN length(x) <= {most} THEN [x] ELSE list_transform(range(0, length(x), {most}), lambda i: substr(x, i + 1, {most})) END)) AS p FROM ({out})"
    state = "{'done': CAST([] AS VARCHAR[]), 'now': ''}"
    step = f"""{{'done': CASE WHEN length(s.now || y.now) <= {most} OR s.now = '' THEN s.done ELSE list_append(s.done, {_strip("s.now")}) END,
      'now': CASE WHEN length(s.now || y.now) <= {most} THEN s.now || y.now WHEN length(right(s.now, {carry}) || y.now) <= {most} THEN right(s.now, {carry}) || y.now ELSE y.now END}}"""
    folded = f"list_reduce(list_transform(p, lambda x: {{'done': CAST([] AS VARCHAR[]), 'now': x}}), lambda s, y: {step}, {state})"
    done = f"SELECT doc_id, CASE WHEN f.now = '' THEN f.done ELSE list_append(f.done, {_strip('f.now')}) END AS c FROM (SELECT doc_id, {folded} AS f FROM ({out}))"
    return f"SELECT doc_id, unnest(range(len(c))) AS chunk_index, unnest(c) AS raw_text FROM ({done})"


_PACKED = """
    WITH RECURSIVE o AS (SELECT conv_id, turn, text, length(text) + 2 AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
    w AS (SELECT conv_id, i, n AS used, 0 AS section_index FROM o WHERE i = 1
          UNION ALL SELECT o.conv_id, o.i, CASE WHEN w.used + o.n > 120 THEN o.n ELSE w.used + o.n END, CASE WHEN w.used + o.n > 120 THEN w.section_index + 1 ELSE w.section_index END
          FROM w JOIN o ON o.conv_id = w.conv_id AND o.i = w.i + 1),
    packed AS (SELECT conv_id, CAST(section_index AS BIGINT) AS section_index, string_agg(text, chr(10) || chr(10) ORDER BY i) AS text, min(turn) AS page_start FROM w JOIN o USING (conv_id, i) GROUP BY conv_id, section_index)"""

_STATES = """SELECT source, d.doc_id, CASE WHEN e.vec_id IS NOT NULL THEN 'embedded' WHEN l.doc_id IS NOT NULL THEN 'contextualized' ELSE 'pending' END AS status
    FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id"""
_COUNTS = "count(*) FILTER (status = 'pending') AS n_pending, count(*) FILTER (status = 'contextualized') AS n_contextualized, count(*) FILTER (status = 'embedded') AS n_embedded"
_TOKENS = "greatest(1, length(text) // 4)"
_TITLE = f"""CASE WHEN coalesce(title, '') <> '' THEN title WHEN rtrim(substr({_squeeze("text")}, 1, 60)) = '' THEN 'Section ' || (n + 1)
    ELSE 'Section ' || (n + 1) || ' -- ' || rtrim(substr({_squeeze("text")}, 1, 60)) || '...' END"""
_LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '')"

_CLEAN = r"""regexp_replace(replace(replace(regexp_replace(regexp_replace(text, '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g'), '\n{2,}', chr(1), 'g'), chr(10), ' '), chr(1), chr(10) || chr(10)), '[ \t]{2,}', ' ', 'g')"""


def statements() -> dict[str, str]:
    out = {
        "vector_topk": _vector("SELECT * FROM embeddings", "vec_id % 20 = 0", 10),
        "vector_batch_topk": _vector("SELECT * FROM embeddings", "vec_id IN (SELECT item_id FROM benchmark)", 5),
        "vector_pairs_jvm": _vector("SELECT * FROM embeddings", "vec_id % 20 = 0", 5),
        "vector_topk_filtered": _vector("SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src3')", "vec_id % 20 = 0", 5),
        "tokenize_terms": f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_terms('text')}) AS term FROM documents) GROUP BY ALL",
        "doc_length": f"SELECT doc_id, len({_terms('text')}) AS dl FROM documents",
        "term_df": f"SELECT term, count(DISTINCT doc_id) AS doc_freq FROM (SELECT doc_id, unnest({_terms('text')}) AS term FROM documents) GROUP BY term",
        "corpus_stats": f"SELECT count(*) AS n_docs, round(avg(len({_terms('text')})), 6) AS avg_dl FROM documents",
        "bm25_topk": _ranked_bm25("SELECT * FROM documents", "SELECT * FROM benchmark"),
        "bm25_topk_filtered": _ranked_bm25("SELECT * FROM documents", "SELECT * FROM benchmark", "lang = 'en'"),
        "bm25_two_fields": _ranked_bm25("SELECT doc_id, text || ' ' || concat_ws(' ', lang, source) AS text FROM documents", "SELECT item_id, text || ' src7 de' AS text FROM benchmark"),
        "rrf_hybrid": f"WITH {_ARMS}, {_fused(['v', 'k'])} {_WON}",
        "rrf_single_arm": f"WITH {_ARMS}, {_fused(['v'])} {_WON}",
        "rrf_three_arms": f"WITH {_ARMS}, n AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, doc_id) AS rank FROM d, (SELECT DISTINCT query_id FROM v) QUALIFY rank <= 50), {_fused(['v', 'k', 'n'])} {_WON}",
        "hybrid_cited": f"WITH {_ARMS}, {_fused(['v', 'k'])} SELECT query_id, rank, '[' || source || ' -- ' || lang || ', p.' || doc_id || '] (rank=' || rank || ')' || chr(10) || text AS citation FROM won JOIN d USING (doc_id)",
        "hybrid_expand": f"WITH {_ARMS}, {_fused(['v', 'k'])} SELECT query_id, doc_id, rank, c.section_text FROM won LEFT JOIN (SELECT conv_id, min(text) AS section_text FROM conversations WHERE turn = 0 GROUP BY 1) c ON c.conv_id = doc_id",
        "library_search": f"WITH {_found()} {_HITS}",
        "library_search_vector": f"WITH {_found(arms=('v',))} {_HITS}",
        "library_search_filtered": f"WITH {_found(_ENGLISH)} {_HITS}",
        "library_report": f"""WITH {_found()} SELECT query_id, string_agg('[' || book_name || ' -- ' || chapter_title || ', p.' || doc_id || '] (score=' || printf('%.3f', score) || ')' || chr(10) || raw_text,
            chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS report FROM hit GROUP BY query_id""",
        "chunk_documents": _chunks(600, 80),
        "chunk_overlap_small": _chunks(40, 8),
        "chunk_stats": f"SELECT doc_id, count(*) AS n_chunks, max(length(raw_text)) AS longest, CAST(sum(length(raw_text)) AS BIGINT) AS total FROM ({_chunks(600, 80)}) GROUP BY doc_id",
        "pack_sections": f"{_PACKED} SELECT * FROM packed",
        "sections_in_chapter": f"{_PACKED} SELECT conv_id, count(*) AS n_sections, max(length(text)) AS longest FROM packed GROUP BY conv_id",
        "running_chapters": "SELECT conv_id, turn, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS chapter_index FROM conversations",
        "chapter_bounds": """WITH c AS (SELECT conv_id AS doc_id, max(turn) AS n FROM conversations GROUP BY 1),
            h AS (SELECT conv_id AS doc_id, role AS title, turn AS page, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS chapter_index FROM conversations WHERE role = 'user')
            SELECT doc_id, chapter_index, title, greatest(1, page) AS page_start, greatest(greatest(1, page), least(coalesce(nxt - 1, n), n)) AS page_end FROM h JOIN c USING (doc_id)""",
        "slugify_names": "SELECT c_custkey, coalesce(nullif(regexp_replace(regexp_replace(lower(c_name || ' & ' || c_mktsegment), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'book') AS slug FROM customer",
        "section_titles": f"SELECT doc_id, {_TITLE} AS title FROM (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN source END AS title, doc_id % 7 AS n FROM documents)",
        "approx_tokens": f"SELECT doc_id, {_TOKENS} AS tokens FROM documents",
        "query_terms": r"SELECT item_id, unnest(range(len(w))) AS pos, unnest(w) AS term FROM (SELECT item_id, regexp_extract_all(text, '[\p{L}\p{N}\p{M}_]+') AS w FROM benchmark)",
        "content_hash": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
        "fake_embedding": "SELECT item_id, i, round(CAST(CAST(CAST('0x' || substr(sha256(text), CAST(2 * i + 1 AS INT), 2) AS INT) / 127.5 - 1.0 AS FLOAT) AS DOUBLE), 6) AS x FROM benchmark, range(4) t(i)",
        "clean_pages": f"SELECT doc_id, {_strip(_CLEAN)} AS text FROM documents",
        "toc_line_density": rf"""SELECT doc_id, round(coalesce(len(list_filter(ln, lambda x: regexp_matches(x, '^.{{3,}}?[^0-9][\s.…]+[0-9]{{1,4}}\s*$'))) / nullif(len(ln), 0), 0), 9) AS density,
            len(list_filter(ln, lambda x: regexp_matches(x, '(?i)^\s*(?:table of contents|contents)\s*$'))) > 0 AS has_header,
            len(list_filter(ln, lambda x: regexp_matches(x, '(?i)^\s*(?:part\s+[ivxlcdm0-9]+|chapter\s+[0-9]+|appendix\s+[a-z])\b'))) AS top_level FROM (SELECT doc_id, {_LINES} AS ln FROM documents)""",
        "prompts": "SELECT d.doc_id, 'The section in short: ' || coalesce('quality ' || q, '(no summary available)') || chr(10) || chr(10) || 'Passage:' || chr(10) || text || chr(10) || chr(10) || 'Say where in the section this passage stands.' AS prompt FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) l USING (doc_id)",
        "library_status": f"SELECT source, {_COUNTS} FROM ({_STATES}) GROUP BY source",
        "status_totals": f"SELECT {_COUNTS} FROM ({_STATES})",
        "book_listing": "SELECT source, count(*) AS n_chapters, count(DISTINCT lang) AS n_langs, CAST(sum(n_chars) AS BIGINT) AS n_chars, min(doc_id) AS first_id FROM documents GROUP BY source",
        "outline_nested": f"SELECT book_id, chapter_index, n AS section_index, {_TITLE} AS title, {_TOKENS} AS approx_tokens FROM (SELECT CAST(substr(source, 4) AS BIGINT) AS book_id, lang AS chapter_index, doc_id AS n, NULL::VARCHAR AS title, text FROM documents)",
        "search_rows": f"SELECT doc_id, source, lang, chapter_title FROM ({_ROWS}) JOIN (SELECT conv_id, min(role) AS chapter_title FROM conversations WHERE turn = 0 GROUP BY 1) ON conv_id = doc_id",
        "pending_work": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
        "stage_batch": f"SELECT doc_id, source, status FROM ({_STATES}) WHERE status = 'pending' ORDER BY doc_id LIMIT 16",
        "identity_resolution": """WITH n AS (SELECT doc_id, source || '-' || (doc_id % 500) AS slug, sha256(text) AS h FROM documents),
            a AS (SELECT slug, min(h) AS h FROM n WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY slug)
            SELECT n.doc_id, n.slug, CASE WHEN a.h IS NULL THEN 'insert' WHEN a.h = n.h THEN 'keep' ELSE 'conflict' END AS action FROM n LEFT JOIN a USING (slug)""",
        "idempotent_load": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
        "upsert_keep_summary": """WITH o AS (SELECT doc_id, CAST(max(quality) AS VARCHAR) AS summary FROM labels GROUP BY 1)
            SELECT d.doc_id, o.summary, d.source AS title FROM documents d LEFT JOIN o USING (doc_id)
            UNION ALL SELECT doc_id, summary, 'old' FROM o WHERE doc_id NOT IN (SELECT doc_id FROM documents)""",
        "latest_wins": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
        "delete_book": "SELECT doc_id, source FROM documents WHERE source <> 'src4' OR source IS NULL",
        "reindex": f"WITH p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_terms('text')}) AS term FROM ({_ROWS})) GROUP BY ALL) SELECT doc_id, count(*) AS n_terms, CAST(sum(tf) AS BIGINT) AS n_tokens FROM p GROUP BY doc_id",
        "toc_json_parse": "SELECT doc_id, source AS title, doc_id AS declared_page FROM documents",
    }
    return out
