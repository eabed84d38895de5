"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger stores the measurements
and one long whose bits say which rules failed; policies are masks over these
bits, so that a new policy, or the effect of leaving a rule out, needs no text.

Edge cases: a null or empty text has no words, fails ``few_words`` and no
ratio rule; repeated rows are judged alike; a column of the input whose name
the ledger uses is replaced by the ledger's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, table, words

WINDOW = 8

#: Name of each rule in bit order; the condition under which it fails, over the measurements, all in whole numbers.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 25 * n_words",
    "shouting": "100 * n_upper > 60 * n_letters",
    "few_letters": "100 * n_letters < 40 * word_chars",
    "exclamations": "100 * n_exclaims > 30 * n_words",
}

#: Policies by version: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "repeated_lines", "short_words", "long_words"),
    "v2": tuple(RULES),
}


def mask_of(names) -> int:
    order = list(RULES)
    return sum(1 << order.index(name) for name in names)


def repeated_window_words(tokens: Column, window: int = WINDOW) -> Column:
    """How many words lie in ``window``-word windows that occur twice or more in the text."""
    hashes = F.transform(tokens, lambda w: F.xxhash64(w))
    grams = let(hashes, lambda a: F.transform(F.sequence(F.lit(1), F.size(a) - (window - 1)), lambda i: F.xxhash64(F.slice(a, i, window))))

    def covered(g: Column) -> Column:
        ordered = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        no = F.lit(False)
        twice = let(
            ordered,
            lambda p: F.filter(
                p,
                lambda x, i: F.when(i > 0, F.get(p, i - 1)["h"] == x["h"]).otherwise(no) | F.coalesce(F.get(p, i + 1)["h"] == x["h"], no),
            ),
        )
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        begin = F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last"))
        return F.aggregate(
            starts,
            begin,
            lambda s, at: F.struct((s["n"] + F.least(F.lit(window), at - s["last"])).alias("n"), at.alias("last")),
            lambda s: s["n"],
        )

    counted = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))
    return F.when(F.size(tokens) > window, counted).otherwise(F.lit(0)).cast("long")


def _left(text: Column, pattern: str) -> Column:
    """Characters left once every match of ``pattern`` is gone."""
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the measurements and ``fail_bits``; one narrow pass over the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    measured = F.struct(
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        _left(text, "[^#*$%&|<>]+").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))).alias("lines"),
        repeated_window_words(F.col("_words")).alias("n_repeat_words"),
        _left(text, r"\P{L}+").alias("n_letters"),
        _left(text, r"\P{Lu}+").alias("n_upper"),
        _left(text, "[^!]+").alias("n_exclaims"),
    )
    flat = {k: F.col(f"_m.{k}") for k in ("n_words", "word_chars", "n_symbols", "n_repeat_words", "n_letters", "n_upper", "n_exclaims")}
    flat["n_lines"] = F.col("_m.lines.n").cast("long")
    flat["n_dup_lines"] = (F.col("_m.lines.n") - F.col("_m.lines.d")).cast("long")
    bits = " + ".join(f"(CASE WHEN {failed} THEN {1 << k}L ELSE 0L END)" for k, failed in enumerate(RULES.values()))
    return (
        docs.withColumn("_words", words(F.col(text_col)))
        .withColumn("_m", measured)
        .drop("_words")
        .withColumns(flat)
        .drop("_m")
        .withColumn("fail_bits", F.expr(bits))
    )


def apply_policies(entries: DataFrame, policies: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """A boolean ``kept_<version>`` for each policy, from the stored bits alone."""
    policies = POLICIES if policies is None else policies
    return entries.withColumns({f"kept_{v}": F.col("fail_bits").bitwiseAND(F.lit(mask_of(names))) == 0 for v, names in policies.items()})


def ablations(entries: DataFrame, policies: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """By policy and rule: documents that fail the rule, and those that only this rule rejects."""
    policies = POLICIES if policies is None else policies
    sums, rows = [F.count(F.lit(1)).alias("n")], []
    for v, names in policies.items():
        for name in names:
            hit = F.col("fail_bits").bitwiseAND(F.lit(mask_of(names)))
            sums += [
                F.count_if(hit.bitwiseAND(F.lit(mask_of([name]))) != 0).alias(f"{v}__{name}__failed"),
                F.count_if(hit == mask_of([name])).alias(f"{v}__{name}__only"),
            ]
            rows.append(F.struct(F.lit(v).alias("policy"), F.lit(name).alias("rule"), F.col(f"{v}__{name}__failed").alias("failed"), F.col(f"{v}__{name}__only").alias("only")))
    return entries.agg(*sums).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Measurements, base verdict and final verdict (policy v2) for every document."""
    judged = apply_policies(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~F.col("kept_base")).alias("base_failed"), F.col("kept_v2").alias("kept"), "fail_bits",
    )


_SQL_RULES = " + ".join(f"(CASE WHEN {failed} THEN {1 << k} ELSE 0 END)" for k, failed in enumerate(RULES.values()))

ORACLE = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln
  FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM t WHERE len(w) >= 8),
h AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS s FROM g),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM h) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM d) GROUP BY doc_id),
m AS (
  SELECT t.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(ln)::BIGINT AS n_lines, (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(text, '\P{{L}}', '', 'g'))::BIGINT AS n_letters,
         length(regexp_replace(text, '\P{{Lu}}', '', 'g'))::BIGINT AS n_upper,
         length(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_exclaims
  FROM t LEFT JOIN r USING (doc_id)),
b AS (SELECT *, ({_SQL_RULES})::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & {mask_of(POLICIES["base"])}) <> 0 AS base_failed, (fail_bits & {mask_of(POLICIES["v2"])}) = 0 AS kept, fail_bits
FROM b
"""
