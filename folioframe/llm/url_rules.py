"""URL filtering by given rules and by association rules mined from labels.

FP-growth mines frequent combinations of URL tokens together with the label.
Combinations that are frequent enough, and bad with enough confidence (the
lower Wilson bound counts, so that small tables do not make chance rules),
become rules. Each rule is filed under its rarest token; a URL looks up its
own tokens, and the few rules found are held against all of them. The surest
rule decides; its support and confidence stand beside the verdict.

Edge cases: a null URL, or one without ``://``, has an empty host and path and
fits no rule; given rules of equal length: the one with the longer host; URLs
are judged once however often they occur; no labels: nothing is mined and what
no given rule judges is allowed; columns of the input other than the id and
the URL are not looked at.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, table

#: Given rules of the registered query: (verdict, rule); a rule is a host and the path's beginning.
GIVEN = (("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("allow", "example.net/de/8"), ("block", "org/es/"))
MIN_SUPPORT, MIN_CONFIDENCE, Z = 0.004, 0.5, 1.96
BAD = "=bad"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FORM = r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _FORM, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _FORM, 2), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Host labels and their hyphen parts, path segments and query keys; digits become one ``0``."""
    labels = F.split(host_of(url), r"\.")
    hyphened = F.filter(labels, lambda x: x.contains("-"))
    parts = F.filter(F.flatten(F.transform(hyphened, lambda x: F.split(x, "-"))), lambda x: x != "")
    segments = F.transform(F.split(path_of(url), r"[/.]"), lambda x: F.regexp_replace(x, "[0-9]+", "0"))
    keys = F.transform(F.regexp_extract_all(F.regexp_extract(url, _FORM, 3), F.lit(r"[?&]([^=&#]+)"), 1), lambda x: F.concat(F.lit("?"), x))
    every = F.concat(
        F.transform(F.filter(labels, lambda x: x != ""), lambda x: F.concat(F.lit("."), x)),
        F.transform(parts, lambda x: F.concat(F.lit("-"), x)),
        F.transform(F.filter(segments, lambda x: (x != "") & (x != "0")), lambda x: F.concat(F.lit("/"), x)),
        keys,
    )
    return F.array_distinct(F.coalesce(every, F.array().cast("array<string>")))


def given_rule(host: Column, path: Column, rules=GIVEN) -> tuple[Column, Column]:
    """(rule, verdict) of the longest given rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for judged, text in sorted(rules, key=lambda r: (len(r[1]), r[1].find("/"))):  # the last one tried comes first
        of, begins = text.split("/", 1)
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(f"/{begins}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(judged)).otherwise(verdict)
    return rule, verdict


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules ``(items, support, confidence, key)`` from ``(url, bad)``; ``key`` is the rule's rarest token."""
    baskets = labelled.where("url is not null and bad is not null").select(
        F.concat(tokens_of(F.col("url")), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items")
    )
    baskets = saved(baskets, "url-baskets")
    n = baskets.count()
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=1.0).fit(baskets)
    sets = saved(model.freqItemsets.select(F.sort_array("items").alias("items"), "freq"), "url-sets")  # else each use mines again
    whole = sets.where(~F.array_contains("items", BAD))
    bad = sets.where(F.array_contains("items", BAD) & (F.size("items") > 1)).select(F.array_remove("items", BAD).alias("items"), F.col("freq").alias("hits"))
    p = F.col("hits") / F.col("freq")
    spread = Z * F.sqrt(p * (1 - p) / F.col("freq") + F.lit(Z * Z / 4) / (F.col("freq") * F.col("freq")))
    lower = (p + F.lit(Z * Z / 2) / F.col("freq") - spread) / (1 + F.lit(Z * Z) / F.col("freq"))
    rules = bad.join(whole, "items").where(lower >= min_confidence).select("items", (F.col("hits") / F.lit(float(max(n, 1)))).alias("support"), p.alias("confidence"))
    rules = saved(rules.withColumn("_rule", F.xxhash64("items")), "url-rules")
    single = whole.where(F.size("items") == 1).select(F.get("items", F.lit(0)).alias("token"), "freq")
    rarest = rules.select("_rule", F.explode("items").alias("token")).join(single, "token").groupBy("_rule").agg(F.min(F.struct("freq", "token"))["token"].alias("key"))
    return saved(rules.join(rarest, "_rule").drop("_rule"), "url-index")


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``(url, mined_rule, confidence, support)``: for each distinct URL that some rule fits, the surest rule; of equal ones the commoner, then the last by name."""
    own = urls.where("url is not null").select("url").distinct().withColumn("_tokens", tokens_of(F.col("url")))
    looked = own.select("url", "_tokens", F.explode("_tokens").alias("key")).join(rules, "key")
    fits = looked.where(F.size(F.array_except("items", "_tokens")) == 0)
    best = F.max(F.struct("confidence", "support", F.array_join("items", " ").alias("rule")))
    return fits.groupBy("url").agg(best.alias("b")).select("url", F.col("b.rule").alias("mined_rule"), F.col("b.confidence").alias("confidence"), F.col("b.support").alias("support"))


def judged(pages: DataFrame, labelled: DataFrame, rules=GIVEN, **options) -> DataFrame:
    """``(page_id, host, path, rule, verdict, mined_rule, confidence, support)`` for every page."""
    found = matches(pages, mine(labelled, **options))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = given_rule(F.col("host"), F.col("path"), rules)
    out = pages.select("page_id", "url").join(found, "url", "left").withColumns({"host": host, "path": path})
    by_method = F.when(F.col("mined_rule").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"), "mined_rule", "confidence", "support")


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """URLs with the label of the document that their path names: bad if of low quality or toxic."""
    named = pages.select("url", F.expr(r"try_cast(regexp_extract(url, '/([0-9]{1,18})(?:[/.?#]|$)', 1) AS bigint)").alias("doc_id"))
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    return named.where("doc_id is not null").join(labels.select("doc_id", bad.alias("bad")), "doc_id").select("url", "bad")


def op1_url_filters(spark, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages, labelled_urls(pages, table(spark, sf_dir, "labels")))
