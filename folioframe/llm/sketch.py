"""Document fingerprints as threshold-scaled sketches of five-word shingles.

Every shingle hash below a fixed fraction of the hash range is kept, and no
other, so that sketches of any two texts are samples by the same rule: their
overlap estimates containment however unequal the texts are, and the sketch of
a union is the union of sketches. Beside it stand the number of shingles and a
digest of them all, which tell texts apart that are too short to have a hash
below the fraction; such texts are like equal ones alone.

Edge cases: null counts as empty; texts of fewer than five words are one
shingle; two texts without words are alike (1), one of them and another are
not (0); documents of equal id follow each other by text; a null id comes last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, saved, shingle_hashes, table, words

SHINGLE, SCALE = 5, 4
_LOWEST = -(1 << 63)
#: Ranges of text hashes that rows without an id are dealt to, by the top bits of the hash.
_NULL_BITS = 8


def sketch(text: Column, size: int = SHINGLE, scale: int = SCALE) -> Column:
    """``(n, digest, kept)``: how many shingles, a hash of them in order, the kept hashes, distinct and in order."""
    limit = F.lit(_LOWEST + (1 << 64) // scale)
    hashes = shingle_hashes(F.transform(words(text), lambda w: F.xxhash64(w)), size)
    return let(hashes, lambda a: F.struct(F.size(a).alias("n"), F.xxhash64(a).alias("digest"), F.sort_array(F.array_distinct(F.filter(a, lambda h: h < limit))).alias("kept")))


def fingerprint(s: Column) -> Column:
    """A sketch as text: the number of shingles, then the kept hashes in hexadecimal, or the digest where none is kept."""
    kept = F.array_join(F.transform(s["kept"], lambda h: F.lower(F.hex(h))), ",")
    return F.concat(s["n"].cast("string"), F.lit(":"), F.when((F.size(s["kept"]) == 0) & (s["n"] > 0), F.concat(F.lit("="), F.lower(F.hex(s["digest"])))).otherwise(kept))


def containment(a: Column, b: Column) -> Column:
    """The share of the smaller sketch that the larger one contains; where one is empty, whether the shingles are the same."""
    least = F.least(F.size(a["kept"]), F.size(b["kept"]))
    share = F.size(F.array_intersect(a["kept"], b["kept"])) / F.greatest(least, F.lit(1)).cast("double")
    return F.when(least > 0, share).otherwise(((a["n"] == b["n"]) & (a["digest"] == b["digest"])).cast("double"))


def merge(a: Column, b: Column) -> Column:
    """The kept hashes of two texts' shingles together, from those of each."""
    return F.sort_array(F.array_union(a, b))


def _bucket(id_col: Column, bounds: list[int]) -> Column:
    """Which range of ids, highest first, by binary search over ``bounds`` (ascending); null ids go to the last."""
    if not bounds:
        return F.lit(0)
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))

    def search(edges: Column) -> Column:
        def step(s: Column, _: Column) -> Column:
            mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
            up = (s["lo"] < s["hi"]) & (F.get(edges, mid) <= id_col)
            return F.struct(F.when(up, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(up, s["hi"]).otherwise(F.least(mid, s["hi"])).alias("hi"))

        return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")), step, lambda s: s["lo"])

    found = let(F.lit(bounds).cast("array<bigint>"), search)
    return F.lit(len(bounds)) - F.coalesce(found, F.lit(0))


def with_next(docs: DataFrame, id_col: str, text_col: str, derive, carry: list[str], spread: int = 4) -> DataFrame:
    """``derive(docs)`` with ``next_<c>``: the values of the following row in descending id order; the first row follows the last.

    Rows are dealt by id ranges (quantiles of the ids), rows without an id by
    ranges of their text's hash, so that only the range edges look outside their
    own range. There is one edge row per range; it is found by its id alone, and
    what ``derive`` adds is made for edge rows and for each row once.
    """
    parts = spread * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = [k / parts for k in range(1, parts)]
    bounds = sorted(set(docs.select(id_col).dropna().stat.approxQuantile(id_col, share, 0.25 / parts))) if share else []
    by_text = F.xxhash64(text_col)
    unnamed = F.lit(len(bounds) + 1 + (1 << _NULL_BITS - 1)) + F.shiftright(by_text, 64 - _NULL_BITS).cast("int")
    bucket = F.when(F.col(id_col).isNull(), unnamed).otherwise(_bucket(F.col(id_col), [int(x) for x in bounds]))
    dealt = docs.withColumn("_bucket", bucket)
    here = Window.partitionBy("_bucket").orderBy(F.col(id_col).desc_nulls_last(), by_text)
    top = F.broadcast(saved(dealt.groupBy("_bucket").agg(F.max(id_col).alias("_top")), "tops"))  # one row for each range
    at_top = dealt.join(top, "_bucket").where(F.col(id_col).eqNullSafe(F.col("_top"))).drop("_top")
    lowest = saved(at_top.groupBy("_bucket").agg(F.min(by_text).alias("_least")), "tops")
    heads = derive(at_top.join(F.broadcast(lowest), "_bucket").where(by_text == F.col("_least")).dropDuplicates(["_bucket"]))
    heads = saved(heads.select("_bucket", *carry), "heads")
    ring = Window.orderBy("_bucket")  # over one row for each range
    follows = heads.select("_bucket", F.coalesce(F.lead("_bucket").over(ring), F.min("_bucket").over(Window.partitionBy())).alias("_then"))
    after = follows.join(heads.select(F.col("_bucket").alias("_then"), *[F.col(c).alias(f"_edge_{c}") for c in carry]), "_then").drop("_then")
    led = derive(dealt).withColumn("_more", F.lead(F.lit(True)).over(here)).withColumns({f"_lead_{c}": F.lead(c).over(here) for c in carry})
    out = led.join(after.hint("merge"), "_bucket", "left")
    out = out.withColumns({f"next_{c}": F.when(F.col("_more"), F.col(f"_lead_{c}")).otherwise(F.col(f"_edge_{c}")) for c in carry})
    return out.drop("_bucket", "_more", *[f"_lead_{c}" for c in carry], *[f"_edge_{c}" for c in carry])


def op4_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs, "doc_id", "text", lambda d: d.withColumn("sketch", sketch(F.col("text"))), ["text", "sketch"])
    n = F.length("text").cast("long")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (n - cut).cast("int")), F.substring("next_text", F.lit(1), cut))
    rows = rows.withColumn("n_chars", n).withColumn("edited", edited).drop("text", "next_text").withColumn("edited_sketch", sketch(F.col("edited")))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sketch")).alias("fingerprint"), fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        containment(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
