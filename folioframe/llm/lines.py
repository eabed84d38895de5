"""Fuzzy line deduplication: SimHash, pigeonhole blocks, edit similarity, connected groups.

Lines are normalised (lower case, single spaces). Equal ones are one line,
whatever their length. Lines of an edit similarity of ``SIMILARITY`` or more
over words differ in few words, but a SimHash of the whole line spreads each
changed word over all of its bits, so that few blocks of it stay alike. The
words are therefore dealt to parts first: they are put in an order that every
line shares (long ones tend to come first, for they are rare; hashes decide),
and every run of three among the first ``TOP`` is a part. The SimHashes of the
parts are the blocks of the line's fingerprint. A changed word touches the
blocks of its own parts alone, so that by pigeonhole some block stays equal;
lines that agree on a block are candidates. Lines of up to ``PAIRED`` words
have parts of two words.

Within a block all lines are held against its two ends, and then only against
those that these links have not connected with them. If that leaves many, the
block is divided by the words that are rarest in it: lines that are alike share
one of the first quarter of their words, whatever order all lines have in common
(prefix filtering, which loses none). Repeated words of a line are numbered; the
order is by counts of a sample of the lines, so that the sample decides how many
lines meet, not which are linked. A pair meets at its first common word alone,
and stays a pair if neither line misses more of the other's words than edits are
allowed.
Links of lines whose edit similarity reaches ``SIMILARITY`` join them into
groups; a group keeps the occurrence of the smallest document id, the first
one there.

Words are told apart by 31 bits of a hash and lines by 64.

Edge cases: empty lines are never removed; lines of fewer than five words only
match equal ones (0.8 allows no edit there); null text has no lines and stays
null; a text that loses all its lines becomes empty; rows that repeat both id
and text share one fate; null ids come after all others; columns of the input
are kept as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import OPEN, crossing, ends, fitting
from .common import discard, let, looked_up, saved, small_side, table
from .components import components

SIMILARITY = 0.8
#: Words that enter parts; longest line with parts of two words, and how many of its words enter them.
TOP, PAIRED, PAIRED_TOP = 11, 12, 8
_WORD, _LENGTH = 0x7FFFFFFF, 1023
#: Hashes are not worth encoding or compressing.
RANDOM = {"parquet.enable.dictionary": "false", "compression": "none"}
#: Lines whose words are counted for the common order of divided blocks, the places that count them, and repeats of a word that are told apart.
SAMPLE, PLACES, REPEATS = 512, 1 << 14, 8
#: Code points that a word can stand for in Levenshtein.
_PLANE = 1 << 20


def _line_words(line: Column) -> Column:
    words = F.split(line, " ", -1)
    loose = F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    return F.when(loose, F.array_remove(words, "")).otherwise(words)


def _normalised(text: Column) -> Column:
    """Lower case, and one kind of blank; single-character replacements are cheaper than a pattern."""
    text = F.lower(text)
    for blank in "\t\x0b\f\r":
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return text


def _rank(word: Column) -> Column:
    """The place of a word in the common order: a hash, halved for every letter, so that long words tend to come first."""
    return F.call_function("shiftrightunsigned", F.xxhash64(word), F.length(word).bitwiseAND(F.lit(31)))


def _least(similarity: float) -> int:
    """Words of the shortest line that may differ from another."""
    return math.ceil(1 / (1 - similarity) - 1e-9)


def _at(n: Column) -> Column:
    """An occurrence: a hash of its place, with the length of the line (1,023 at most) in its last bits."""
    return F.xxhash64("_doc", "_pos").bitwiseAND(F.lit(~_LENGTH)).bitwiseOR(F.least(n, F.lit(_LENGTH)).cast("long"))


def _fits(similarity: float):
    """Whether the lengths of two occurrences allow the similarity at all."""

    def compared(a: Column, b: Column) -> Column:
        x, y = a.bitwiseAND(F.lit(_LENGTH)), b.bitwiseAND(F.lit(_LENGTH))
        return F.abs(x - y) <= F.floor(F.greatest(x, y) * F.lit(1 - similarity) + F.lit(1e-9))

    return compared


def _lines(docs: DataFrame, text_col: str, similarity: float) -> DataFrame:
    """``_id, _doc, _pos, _at, line, blocks`` of each line with words; no blocks where no edit is allowed."""
    rows = docs.select("_id", "_doc", F.posexplode(F.split(_normalised(F.col(text_col)), "\n", -1)).alias("_pos", "_line")).where(F.trim("_line") != "")
    rows = rows.select("_id", "_doc", "_pos", _line_words(F.col("_line")).alias("_w"))
    rows = rows.select("_id", "_doc", "_pos", F.size("_w").alias("n"), F.xxhash64("_w").alias("line"), F.transform("_w", _rank).alias("_v"))
    rows = rows.select("_id", "_doc", "_pos", "n", "line", F.slice(F.array_distinct(F.sort_array("_v")), 1, TOP).alias("_top"))
    return rows.select("_id", "_doc", "_pos", _at(F.col("n")).alias("_at"), "line", blocks(F.col("_top"), F.col("n"), similarity).alias("blocks"))


def part_simhash(*hashes: Column) -> Column:
    """The SimHash of a part of up to three words: each bit that is set in over half of the hashes."""
    if len(hashes) == 1:
        return hashes[0]
    if len(hashes) == 2:
        return hashes[0].bitwiseAND(hashes[1])
    a, b, c = hashes
    return a.bitwiseAND(b).bitwiseOR(c.bitwiseAND(a.bitwiseOR(b)))


def blocks(top: Column, n: Column, similarity: float = SIMILARITY) -> Column:
    """The blocks of a line's fingerprint: the SimHash of each part."""
    none = F.array().cast("array<bigint>")

    def runs(size: int, most: int) -> Column:
        # A line all of whose words are there is a ring, so that each word is in as many parts.
        first = F.slice(top, 1, most) if most < TOP else top
        ring = F.when(F.size(top) < most, F.concat(first, F.slice(first, 1, size - 1))).otherwise(first)

        def part(r: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), F.size(r) - size), lambda i: part_simhash(*[F.get(r, i + k) for k in range(size)]))

        return let(ring, lambda r: F.when(F.size(r) >= size, part(r)).otherwise(none))

    threes = F.when(n >= math.ceil((PAIRED + 1) * similarity - 1e-9), runs(3, TOP)).otherwise(none)
    # Lines of few words, or of few different ones, in which each of these is a part as well.
    short = F.array_distinct(F.concat(threes, F.when(n <= PAIRED, runs(2, PAIRED_TOP)).otherwise(none), F.when(F.size(top) < 4, top).otherwise(none)))
    return F.when(n < _least(similarity), none).when((n <= PAIRED) | (F.size(top) < 4), short).otherwise(threes)


def _coded(words: Column) -> Column:
    """The words of a line as one character each, so that Levenshtein counts words."""
    code = F.transform(words, lambda w: F.lpad(F.hex(F.pmod(w, F.lit(_PLANE)) + 0x10000), 8, "0"))
    return F.decode(F.unhex(F.array_join(code, "")), "UTF-32")


def _most(n_a: Column, n_b: Column, similarity: float) -> Column:
    """The edits that lines of these lengths may have."""
    return F.floor(F.greatest(n_a, n_b) * F.lit(1 - similarity) + F.lit(1e-9)).cast("int")


def _marks(words: Column) -> list[Column]:
    """``n`` and twice two longs: the parity of the words, by 7 bits of their hashes, and that of the pairs of neighbours.

    An edit changes two of the 128 bits of words at most, and four of those of pairs.
    """
    zero = F.struct(F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q"))

    def flipped(s: Column, w: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), w.bitwiseAND(F.lit(63)))
        low = w.bitwiseAND(F.lit(64)) == 0
        return F.struct(F.when(low, s["p"].bitwiseXOR(bit)).otherwise(s["p"]).alias("p"), F.when(low, s["q"]).otherwise(s["q"].bitwiseXOR(bit)).alias("q"))

    pairs = F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda x, y: F.shiftright(x, 7).bitwiseXOR(y))
    return [F.size(words).alias("n"), F.aggregate(words, zero, flipped).alias("parity"), F.aggregate(pairs, zero, flipped).alias("order")]


def _near(similarity: float):
    """Whether lengths and parities of two lines allow the similarity; no link is lost. Words in another order fail by their pairs."""

    def compared(left, right) -> Column:
        most = _most(left("n"), right("n"), similarity)
        flips = F.bit_count(left("p").bitwiseXOR(right("p"))) + F.bit_count(left("q").bitwiseXOR(right("q")))
        turns = F.bit_count(left("r").bitwiseXOR(right("r"))) + F.bit_count(left("s").bitwiseXOR(right("s")))
        return (F.abs(left("n") - right("n")) <= most) & (flips <= most * 2) & (turns <= most * 4)

    return compared


def _joined(pairs: DataFrame, words: DataFrame, *columns: str) -> DataFrame:
    for side in "ab":
        pairs = pairs.join(words.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
    return pairs


def _verified(pairs: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose edit similarity over words is high enough.

    Lines of one length that differ in few places are decided at once. Of the
    others, pairs in which a line misses more words of the other than edits are
    allowed go; the rest is coded for Levenshtein. Codes are narrower than words;
    where two words of a pair share one, the pair is coded by the places of its
    words instead.
    """
    both = _joined(pairs, words, "words")
    a, b, most = F.col("words_a"), F.col("words_b"), F.col("_most")
    both = both.withColumn("_most", _most(F.size(a), F.size(b), similarity))
    changed = F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda x: x))
    at_once = (F.size(a) == F.size(b)) & (changed <= most)
    missing = (F.size(F.array_except(a, b)) <= most) & (F.size(F.array_except(b, a)) <= most)
    levenshtein = lambda x, y: F.call_function("levenshtein", x, y, most) >= 0
    narrow = lambda c: F.transform(c, lambda x: F.pmod(x, F.lit(_PLANE)))
    alone = let(F.array_distinct(F.concat(a, b)), lambda w: F.size(w) == F.size(F.array_distinct(narrow(w))))
    placed = let(F.array_distinct(F.concat(a, b)), lambda d: F.struct(*[_coded(F.transform(w, lambda x: F.array_position(d, x).cast("int"))).alias(s) for s, w in (("a", a), ("b", b))]))
    coded = F.when(alone, levenshtein(_coded(a), _coded(b))).otherwise(let(placed, lambda p: levenshtein(p["a"], p["b"])))
    return both.where(F.when(at_once, F.lit(True)).when(missing, coded).otherwise(F.lit(False))).select("a", "b")


def _numbered(words: Column) -> Column:
    """The words of a line, each with the number of equal ones before it, by 32 bits of a hash; an edit changes one of them."""
    again = lambda s, x, i: sum((F.get(s, i - k).eqNullSafe(x).cast("int") for k in range(1, REPEATS)), F.lit(0))
    return F.array_distinct(let(F.sort_array(words), lambda s: F.transform(s, lambda x, i: F.hash(x, again(s, x, i)))))


def _place(part: Column) -> Column:
    return F.pmod(part, F.lit(PLACES))


def _divided(large: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """Lines of large blocks under finer keys: the first of their words, those that are rare among such lines first.

    A line misses as many of another's words as edits are allowed at most: a
    quarter of its own words, if 0.8 of the longer one's have to be the same.
    """
    nodes = saved(large.drop("key", "main", "rest", "many").distinct(), "line-large")
    own = saved(words.join(small_side(nodes.select("node")), "node", "left_semi").select("node", _numbered(F.col("words")).alias("parts")), "line-numbered")
    some = own.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select(F.explode("parts").alias("part"))
    counted = {r.place: r["count"] for r in some.groupBy(_place(F.col("part")).alias("place")).count().collect()}  # PLACES rows at most
    counts = ",".join(str(counted.get(k, 0)) for k in range(PLACES))
    order = own.sparkSession.range(1).select(F.split(F.lit(counts), ",").cast("array<int>").alias("counts"))
    told = own.crossJoin(F.broadcast(order))
    ranked = F.sort_array(F.transform("parts", lambda x: F.struct(F.get("counts", _place(x)).alias("c"), x.alias("x"))))
    told = told.select("node", F.transform(ranked, lambda y: y["x"]).alias("parts")).join(nodes, "node")
    first = F.slice("parts", F.lit(1), (F.floor(F.col("n") * ((1 - similarity) / similarity) + 1e-9) + 1).cast("int"))
    rows = told.withColumn("first", first)
    return saved(rows.withColumn("key", F.explode("first")).withColumn("at", F.col("key")), "line-divided")


def _close(similarity: float):
    """Whether lines of divided blocks can be alike; a pair counts where it meets first."""
    near = _near(similarity)

    def compared(left, right) -> Column:
        most = _most(left("n"), right("n"), similarity)
        meet = F.get(F.array_intersect(left("first"), right("first")), F.lit(0)) == left("at")
        missing = (F.size(F.array_except(left("parts"), right("parts"))) <= most) & (F.size(F.array_except(right("parts"), left("parts"))) <= most)
        return near(left, right) & meet & missing

    return compared


def candidates(standing: DataFrame) -> DataFrame:
    """``(key, node)`` of the blocks that more than one line has; ``standing`` has ``(node, blocks)``."""
    keyed = standing.select("node", F.explode("blocks").alias("key"))
    shared = saved(keyed.groupBy("key").count().where("count > 1").select("key"), "line-shared")
    rows = saved(keyed.join(small_side(shared, 2_000_000), "key", "left_semi").select("key", "node").distinct(), "line-rows")
    discard(shared)
    return rows


def _words_of(docs: DataFrame, text_col: str, nodes: DataFrame, repeated: bool) -> DataFrame:
    """``(node, words, n, parity, order)`` of some occurrences, words by 31 bits of their hashes; ``repeated``: some stand in several rows."""
    rows = docs.select("_doc", F.posexplode(F.split(text_col, "\n", -1)).alias("_pos", "_line"))
    own = F.transform(_line_words(F.col("_w")), lambda w: F.xxhash64(w).bitwiseAND(F.lit(_WORD)).cast("int"))
    rows = rows.withColumn("place", F.xxhash64("_doc", "_pos").bitwiseAND(F.lit(~_LENGTH)))
    places = nodes.select("node", F.col("node").bitwiseAND(F.lit(~_LENGTH)).alias("place"))
    found = rows.join(small_side(saved(places, "line-places")), "place").withColumn("_w", _normalised(F.col("_line")))
    found = found.dropDuplicates(["node"]) if repeated else found
    return saved(found.select("node", own.alias("words")).select("node", "words", *_marks(F.col("words"))), "line-words")


def groups(docs: DataFrame, standing: DataFrame, text_col: str, similarity: float = SIMILARITY) -> DataFrame:
    """``(node, root)`` of lines that are joined with others."""
    rows = candidates(standing)
    star, many = ends(rows, "line", _fits(similarity))
    wanted = star.select(F.col("a").alias("node")).unionByName(star.select(F.col("b").alias("node"))).unionByName(looked_up(rows, many, ["key"], "many").select("node"))
    wanted = saved(wanted.distinct(), "line-wanted")
    repeated = not standing.join(small_side(wanted), "node", "left_semi").groupBy("node").count().where("count > 1").isEmpty()
    words = _words_of(docs, text_col, wanted, repeated)
    marks, near = saved(words.select("node", "n", "parity.p", "parity.q", F.col("order.p").alias("r"), F.col("order.q").alias("s")), "line-marks"), _near(similarity)
    sure = saved(_verified(fitting(star, marks, near), words, similarity), "line-sure")
    roots = saved(components(sure, "a", "b"), "line-roots")
    more = crossing(rows, roots, marks, near, lambda large: _divided(large, words, similarity), "line", OPEN, _close(similarity))
    more = saved(_verified(more, words, similarity), "line-more")
    if not more.isEmpty():  # from the groups there are
        roots = saved(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), "a", "b"), "line-roots")
    discard(rows, star, words, marks, sure, more)
    return roots


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with repeated lines gone from the text, and ``n_lines``, ``n_removed``."""
    mark = F.xxhash64(id_col, text_col)
    order = F.coalesce(F.col(id_col), F.lit(2**63 - 1))
    own = docs.select(order.cast("long").alias("_id"), mark.alias("_doc"), text_col)
    seen = saved(_lines(own, text_col, similarity), "lines", RANDOM)
    many = seen.groupBy("line").agg(F.count(F.lit(1)).alias("times"), F.min("_id").alias("first"), F.min("_at").alias("at")).where("times > 1")
    again = saved(many, "lines-again")
    # One occurrence stands for each line; the others have nothing to add to the candidates.
    standing = seen.where(F.size("blocks") > 0).select("line", F.col("_at").alias("node"), "blocks").join(small_side(again.select("line", "at")), "line", "left").where("at is null or at = node")
    roots = groups(own, standing.select("node", "blocks"), text_col, similarity)
    known = seen.select("line", "_id", F.col("_at").alias("node")).join(small_side(roots), "node").dropDuplicates(["node"])
    linked = known.join(small_side(again), "line", "left").select("line", "root", F.coalesce("times", F.lit(1)).alias("times"), F.coalesce("first", "_id").alias("first"))
    linked = saved(linked, "lines-linked")
    single = again.join(small_side(linked.select("line")), "line", "left_anti").select("line", F.col("line").alias("root"), "times", "first")
    keepers = saved(linked.groupBy("root").agg(F.min("first").alias("keeper"), F.count(F.lit(1)).alias("many")), "lines-keepers")
    linked = looked_up(linked, keepers, ["root"], "many").select("line", "root", "times", "keeper")
    repeated = saved(linked.unionByName(single.withColumnRenamed("first", "keeper")), "lines-repeated")
    hits = saved(looked_up(seen.select("_id", "_doc", "_pos", "line"), repeated, ["line"], "times").select("_id", "_doc", "_pos", "root", "keeper"), "lines-hits")
    keep = hits.where(F.col("_id") == F.col("keeper")).groupBy("root").agg(F.min(F.struct("_doc", "_pos")).alias("k")).select("root", F.col("k._doc").alias("_keep"), F.col("k._pos").alias("_at"))
    keep = saved(keep, "lines-keep")
    gone = hits.join(small_side(keep), "root").where((F.col("_doc") != F.col("_keep")) | (F.col("_pos") != F.col("_at")))
    gone = saved(gone.groupBy("_doc").agg(F.collect_set("_pos").alias("_gone")), "lines-gone")  # as many as a text has lines
    discard(seen, again, linked, repeated, hits)
    count = gone.agg(F.sum(F.size("_gone"))).first()[0] or 0
    out = docs.withColumn("_doc", mark).join(F.broadcast(gone) if count <= 2_000_000 else gone, "_doc", "left").drop("_doc")
    lines = F.split(text_col, "\n", -1)
    left = let(lines, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("_gone")), lambda i: F.get(x, i)), "\n"))
    feeds = F.length(text_col) - F.length(F.replace(text_col, F.lit("\n"), F.lit("")))
    return out.withColumns(
        {
            "n_lines": F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(feeds + 1).cast("long"),
            "n_removed": F.when(F.col("_gone").isNull(), F.lit(0)).otherwise(F.size("_gone")).cast("long"),
            text_col: F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(left),
        }
    ).drop("_gone")


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with what is left of its text."""
    return deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
