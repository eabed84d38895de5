"""Near-duplicate documents by resemblance: wide candidates, confirmed on whole shingle sets.

Texts of equal words are one node. Nodes are candidates if their SimHashes lie
within ``radius`` bits (BK-trees, ``simhash.links``) or are equal, or if they
agree on one of ``BANDS`` keys of ``ROWS`` min-hashes each: of pairs with a
resemblance of 0.8 a share of 1 - (1 - 0.8 ** 4) ** 20 = 0.99997 does, of more
alike ones more. Links are candidates whose shingle sets have a resemblance of
``SIMILARITY`` or more, computed on the sets. Within a key all are held against
the first and the last node, then those that no link has connected are held
against each other; if these are many, only those that share one of the fifth of
their shingles which is rarest among them (prefix filtering, which loses no link):
neither a large group of copies nor texts with a common passage cost the square
of their number.

Edge cases: texts without words are one node, null among them; texts of fewer
words than a shingle are one shingle; A-Z are lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import OPEN, crossing, ends, fitting, ordered, rarest
from .common import discard, saved, small_side
from .components import components
from .simhash import RADIUS, SEED, links

SIMILARITY, BANDS, ROWS = 0.8, 20, 4
_STEP = 1 << 12
_RANDOM = np.random.default_rng(SEED)
_FACTOR = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
_SHIFT = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_MIX = _RANDOM.integers(0, 1 << 64, (BANDS, ROWS), np.uint64) | np.uint64(1)


def shingles(text: str | None, size: int) -> tuple[int, np.ndarray]:
    """A hash of the words of a text, 0 if it has none, and the hashes of its shingles in order."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0, np.empty(0, np.uint64)
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= size:
        return digest(joined, SEED + 1), np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    pairs = zip(starts[: len(ends) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return digest(joined, SEED + 1), np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), np.uint64, len(ends) - size + 1)


def _simhash(hashes: np.ndarray) -> int:
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _STEP):
        total += np.unpackbits(hashes[at : at + _STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


def _bands(hashes: np.ndarray) -> np.ndarray:
    """The keys of a set of shingles."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _STEP):
        np.minimum(least, (hashes[at : at + _STEP, None] * _FACTOR + _SHIFT).min(axis=0), out=least)
    least ^= least >> np.uint64(32)
    return (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64)


def _marks(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``(id, words, fp, n, keys)``: a hash of the words, the SimHash, the size of the shingle set, its band keys."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, fp, n, keys = [], [], [], []
            for x in batch.column(1):
                w, hashes = shingles(x.as_py(), size)
                distinct = np.unique(hashes)
                words.append(w)
                fp.append(_simhash(hashes))
                n.append(len(distinct))
                keys.append(_bands(distinct) if len(distinct) else distinct)
            offsets = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.empty(0, np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (words, fp)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *longs, pa.array(n, pa.int32()), lists], names=[id_col, "words", "fp", "n", "keys"])

    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, words bigint, fp bigint, n int, keys array<bigint>"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _sets(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``(node, hashes)``: whole shingle sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [np.unique(shingles(x.as_py(), size)[1]) for x in part.column(1)]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["node", "hashes"])

    schema = f"node {docs.schema[id_col].dataType.simpleString()}, hashes array<bigint>"
    return docs.select(id_col, text_col).mapInArrow(run, schema).dropDuplicates(["node"])


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("set_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("set_b")), "b")
    both = both.withColumn("same", F.size(F.array_intersect("set_a", "set_b")))
    return both.where(F.col("same") + 1e-9 >= (F.size("set_a") + F.size("set_b") - F.col("same")) * similarity).select("a", "b")


def _near(similarity: float):
    """Whether sets of these sizes can have the resemblance at all."""
    return lambda left, right: F.least(left("n"), right("n")) + 1e-9 >= F.greatest(left("n"), right("n")) * similarity


def _divided(large: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Nodes of large blocks under finer keys: their shingles that are rarest among all such nodes."""
    nodes = large.drop("key", "main", "rest", "many").distinct()
    each = nodes.select("node").join(sets, "node").select("node", F.size("hashes").alias("size"), F.explode("hashes").alias("part"))
    return rarest(each, [], 1 - similarity, "near").join(nodes, "node").withColumnRenamed("part", "key")


def near_duplicates(docs: DataFrame, id_col: str, text_col: str, shingle: int = 5, radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """``(id, component_id)`` for every row; ids are not null and stand for one text each."""
    marks = saved(_marks(docs, id_col, text_col, shingle), "near-marks")
    nodes = saved(marks.groupBy("words").agg(F.min(id_col).alias("node"), *[F.first(c).alias(c) for c in ("fp", "n", "keys")]), "near-nodes")
    keyed = nodes.select("node", F.explode(F.array_append("keys", F.xxhash64(F.lit(-1), "fp"))).alias("key"))
    shared = saved(keyed.groupBy("key").count().where("count > 1").select("key"), "near-shared")
    rows = saved(keyed.join(small_side(shared), "key", "left_semi").select("key", "node"), "near-rows")
    sizes, near = saved(nodes.select("node", "n"), "near-sizes"), _near(similarity)
    bits = links(nodes.groupBy("fp").agg(F.min("node").alias("node")), radius).select(*ordered("a", "b"))
    pairs = saved(fitting(ends(rows, "near")[0].unionByName(bits).distinct(), sizes, near), "near-pairs")
    wanted = rows.select("node").unionByName(pairs.select(F.col("a").alias("node"))).unionByName(pairs.select(F.col("b").alias("node")))
    wanted = saved(wanted.distinct().select(F.col("node").alias(id_col)), "near-wanted")
    sets = saved(_sets(docs.join(small_side(wanted), id_col, "left_semi"), id_col, text_col, shingle), "near-sets")
    sure = saved(_confirmed(pairs, sets, similarity), "near-sure")
    roots = saved(components(sure, "a", "b"), "near-roots")
    more = crossing(rows, roots, sizes, near, lambda large: _divided(large, sets, similarity), "near", OPEN)
    more = saved(_confirmed(more, sets, similarity), "near-more")
    if not more.isEmpty():  # from the groups there are
        roots = saved(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), "a", "b"), "near-roots")
    for old in (rows, sets):
        discard(old)
    named = nodes.select("words", "node").join(roots, "node", "left").select("words", F.coalesce("root", "node").alias("component_id"))
    return marks.select(id_col, "words").join(named, "words").select(id_col, "component_id")
