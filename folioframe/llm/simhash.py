"""SimHash near-duplicates: 64-bit fingerprints linked by BK-trees.

Fingerprints within ``radius`` bits agree exactly on one of ``radius + 1``
blocks, so each distinct fingerprint goes to that many shards, named by block
and value. A shard that holds more than ``SHARD`` fingerprints is divided
again by blocks of the bits it does not share yet, until at most ``FREE`` bits
are free: no tree can hold more than 2 ** 13 = 8,192 fingerprints however many
copies there are. A BK-tree over each shard (children keyed by their
distance to the parent) answers every member by following only the edges
within the radius; all trees of a batch are built and searched level by level
with NumPy. A shard returns a spanning forest of its links, so that groups of
copies cost no more than their size.

Edge cases: null or empty text has fingerprint zero and is linked like any
other; equal fingerprints are one node; an empty table gives an empty result;
rows repeated under one id get the same component; a fingerprint that only null
ids have is not linked, and its component is null.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, small_side, table
from .components import components

SEED, RADIUS, SHARD, FREE = 42, 2, 4096, 13
_STEP = 1 << 15


def text_fingerprint(text: str | None, shingle: int, seed: int = SEED) -> int:
    """The SimHash of a whole text over its word shingles, A-Z lower-cased."""
    import xxhash

    if not text:
        return 0
    found = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    del found
    total, n, digest = np.zeros(64, np.int64), len(ends) - shingle + 1, xxhash.xxh64_intdigest
    for at in range(0, n, _STEP):
        to = min(n, at + _STEP)
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at:to].tolist(), ends[at + shingle - 1 : to + shingle - 1].tolist(), strict=True)], np.uint64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """``(id, fp)``; fp is the fingerprint's 64 bits as a long."""
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, fp bigint"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.fromiter((text_fingerprint(x.as_py(), shingle) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], names=[id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


class Forest:
    """BK-trees over the shards of one batch; ``shard`` is sorted, ``fp`` distinct within a shard."""

    def __init__(self, shard: np.ndarray, fp: np.ndarray):
        n = len(fp)
        self.fp, index = fp, np.arange(n)
        _, first, group = np.unique(shard, return_index=True, return_inverse=True)
        self.root = first[group]
        parent, rest, at = np.full(n, -1), index[index != self.root], self.root.copy()
        edge = np.zeros(n, np.int64)
        while len(rest):  # each round hangs the first of those that arrive at a free edge, and moves the others down
            distance = np.bitwise_count(fp[rest] ^ fp[at[rest]]).astype(np.int64)
            _, lead, group = np.unique(at[rest] * 65 + distance, return_index=True, return_inverse=True)
            child = rest[lead]
            parent[child], edge[child] = at[child], distance[lead]
            down = rest != child[group]
            rest, below = rest[down], child[group][down]
            at[rest] = below
        hung = index[parent >= 0]
        keys = parent[hung] * 65 + edge[hung]
        order = np.argsort(keys, kind="stable")
        self.keys, self.child = keys[order], hung[order]

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of members of a shard that differ in at most ``radius`` bits, each once, a slice of queries at a time."""
        for start in range(0, len(self.fp), 1024):
            query = np.arange(start, min(len(self.fp), start + 1024))
            node = self.root[query]
            while len(query):
                distance = np.bitwise_count(self.fp[query] ^ self.fp[node]).astype(np.int64)
                near = (distance <= radius) & (node < query)
                if near.any():
                    yield query[near], node[near]
                low = np.searchsorted(self.keys, node * 65 + np.maximum(distance - radius, 0), "left")
                many = np.searchsorted(self.keys, node * 65 + np.minimum(distance + radius, 64), "right") - low
                step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                query, node = np.repeat(query, many), self.child[np.repeat(low, many) + step]


def _spanning(n: int, pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest linked index of each member."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = root[a], root[b]
            open_ = x != y
            if not open_.any():
                break
            a, b = a[open_], b[open_]
            np.minimum.at(root, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
            while (root[root] != root).any():
                root = root[root]
    return root


def _shard_links(radius: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(part: pa.Table) -> pa.RecordBatch:
            shard, fp, node = (part.column(c).to_numpy() for c in ("shard", "fp", "node"))
            root = _spanning(len(fp), Forest(shard, fp.view(np.uint64)).links(radius))
            linked = root != np.arange(len(fp))
            return pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[root[linked]])], names=["a", "b"])

        held = None
        for batch in batches:  # rows arrive by shard; the last one of a batch may go on in the next
            now = pa.Table.from_batches([batch])
            now = now if held is None else pa.concat_tables([held, now])
            shard = now.column("shard").to_numpy()
            whole = int(np.searchsorted(shard, shard[-1], "left")) if len(shard) else 0
            if whole:
                yield solve(now.slice(0, whole))
            held = now.slice(whole)
        if held is not None and held.num_rows:
            yield solve(held)

    return run


def _blocks(free: int, parts: int) -> list[int]:
    """The masks that divide the set bits of ``free`` into ``parts`` blocks."""
    bits = [k for k in range(64) if free >> k & 1]
    return [sum(1 << k for k in bits[len(bits) * i // parts : len(bits) * (i + 1) // parts]) for i in range(parts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masked(mask) -> object:
    return F.col("fp").bitwiseAND(mask)


def links(nodes: DataFrame, radius: int = RADIUS, limit: int = SHARD) -> DataFrame:
    """``(a, b)``: links that connect what lies within ``radius`` bits; ``nodes`` has ``(node, fp)``, fp distinct."""
    def divided(rows: DataFrame, levels: list[int]) -> tuple[DataFrame, list[int]]:
        pieces = {m: [m | x for x in _blocks(~m & (1 << 64) - 1, radius + 1)] for m in levels}
        choice = F.create_map(*[y for m, xs in pieces.items() for y in (F.lit(_signed(m)), F.array(*[F.lit(_signed(x)) for x in xs]))])
        out = rows.withColumn("mask", F.explode(F.element_at(choice, F.col("mask"))))
        return out.withColumn("shard", F.xxhash64("mask", _masked(F.col("mask")))), sorted({x for xs in pieces.values() for x in xs})

    rows, levels = divided(nodes.select("node", "fp").withColumn("mask", F.lit(0).cast("long")), [0])
    done = []
    while max(64 - bin(m).count("1") for m in levels) > FREE:
        large = saved(rows.groupBy("shard").count().where(F.col("count") > limit).select("shard"), "large-shards")
        if large.isEmpty():
            break
        wide = small_side(large)
        done.append(rows.join(wide, "shard", "left_anti"))
        rows, levels = divided(rows.join(wide, "shard", "left_semi").drop("shard"), levels)
    every = rows
    for part in done:
        every = every.unionByName(part)
    every = every.select("shard", "fp", "node")
    dealt = every.repartition("shard").sortWithinPartitions("shard", "node")
    kind = nodes.schema["node"].dataType.simpleString()
    return dealt.mapInArrow(_shard_links(radius), f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = RADIUS) -> DataFrame:
    """``(id, fp, component_id)`` for every row."""
    marks = saved(fingerprints(docs, id_col, text_col, shingle), "simhash")
    nodes = saved(marks.groupBy("fp").agg(F.min(id_col).alias("node")), "simhash-nodes")
    pairs = links(nodes.where(F.col("node").isNotNull()), radius)
    roots = saved(components(pairs, "a", "b"), "simhash-roots")
    named = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return marks.join(named, "fp").select(id_col, "fp", "component_id")


def op2_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = near_duplicates(table(spark, sf_dir, "documents"), shingle=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
