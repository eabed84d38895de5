"""Document quality by co-training two views.

One classifier sees the text (its words and pairs of words, in hashed buckets,
character-class pairs, vocabulary and line figures), another the document's
metadata (source, language, length). Over
some rounds each labels the unlabelled documents that it is surest of, and
the other learns from them. Each view is then calibrated on labelled
documents that neither learned from, and the calibrated views are combined.

The classifiers are fitted on bounded samples (``LABELLED`` and ``UNLABELLED``
documents, those whose id has the lowest hash); every document is scored, over
its whole text.

Edge cases: a null or empty text has only zero counts; null metadata is a value
of its own; ids with conflicting labels count once for each; without labels of
both kinds every score is the share of good labels (0.5 if there are none).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

LABELLED, UNLABELLED, ROUNDS, PER_ROUND, KEEP = 6_000, 4_000, 5, 200, 0.5
#: Character classes: other, space, line feed, lower, upper, digit, then one for each of these.
MARKS = ".,!?#*$%&|"
CLASSES = 6 + len(MARKS)
BUCKETS = 64
#: Buckets of words and of pairs of words in the text view.
WORD_BUCKETS, PAIR_BUCKETS = 192, 64
FIGURES = 6
TEXT = CLASSES * CLASSES + FIGURES + WORD_BUCKETS + PAIR_BUCKETS


def _classes() -> np.ndarray:
    kind = np.zeros(0x3000, np.uint8)
    for code in range(len(kind)):
        c = chr(code)
        kind[code] = 2 if c == "\n" else 1 if c.isspace() else 4 if c.isupper() else 3 if c.isalpha() else 5 if c.isdigit() else 6 + MARKS.index(c) if c in MARKS else 0
    return kind


_KIND = _classes()


def text_view(text: str | None) -> np.ndarray:
    """Features of a whole text."""
    out = np.zeros(TEXT, np.float32)
    if not text:
        return out
    pairs = np.zeros(CLASSES * CLASSES, np.int64)
    for at in range(0, max(1, len(text) - 1), 1 << 20):
        codes = np.frombuffer(text[at : at + (1 << 20) + 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _KIND[np.minimum(codes, len(_KIND) - 1)].astype(np.int64)
        pairs += np.bincount(kind[:-1] * CLASSES + kind[1:], minlength=CLASSES * CLASSES)
    out[: CLASSES * CLASSES] = np.sqrt(pairs / max(1, pairs.sum()))
    found, lines = text.split(), text.split("\n")
    n, distinct = len(found), len(set(found))
    grams = len(set(zip(found, found[1:], found[2:], strict=False)))
    at = CLASSES * CLASSES
    out[at : at + FIGURES] = (np.log1p(n) / 5, distinct / max(1, n), grams / max(1, n - 2), len(set(lines)) / len(lines), (len(text) - n) / max(1, n) / 10, min(n, 20) / 20)
    if found:
        # Words by their hash, pairs by a mix of both hashes; the square root of shares, as for character classes.
        known = {w: zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) for w in set(found)}
        codes = np.fromiter(map(known.__getitem__, found), np.uint32, n)
        at += FIGURES
        out[at : at + WORD_BUCKETS] = np.sqrt(np.bincount(codes % WORD_BUCKETS, minlength=WORD_BUCKETS) / n)
        if n > 1:
            both = (codes[:-1] * np.uint32(2654435761) + codes[1:]) >> np.uint32(8)
            out[at + WORD_BUCKETS :] = np.sqrt(np.bincount(both % PAIR_BUCKETS, minlength=PAIR_BUCKETS) / (n - 1))
    return out


def meta_view(source: str | None, lang: str | None, n_chars: int | None) -> list[int]:
    """Which features of the metadata are set."""
    size = 0 if not n_chars or n_chars < 1 else 1 + min(30, int(n_chars).bit_length())
    return [zlib.crc32(f"s{source}".encode("utf-8", "surrogatepass")) % BUCKETS, BUCKETS + zlib.crc32(f"l{lang}".encode("utf-8", "surrogatepass")) % BUCKETS, 2 * BUCKETS + size]


META = 2 * BUCKETS + 32


def _meta_matrix(sources, langs, sizes) -> np.ndarray:
    out = np.zeros((len(sources), META), np.float32)
    for k, row in enumerate(zip(sources, langs, sizes, strict=True)):
        out[k, meta_view(*row)] = 1
    return out


class Logistic:
    """Regularised logistic regression by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 12):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])
        weight = np.ones(len(x)) if weight is None else weight
        self.w = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], ridge)
        penalty[-1] = 1e-3
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            slope = z.T @ (weight * (p - y)) + penalty * self.w
            curve = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(penalty)
            move = np.linalg.solve(curve, slope)
            self.w -= move / max(1.0, np.abs(move).max())

    def margin(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w[:-1] + self.w[-1]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


class CoTrained:
    """Both views and their combination, from labelled and unlabelled samples (text view, metadata view[, label])."""

    def __init__(self, text, meta, label, more_text, more_meta, rounds: int = ROUNDS, per_round: int = PER_ROUND):
        self.prior = float(np.mean(label)) if len(label) else 0.5
        self.fitted = len(label) >= 10 and 0 < self.prior < 1
        self.exchanged = [0, 0]
        if not self.fitted:
            return
        fit = np.arange(len(label)) % 4 != 0  # the rest calibrates
        if len(set(label[fit])) < 2 or len(set(label[~fit])) < 2:
            fit = np.ones(len(label), bool)
        views, pools = [text[fit], meta[fit]], [more_text, more_meta]
        given = [np.full(len(more_text), -1), np.full(len(more_text), -1)]  # pseudo-labels that each view has got
        models = [None, None]
        for turn in range(rounds + 1):
            for v in (0, 1):
                has = given[v] >= 0
                x = np.vstack([views[v], pools[v][has]])
                y = np.concatenate([label[fit], given[v][has]])
                models[v] = Logistic(x, y, np.concatenate([np.ones(fit.sum()), np.full(has.sum(), 0.5)]))
            if turn == rounds:
                break
            for v in (0, 1):  # what v is surest of, the other learns
                p, to = models[v](pools[v]), given[1 - v]
                for want, sure in ((1, p), (0, 1 - p)):
                    share = self.prior if want else 1 - self.prior
                    free = np.flatnonzero((to < 0) & (sure >= 0.95))
                    chosen = free[np.argsort(-sure[free], kind="stable")][: max(1, round(per_round * share))]
                    to[chosen] = want
        self.exchanged = [int((g >= 0).sum()) for g in given]
        self.models = models
        cal = ~fit if (~fit).any() else fit
        margins = [m.margin(v[cal]).clip(-12, 12) for m, v in zip(models, (text, meta), strict=True)]
        self.calibrated = [Logistic(m[:, None], label[cal]) for m in margins]
        both = np.stack([c.margin(m[:, None]) for c, m in zip(self.calibrated, margins, strict=True)], axis=1)
        self.combined = Logistic(both, label[cal])

    def __call__(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The combined score, and each view's own."""
        if not self.fitted:
            return (np.full(len(text), self.prior),) * 3
        margins = [m.margin(v).clip(-12, 12)[:, None] for m, v in zip(self.models, (text, meta), strict=True)]
        both = np.stack([c.margin(m) for c, m in zip(self.calibrated, margins, strict=True)], axis=1)
        return self.combined(both), *(c(m) for c, m in zip(self.calibrated, margins, strict=True))


def learn(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, unlabelled: int = UNLABELLED, **options) -> CoTrained:
    """Fit on the ``labelled`` labelled and ``unlabelled`` other documents whose ids have the lowest hashes."""
    ids = docs.select("doc_id").where("doc_id is not null").distinct()
    given = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality").distinct()
    known = given.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(labelled)
    other = ids.join(given, "doc_id", "left_anti").orderBy(F.xxhash64("doc_id"), "doc_id").limit(unlabelled).select("doc_id", F.lit(None).cast("int").alias("quality"))
    picked = known.unionByName(other)  # at most labelled + unlabelled rows
    rows = docs.select("doc_id", "text", "source", "lang", "n_chars").join(F.broadcast(picked), "doc_id")
    schema = "doc_id long, quality int, text array<float>, source string, lang string, n_chars long"

    def view(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.to_pydict()
            features = [text_view(x).tolist() for x in d["text"]]
            yield pa.RecordBatch.from_pydict({"doc_id": d["doc_id"], "quality": pa.array(d["quality"], pa.int32()), "text": pa.array(features, pa.list_(pa.float32())), "source": d["source"], "lang": d["lang"], "n_chars": d["n_chars"]})

    got = sorted(rows.select("doc_id", "quality", "text", "source", "lang", "n_chars").mapInArrow(view, schema).collect(), key=lambda r: (r.doc_id, str(r.quality), r.n_chars or 0))
    got.sort(key=lambda r: (r.doc_id * 2654435761) % (1 << 32))  # folds must not follow the ids
    text = np.array([r.text for r in got], np.float32).reshape(len(got), TEXT)
    meta = _meta_matrix([r.source for r in got], [r.lang for r in got], [r.n_chars for r in got])
    label = np.array([-1 if r.quality is None else int(r.quality > 0) for r in got], int)
    has = label >= 0
    return CoTrained(text[has], meta[has], label[has], text[~has], meta[~has], **options)


def scored(docs: DataFrame, model: CoTrained, keep: float = KEEP) -> DataFrame:
    """``(doc_id, score, text_score, meta_score, kept)`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, score double, text_score double, meta_score double, kept boolean"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                text = np.array([text_view(x.as_py()) for x in part.column(1)], np.float32).reshape(part.num_rows, -1)
                meta = _meta_matrix(*(part.column(k).to_pylist() for k in (2, 3, 4)))
                score, a, b = shared.value(text, meta)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x.astype(float)) for x in (score, a, b)), pa.array(score >= keep)], names=["doc_id", "score", "text_score", "meta_score", "kept"])

    return docs.select(F.col("doc_id").cast("long"), "text", "source", "lang", F.col("n_chars").cast("long")).mapInArrow(run, schema)


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Score and verdict for every document."""
    docs = table(spark, sf_dir, "documents")
    return scored(docs, learn(docs, table(spark, sf_dir, "labels")))
