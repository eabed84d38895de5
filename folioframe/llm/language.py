"""Language identification by cross-parsing.

Each language's sample of labelled texts becomes a suffix automaton. A text is
parsed into phrases, each the longest match of the rest of the text in the
automaton; a phrase counts as the bits of a pointer into the sample, and the
language with the fewest bits wins. Parsing runs in lockstep over segments of
all texts of a batch, through one table of transitions per language.

The commonest letters of the samples are a symbol each; any other letter is
spelled by the hexadecimal digits of its code point, so that no two letters
are alike in any script.

Edge cases: a null text, or one without a letter, is ``und`` with score 0;
ties go to the first language in code-point order; with no labelled text
every document is ``und``; a long text is cut into segments, all of which
count; columns named like the operator's own are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

#: The sample of each language: of the ``SAMPLE_DOCS`` labelled documents whose ids have the lowest hashes, in this
#: order, each that still fits whole into ``MODEL_CHARS`` symbols. No text is cut.
SAMPLE_DOCS, MODEL_CHARS = 200, 30_000
#: Symbols: padding, space, sixteen digits that spell rare letters, then the commonest letters of the samples.
PAD, GAP, DIGITS, SYMBOLS = 0, 1, 2, 96  # at most; a model has as many as its letters need
FIRST_LETTER = DIGITS + 16
SEGMENT, LANES = 256, 32_768
UNKNOWN = "und"


def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def suffix_automaton(text: np.ndarray, symbols: int) -> np.ndarray:
    """Transitions (a row for each state, -1 for none) of the automaton of all substrings."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in text.tolist():
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and symbol not in step[at]:
            step[at][symbol] = new
            at = link[at]
        if at >= 0:
            to = step[at][symbol]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                copy = len(step)
                step.append(dict(step[to]))
                link.append(link[to])
                length.append(length[at] + 1)
                while at >= 0 and step[at].get(symbol) == to:
                    step[at][symbol] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
    out = np.full((len(step), symbols), -1, np.int32)
    for state, moves in enumerate(step):
        if moves:
            out[state, list(moves)] = list(moves.values())
    return out


def _table(text: np.ndarray, symbols: int) -> np.ndarray:
    """For each state and symbol: the state after it, with the phrases that end there in the top two bits."""
    go = suffix_automaton(text, symbols)
    root, none = go[0].copy(), go < 0
    ended = none.astype(np.uint32)  # the phrase so far ends; the symbol begins a new one
    ended[:, root < 0] += 1  # or is one by itself
    ended[0] = root < 0
    after = np.where(none, np.maximum(root, 0), go).astype(np.uint32)
    ended[:, PAD], ended[0, PAD], after[:, PAD] = 1, 0, 0
    return (after | ended << 30).reshape(-1)


class Model:
    """Tables by language. Learned from (language, text) pairs in the order in which they may enter the samples."""

    def __init__(self, sample: Iterable[tuple[str, str]], chars: int = MODEL_CHARS):
        texts: dict[str, list[np.ndarray]] = {}
        for lang, text in sample:
            texts.setdefault(lang, []).append(_codes(text + " "))
        every = np.concatenate([x for part in texts.values() for x in part]) if texts else np.zeros(0, np.uint32)
        letter = _is_letter()
        seen, counts = np.unique(every[letter[every]], return_counts=True)
        self.common = seen[np.lexsort((seen, -counts))][: SYMBOLS - FIRST_LETTER]
        self._map()
        self.samples: dict[str, np.ndarray] = {}
        for lang in sorted(texts):
            taken, room = [], chars
            for text in map(self.reduce, texts[lang]):
                if len(text) <= room:
                    taken.append(text)
                    room -= len(text)
            whole = np.concatenate(taken) if taken else np.zeros(0, np.uint8)
            if len(whole):
                self.samples[lang] = whole
        self._build()

    def __getstate__(self):
        return self.common, self.samples  # what is sent are the samples; tables are built where they are used

    def __setstate__(self, state):
        self.common, self.samples = state
        self._map()
        self._build()

    def _map(self) -> None:
        self.symbol = np.where(_is_letter(), PAD, GAP).astype(np.uint8)  # PAD: a letter to be spelled
        self.symbol[self.common] = FIRST_LETTER + np.arange(len(self.common))
        self.width = FIRST_LETTER + len(self.common)

    def _build(self) -> None:
        self.langs = list(self.samples)
        self.tables = [_table(text, self.width) for text in self.samples.values()]
        self.bits = [np.log2(len(text) + 2) for text in self.samples.values()]

    def reduce(self, codes: np.ndarray) -> np.ndarray:
        """Symbols of a text, runs of what is no letter being one space and rare letters spelled."""
        found = self.symbol[codes]
        gap = found == GAP
        gap[1:] &= gap[:-1].copy()
        gap[:1] = False
        found, codes = found[~gap], codes[~gap]
        rare = found == PAD
        if not rare.any():
            return found
        size = np.where(rare, np.where(codes < 0x10000, 4, 6), 1)
        end = np.cumsum(size)
        out = np.repeat(found, size)
        digit = np.repeat(end, size) - 1 - np.arange(len(out))  # how many digits follow
        spelled = out == PAD
        out[spelled] = DIGITS + (np.repeat(codes, size)[spelled] >> (4 * digit[spelled]).astype(np.uint32) & 15)
        return out

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """How many phrases each text needs in each language."""
        sizes = np.array([len(x) for x in texts], np.int64)
        lanes = np.maximum(1, -(-sizes // SEGMENT))
        begin = np.cumsum(lanes) - lanes
        flat = np.zeros(int(lanes.sum()) * SEGMENT, np.uint8)
        for at, text in zip((begin * SEGMENT).tolist(), texts, strict=True):
            flat[at : at + len(text)] = text
        steps = np.ascontiguousarray(flat.reshape(-1, SEGMENT).T)
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        for k, moves in enumerate(self.tables):
            ended = np.zeros(steps.shape[1], np.uint32)
            for first in range(0, steps.shape[1], LANES):
                block = steps[:, first : first + LANES]
                state = np.zeros(block.shape[1], np.uint32)
                total = ended[first : first + LANES]
                for row in block:
                    state *= np.uint32(self.width)
                    state += row
                    move = moves.take(state)
                    state = move & 0x3FFFFFFF
                    move >>= 30
                    total += move
                total += state != 0
            out[:, k] = np.add.reduceat(ended, begin)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [k for k, text in enumerate(texts) if text and self.langs and _has_letter(text)]
        start = 0
        while start < len(known):  # about two million characters at once
            stop, chars = start, 0
            while stop < len(known) and (stop == start or chars < 2_000_000):
                chars += len(texts[known[stop]])
                stop += 1
            costs = self.phrases([self.reduce(_codes(texts[k])) for k in known[start:stop]]) * np.array(self.bits)
            best = costs.argmin(axis=1)
            share = 1 / np.exp2(np.maximum((costs.min(axis=1, keepdims=True) - costs) / 4, -60)).sum(axis=1)
            for k, b, s in zip(known[start:stop], best.tolist(), share.tolist(), strict=True):
                langs[k], scores[k] = self.langs[b], s
            start = stop
        return langs, scores


def held_out(id_col: str = "doc_id"):
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from the ``sample_docs`` labelled documents of each language whose id has the lowest hash.

    Ids are ranked first, so that texts are read for the sample alone.
    """
    usable = F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)
    order = Window.partitionBy(lang_col).orderBy(F.xxhash64(id_col), id_col)
    ranked = docs.where(usable).select(id_col, lang_col).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= sample_docs)
    picked = ranked.select(id_col).distinct()  # at most sample_docs rows for each language
    # A text that no sample has room for is not fetched; one with fewer letters than that, but more characters, neither.
    fits = F.when(F.length(text_col) <= MODEL_CHARS, F.col(text_col))
    rows = docs.where(usable).join(F.broadcast(picked), id_col, "left_semi").select(F.xxhash64(id_col), id_col, lang_col, fits.alias("t")).where("t is not null")
    return Model((r[2], r[3]) for r in sorted(rows.collect()))


def identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    names, at = docs.columns, docs.columns.index(text_col)
    schema = type(docs.schema)(list(docs.schema.fields)).add("lang_pred", "string").add("score", "double")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                langs, scores = shared.value.predict(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    out = identified(docs.select("doc_id", "text"), learn(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
