"""Encoding and decoding with a merge-type SentencePiece vocabulary.

The model file is read directly. A text is cut where no vocabulary piece can
span (before white space, between letters and other characters, around line
feeds; checked against the vocabulary), and each part is merged by an agenda:
its adjacent symbol pairs in order of score, leftmost first. The agenda of a
long part, or of one with characters outside the vocabulary, is a heap. Short
parts are merged many at a time: a row of pair ranks is a part's agenda, its
least rank the top, so that both give the same ids (tested on all short parts
of a table). Short parts are memoised per worker, within a bound in bytes.
Every part that is merged is also encoded by the sentencepiece library, a batch
at a time; if the two differ, the library's ids are taken and counted
(``Encoder.differing``, the column ``n_differing``).

Edge cases: null counts as empty and has no ids; characters outside the
vocabulary become byte pieces; U+2581 in a text is the white-space mark and
decodes to a space, as in the library; texts of any length are encoded whole.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, tokenizer_path

MARK = "▁"
#: Piece types of the model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Ways to cut a text, finest first; the first that cuts no piece of the vocabulary is used.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
CUTS = (
    f"\n+|{MARK}*[{_LATIN}]+|{MARK}*[^{_LATIN}{MARK}\n]+|{MARK}+",
    f"\n+|{MARK}*[^{MARK}\n]+|{MARK}+",
    f"{MARK}*[^{MARK}]+|{MARK}+",
    r"[\s\S]+",
)
#: Bytes in each of the two generations of a worker's memo, and those that a part takes beside its text and ids.
MEMO_BYTES, PART_BYTES = 40_000_000, 200
#: Longest part that is merged among many.
SHORT = 24


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The (number, value) fields of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Vocabulary:
    """What encoding and decoding need of a model file."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            data = file.read()
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.byte_ids: list[int] = [0] * 256
        self.surface: list[bytes] = []
        kind_of_model, normal = 1, {}
        for number, value in _fields(data):
            if number == 1:
                piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(_fields(value))
                text, kind, at = piece[1].decode(), piece[3], len(self.surface)
                if kind == NORMAL:
                    self.ids[text], self.scores[text] = at, struct.unpack("<f", piece[2])[0]
                elif kind == BYTE:
                    self.byte_ids[int(text[3:5], 16)] = at
                elif kind in (USER, UNUSED):
                    raise ValueError(f"pieces of type {kind} are not supported: {text!r}")
                self.surface.append(bytes([int(text[3:5], 16)]) if kind == BYTE else text.replace(MARK, " ").encode() if kind == NORMAL else b"")
            elif number == 2:
                kind_of_model = dict(_fields(value)).get(3, 1)
            elif number == 3:
                normal = dict(_fields(value))
        if kind_of_model != 2 or normal.get(2) or normal.get(4, 1) or not normal.get(3, 1) or not normal.get(5, 1):
            raise ValueError("a merge-type model without normalisation, with a leading space, is needed")
        self.parts = next(p for p in map(re.compile, CUTS) if all(p.findall(piece) == [piece] for piece in self.ids))
        self._tables()

    def _tables(self) -> None:
        """For merging many parts: the id that each pair of ids merges to, by sorted key, and the rank of each id."""
        ids = self.ids
        ranked = sorted(ids, key=lambda p: -self.scores[p])
        self.rank = np.full(len(self.surface) + 1, 1 << 30, np.int32)
        level = -1
        for k, piece in enumerate(ranked):
            level = level if k and self.scores[piece] == self.scores[ranked[k - 1]] else k
            self.rank[ids[piece]] = level
        pairs = {(ids[p[:k]], ids[p[k:]]): at for p, at in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ids = keys[order], np.fromiter(pairs.values(), np.int32, len(pairs))[order]

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id of each merged pair; one past the last id where there is none."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ids[at], len(self.surface))

    def merge_many(self, parts: list[str]) -> list[bytes]:
        """The ids of each part as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(parts)
        by_length: dict[int, tuple[list[int], list[list[int]]]] = {}
        for k, part in enumerate(parts):
            symbols = [self.ids.get(c, -1) for c in part] if len(part) <= SHORT else [-1]
            if -1 in symbols:
                found = self.merge(part)
                out[k] = struct.pack(f"<{len(found)}i", *found)
            else:
                where, rows = by_length.setdefault(len(part), ([], []))
                where.append(k)
                rows.append(symbols)
        for where, rows in by_length.values():
            for k, row in zip(where, self._merged(np.array(rows, np.int32)), strict=True):
                out[k] = row
        return out

    def _merged(self, symbols: np.ndarray) -> list[bytes]:
        n, width = symbols.shape
        none = len(self.surface)
        size, order = np.full(n, width), np.arange(n)
        done: list[bytes] = [b""] * n
        pair = self._pairs(symbols[:, :-1], symbols[:, 1:])
        while len(order):
            ranks = self.rank[pair] if pair.shape[1] else np.full((len(order), 1), 1 << 30)
            at = ranks.argmin(axis=1)  # the top of each part's agenda: best score, leftmost
            row = np.arange(len(order))
            over = ranks[row, at] == 1 << 30
            if over.any():
                flat = symbols[over].astype("<i4")
                for k, line, m in zip(order[over].tolist(), flat, size[over].tolist(), strict=True):
                    done[k] = line[:m].tobytes()
                go = ~over
                symbols, pair, at, size, order = symbols[go], pair[go], at[go], size[go], order[go]
                row = np.arange(len(order))
                if not len(order):
                    break
            width = symbols.shape[1]
            new = pair[row, at]
            take = np.arange(width - 1) + (np.arange(width - 1) > at[:, None])
            symbols = np.take_along_axis(symbols, take, axis=1)
            symbols[row, at] = new
            if width > 2:
                pair = np.take_along_axis(pair, take[:, :-1] if width > 2 else take, axis=1)
                size -= 1
                left, right = at > 0, at < size - 1
                pair[row[left], at[left] - 1] = self._pairs(symbols[row[left], at[left] - 1], symbols[row[left], at[left]])
                pair[row[right], at[right]] = self._pairs(symbols[row[right], at[right]], symbols[row[right], at[right] + 1])
                edge = ~right
                edge &= at < width - 2
                pair[row[edge], at[edge]] = none
            else:
                pair, size = pair[:, :0], size - 1
        return done

    def merge(self, part: str) -> list[int]:
        """The ids of one part, by the agenda of adjacent pairs."""
        symbols: list[str] = list(part)
        n, ids, scores = len(symbols), self.ids, self.scores
        if part in ids and n == 1:
            return [ids[part]]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[float, int, int, str]] = []
        for k in range(n - 1):
            pair = symbols[k] + symbols[k + 1]
            score = scores.get(pair)
            if score is not None:
                agenda.append((-score, k, k + 1, pair))
        heapq.heapify(agenda)
        while agenda:
            _, left, right, pair = heapq.heappop(agenda)
            if not symbols[left] or not symbols[right] or after[left] != right or symbols[left] + symbols[right] != pair:
                continue  # one of the two has been merged meanwhile
            symbols[left], symbols[right] = pair, ""
            follow = after[left] = after[right]
            if follow < n:
                before[follow] = left
                wider = pair + symbols[follow]
                score = scores.get(wider)
                if score is not None:
                    heapq.heappush(agenda, (-score, left, follow, wider))
            ahead = before[left]
            if ahead >= 0:
                wider = symbols[ahead] + pair
                score = scores.get(wider)
                if score is not None:
                    heapq.heappush(agenda, (-score, ahead, left, wider))
        out: list[int] = []
        for symbol in symbols:
            if symbol:
                found = ids.get(symbol)
                if found is None:
                    out += [self.byte_ids[b] for b in symbol.encode()]
                else:
                    out.append(found)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: pieces joined, the leading space dropped, bytes that are not UTF-8 replaced."""
        surface = self.surface
        text = b"".join([surface[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


class Encoder:
    """Memoised whole-text encoding, held against the library part by part."""

    def __init__(self, path: str, checked: bool = True, memo_bytes: int = MEMO_BYTES):
        self.vocabulary, self.young, self.old = Vocabulary(path), {}, {}
        self.size, self.memo_bytes, self.differing = 0, memo_bytes, set()
        self.library = None
        if checked:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=path)

    def batch(self, texts: list[str | None]) -> Iterator[tuple[bytes, str, int]]:
        """For each text its ids, as little-endian 32-bit integers, the decoded ids, and how many parts differed from the library's."""
        split, decode = self.vocabulary.parts.findall, self.vocabulary.decode
        for start in range(0, len(texts), 256):
            cut = [split((MARK + text).replace(" ", MARK)) if text else [] for text in texts[start : start + 256]]
            if self.size > self.memo_bytes:
                self.young, self.old, self.size = {}, self.young, 0
            young, old = self.young, self.old
            fresh = set().union(*cut).difference(young)
            known = [part for part in fresh if part in old]
            for part in known:
                self.keep(part, old[part])
            new = sorted(fresh.difference(known))
            made = dict(zip(new, self.encoded(new), strict=True))
            for part in new:
                if len(part) <= SHORT:
                    self.keep(part, made[part])
            for parts in cut:
                ids = b"".join([young[part] if part in young else made[part] for part in parts])
                yield ids, decode(np.frombuffer(ids, "<i4").tolist()), sum(part in self.differing for part in parts) if self.differing else 0

    def keep(self, part: str, ids: bytes) -> None:
        self.young[part] = ids
        self.size += len(part) * 4 + len(ids) + PART_BYTES

    def encoded(self, parts: list[str]) -> list[bytes]:
        """The ids of parts, held against the library."""
        ours = self.vocabulary.merge_many(parts)
        if self.library is None or not parts:
            return ours
        # The library puts the mark before a text itself; a line feed, which no piece holds, shields other parts from it.
        skip = len(self.library.encode("\n"))
        theirs = self.library.encode([part[1:] if part[0] == MARK and part != MARK else "\n" + part for part in parts], num_threads=1)
        for k, (part, ids) in enumerate(zip(parts, theirs, strict=True)):
            found = struct.pack(f"<{len(ids)}i", *ids)[0 if part[0] == MARK and part != MARK else 4 * skip :]
            if found != ours[k]:
                ours[k] = found
                if len(self.differing) < 100_000:  # names are for the count alone
                    self.differing.add(part)
        return ours


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, checked: bool = True) -> Encoder:
    """One encoder for each worker process, kept from task to task with its memo."""
    if (path, checked) not in _ENCODERS:
        _ENCODERS[path, checked] = Encoder(path, checked)
    return _ENCODERS[path, checked]


def encoded(docs: DataFrame, text_col: str = "text", model: str | None = None, checked: bool = True) -> DataFrame:
    """``docs`` with ``ids`` (array of int), ``decoded`` and ``n_differing`` in place of the text column."""
    path = model or tokenizer_path("piece_bpe_32k.model")
    kept = [f for f in docs.schema.fields if f.name not in (text_col, "ids", "decoded", "n_differing")]
    rest = docs.select(*[f.name for f in kept], text_col)
    names = [f.name for f in kept]
    schema = T.StructType(kept).add("ids", T.ArrayType(T.IntegerType())).add("decoded", T.StringType()).add("n_differing", T.LongType())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, checked)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                ids, texts, differing = [], [], []
                for a, b, c in own.batch(part.column(part.num_columns - 1).to_pylist()):
                    ids.append(a)
                    texts.append(b)
                    differing.append(c)
                ends = pa.array([0, *(len(x) // 4 for x in ids)], pa.int64()).to_numpy().cumsum().astype("int32")
                flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
                lists = pa.ListArray.from_arrays(pa.array(ends), flat)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists, pa.array(texts, pa.string()), pa.array(differing, pa.int64())], names=[*names, "ids", "decoded", "n_differing"])

    return rest.mapInArrow(run, schema)


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    out = encoded(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), "n_differing",
    )
