"""Model work: summaries, contexts, embeddings. Clients are made on the executors."""

from __future__ import annotations

import hashlib
import json
import re
import time
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import REASONING, chunk_prompt, embedding_input, section_prompt

# Retries and waits, sizes of batches and of the model's window, and what models are told.
ATTEMPTS, FIRST_WAIT_S, LONGEST_WAIT_S = 5, 1.0, 30.0
EMBED_BATCH, CONTEXT_WINDOW = 16, 16384
SUMMARY_ROLE = "You summarize one section of a book in two or three plain sentences. Reply with the summary only."
CONTEXT_ROLE = "You write one or two sentences that place an excerpt within its section, to help retrieval. Reply with the note only."
CONTENTS_ROLE = 'List the top-level entries (parts, chapters, appendices) of these contents pages in order, as a JSON array of {"title": text, "declared_page": whole number}. Reply with the array only.'


class ModelClient(Protocol):
    def generate(self, model: str, system: str, prompt: str) -> str: ...

    def embed(self, model: str, texts: list[str]) -> list[list[float]]: ...


class FakeClient:
    """Deterministic: vectors from SHA-256 bytes, replies that begin as the prompt does."""

    def __init__(self, size: int = 8):
        self.size = size

    def generate(self, model: str, system: str, prompt: str) -> str:
        return f"note: {prompt[:40]}"

    def embed(self, model: str, texts: list[str]) -> list[list[float]]:
        return [[b / 127.5 - 1.0 for b in hashlib.sha256(t.encode()).digest()[: self.size]] for t in texts]


def retried(call: Callable, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep):
    """``call()``, again after growing waits if it fails."""
    for k in range(attempts):
        try:
            return call()
        except Exception:
            if k == attempts - 1:
                raise
            sleep(min(LONGEST_WAIT_S, FIRST_WAIT_S * 2**k))


class HttpClient:
    """A local model server's JSON interface."""

    def __init__(self, host: str, window: int = CONTEXT_WINDOW):
        self.host, self.window = host.rstrip("/"), window

    def _post(self, path: str, body: dict | None) -> dict:
        request = urllib.request.Request(f"{self.host}{path}", None if body is None else json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request) as reply:
            return json.load(reply)

    def generate(self, model: str, system: str, prompt: str) -> str:
        body = {"model": model, "system": system, "prompt": prompt, "stream": False, "options": {"temperature": 0, "num_ctx": self.window}}
        return strip_reasoning(retried(lambda: self._post("/api/generate", body))["response"])

    def embed(self, model: str, texts: list[str]) -> list[list[float]]:
        return retried(lambda: self._post("/api/embed", {"model": model, "input": texts}))["embeddings"]

    def require(self, *models: str) -> None:
        """An error that says what to pull, unless all models are there."""
        have = [m["name"] for m in self._post("/api/tags", None)["models"]]
        missing = [m for m in models if not any(same_model(m, h) for h in have)]
        if missing:
            raise RuntimeError("missing models; run: " + "; ".join(f"ollama pull {m}" for m in missing))


def same_model(wanted: str, installed: str) -> bool:
    """Equal, or the name without a tag against its latest."""
    return wanted == installed or (":" not in wanted and installed == f"{wanted}:latest")


def strip_reasoning(text: str) -> str:
    return re.sub(REASONING, "", text).strip()


def _generated(rows: DataFrame, key: list[str], prompt: str, client: Callable[[], ModelClient], model: str, role: str, name: str) -> DataFrame:
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in key)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = client()
        for batch in batches:
            out = batch[key].copy()
            out[name] = [own.generate(model, role, p) for p in batch[prompt]]
            yield out

    return rows.select(*key, prompt).mapInPandas(run, f"{kinds}, {name} string")


SECTION_KEY = ["book_id", "chapter_index", "section_index"]
CHUNK_KEY = [*SECTION_KEY, "chunk_index"]


def unsummarized(sections: DataFrame, done: DataFrame) -> DataFrame:
    return sections.join(done.where("summary is not null").select(*SECTION_KEY), SECTION_KEY, "left_anti")


def summarize(sections: DataFrame, client: Callable[[], ModelClient], model: str) -> DataFrame:
    """``(key, summary)`` for each section."""
    asked = sections.withColumn("_prompt", section_prompt(F.col("title"), F.col("section_index"), F.col("text")))
    return _generated(asked, SECTION_KEY, "_prompt", client, model, SUMMARY_ROLE, "summary")


def uncontextualized(chunks: DataFrame, done: DataFrame) -> DataFrame:
    return chunks.join(done.select(*CHUNK_KEY), CHUNK_KEY, "left_anti")


def contextualize(chunks: DataFrame, summaries: DataFrame, client: Callable[[], ModelClient], model: str) -> DataFrame:
    """``(key, context)`` for each chunk."""
    known = chunks.join(summaries.select(*SECTION_KEY, "summary"), SECTION_KEY, "left")
    asked = known.withColumn("_prompt", chunk_prompt(F.col("summary"), F.col("raw_text")))
    return _generated(asked, CHUNK_KEY, "_prompt", client, model, CONTEXT_ROLE, "context")


def unembedded(chunks: DataFrame, contexts: DataFrame, done: DataFrame) -> DataFrame:
    """Chunks with a context, beside it, and no vector."""
    return chunks.join(contexts.select(*CHUNK_KEY, "context"), CHUNK_KEY).join(done.select(*CHUNK_KEY), CHUNK_KEY, "left_anti")


def embed(chunks: DataFrame, client: Callable[[], ModelClient], model: str, batch_size: int = EMBED_BATCH) -> DataFrame:
    """``(key, embedding)`` for each chunk with its context, ``batch_size`` texts in a call."""
    kinds = ", ".join(f"{k} {chunks.schema[k].dataType.simpleString()}" for k in CHUNK_KEY)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = client()
        for batch in batches:
            for at in range(0, len(batch), batch_size):
                part = batch.iloc[at : at + batch_size]
                out = part[CHUNK_KEY].copy()
                out["embedding"] = [[float(x) for x in v] for v in own.embed(model, list(part["_input"]))]
                yield out

    rows = chunks.select(*CHUNK_KEY, embedding_input(F.col("context"), F.col("raw_text")).alias("_input"))
    return rows.mapInPandas(run, f"{kinds}, embedding array<float>")
