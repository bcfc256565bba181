"""Where models plug in: segmenters, embedders, judges; and deterministic stand-ins that need none."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


class Segmenter(Protocol):
    def __call__(self, text: str) -> list[str]: ...


class Embedder(Protocol):
    dim: int

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class Judge(Protocol):
    def __call__(self, prompt: str) -> str: ...


class HashEmbedder:
    """Unit vectors from hashes of words: equal texts get equal ones, similar texts similar ones."""

    def __init__(self, dim: int = 128):
        self.dim = dim

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(self.dim)
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest())
                v[h % self.dim] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out


class RecordedJudge:
    """Answers that were recorded for prompts, and one for all others."""

    def __init__(self, answers: dict[str, str], otherwise: str = "{}"):
        self.answers, self.otherwise = answers, otherwise

    def __call__(self, prompt: str) -> str:
        return self.answers.get(prompt, self.otherwise)


class RetryableError(Exception):
    """A failure of a remote model that may pass: a timeout, 408, 409, 429 or 5xx."""


def with_retry(call: Callable, attempts: int = 3, wait: float = 0.5, sleep: Callable = time.sleep) -> Callable:
    """The call, tried again after a retryable failure, waiting twice as long each time."""

    def run(*args):
        for attempt in range(attempts):
            try:
                return call(*args)
            except RetryableError:
                if attempt + 1 == attempts:
                    raise
                sleep(wait * 2**attempt)

    return run


class FallbackEmbedder:
    """The first embedder that works, in order, of one length: vectors of different models are never mixed."""

    def __init__(self, *embedders: Embedder):
        if len({e.dim for e in embedders}) != 1:
            raise ValueError("embedders to fall back on must have one length")
        self.embedders, self.dim = embedders, embedders[0].dim

    def __call__(self, texts: list[str]) -> list[list[float]]:
        failures = []
        for embedder in self.embedders:
            try:
                return embedder(texts)
            except Exception as e:  # noqa: BLE001
                failures.append(e)
        raise RuntimeError(f"no embedder works: {failures}")


def embed(rows: DataFrame, embedder: Embedder, batch: int = 128) -> DataFrame:
    """(memory_id, workspace, dim, embedding) of rows (id, workspace, content) in batches of a fixed size; a batch
    that fails, or vectors of a wrong length, are left out and come again in the next backfill."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), batch):
                some = part.iloc[at : at + batch]
                try:
                    vectors = embedder(some["content"].tolist())
                except Exception:  # noqa: BLE001
                    continue
                if len(vectors) == len(some) and all(len(v) == embedder.dim for v in vectors):
                    yield pd.DataFrame({"memory_id": some["id"], "workspace": some["workspace"], "dim": embedder.dim, "embedding": vectors})

    return rows.where("content is not null").select("id", "workspace", "content").mapInPandas(run, "memory_id string, workspace string, dim int, embedding array<float>")


def segment(rows: DataFrame, column: str, segmenter: Segmenter) -> DataFrame:
    """Rows with `words`, dictionary words of two or more characters, for `text.tokenize`."""

    @F.pandas_udf("array<string>")
    def words(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [w for w in segmenter(t) if len(w) >= 2] if t else [])

    return rows.withColumn("words", words(column))
