"""Embedders: the interface, an offline one by feature hashing, and embedding of what has no vector yet."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.functions.text import embed_input


class Embedder(Protocol):
    """Turns texts into rows of a matrix, one a text. Called on executors; load models lazily."""

    width: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Deterministic vectors from hashed character trigrams, scaled to length 1."""

    def __init__(self, width: int = 64):
        self.width = width

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width))
        for i, t in enumerate(texts):
            s = f" {t.lower()} "
            for g in (s[j : j + 3] for j in range(len(s) - 2)):
                h = zlib.crc32(g.encode("utf-8", "surrogatepass"))
                out[i, h % self.width] += 1 if h & 0x10000 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


class LetterEmbedder:
    """How often each letter from a to z occurs, case aside: vectors that can be checked by hand and in SQL."""

    width = 26

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width))
        for i, t in enumerate(texts):
            code = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
            code = np.where((code >= 65) & (code <= 90), code + 32, code)
            out[i] = np.bincount(code[(code >= 97) & (code <= 122)] - 97, minlength=self.width)
        return out


class ModelEmbedder:
    """A model of one's own: `load` returns (tokenise, forward) and is called once a worker, at the first batch.

    tokenise: texts -> (ids, mask), padded and cut to one length; forward: (ids, mask) -> token
    vectors (texts, tokens, width). A text's vector is the mean of its tokens' that the mask sets.
    """

    def __init__(self, load: Callable[[], tuple[Callable, Callable]], width: int):
        self.load, self.width, self._parts = load, width, None

    def __getstate__(self) -> dict:
        return {"load": self.load, "width": self.width, "_parts": None}  # each worker loads its own

    def embed(self, texts: list[str]) -> np.ndarray:
        if self._parts is None:
            self._parts = self.load()
        tokenise, forward = self._parts
        ids, mask = tokenise(texts)
        tokens = np.asarray(forward(ids, mask), float)
        weight = np.asarray(mask, float)[:, :, None]
        return (tokens * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-9)


class ApiEmbedder:
    """A service: `call` sends up to `batch` texts and returns a vector each. A failing batch is tried again, then raises, so that no row is ever skipped."""

    def __init__(self, call: Callable[[list[str]], list[list[float]]], width: int, batch: int = 10, attempts: int = 3, wait: float = 1.0):
        self.call, self.width, self.batch, self.attempts, self.wait = call, width, batch, attempts, wait

    def _send(self, texts: list[str]) -> np.ndarray:
        for attempt in range(1, self.attempts + 1):
            try:
                got = np.asarray(self.call(texts), float)
                if got.shape != (len(texts), self.width):
                    raise ValueError(f"{got.shape} for {len(texts)} texts")
                return got
            except Exception:
                if attempt == self.attempts:
                    raise
                time.sleep(self.wait * attempt)
        raise AssertionError

    def embed(self, texts: list[str]) -> np.ndarray:
        parts = [self._send(texts[lo : lo + self.batch]) for lo in range(0, len(texts), self.batch)]
        return np.concatenate(parts) if parts else np.zeros((0, self.width))


def embed_column(df: DataFrame, text: str, embedder: Embedder, out: str = "vector", cap: int = 8000, batch: int = 64) -> DataFrame:
    """df with `out` ARRAY<FLOAT>: the vector of each text cut to `cap` characters; null for null and empty texts.

    A failing embedder fails the task, which Spark retries; rows are never shifted or dropped.
    """
    names = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("_input").to_pylist()
            vectors: list = [None] * len(texts)
            at = [i for i, t in enumerate(texts) if t]
            for lo in range(0, len(at), batch):
                part = at[lo : lo + batch]
                for i, v in zip(part, embedder.embed([texts[i] for i in part]).astype(np.float32), strict=True):
                    vectors[i] = v
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(vectors, pa.list_(pa.float32()))], names=[*names, out])

    return df.withColumn("_input", embed_input(F.col(text), cap)).mapInArrow(run, schema)


def embed_missing(chunks: DataFrame, vectors: DataFrame, embedder: Embedder) -> DataFrame:
    """Vectors of the chunks whose id has none yet: an anti join, so nothing is embedded twice."""
    new = chunks.join(vectors.where(F.col("vector").isNotNull()).select("id"), "id", "left_anti")
    return embed_column(new, "chunk", embedder)
