"""Where learned models plug in, and deterministic stand-ins for tests.

A model is built on the worker by a factory, once per task, and fed whole Arrow batches.
"""

from __future__ import annotations

import hashlib
import logging
import re
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Protocol, TypeVar

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

log = logging.getLogger("papyra")
T = TypeVar("T")


class Embedder(Protocol):
    dims: int

    def encode(self, texts: list[str]) -> np.ndarray:
        """(texts, dims) vectors."""


class PairScorer(Protocol):
    def score(self, pairs: list[tuple[str, str]]) -> list[float | None]:
        """One score for each (query, text); None where there is none."""


class TextModel(Protocol):
    def complete(self, prompts: list[str]) -> list[str | None]:
        """One text for each prompt; None on failure."""


class HashEmbedder:
    """Bag of hashed words: texts that share words have similar vectors."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), np.float32)
        for i, text in enumerate(texts):
            for w in re.findall(r"\w+", (text or "").lower()):
                h = xxhash.xxh32_intdigest(w)
                out[i, h % self.dims] += 1 if h & 1 << 20 else -1
        return out


class OverlapScorer:
    """Share of the query's words that the text holds."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float | None]:
        out: list[float | None] = []
        for q, t in pairs:
            a, b = set(re.findall(r"\w+", (q or "").lower())), set(re.findall(r"\w+", (t or "").lower()))
            out.append(len(a & b) / len(a) if a and t else None)
        return out


class EchoModel:
    """Returns the prompt's first sentence, or None for a blank one."""

    def complete(self, prompts: list[str]) -> list[str | None]:
        return [re.split(r"(?<=[.!?])\s+", p.strip())[0] if p and p.strip() else None for p in prompts]


class VectorCache:
    """Vectors of the last ``size`` texts, on the driver: the first in goes first, whether it was asked for again or not."""

    def __init__(self, model: Embedder, size: int = 128):
        self.model, self.size, self._held = model, size, {}

    def vector(self, text: str) -> np.ndarray:
        key = hashlib.md5(text.encode()).hexdigest()
        if key not in self._held:
            while len(self._held) >= self.size:
                del self._held[next(iter(self._held))]
            self._held[key] = np.asarray(self.model.encode([text])[0], np.float32)
        return self._held[key]


_singletons: dict[str, object] = {}


def once(name: str, factory: Callable[[], T]) -> T:
    """A model built once per worker process and kept for its later tasks."""
    if name not in _singletons:
        _singletons[name] = factory()
    return _singletons[name]


@contextmanager
def timed(label: str) -> Iterator[None]:
    """Logs how long the block took, also where it fails."""
    began = time.perf_counter()
    try:
        yield
    finally:
        log.debug("%s took %.1f ms", label, 1000 * (time.perf_counter() - began))


def device() -> str:
    """Where models run: a graphics card if PyTorch is there and finds one."""
    try:
        import torch
    except ImportError:
        return "cpu"
    return "cuda" if torch.cuda.is_available() else "cpu"


def relevance_prompt(question: Column, title: Column, abstract: Column) -> Column:
    """Asks a text model why a paper answers a question."""
    return F.concat(F.lit("Question: "), question, F.lit("\nTitle: "), F.coalesce(title, F.lit("")), F.lit("\nAbstract: "), F.coalesce(abstract, F.lit("")), F.lit("\nSay in two sentences why this paper is relevant to the question."))


def embed(df: DataFrame, key: str, text: str, factory: Callable[[], Embedder], batch: int = 16, keep: bool = False) -> DataFrame:
    """``(key, vector)``: L2-normalised vectors, ``batch`` texts a call. Null texts embed as empty ones. With ``keep`` the rows
    as they are, with their ``vector``, so that nothing has to be joined."""
    rows = df if keep else df.select(key, text)
    place, n = rows.columns.index(text), len(rows.columns) if keep else 1
    schema = t.StructType([*rows.schema.fields[:n], t.StructField("vector", t.ArrayType(t.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for b in batches:
            texts = [x or "" for x in b.column(place).to_pylist()]
            parts = [np.asarray(model.encode(texts[i : i + batch]), np.float32) for i in range(0, len(texts), batch)]
            if not parts:
                continue
            v = np.concatenate(parts)
            if len(v) != len(texts):
                raise ValueError(f"{len(v)} vectors for {len(texts)} texts")
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(list(v), pa.list_(pa.float32()))], schema.names)

    return rows.mapInArrow(run, schema)


def cross_scored(df: DataFrame, query: str, text: str, factory: Callable[[], PairScorer], batch: int = 16) -> DataFrame:
    """The rows with ``cross_score``; sort by it with nulls last."""

    @F.pandas_udf("double")
    def score(q, t):
        import pandas as pd

        model, pairs = factory(), list(zip(q.fillna(""), t.fillna("")))
        return pd.Series([s for i in range(0, len(pairs), batch) for s in model.score(pairs[i : i + batch])], dtype="float64")

    return df.withColumn("cross_score", score(F.col(query), F.col(text)))


def generated(df: DataFrame, key: str, prompt: str, factory: Callable[[], TextModel], name: str = "generated") -> DataFrame:
    """``(key, name)``: a model's text for each prompt (summaries, questions, hypothetical answers); null on failure."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.complete([p or "" for p in b.column(1).to_pylist()]), pa.string())], [key, name])

    return df.select(key, prompt).mapInArrow(run, f"`{key}` {kind}, `{name}` string")
