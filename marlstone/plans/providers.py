"""Interfaces to models: an embedder, a reranker, a language model. The defaults are deterministic stubs; pass others to register()."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F

DIMENSIONS = 64


def hashed_words(text: str) -> list[float]:
    """A unit vector of hashed words; zero for none."""
    out = [0.0] * DIMENSIONS
    for w in text.lower().split():
        h = zlib.crc32(w.encode())
        out[h % DIMENSIONS] += 1.0 if h & 1024 else -1.0
    norm = math.sqrt(sum(x * x for x in out))
    return [x / norm for x in out] if norm else out


def shared_words(query: str, text: str) -> float:
    q = set(query.lower().split())
    return len(q & set(text.lower().split())) / max(1, len(q))


def first_sentence(text: str) -> str:
    return text.split(".")[0][:200]


MODELS: dict[str, Callable] = {"embed": hashed_words, "rerank": shared_words, "answer": first_sentence}


def register(**models: Callable) -> None:
    MODELS.update(models)


def embed(text):
    model = MODELS["embed"]

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.fillna("").map(model)

    return run(text)


def rerank(query, text):
    model = MODELS["rerank"]

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, s in batches:
            yield pd.Series([model(a, b) for a, b in zip(q.fillna(""), s.fillna(""))], dtype="float64")

    return run(query, text)


def answer(text):
    model = MODELS["answer"]

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.fillna("").map(model)

    return run(text)
