"""Embedding back ends as Arrow-batched column functions; the default needs no model."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HASHING_DIM = 128
#: Patterns of tokens that a task keeps at a time.
HELD_SIGNS = 20_000


def _hash_vectors(texts: pd.Series) -> pd.Series:
    import hashlib
    import re

    import numpy as np

    word = re.compile(r"\w+")
    cjk = re.compile("[一-鿿]")
    position = np.arange(16)  # the pattern of a token repeats after sixteen dimensions
    signs: dict[str, object] = {}

    def sign(token):
        if token not in signs:
            if len(signs) >= HELD_SIGNS:
                signs.clear()
            digest = np.frombuffer(hashlib.md5(token.encode("utf-8")).digest(), dtype=np.uint8)
            signs[token] = ((digest >> (position % 8)) & 1).astype(np.int64) * 2 - 1
        return signs[token]

    def vector(text):
        lowered = (text or "").lower().strip()
        total = np.zeros(16, dtype=np.int64)
        counts: dict[str, int] = {}
        for token in word.findall(lowered) + cjk.findall(lowered):
            counts[token] = counts.get(token, 0) + 1
        for token, n in counts.items():
            total += n * sign(token)
        total = np.tile(total, HASHING_DIM // 16)
        norm = float(np.sqrt((total * total).sum()))
        if norm == 0.0:
            unit = np.zeros(HASHING_DIM)
            unit[0] = 1.0
            return unit.astype(np.float32)
        return (total / norm).astype(np.float32)

    return texts.map(vector)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def hashing_embedding(texts: pd.Series) -> pd.Series:
    """Sum of +-1 md5 patterns of words and CJK characters over 128 dimensions, unit length."""
    return _hash_vectors(texts)


_BACKENDS: dict[str, Callable[[Column], Column]] = {"hashing": hashing_embedding}


def register_backend(name: str, encode: Callable[[Column], Column]) -> None:
    """``encode`` maps a text column to an array<float> column (e.g. a pandas UDF on a model)."""
    _BACKENDS[name.strip().lower()] = encode


def select_backend(name: str | None = None) -> Callable[[Column], Column]:
    return _BACKENDS.get((name or "").strip().lower(), hashing_embedding)


_ENTAILMENT: dict[str, Callable[[Column, Column], Column]] = {}


def register_entailment(name: str, score: Callable[[Column, Column], Column]) -> None:
    """``score`` maps (premise, hypothesis) columns to a double column."""
    _ENTAILMENT[name.strip().lower()] = score


def select_entailment(name: str | None) -> Callable[[Column, Column], Column] | None:
    """None (gate off) unless a registered back end is named."""
    return _ENTAILMENT.get((name or "").strip().lower())
