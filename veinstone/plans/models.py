"""Sparse and dense model references: resolution, the chain of sparse backends, term weights of a masked language model."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.sinks import requires_idf


@dataclass(frozen=True)
class SparseBackend:
    """What weighs terms; encoder is None for BM25."""

    name: str
    model: str
    idf: bool
    fallback: bool
    log: tuple[str, ...]
    encoder: Any = None


def model_reference(name: str, local_only: bool = False, required: tuple[str, ...] = ()) -> tuple[str, bool]:
    """(path or hub name, whether only local files are used). A local bundle must hold the required files; a path must exist."""
    path = Path(name).expanduser()
    if path.exists():
        if gone := [r for r in required if not (path / r).exists()]:
            raise FileNotFoundError(f"the model bundle {path} lacks {gone}")
        return str(path.resolve()), True
    if path.is_absolute() or name.startswith((".", "~")) or "\\" in name or len(path.parts) > 2:
        raise FileNotFoundError(f"no model at {path}")
    return name, local_only


def sparse_backend(model: str, online: str, make: Callable[[str, bool], Any], offline: bool = False, local_only: bool = False, bm25: bool = True) -> SparseBackend:
    """The configured encoder, else the online one (unless offline, local files only, or the same), else BM25 with IDF, else an error with all reasons."""
    log: list[str] = []
    tries = [(model, local_only, False)]
    if online == model:
        log.append("online: skipped, the configured model is the same")
    elif offline or local_only:
        log.append("online: skipped, " + ("offline" if offline else "local files only"))
    else:
        tries.append((online, False, True))
    for name, local, fallback in tries:
        try:
            return SparseBackend("encoder", name, False, fallback, tuple(log), make(name, local))
        except Exception as e:  # noqa: BLE001  each backend may fail in its own way
            log.append(f"{name}: {e}")
    if bm25:
        return SparseBackend("bm25", "bm25", requires_idf("bm25"), True, tuple(log))
    raise RuntimeError("no sparse backend: " + " | ".join(log))


def splade_weights(logits: np.ndarray, mask: np.ndarray) -> dict[int, float]:
    """of logits (tokens x vocabulary) and a mask of tokens, the positive maxima over tokens of log(1 + relu)."""
    best = (np.log1p(np.maximum(logits, 0)) * mask[:, None]).max(axis=0) if len(logits) else np.zeros(0)
    return {int(i): float(best[i]) for i in np.flatnonzero(best > 0)}


def sparse_column(text: Column, model: Callable[[str], tuple[np.ndarray, np.ndarray]]) -> Column:
    """F34 over a column: map<int, float>; blank texts have no weights. model: a text to logits and mask, called in Arrow batches."""

    def each(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield part.map(lambda t: splade_weights(*model(t)) if isinstance(t, str) and t.strip() else {})

    def typed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from each(texts)

    typed.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(typed, "map<int,double>")(text)


def checked_dimension(vector: Column, dim: int) -> Column:
    """an error for vectors of another length than the collection's."""
    return F.when(F.size(vector) == dim, vector).otherwise(F.raise_error(F.concat(F.lit(f"expected {dim} dimensions, got "), F.size(vector).cast("string"))))


def instructed(model: str) -> bool:
    """Whether a dense model wants an instruction before the query, told by its name."""
    return "instruct" in model.lower()


def batch_encoder(model: Callable[[list[str]], np.ndarray], dim: int, size: int = 256) -> Callable[[Column], Column]:
    """a column of texts to array<double>, on the executors, size texts a call. Null texts are null; a wrong number or length of vectors is an error.

    Serves tables of points and of queries alike, e.g. as Engine(encode=...).
    """

    def each(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out: list[Any] = [None] * len(part)
            at = [i for i, t in enumerate(part) if isinstance(t, str)]
            for k in range(0, len(at), size):
                own = at[k : k + size]
                found = np.asarray(model([part.iloc[i] for i in own]), float)
                if found.shape != (len(own), dim):
                    raise ValueError(f"expected {len(own)} vectors of {dim} dimensions, got an array of {found.shape}")
                for i, vector in zip(own, found, strict=True):
                    out[i] = vector.tolist()
            yield pd.Series(out, dtype=object)

    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from each(texts)

    encode.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return lambda text: F.pandas_udf(encode, "array<double>")(text)
