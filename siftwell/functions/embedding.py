"""Embedders and the codec of stored vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.text import hashed_vector


class Embedder(Protocol):
    """What an index needs of a model: who made a vector, how long it is, and the vectors of texts and of a query."""

    provider: str
    model: str
    dimension: int

    def embed(self, text: Column) -> Column: ...

    def embed_query(self, spark: SparkSession, query: str) -> list[float]: ...


@dataclass(frozen=True)
class HashEmbedder:
    """Deterministic unit vectors without meaning, as an expression: nothing leaves the JVM."""

    dimension: int = 64
    provider: str = "deterministic"
    model: str = "sha256"

    def embed(self, text: Column) -> Column:
        return hashed_vector(text, self.dimension)

    def embed_query(self, spark: SparkSession, query: str) -> list[float]:
        return spark.range(1).select(self.embed(F.lit(query)).alias("v")).first().v


@dataclass(frozen=True)
class ArrowEmbedder:
    """A model in Python: ``load`` runs once per task and returns a function from a list of texts to an array of vectors.

    Vectors are brought to unit length; one of another dimension, of no length or not finite is an error. Queries get
    ``query_prefix`` in front, as instruction-tuned models ask for.
    """

    provider: str
    model: str
    dimension: int
    load: Callable[[], Callable[[list[str]], np.ndarray]] = field(repr=False)
    query_prefix: str = ""
    batch: int = 64

    def _vectors(self, model: Callable[[list[str]], np.ndarray], texts: list[str]) -> list[list[float]]:
        out = []
        for i in range(0, len(texts), self.batch):
            got = np.asarray(model(texts[i : i + self.batch]), np.float64)
            if got.shape != (len(texts[i : i + self.batch]), self.dimension):
                raise ValueError(f"{self.model} gave vectors of shape {got.shape}")
            norm = np.linalg.norm(got, axis=1, keepdims=True)
            if not np.isfinite(norm).all() or (norm == 0).any():
                raise ValueError(f"{self.model} gave a vector that can't be normalised")
            out.extend((got / norm).tolist())
        return out

    def embed(self, text: Column) -> Column:
        vectors, load = self._vectors, self.load

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                yield pd.Series(vectors(model, texts.fillna("").tolist()), dtype=object)

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, "array<double>")(text)

    def embed_query(self, spark: SparkSession, query: str) -> list[float]:
        return self._vectors(self.load(), [self.query_prefix + query])[0]


def identity(embedder: Embedder) -> dict:
    """What must be equal for vectors to be compared."""
    return {"provider": embedder.provider, "model": embedder.model, "dimension": embedder.dimension}


def packed(vector: Column) -> Column:
    """A vector as little-endian 32-bit floats; null stays null, a null component or one beyond 32 bits is an error."""

    def run(values: pd.Series) -> pd.Series:
        def one(v):
            if v is None:
                return None
            with np.errstate(over="ignore"):
                narrow = np.asarray(v, np.float64).astype("<f4")
            if not np.isfinite(narrow).all():
                raise ValueError("a component isn't a finite 32-bit number")
            return narrow.tobytes()

        return values.map(one, na_action="ignore")

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "binary")(vector)


def unpacked(blob: Column) -> Column:
    """The vector of ``packed`` bytes; a length that isn't a multiple of 4 is an error."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda b: np.frombuffer(b, "<f4").tolist(), na_action="ignore")

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<float>")(blob)
