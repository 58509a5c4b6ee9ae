"""Vectors with integer components, for operators that compute exactly."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    finite = F.forall(vector.cast("array<double>"), lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return F.coalesce(finite, F.lit(False))


def floored(vector: Column, scale: int) -> Column:
    """Every component times ``scale``, rounded down."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))).cast("long"))


@dataclass(frozen=True)
class Extent:
    """Rows of a table of integer vectors, the longest one's length and the largest magnitude."""

    rows: int
    width: int
    largest: int


def extent(vectors: DataFrame, column: str = "whole") -> Extent:
    rows, width, low, high = vectors.agg(
        F.count("*"), F.coalesce(F.max(F.size(column)), F.lit(0)), F.coalesce(F.min(F.array_min(column)), F.lit(0)),
        F.coalesce(F.max(F.array_max(column)), F.lit(0))).first()
    largest = max(-low, high)
    if largest >= 1 << 31:
        raise ValueError(f"a scaled component of {largest} is too large: results are sums of products in 64 bits")
    return Extent(rows, width, largest)


def matrix(vectors, width: int, kind=np.int64) -> np.ndarray:
    """Rows of ``width`` components; shorter vectors are filled with zeros."""
    if len(vectors) and all(len(v) == width for v in vectors):
        return np.array([np.asarray(v) for v in vectors], np.int64).reshape(len(vectors), width).astype(kind)
    out = np.zeros((len(vectors), width), np.int64)
    for row, vector in zip(out, vectors, strict=True):
        row[:len(vector)] = vector
    return out.astype(kind)
