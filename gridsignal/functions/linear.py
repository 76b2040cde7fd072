"""Small dense linear algebra on array columns, inside Spark's expressions: no Python worker, no row moves.

A vector is an array of doubles, a matrix an array of rows. Systems are those of a regression's few columns.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(values: np.ndarray) -> Column:
    return F.array(*[F.lit(float(x)) for x in values]) if len(values) else F.array().cast("array<double>")


def matrix(values: np.ndarray) -> Column:
    return F.array(*[vector(row) for row in values])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


def product(m: Column, v: Column) -> Column:
    """A matrix by a vector."""
    return F.transform(m, lambda row: dot(row, v))


def scaled(v: Column, w: Column) -> Column:
    return F.transform(v, lambda x: x * w)


def combined(parts: list[tuple[Column, Column]]) -> Column:
    """Sum of vectors times numbers."""
    out = scaled(parts[0][1], parts[0][0])
    for w, v in parts[1:]:
        out = F.zip_with(out, scaled(v, w), lambda x, y: x + y)
    return out


def combined_matrices(parts: list[tuple[Column, Column]]) -> Column:
    """Sum of matrices times numbers."""
    out: Column | None = None
    for w, m in parts:
        own = _rows_scaled(m, w)
        out = own if out is None else F.zip_with(out, own, lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return out


def _rows_scaled(m: Column, w: Column) -> Column:
    return F.transform(m, lambda row: scaled(row, w))


def inverse(m: Column, size: int) -> Column:
    """Of a symmetric positive definite matrix with ``size`` rows, by elimination."""
    unit = [vector(np.eye(size)[i]) for i in range(size)]
    wide = F.transform(m, lambda row, i: F.concat(row, F.element_at(F.array(*unit), (i + 1).cast("int"))))

    def eliminate(now: Column, k: Column) -> Column:
        pivot = F.element_at(now, (k + 1).cast("int"))
        own = F.transform(pivot, lambda x: x / F.element_at(pivot, (k + 1).cast("int")))
        return F.transform(now, lambda row, i: F.when(i == k, own).otherwise(F.zip_with(row, own, lambda x, y: x - F.element_at(row, (k + 1).cast("int")) * y)))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), wide, eliminate)
    return F.transform(done, lambda row: F.slice(row, size + 1, size))
