"""Signals: drift bases, response shapes, resampling. Small matrices are numpy; rows stay in Spark."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def orthonormal(m: np.ndarray) -> np.ndarray:
    """Orthonormal basis of the columns' span."""
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    return u[:, s > s.max(initial=0) * max(m.shape) * np.finfo(float).eps]


def polynomial_basis(n: int, order: int, tr: float = 1.0) -> np.ndarray:
    t = np.arange(n) * tr
    return orthonormal(t[:, None] ** np.arange(order + 1))


def cosine_basis(n: int, cutoff: float, tr: float) -> np.ndarray:
    """Constant and cosines slower than ``cutoff`` seconds."""
    count = int(2 * n * tr / cutoff + 1)
    k = np.arange(n)[:, None]
    columns = np.cos(math.pi * np.arange(max(1, count - 1)) * (2 * k + 1) / (2 * n)) * math.sqrt(2 / n)
    columns[:, 0] = 1 / math.sqrt(n)
    return orthonormal(columns)


def finite_differences(order: int, size: int) -> np.ndarray:
    """Square matrix of central differences of the given order, zeros beyond the ends."""
    stencil = np.array([1.0])
    for _ in range(order):
        stencil = np.convolve(stencil, [1.0, -1.0])
    out = np.zeros((size, size))
    for i in range(size):
        for j, c in enumerate(stencil):
            k = i + j - order // 2
            if 0 <= k < size:
                out[i, k] = c
    return out


def differenced(signal: Column, order: int) -> Column:
    """``finite_differences(order)`` times an array column of any length, zeros beyond its ends."""
    stencil = [1.0]
    for _ in range(order):
        stencil = [float(a) for a in np.convolve(stencil, [1.0, -1.0])]
    at = lambda i, j: F.when((i + j >= 0) & (i + j < F.size(signal)), F.get(signal, i + j)).otherwise(0.0)
    return F.transform(signal, lambda _, i: sum((at(i, F.lit(j - order // 2)) * c for j, c in enumerate(stencil)), F.lit(0.0)))


def roughness(signal: Column, dt: float, order: int = 2) -> Column:
    """The quadratic form of ``smoothness_precision`` at an array column."""
    return F.aggregate(differenced(signal, order), F.lit(0.0), lambda t, d: t + d * d) / dt ** (2 * order)


def smoothness_precision(size: int, dt: float, order: int = 2) -> np.ndarray:
    d = finite_differences(order, size)
    return d.T @ d / dt ** (2 * order)


def canonical_response(duration: float = 25.0, dt: float = 0.6, peak: float = 6.0, under: float = 16.0, ratio: float = 6.0, unit: bool = True) -> np.ndarray:
    """Difference of two gamma densities, 0 at the end, of unit norm."""
    t = np.arange(0, duration + dt / 2, dt)

    def gamma(shape: float) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.where(t > 0, np.exp((shape - 1) * np.log(np.where(t > 0, t, 1.0)) - t - math.lgamma(shape)), 0.0)

    h = gamma(peak) - gamma(under) / ratio
    h[-1] = 0.0
    return h / np.linalg.norm(h) if unit else h


def response_derivative(duration: float = 25.0, dt: float = 0.6) -> np.ndarray:
    return np.gradient(canonical_response(duration, dt), dt)


def bump_response(t: np.ndarray, peak_at: float = 6, peak: float = 1, peak_width: float = 0.2, under_at: float = 11, under: float = 0.2, under_width: float = 0.01) -> np.ndarray:
    return peak * np.exp(-peak_width * (t - peak_at) ** 2) - under * np.exp(-under_width * (t - under_at) ** 2)


def time_to_peak_and_width(h: np.ndarray, dt: float) -> tuple[float, float]:
    """When the response peaks, and how long it stays above half its peak."""
    top = int(h.argmax())
    half = h[top] / 2
    left = next((i + (half - h[i]) / (h[i + 1] - h[i]) for i in range(top - 1, -1, -1) if h[i] <= half), 0.0)
    right = next((i - 1 + (h[i - 1] - half) / (h[i - 1] - h[i]) for i in range(top + 1, len(h)) if h[i] <= half), float(len(h) - 1))
    return top * dt, (right - left) * dt


def without_trend(df: DataFrame, by: list[str], time: str, value: str) -> DataFrame:
    """Add ``slope``, ``intercept`` and ``residual`` of the least-squares line through each group."""
    fit = df.groupBy(*by).agg(F.regr_slope(value, time).alias("slope"), F.regr_intercept(value, time).alias("intercept"))
    out = df.join(fit, by)
    return out.withColumn("residual", F.col(value) - F.col("slope") * F.col(time) - F.col("intercept"))


def projector(basis: np.ndarray, signal: Column) -> Column:
    """Coefficients of an array column on an orthonormal basis, as an array; one dot product for each column of it."""
    dot = lambda row: F.aggregate(F.zip_with(signal, F.array(*[F.lit(float(x)) for x in row]), lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
    return F.array(*[dot(column) for column in basis.T])


def cosine_coefficients(signal: Column, cutoff: float, tr: float) -> Column:
    """Coefficients of an array column of any length on the columns of ``cosine_basis``, as an array."""
    n = F.size(signal)
    count = F.greatest(F.lit(1), F.floor(2 * n * F.lit(tr / cutoff) + 1).cast("int") - 1)
    wave = lambda k, i: F.when(k == 0, 1 / F.sqrt(n)).otherwise(F.cos(math.pi * k * (2 * i + 1) / (2 * n)) * F.sqrt(F.lit(2.0) / n))
    dot = lambda k: F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda t, i: t + F.get(signal, i) * wave(k, i))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), count - 1), dot)).otherwise(F.array().cast("array<double>"))


def undrifted(df: DataFrame, signal: str, basis: np.ndarray | Callable[[int], np.ndarray]) -> DataFrame:
    """Subtract an array column's projection on the basis, batch by batch; ``basis`` may depend on the signal's length."""
    from pyspark.sql.types import ArrayType, DoubleType

    @F.pandas_udf(ArrayType(DoubleType()))
    def clean(ys: pd.Series) -> pd.Series:
        out = ys.copy()
        lengths = ys.map(lambda y: -1 if y is None else len(y))
        for n in lengths.unique():
            if n > 0:
                own = lengths == n
                y, b = np.stack(ys[own].to_numpy()), basis(int(n)) if callable(basis) else basis
                out[own] = pd.Series(list(y - (y @ b) @ b.T), ys.index[own])
        return out

    return df.withColumn(signal, clean(F.col(signal)))


def resampled(df: DataFrame, by: list[str], time: str, value: str, grid: list[float]) -> DataFrame:
    """(by, time, value): linear interpolation on the grid; beyond the last knot the last segment goes on.

    Each segment makes the grid points that fall in it, so knots and grid are never joined.
    """
    order = Window.partitionBy(*by).orderBy(time)
    seg = df.select(*by, F.col(time).alias("t0"), F.col(value).alias("v0"), F.lead(time).over(order).alias("t1"), F.lead(value).over(order).alias("v1"), F.lead(time, 2).over(order).alias("t2"), F.lag(time).over(order).alias("tp"))
    seg = seg.filter("t1 IS NOT NULL AND t1 > t0")
    points = F.filter(F.array(*[F.lit(float(g)) for g in grid]), lambda g: ((g >= F.col("t0")) | F.col("tp").isNull()) & ((g < F.col("t1")) | F.col("t2").isNull()))
    out = seg.withColumn("g", F.explode(points))
    line = F.col("v0") + (F.col("g") - F.col("t0")) * (F.col("v1") - F.col("v0")) / (F.col("t1") - F.col("t0"))
    return out.select(*by, F.col("g").alias(time), line.alias(value))


def gaussian_kernel(width: int) -> np.ndarray:
    x = np.arange(-width, width + 1)
    k = np.exp(-(x**2) / max(width, 1))
    return k / k.sum()


def blurred(df: DataFrame, by: list[str], time: str, value: str, width: int) -> DataFrame:
    """Convolution with the Gaussian kernel where it fits wholly; ``time`` counts whole steps."""
    kernel = F.array(*[F.struct(F.lit(i - width).alias("o"), F.lit(float(k)).alias("k")) for i, k in enumerate(gaussian_kernel(width))])
    spread = df.select(*by, time, value, F.explode(kernel).alias("e")).select(*by, (F.col(time) + F.col("e.o")).alias(time), (F.col(value) * F.col("e.k")).alias("c"))
    return spread.groupBy(*by, time).agg(F.sum("c").alias(value), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == 2 * width + 1).drop("_n")


def convolved(df: DataFrame, by: list[str], time: str, value: str, kernel: np.ndarray) -> DataFrame:
    """Each row's value spread by the kernel over its step and those after it, added up at every step reached. ``time`` counts whole
    steps; values without a time stay without one.

    Values of a step are added up first. A step then makes those up to the next one that has values, from the steps that the kernel
    still reaches, so no row is copied for each weight before a shuffle or a grouping, and a window's group has a row a step at most.
    """
    weights, last = F.array(*[F.lit(float(k)) for k in kernel]), len(kernel) - 1
    own = Window.partitionBy(*by).orderBy(time)
    recent = F.collect_list(F.struct(F.col(time).alias("t"), F.col(value).alias("v"))).over(own.rangeBetween(-last, 0))
    steps = df.groupBy(*by, time).agg(F.sum(value).alias(value))
    rows = steps.select(*by, time, value, recent.alias("_recent"), F.least(F.col(time) + last, F.lead(time).over(own) - 1).alias("_end"))
    # a weight beyond the kernel's end is null
    total = lambda t: F.aggregate("_recent", F.lit(0.0), lambda s, r: s + F.coalesce(r["v"] * F.get(weights, (t - r["t"]).cast("int")), F.lit(0.0)))
    step = lambda t, v: F.struct(t.alias("t"), v.alias("v"))
    timeless = F.array(step(F.col(time), F.col(value) * float(sum(kernel))))
    made = F.when(F.col(time).isNull(), timeless).otherwise(F.transform(F.sequence(time, "_end"), lambda t: step(t, total(t))))
    return rows.select(*by, F.explode(made).alias("_s")).select(*by, F.col("_s.t").alias(time), F.col("_s.v").alias(value))


def resampled_signal(signal: Column, factor: int) -> Column:
    """An array column on a grid ``factor`` times finer, from its first to before its last entry, by linear interpolation."""
    at = F.sequence(F.lit(0), F.size(signal) * 0 + (F.size(signal) - 1) * factor - 1)
    low = lambda i: F.floor(i / F.lit(factor)).cast("int")
    part = lambda i: (i % F.lit(factor)) / F.lit(float(factor))
    line = lambda i: F.get(signal, low(i)) + (F.coalesce(F.get(signal, low(i) + 1), F.lit(0.0)) - F.get(signal, low(i))) * part(i)
    return F.when(F.size(signal) > 1, F.transform(at, line)).otherwise(F.array().cast("array<double>"))


def closest(values: Column, x: Column) -> Column:
    """Place (from 0) in a sorted array column of the entry nearest to ``x``, ties to the later one."""
    far = F.transform(values, lambda v: F.abs(v - x))
    n = F.size(values)
    return n - F.array_position(F.reverse(far), F.array_min(far)).cast("int")
