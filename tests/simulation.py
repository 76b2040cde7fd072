"""Simulated signals with known truth."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from gridsignal.functions.signal import canonical_response, polynomial_basis


@dataclass
class Simulation:
    signals: DataFrame
    onsets: np.ndarray
    drift: np.ndarray
    response: np.ndarray
    levels: np.ndarray
    labels: np.ndarray
    edges: list[tuple[int, int]]
    dt: float


def potts_field(edges: list[tuple[int, int]], n: int, beta: float, rng: np.random.Generator, sweeps: int = 30, labels: int = 2) -> np.ndarray:
    """A Potts field by cluster flips: equal neighbours stick with probability 1 - exp(-beta), clusters draw new labels."""
    z = rng.integers(0, labels, n)
    for _ in range(sweeps):
        root = np.arange(n)

        def find(i: int, root: np.ndarray = root) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for a, b in edges:
            if z[a] == z[b] and rng.random() < 1 - np.exp(-beta):
                root[find(a)] = find(b)
        z = rng.integers(0, labels, n)[[find(i) for i in range(n)]]
    return z


def grid_edges(rows: int, cols: int) -> list[tuple[int, int]]:
    at = np.arange(rows * cols).reshape(rows, cols)
    return [(int(a), int(b)) for x, y in ((at[:, :-1], at[:, 1:]), (at[:-1], at[1:])) for a, b in zip(x.ravel(), y.ravel(), strict=True)]


def onset_arrays(rng: np.random.Generator, conditions: int, scans: int, lags: int, step: int, gap: float = 6.0) -> np.ndarray:
    """conditions x scans x lags: X[scan, lag] = bin(scan x step - lag) of random onsets."""
    out = np.zeros((conditions, scans, lags))
    for m in range(conditions):
        bins = np.zeros(scans * step)
        at = np.unique(np.cumsum(rng.exponential(gap * step, scans)).astype(int))
        bins[at[at < len(bins)]] = 1
        for lag in range(lags):
            at = np.arange(scans) * step - lag
            out[m, at >= 0, lag] = bins[at[at >= 0]]
    return out


def ar_noise(rng: np.random.Generator, shape: tuple[int, int], variance: float, coefficients: tuple[float, ...] = ()) -> np.ndarray:
    e = rng.standard_normal(shape) * np.sqrt(variance)
    for t in range(1, shape[1]):
        for k, c in enumerate(coefficients, 1):
            if t >= k:
                e[:, t] += c * e[:, t - k]
    return e


def simulate(spark: SparkSession, side: int = 6, conditions: int = 2, scans: int = 120, tr: float = 1.0, dt: float = 0.5, duration: float = 12.0, active_mean: float = 6.0, noise: float = 0.2, parcels: int = 1, seed: int = 1) -> Simulation:
    """``parcels`` copies of the scenario with their own noise: y = sum of level x (onsets * response) + drift + noise."""
    rng = np.random.default_rng(seed)
    response = canonical_response(duration, dt)
    onsets = onset_arrays(rng, conditions, scans, len(response), round(tr / dt))
    edges = grid_edges(side, side)
    labels = np.stack([potts_field(edges, side * side, 0.6, rng) for _ in range(conditions)], 1)
    levels = np.where(labels == 1, active_mean + rng.standard_normal(labels.shape) * 0.5, rng.standard_normal(labels.shape) * 0.5)
    drift = polynomial_basis(scans, 3, tr)
    shape = np.stack([x @ response for x in onsets], 1)
    rows = []
    for p in range(parcels):
        y = levels @ shape.T + rng.standard_normal((side * side, drift.shape[1])) @ drift.T * 3 + ar_noise(rng, (side * side, scans), noise)
        rows += [(p + 1, v, [float(x) for x in own]) for v, own in enumerate(y)]
    return Simulation(spark.createDataFrame(rows, "parcel long, voxel long, y array<double>"), onsets, drift, response, levels, labels, edges, dt)
