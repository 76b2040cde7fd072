"""Region-wise model fits: split by parcel, estimate in one task each, results as rows.

A signal is a row ``(parcel, voxel, y array<double>)``. Estimators are numpy functions on one parcel's voxels; a parcel's
size is bounded (split larger ones first), the number of parcels is not. ``fit_parcels`` runs any of them and keeps
failures as reports. The linear model needs no grouping: its small solution matrix goes to the rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsignal.functions import linear
from gridsignal.functions.signal import smoothness_precision

OUTPUT = "parcel long, name string, voxel long, condition string, at double, value double, report string"


def _cells(parcel: int, voxel: int | None, pass_error: bool, estimate: Callable, *args) -> list[tuple]:
    """Rows of OUTPUT of one estimate, or its error as a report."""
    try:
        return [(parcel, name, *cell, "ok") for name, cells in estimate(*args).items() for cell in cells]
    except Exception as error:
        if not pass_error:
            raise
        return [(parcel, None, voxel, None, None, None, f"{type(error).__name__}: {error}")]


def _frame(out: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])
    return frame.astype({"voxel": "Int64", "at": "float64", "value": "float64"})


def fit_parcels(signals: DataFrame, estimate: Callable[..., dict], by: str = "parcel", pass_error: bool = True, edges: DataFrame | None = None) -> DataFrame:
    """Rows (columns of OUTPUT) of what ``estimate(voxels, y, seed)`` returns for each parcel.

    It returns {name: list of (voxel or None, condition or None, at or None, value)}. A parcel that fails gives one row
    with the error as its report, unless ``pass_error`` is false. The seed depends on the parcel only. With ``edges``
    (``by``, src, dst), a parcel's own edges come to its task and are the estimator's fourth argument.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return fitted(key, rows)

    def run_linked(key: tuple, rows: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        return fitted(key, rows, list(zip(links["src"].tolist(), links["dst"].tolist(), strict=True)))

    def fitted(key: tuple, rows: pd.DataFrame, *links: list[tuple[int, int]]) -> pd.DataFrame:
        if rows.empty:
            return _frame([])
        parcel = int(key[0])
        rows = rows.sort_values("voxel")
        fit = lambda: estimate(rows["voxel"].to_numpy(), np.stack(rows["y"].to_numpy()).astype(float), zlib.crc32(str(parcel).encode()), *links)
        return _frame(_cells(parcel, None, pass_error, fit))

    if edges is None:
        return signals.groupBy(by).applyInPandas(run, OUTPUT)
    return signals.groupBy(by).cogroup(edges.groupBy(by)).applyInPandas(run_linked, OUTPUT)


def fit_voxels(signals: DataFrame, estimate: Callable[[np.ndarray, np.ndarray, int], dict], pass_error: bool = True) -> DataFrame:
    """As ``fit_parcels``, for estimators that treat each voxel alone: no row moves, and a failure is one voxel's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for parcel, voxel, y in zip(rows["parcel"], rows["voxel"], rows["y"], strict=True):
                fit = lambda: estimate(np.array([voxel]), np.asarray(y, float)[None], zlib.crc32(str(voxel).encode()))  # noqa: B023, E731
                out += _cells(int(parcel), int(voxel), pass_error, fit)
            yield _frame(out)

    return signals.select("parcel", "voxel", "y").mapInPandas(run, OUTPUT)


def without_crashed(results: DataFrame) -> DataFrame:
    return results.filter((F.col("report") == "ok") & F.col("value").isNotNull())


# linear model


def design_matrix(active: dict[str, np.ndarray], response: np.ndarray, drift: np.ndarray, step: int = 1) -> tuple[np.ndarray, list[str]]:
    """Conditions' grids convolved with the response, sampled every ``step`` bins, and the drift's columns."""
    n = len(drift)
    names = sorted(active)
    columns = [np.convolve(active[c], response)[::step][:n] for c in names]
    return np.column_stack([*columns, drift]), names + [f"drift{i}" for i in range(drift.shape[1])]


def glm(signals: DataFrame, design: np.ndarray, contrasts: dict[str, np.ndarray] | None = None, signal: str = "y") -> DataFrame:
    """Add beta (array), s2 and, for each contrast, effect_*, var_* and t_* by ordinary least squares.

    The solution matrix is small and part of the task; no row moves. Constant and wrong-length signals give what the
    algebra gives; a null signal gives nulls.
    """
    solve = np.linalg.pinv(design)
    free = design.shape[0] - np.linalg.matrix_rank(design)
    unscaled = solve @ solve.T
    vectors = {k: np.asarray(v, float) for k, v in (contrasts or {}).items()}
    fields = ", ".join(["beta: array<double>", "s2: double", *[f"{p}_{k}: double" for k in vectors for p in ("effect", "var", "t")]])

    @F.pandas_udf(f"struct<{fields.replace(', ', ',').replace(': ', ':')}>")
    def fit(ys: pd.Series) -> pd.DataFrame:
        y = np.stack([np.full(len(design), np.nan) if v is None else np.asarray(v, float) for v in ys]) if len(ys) else np.zeros((0, len(design)))
        beta = y @ solve.T
        s2 = ((y - beta @ design.T) ** 2).sum(1) / max(free, 1)
        out = {"beta": list(beta), "s2": s2}
        for k, c in vectors.items():
            effect, var = beta @ c, s2 * float(c @ unscaled @ c)
            out |= {f"effect_{k}": effect, f"var_{k}": var, f"t_{k}": effect / np.sqrt(np.maximum(var, 1e-300))}
        return pd.DataFrame(out)

    return signals.withColumn("_fit", fit(F.col(signal))).select("*", "_fit.*").drop("_fit")


def glm_ar1(signals: DataFrame, design: np.ndarray, contrasts: dict[str, np.ndarray] | None = None, signal: str = "y") -> DataFrame:
    """Add rho, beta (array), s2 and, for each contrast, effect_*, var_* and t_*, with residuals that follow AR(1).

    A first fold over the signal array gives the least-squares levels and the residuals' correlation at lag one, rho. Rows
    are then whitened (the first by sqrt(1 - rho^2)). The whitened normal equations are quadratic in rho, so the sums that
    they need are dot products of the signal with three fixed matrices, and nothing is fitted in Python. The design is
    a table of one row beside the signals. A signal of another length than the design, or one that the design
    explains wholly, has rho 0 or nulls as the algebra gives them; a null signal gives nulls.
    """
    x = np.asarray(design, float)
    n, p = x.shape
    before, after = np.vstack([np.zeros((1, p)), x[:-1]]), np.vstack([x[1:], np.zeros((1, p))])
    ends = x.copy()
    ends[-1] = 0.0
    ends[0] -= x[0]
    # of the sums over t of x_t x_t', of both products at lag one, and of those that rho^2 multiplies
    grams = [x.T @ x, x.T @ before + before.T @ x, x.T @ ends]
    tables = [x.T, (before + after).T, ends.T]
    spark = signals.sparkSession
    names = ["_x", "_lag", "_end", "_gram0", "_gram1", "_gram2", "_solve"]
    fixed = [[[float(v) for v in row] for row in m] for m in (*tables, *grams, np.linalg.pinv(x.T @ x))]
    one = F.broadcast(spark.createDataFrame([tuple(fixed)], ", ".join(f"{c} array<array<double>>" for c in names)))  # one row

    y = F.col("_y")
    out = signals.crossJoin(one).withColumn("_y", F.col(signal).cast("array<double>"))
    out = out.withColumn("_a", linear.product(F.col("_x"), y)).withColumn("_b", linear.product(F.col("_lag"), y)).withColumn("_c", linear.product(F.col("_end"), y))
    level = linear.product(F.col("_solve"), F.col("_a"))
    out = out.withColumn("_ols", level)
    fitted = F.aggregate(F.sequence(F.lit(1), F.lit(p)), F.transform(y, lambda v: v), lambda rest, j: F.zip_with(rest, F.element_at("_x", j), lambda r, v: r - v * F.element_at("_ols", j)))
    out = out.withColumn("_r", fitted)
    lagged = linear.dot(F.slice("_r", 1, n - 1), F.slice("_r", 2, n - 1)) if n > 1 else F.lit(0.0)
    power = linear.dot(F.col("_r"), F.col("_r"))
    out = out.withColumn("rho", F.when(power > 0, lagged / F.when(power > 0, power)).otherwise(F.when(y.isNotNull(), 0.0)))
    rho = F.col("rho")
    weights = [F.lit(1.0), -rho, rho * rho]
    out = out.withColumn("_inv", linear.inverse(linear.combined_matrices([(w, F.col(f"_gram{k}")) for k, w in enumerate(weights)]), p))
    out = out.withColumn("_rhs", linear.combined(list(zip(weights, [F.col("_a"), F.col("_b"), F.col("_c")], strict=True))))
    out = out.withColumn("beta", F.when(y.isNotNull(), linear.product(F.col("_inv"), F.col("_rhs"))))
    # residuals of the whitened rows, from the signal's own
    rest = F.aggregate(F.sequence(F.lit(1), F.lit(p)), F.transform(y, lambda v: v), lambda have, j: F.zip_with(have, F.element_at("_x", j), lambda r, v: r - v * F.element_at("beta", j)))
    out = out.withColumn("_e", rest)
    white = F.zip_with(F.slice("_e", 2, n), F.slice("_e", 1, n - 1), lambda u, v: (u - rho * v) * (u - rho * v))
    first = F.get("_e", F.lit(0))
    squares = F.aggregate(white, (F.lit(1.0) - rho * rho) * first * first, lambda t, v: t + v)
    out = out.withColumn("s2", squares / max(n - int(np.linalg.matrix_rank(x)), 1))
    for name, c in (contrasts or {}).items():
        w = linear.vector(np.asarray(c, float))
        effect, var = linear.dot(F.col("beta"), w), F.col("s2") * linear.dot(w, linear.product(F.col("_inv"), w))
        out = out.withColumn(f"effect_{name}", effect).withColumn(f"var_{name}", var).withColumn(f"t_{name}", effect / F.sqrt(F.greatest(var, F.lit(1e-300))))
    return out.drop("_y", "_a", "_b", "_c", "_ols", "_r", "_inv", "_rhs", "_e", *names)


# regularised finite impulse response


def rfir(onsets: np.ndarray, drift: np.ndarray, dt: float, n_iterations: int = 50, tolerance: float = 1e-5) -> Callable:
    """Estimator of each voxel's response to each condition.

    ``onsets``: conditions x scans x lags. Each response has a smoothness prior; noise and prior variances follow by
    expectation-maximisation, voxel by voxel.
    """
    conditions, scans, lags = onsets.shape
    x = onsets.transpose(1, 0, 2).reshape(scans, conditions * lags)
    clean = np.eye(scans) - drift @ np.linalg.pinv(drift)
    x = clean @ x
    precision = smoothness_precision(lags, dt) + 1e-8 * np.eye(lags)
    prior = np.kron(np.eye(conditions), precision / np.trace(precision) * lags)
    gram = x.T @ x

    def estimate(voxels: np.ndarray, y: np.ndarray, seed: int) -> dict:
        cells, noise = [], []
        for voxel, own in zip(voxels, y @ clean.T, strict=True):
            s2, tau = max(own.var(), 1e-12), 1.0
            h = np.zeros(conditions * lags)
            for _ in range(n_iterations):
                cov = np.linalg.inv(gram / s2 + prior / tau)
                new = cov @ (x.T @ own) / s2
                rest = own - x @ new
                s2 = max((rest @ rest + np.sum(gram * cov)) / scans, 1e-12)
                tau = max((new @ prior @ new + np.sum(prior * cov)) / len(new), 1e-12)
                if np.linalg.norm(new - h) <= tolerance * (np.linalg.norm(h) + 1e-12):
                    break
                h = new
            cells += [(int(voxel), str(m), lag * dt, float(v)) for m in range(conditions) for lag, v in enumerate(new.reshape(conditions, lags)[m])]
            noise.append((int(voxel), None, None, float(s2)))
        return {"hrf": cells, "noise_var": noise}

    return estimate


# joint detection and estimation


def neighbours_of(edges: list[tuple[int, int]], voxels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of both ends of a parcel's edges, each edge in both directions once, by the first end."""
    at = {int(v): i for i, v in enumerate(voxels)}
    pairs = {p for a, b in edges if a in at and b in at for p in ((at[a], at[b]), (at[b], at[a]))}
    ends = np.array(sorted(pairs), int).reshape(-1, 2)
    return ends[:, 0], ends[:, 1]


class Parcel:
    """What the two joint estimators share: cleaned onsets, drift, prior of the response."""

    def __init__(self, onsets: np.ndarray, drift: np.ndarray, dt: float):
        self.onsets, self.drift, self.dt = onsets, drift, dt
        self.m, self.n, self.d = onsets.shape
        precision = smoothness_precision(self.d, dt) + 1e-6 * np.eye(self.d)
        self.prior = precision / np.trace(precision) * self.d
        self.back = drift @ np.linalg.pinv(drift)

    def start(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Response (unit norm), levels, noise and trend to begin with."""
        from gridsignal.functions.signal import canonical_response

        h = np.resize(canonical_response((self.d - 1) * self.dt, self.dt), self.d)
        h /= np.linalg.norm(h)
        s = np.stack([x @ h for x in self.onsets], 1)
        clean = y - y @ self.back.T
        a = clean @ np.linalg.pinv(s - self.back @ s).T
        trend = (y - a @ s.T) @ self.back.T
        return h, a, np.maximum((y - trend - a @ s.T).var(1), 1e-9), trend


def variational_jde(onsets: np.ndarray, drift: np.ndarray, dt: float, edges: list[tuple[int, int]], beta: float = 0.8, n_max: int = 100, n_min: int = 5, tolerance: float = 1e-4) -> Callable:
    """Estimator of a parcel's response, its voxels' levels and activation probabilities by variational EM.

    Levels follow a two-class mixture (the inactive class has mean 0); classes have a Potts prior over the neighbours,
    taken in mean field. The response is kept at unit norm, the levels carry the scale.
    """
    model = Parcel(onsets, drift, dt)

    def estimate(voxels: np.ndarray, y: np.ndarray, seed: int, links: list[tuple[int, int]] = edges) -> dict:
        ends, near = neighbours_of(links, voxels)
        h, a, noise, trend = model.start(y)
        cov_h = np.zeros((model.d, model.d))
        q = np.full((*a.shape, 2), 0.5)
        mean = np.zeros((model.m, 2))
        mean[:, 1] = np.maximum(a, 0).mean(0) + a.std(0)
        var = np.maximum(np.stack([a.var(0)] * 2, 1) / 2, 1e-6)
        sigma_h, last = 1.0, None
        for step in range(n_max):
            rest = y - trend
            s = np.stack([x @ h for x in onsets], 1)
            cross = np.einsum("mnd,knd->mk", onsets @ cov_h, onsets)
            weight = q / var[None]
            # levels
            precision = (s.T @ s + cross)[None] / noise[:, None, None] + np.einsum("vm,mk->vmk", weight.sum(2), np.eye(model.m))
            cov_a = np.linalg.inv(precision)
            a = np.einsum("vmk,vk->vm", cov_a, rest @ s / noise[:, None] + (weight * mean[None]).sum(2))
            second = cov_a + np.einsum("vm,vk->vmk", a, a)
            # classes
            around = np.zeros_like(q)
            np.add.at(around, ends, q[near])
            log_q = -0.5 * np.log(var)[None] - 0.5 * ((a[:, :, None] - mean[None]) ** 2 + np.diagonal(cov_a, axis1=1, axis2=2)[:, :, None]) / var[None] + beta * around
            q = np.exp(log_q - log_q.max(2, keepdims=True))
            q = np.maximum(q / q.sum(2, keepdims=True), 1e-12)
            # response, back to unit norm
            shape = h
            gram = np.einsum("mk,mnd,kne->de", np.einsum("vmk,v->mk", second, 1 / noise), onsets, onsets, optimize=True)
            cov_h = np.linalg.inv(gram + model.prior / sigma_h)
            h = cov_h @ np.einsum("mnd,mn->d", onsets, np.einsum("vm,vn,v->mn", a, rest, 1 / noise))
            sigma_h = max((h @ model.prior @ h + np.sum(model.prior * cov_h)) / model.d, 1e-9)
            norm = np.linalg.norm(h) * (1 if h[np.abs(h).argmax()] > 0 else -1)
            if abs(norm) < 1e-6:
                # no response in the data: keep the last shape
                h, free = shape, last if last is not None else 0.0
                break
            h, cov_h, a, second, cov_a = h / norm, cov_h / norm**2, a * norm, second * norm**2, cov_a * norm**2
            # mixture, drift, noise
            mass = q.sum(0)
            mean = (q * a[:, :, None]).sum(0) / mass
            mean[:, 0] = 0.0
            var = np.maximum((q * ((a[:, :, None] - mean[None]) ** 2 + np.diagonal(cov_a, axis1=1, axis2=2)[:, :, None])).sum(0) / mass, 1e-8)
            s = np.stack([x @ h for x in onsets], 1)
            trend = (y - a @ s.T) @ model.back.T
            left = y - trend - a @ s.T
            extra = np.einsum("vmk,mk->v", cov_a, s.T @ s)
            noise = np.maximum(((left**2).sum(1) + extra) / model.n, 1e-9)
            free = -0.5 * model.n * np.log(noise).sum() - (q * np.log(q)).sum() + 0.5 * np.linalg.slogdet(cov_a)[1].sum()
            if last is not None and step >= n_min and abs(free - last) <= tolerance * abs(last):
                break
            last = free
        names = [str(m) for m in range(model.m)]
        ids = [int(v) for v in voxels]
        grid = [(i, v, k, c) for i, v in enumerate(ids) for k, c in enumerate(names)]
        return {
            "hrf": [(None, None, lag * dt, float(x)) for lag, x in enumerate(h)],
            "nrl": [(v, c, None, float(a[i, k])) for i, v, k, c in grid],
            "active": [(v, c, None, float(q[i, k, 1])) for i, v, k, c in grid],
            "noise_var": [(v, None, None, float(noise[i])) for i, v in enumerate(ids)],
            "class_mean": [(None, c, float(j), float(mean[k, j])) for k, c in enumerate(names) for j in (0, 1)],
            "class_var": [(None, c, float(j), float(var[k, j])) for k, c in enumerate(names) for j in (0, 1)],
            "free_energy": [(None, None, float(step), float(free))],
        }

    return estimate


def gibbs_jde(onsets: np.ndarray, drift: np.ndarray, dt: float, edges: list[tuple[int, int]], beta: float = 0.8, n_iterations: int = 300) -> Callable:
    """The same model by Gibbs sampling; posterior means after a third of the sweeps as burn-in."""
    model = Parcel(onsets, drift, dt)

    def estimate(voxels: np.ndarray, y: np.ndarray, seed: int, links: list[tuple[int, int]] = edges) -> dict:
        rng = np.random.default_rng(seed)
        ends, other = neighbours_of(links, voxels)
        near = np.split(other, np.searchsorted(ends, np.arange(1, len(voxels))))
        h, a, noise, trend = model.start(y)
        middle = (a.max(0) + a.min(0)) / 2
        labels = (a > middle).astype(int)
        mean, var = np.zeros((model.m, 2)), np.ones((model.m, 2))
        for k in range(model.m):
            mean[k, 1] = a[labels[:, k] == 1, k].mean()
            for z in (0, 1):
                own = a[labels[:, k] == z, k]
                # wide enough for the first sweeps to move the means
                var[k, z] = max(((own - mean[k, z]) ** 2).mean() if len(own) else 1.0, a[:, k].var() / 10, 1e-3)
        sigma_h = 1.0
        total = {"h": np.zeros(model.d), "a": np.zeros_like(a), "z": np.zeros(a.shape), "noise": np.zeros(len(y))}
        kept, burn = 0, n_iterations // 3
        for sweep in range(n_iterations):
            rest = y - trend
            s = np.stack([x @ h for x in onsets], 1)
            power = (s * s).sum(0)
            for k in range(model.m):
                own = rest - a @ s.T + np.outer(a[:, k], s[:, k])
                for i in range(len(y)):
                    c = own[i] @ s[:, k] / noise[i]
                    logs, draws = np.empty(2), np.empty((2, 2))
                    for z in (0, 1):
                        v = 1 / (power[k] / noise[i] + 1 / var[k, z])
                        m = v * (c + mean[k, z] / var[k, z])
                        logs[z] = 0.5 * np.log(v / var[k, z]) + 0.5 * m * m / v - 0.5 * mean[k, z] ** 2 / var[k, z] + beta * (labels[near[i], k] == z).sum()
                        draws[z] = m, v
                    z = int(rng.random() < 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500))))
                    labels[i, k] = z
                    a[i, k] = draws[z, 0] + np.sqrt(draws[z, 1]) * rng.standard_normal()
            gram = np.einsum("mk,mnd,kne->de", np.einsum("vm,vk,v->mk", a, a, 1 / noise), onsets, onsets, optimize=True)
            cov = np.linalg.inv(gram + model.prior / sigma_h)
            h = rng.multivariate_normal(cov @ np.einsum("mnd,mn->d", onsets, np.einsum("vm,vn,v->mn", a, rest, 1 / noise)), (cov + cov.T) / 2)
            sigma_h = (h @ model.prior @ h / 2) / max(rng.gamma(model.d / 2 + 1), 1e-9) + 1e-9
            norm = np.linalg.norm(h) * (1 if h[np.abs(h).argmax()] > 0 else -1)
            h, a, mean, var = h / norm, a * norm, mean * norm, var * norm**2
            for k in range(model.m):
                for z in (0, 1):
                    own = a[labels[:, k] == z, k]
                    spread = ((own - mean[k, z]) ** 2).sum()
                    var[k, z] = (spread / 2 + 0.1) / max(rng.gamma(len(own) / 2 + 2), 1e-9)
                    if z:
                        v = 1 / (len(own) / var[k, 1] + 1 / 100)
                        mean[k, 1] = v * own.sum() / var[k, 1] + np.sqrt(v) * rng.standard_normal()
            s = np.stack([x @ h for x in onsets], 1)
            trend = (y - a @ s.T) @ model.back.T
            left = y - trend - a @ s.T
            noise = np.maximum((left**2).sum(1) / 2 / np.maximum(rng.gamma(model.n / 2, size=len(y)), 1e-9), 1e-9)
            if sweep >= burn:
                kept += 1
                for name, now in (("h", h), ("a", a), ("z", labels), ("noise", noise)):
                    total[name] += now
        means = {k: v / kept for k, v in total.items()}
        ids, names = [int(v) for v in voxels], [str(m) for m in range(model.m)]
        return {
            "hrf": [(None, None, lag * dt, float(x)) for lag, x in enumerate(means["h"] / np.linalg.norm(means["h"]))],
            "nrl": [(v, c, None, float(means["a"][i, k])) for i, v in enumerate(ids) for k, c in enumerate(names)],
            "active": [(v, c, None, float(means["z"][i, k])) for i, v in enumerate(ids) for k, c in enumerate(names)],
            "noise_var": [(v, None, None, float(means["noise"][i])) for i, v in enumerate(ids)],
        }

    return estimate
