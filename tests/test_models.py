import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridsignal.operators import models
from tests.simulation import simulate
from gridsignal.plans import model_queries


@pytest.fixture(scope="module")
def truth(spark):
    return simulate(spark, parcels=2)


def values(frame, name):
    return frame[frame["name"] == name]


def test_glm_recovers_levels(truth):
    shape = np.stack([x @ truth.response for x in truth.onsets], 1)
    design = np.column_stack([shape, truth.drift])
    contrast = np.zeros(design.shape[1])
    contrast[:2] = 1, -1
    got = models.glm(truth.signals.filter("parcel = 1"), design, {"diff": contrast}).orderBy("voxel").toPandas()
    beta = np.stack(got["beta"].to_numpy())[:, :2]
    assert np.abs(beta - truth.levels).max() < 0.6
    assert np.allclose(got["effect_diff"], beta[:, 0] - beta[:, 1])
    assert got["s2"].mean() == pytest.approx(0.2, rel=0.15)


@pytest.mark.parametrize("kind", ["vem", "gibbs"])
def test_joint_estimation_recovers_truth(truth, kind):
    make = models.variational_jde if kind == "vem" else lambda *a: models.gibbs_jde(*a, n_iterations=60)
    fit = make(truth.onsets, truth.drift, truth.dt, truth.edges)
    got = models.without_crashed(models.fit_parcels(truth.signals, fit)).toPandas()
    assert set(got["parcel"]) == {1, 2}
    one = got[got["parcel"] == 1]
    h = values(one, "hrf").sort_values("at")["value"].to_numpy()
    assert np.abs(h - truth.response).max() < 0.1
    nrl = values(one, "nrl").pivot(index="voxel", columns="condition", values="value").to_numpy()
    assert np.abs(nrl - truth.levels).mean() < 0.4
    active = values(one, "active").pivot(index="voxel", columns="condition", values="value").to_numpy() > 0.5
    assert (active == (truth.labels == 1)).mean() > 0.95


def test_rfir_recovers_responses(truth):
    fit = models.rfir(truth.onsets, truth.drift, truth.dt)
    voxel = int(np.flatnonzero((truth.labels == 1).all(1))[0]) if (truth.labels == 1).all(1).any() else int(truth.levels.sum(1).argmax())
    rows = truth.signals.filter((F.col("parcel") == 1) & (F.col("voxel") == voxel))
    got = models.fit_parcels(rows, fit).toPandas()
    hrf = values(got, "hrf").pivot(index="at", columns="condition", values="value").to_numpy()
    expected = truth.response[:, None] * truth.levels[voxel]
    assert np.abs(hrf - expected).max() < 0.25 * np.abs(expected).max() + 0.3


def test_failures_become_reports_and_partitions_do_not_matter(truth):
    def broken(voxels, y, seed):
        if seed % 2:
            raise ValueError("no")
        return {"mean": [(int(v), None, None, float(m)) for v, m in zip(voxels, y.mean(1), strict=True)]}

    parcels = truth.signals.filter("parcel = 1").withColumn("parcel", F.col("voxel") % 5)
    a = models.fit_parcels(parcels.repartition(1), broken).toPandas().sort_values(["parcel", "voxel"]).reset_index(drop=True)
    b = models.fit_parcels(parcels.repartition(7), broken).toPandas().sort_values(["parcel", "voxel"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b)
    assert {"ok", "ValueError: no"} >= set(a["report"])


def test_edges_come_to_their_parcel(spark):
    # levels near the noise, so that neighbours matter
    truth = simulate(spark, parcels=2, active_mean=1.0, noise=20.0)
    for make in (models.variational_jde, lambda *a: models.gibbs_jde(*a, n_iterations=6)):
        edges = spark.createDataFrame([(p, a, b) for p in (1, 2) for a, b in truth.edges], "parcel long, src long, dst long")
        alone, apart = make(truth.onsets, truth.drift, truth.dt, truth.edges), make(truth.onsets, truth.drift, truth.dt, [])
        by = ["parcel", "name", "voxel", "condition", "at"]
        a, b, c = (f.toPandas().sort_values(by).reset_index(drop=True) for f in (models.fit_parcels(truth.signals, alone), models.fit_parcels(truth.signals, apart, edges=edges), models.fit_parcels(truth.signals, apart)))
        pd.testing.assert_frame_equal(a, b)
        assert set(a["report"]) == {"ok"} and not values(a, "active")["value"].equals(values(c, "active")["value"])


def test_parcels_of_users_are_bounded(spark, tmp_path):
    ts = F.timestamp_seconds(F.lit(19723 * 86400) + F.pmod(F.xxhash64("id"), F.lit(30 * 86400)))
    kind = F.when(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)) == 0, "click").otherwise("view")
    spark.range(9030).select(F.col("id").alias("event_id"), (F.col("id") % 903 * 7).alias("user_id"), kind.alias("event_type"), ts.alias("ts"), F.lit(1.0).alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    fits = model_queries.rfir(spark, str(tmp_path)).filter("name = 'noise_var'").toPandas()
    assert sorted(fits["voxel"]) == [7 * i for i in range(903)]
    assert set(fits.groupby("parcel").size()) <= {90, 91}
    parted = model_queries.in_parcels(model_queries.signals(spark, str(tmp_path)))
    edges = model_queries.sheet_edges(parted)
    at = {r["voxel"]: r["parcel"] for r in parted.collect()}
    pairs = {(r["src"], r["dst"]) for r in edges.collect()}
    assert pairs == {(b, a) for a, b in pairs} and {(0, 7), (0, 70)} <= pairs and (63, 70) not in pairs
    assert all(at[a] == at[b] for a, b in pairs)


def test_a_failing_voxel_is_reported_alone(truth):
    def broken(voxels, y, seed):
        if voxels[0] == 3:
            raise ValueError("no")
        return {"mean": [(int(voxels[0]), None, None, float(y.mean()))]}

    got = models.fit_voxels(truth.signals.filter("parcel = 1"), broken).toPandas()
    assert list(got[got["report"] != "ok"]["voxel"]) == [3] and len(got) == truth.signals.filter("parcel = 1").count()


def test_glm_with_correlated_residuals(spark):
    r = np.random.default_rng(12)
    n = 60
    x = np.column_stack([np.ones(n), np.linspace(-1, 1, n), np.sin(np.arange(n) / 3)])
    rows, want = [], {}
    for v in range(12):
        e = np.zeros(n)
        for t in range(1, n):
            e[t] = 0.6 * e[t - 1] + r.standard_normal()
        y = x @ r.standard_normal(3) + e
        rows.append((v, [float(a) for a in y]))
        rest = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        rho = rest[1:] @ rest[:-1] / (rest @ rest)
        white = np.eye(n) - rho * np.eye(n, k=-1)
        white[0, 0] = np.sqrt(1 - rho**2)
        wx, wy = white @ x, white @ y
        beta = np.linalg.lstsq(wx, wy, rcond=None)[0]
        s2 = ((wy - wx @ beta) ** 2).sum() / (n - 3)
        c = np.array([0.0, 1.0, -1.0])
        want[v] = [rho, *beta, s2, c @ beta, s2 * (c @ np.linalg.inv(wx.T @ wx) @ c)]
    rows += [(90, None), (91, [0.0] * n)]
    got = {z["voxel"]: z for z in models.glm_ar1(spark.createDataFrame(rows, "voxel long, y array<double>"), x, {"d": [0, 1, -1]}).collect()}
    for v, w in want.items():
        z = got[v]
        assert [z["rho"], *z["beta"], z["s2"], z["effect_d"], z["var_d"]] == pytest.approx(w, rel=1e-8, abs=1e-10)
        assert z["t_d"] == pytest.approx(w[5] / np.sqrt(w[6]), rel=1e-8)
    assert got[90]["beta"] is None and got[90]["rho"] is None and got[91]["beta"] == [0.0] * 3
