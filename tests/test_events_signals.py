import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsignal.functions import series, signal, stats
from gridsignal.operators import events as ev


@pytest.fixture(scope="module")
def paradigm(spark):
    rows = [(s, c, t + s * 0.0, None) for s in (0, 1) for c, ts in {"c1": (1.2, 5.6, 7.4), "c2": (2.3, 3.6, 6.4, 9.8)}.items() for t in ts]
    return spark.createDataFrame(rows, "session int, condition string, onset double, duration double")


def test_sessions_are_joined(paradigm):
    got = ev.joined_onsets(ev.with_default_durations(paradigm)).filter("session = 1 AND condition = 'c1'").orderBy("onset").collect()
    assert [round(r["onset"], 6) for r in got] == [11.0, 15.4, 17.2]


def test_raster_rounds_half_to_even(spark, paradigm):
    half = spark.createDataFrame([(0, "a", 0.25, 0.0), (0, "a", 0.75, 0.0)], "session int, condition string, onset double, duration double")
    got = {r["bin"]: r["active"] for r in ev.raster(half, 0.5, 1.0).collect()}
    assert got == {0: 1, 1: 0, 2: 1}
    assert ev.raster(paradigm, 0.5, 10.0).count() == 2 * 2 * 21


def test_durations_fill_bins(spark):
    rows = spark.createDataFrame([(0, "a", 1.0, 2.0), (0, "a", 2.0, 2.0)], "session int, condition string, onset double, duration double")
    assert sorted(r["bin"] for r in ev.sampled(rows, 1.0).collect()) == [1, 2, 3]
    assert rows.agg(ev.design_kind(rows).alias("k")).first()["k"] == "block"


def test_grid_step(paradigm):
    assert ev.grid_step(paradigm, 1.0, 10, 0.05) == pytest.approx(0.2, abs=1e-9)
    assert ev.grid_step(paradigm, 1.0, 10, 0.5) == 0.5


def test_merge_and_intervals(paradigm):
    merged = ev.merge_onsets(paradigm, "all", "c")
    assert merged.select("condition").distinct().collect()[0][0] == "all"
    got = ev.intervals(paradigm.filter("session = 0"), ["condition"]).filter("condition = 'c1'").first()
    assert got["mean_isi"] == pytest.approx(3.1) and got["n_events"] == 3


def test_induced_signal_is_a_convolution(spark):
    active = spark.createDataFrame([("a", 0), ("a", 3)], "condition string, bin long")
    response = spark.createDataFrame([(0, 1.0), (1, 0.5)], "lag long, h double")
    levels = spark.createDataFrame([(7, "a", 2.0)], "voxel long, condition string, level double")
    got = {r["bin"]: r["signal"] for r in ev.induced_signal(levels, active, response).collect()}
    assert got == {0: 2.0, 1: 1.0, 3: 2.0, 4: 1.0}


def test_bases_and_shapes():
    for basis in (signal.polynomial_basis(50, 4), signal.cosine_basis(50, 20.0, 1.0)):
        assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-10)
    h = signal.canonical_response(25.0, 0.5)
    assert np.linalg.norm(h) == pytest.approx(1) and h[-1] == 0
    peak, width = signal.time_to_peak_and_width(h, 0.5)
    assert 4 < peak < 6 and 4 < width < 7
    assert signal.finite_differences(2, 4)[1].tolist() == [1, -2, 1, 0]


def test_undrift_and_resample(spark):
    y = [3.0 + 2 * t + (1 if t % 10 == 0 else 0) for t in range(50)]
    df = spark.createDataFrame([(0, y)], "v long, y array<double>")
    basis = signal.polynomial_basis(50, 1)
    clean = np.array(signal.undrifted(df, "y", basis).first()["y"])
    assert abs(clean @ basis[:, 0]) < 1e-9 and clean.max() < 1.1
    coef = np.array(df.select(signal.projector(basis, F.col("y")).alias("c")).first()["c"])
    assert np.allclose(np.abs(coef), np.abs(np.array(y) @ basis))
    knots = spark.createDataFrame([("a", 0.0, 0.0), ("a", 2.0, 4.0), ("a", 3.0, 5.0)], "k string, t double, v double")
    got = {r["t"]: r["v"] for r in signal.resampled(knots, ["k"], "t", "v", [-1.0, 1.0, 2.5, 4.0]).collect()}
    assert got == {-1.0: -2.0, 1.0: 2.0, 2.5: 4.5, 4.0: 6.0}


def test_mixtures_and_maps(spark):
    assert stats.normal_isf(0.05) == pytest.approx(1.6448536, abs=1e-6)
    rows = [(k, m, 1.0, p) for k, ps in enumerate([(1.0, 0.0), (0.5, 0.5)]) for m, p in zip((0.0, 100.0), ps, strict=True)]
    df = spark.createDataFrame(rows, "k int, m double, v double, p double")
    got = {r["k"]: r["c"] for r in df.withColumn("x", stats.phi((F.lit(0.0) - F.col("m")) / F.sqrt("v"))).groupBy("k").agg(F.sum(F.col("p") * F.col("x")).alias("c")).collect()}
    assert got[0] == pytest.approx(0.5) and got[1] == pytest.approx(0.25)
    a = spark.createDataFrame([(0.0, 1.0), (1.0, 1.0), (10.0, 1.0)], "m double, v double").select(stats.ppm_a_norm(F.col("m"), F.col("v")).alias("p"), stats.ppm_g_norm(F.col("m"), F.col("v")).alias("g")).collect()
    assert [r["p"] for r in a] == pytest.approx([0.5, 0.8413447, 1.0], abs=1e-6)
    assert a[1]["g"] == pytest.approx(1 - 1.6448536, abs=1e-6)
    draws = spark.range(200_000).select(stats.gaussian(0.0, 1.0, 3).alias("x"))
    q = draws.agg(F.percentile("x", F.lit(0.95)).alias("q"), stats.ppm_g_mcmc(F.col("x"), 0.0).alias("g")).first()
    assert q["q"] == pytest.approx(1.645, abs=0.02) and q["g"] == pytest.approx(0.5, abs=0.01)
    small = spark.createDataFrame([(float(i),) for i in range(1, 11)], "x double").agg(stats.plotting_quantile(F.col("x"), 0.5).alias("q")).first()
    assert small["q"] == pytest.approx(5.5)
    x = stats.positive_normal(np.random.default_rng(1), np.array([-5.0] * 4000 + [2.0] * 4000), np.ones(8000))
    assert (x > 0).all() and x[:4000].mean() == pytest.approx(0.1866, abs=0.02)


def test_roc_and_acorr(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "s double, y int")
    assert stats.auc(df, "s", "y").first()["auc"] == pytest.approx(0.875)
    assert [(r["tpr"], r["fpr"]) for r in stats.roc_curve(df, "s", "y").orderBy(F.desc("s")).collect()] == [(0.5, 0.0), (1.0, 0.5), (1.0, 1.0)]
    flat = spark.createDataFrame([("a", t, 2.0) for t in range(5)] + [("b", t, float(t % 2)) for t in range(6)], "k string, t int, v double")
    got = {(r["k"], r["lag"]): r["acorr"] for r in stats.acorr(flat, ["k"], "t", "v", 2).collect()}
    assert got["a", 1] == 1.0 and got["b", 1] == pytest.approx(-5 / 6) and got["b", 2] == pytest.approx(4 / 6)


def test_series_names_and_trees(spark):
    files = spark.createDataFrame([("scan_001.nii",), ("scan_002.nii",), ("scan_005.nii",), ("plain.txt",)], "name string")
    found = series.file_series(files)
    assert {(r["first"], r["last"]) for r in series.condensed(found, ["prefix"]).collect()} == {(1, 2), (5, 5)}
    assert series.missing(found, ["prefix"]).first()["n_missing"] == 2
    name = spark.createDataFrame([("/d/a.nii.gz",)], "n string")
    row = name.select(series.add_suffix(F.col("n"), "_x").alias("s"), series.add_prefix(F.col("n"), "p_").alias("p"), series.replace_ext(F.col("n"), "csv").alias("r"), series.has_ext(F.col("n"), "nii").alias("h")).first()
    assert tuple(row) == ("/d/a_x.nii.gz", "/d/p_a.nii.gz", "/d/a.csv", True)
    assert series.contrast_vector("audio - 2*video", ["audio", "video", "x"]) == [1.0, -2.0, 0.0]
    assert series.contrast_name([1, -1, 0], ["audio", "video", "x"]) == "+audio -video"
    with pytest.raises(ValueError):
        series.contrast_vector("audio - nothing", ["audio"])
    dup = spark.createDataFrame(list(enumerate([1, 1, 2, 1, 4, 5, 7, 2])), "i int, v int")
    assert {tuple(r["positions"]) for r in series.duplicates(dup, "i", "v").collect()} == {(0, 1, 3), (2, 7)}
    tree = spark.sql("SELECT map('a', map('x', 1, 'y', 2), 'b', map('x', 3)) AS t")
    assert {(r["k"], r["l"], r["leaf"]) for r in series.branches(tree, "t", ["k", "l"]).collect()} == {("a", "x", 1), ("a", "y", 2), ("b", "x", 3)}
    assert tree.select(series.get_leaf(F.col("t"), "a", "y")).first()[0] == 2
    assert spark.range(1).select(series.format_duration(F.lit(3723.5)).alias("d")).first()["d"] == "1H2min3.500sec"
    assert math.isclose(spark.range(1).select(series.weighted_sum([1.0, -2.0], ["id", "id"])).first()[0], 0.0)
