import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsignal import study as st
from gridsignal.operators import models
from gridsignal.sources import volumes


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """A mask of two parcels, a design of two conditions and two sessions of ten and eight scans."""
    folder = tmp_path_factory.mktemp("study")
    r = np.random.default_rng(6)
    mask = np.zeros((5, 4, 3), int)
    mask[1:4, 1:3, 1] = 1
    mask[1:4, 1:3, 2] = 2
    cells = [(x, y, z, int(mask[x, y, z])) for x, y, z in np.ndindex(*mask.shape)]
    volumes.write_volumes(spark.createDataFrame([("mask", *c) for c in cells], "item string, x int, y int, z int, value int"), str(folder), "item", ["x", "y", "z"])
    bold = {k: r.standard_normal((5, 4, 3, n)) + 10 for k, n in (("s1", 10), ("s2", 8))}
    bold["s1"][1, 1, 1] = bold["s2"][1, 1, 1] = 0.0
    rows = [(k, *map(int, p), float(v)) for k, d in bold.items() for p, v in np.ndenumerate(d)]
    rows = [(k, *p, v) for k, *p, v in rows]
    volumes.write_volumes(spark.createDataFrame([(k, p[0], p[1], p[2], p[3], v) for k, *p, v in rows], "item string, x int, y int, z int, t int, value double"), str(folder), "item", volumes.AXES)
    (folder / "design.csv").write_text('0 "audio" 2.0 0.\n0 "video" 6.0 2.\n0 "audio" 12.0 0.\n1 "video" 4.0 0.\n1 "audio" 10.0 0.\n')
    return folder, mask, bold


def test_a_study_from_files(spark, files):
    folder, mask, bold = files
    s = st.Study.from_volumes(spark, f"{folder}/mask.nii", f"{folder}/design.csv", [f"{folder}/s1.nii", f"{folder}/s2.nii"], 2.0)
    assert s.scans == (10, 8)
    got = {(r["x"], r["y"], r["z"]): r for r in s.cells.collect()}
    want = {p for p in np.ndindex(*mask.shape) if mask[p] and p != (1, 1, 1)}
    assert set(got) == want
    for p, r in got.items():
        assert r["parcel"] == mask[p] and r["y_"] == pytest.approx([*bold["s1"][p], *bold["s2"][p]])
    assert s.summary().first().asDict() == {"n_subjects": 1, "n_parcels": 2, "n_voxels": 11, "n_scans": 18, "least": 5, "largest": 6}
    full = {(r["x"], r["y"], r["z"]): r["parcel"] for r in s.discard_small_parcels(6).parcel_mask().collect()}
    assert full == {p: 2 if mask[p] == 2 else 0 for p in np.ndindex(*mask.shape)}
    assert s.keep_only_parcels([1]).cells.count() == 5 and s.parcel_edges().filter("parcel = 2").count() == 14
    mean = {r["parcel"]: r["y_"] for r in s.averaged().cells.collect()}
    assert mean[2] == pytest.approx(np.mean([[*bold["s1"][p], *bold["s2"][p]] for p in want if mask[p] == 2], 0))
    assert {r[0] for r in st.Study.from_volumes(spark, f"{folder}/mask.nii", f"{folder}/design.csv", [f"{folder}/s1.nii"], 2.0, conditions=["audio"]).paradigm.get_stimulus_names().collect()} == {"audio"}


def test_linear_models_of_a_study(spark, files, tmp_path):
    folder, mask, bold = files
    s = st.Study.from_volumes(spark, f"{folder}/mask.nii", f"{folder}/design.csv", [f"{folder}/s1.nii", f"{folder}/s2.nii"], 2.0)
    x, names = s.design(cutoff=20.0)
    assert names[:2] == ["audio", "video"] and x.shape == (18, len(names)) and np.linalg.matrix_rank(x) == len(names)
    fitted = {(r["x"], r["y"], r["z"]): r for r in s.glm({"d": "audio - video"}, cutoff=20.0).collect()}
    for p, r in fitted.items():
        beta = np.linalg.lstsq(x, np.array([*bold["s1"][p], *bold["s2"][p]]), rcond=None)[0]
        assert r["beta"] == pytest.approx(list(beta)) and r["effect_d"] == pytest.approx(beta[0] - beta[1])
    with pytest.raises(ValueError):
        s.glm(residuals="ar2")
    out = st.glm_from_files(spark, f"{folder}/s1.nii", 2.0, f"{folder}/design.csv", f"{folder}/mask.nii", str(tmp_path / "fit"), {"d": "audio - video"}, "ar1", cutoff=30.0)
    written = {r["path"].split("/")[-1] for r in volumes.load_volumes(spark, str(tmp_path / "fit")).select("path").distinct().collect()}
    assert {"beta_audio.nii", "effect_d.nii", "t_d.nii"} <= written
    r = out.filter("x = 2 AND y = 1 AND z = 2").first()
    volume = volumes.load_volumes(spark, str(tmp_path / "fit" / "effect_d.nii")).filter("x = 2 AND y = 1 AND z = 2").first()
    assert volume["value"] == pytest.approx(r["effect_d"])


def test_fits_by_parcel_move_no_row(spark, files):
    folder, mask, _ = files
    s = st.Study.from_volumes(spark, f"{folder}/mask.nii", f"{folder}/design.csv", [f"{folder}/s1.nii"], 2.0)
    other = st.replace(s, cells=s.cells.withColumn("subject", F.lit("1")))
    group = s.merge_subjects(other).bucketed("study_of_two", 4)
    count = lambda voxels, y, seed: {"n": [(None, None, None, float(len(voxels)))]}
    results = group.fit(count)
    assert "Exchange" not in results._jdf.queryExecution().executedPlan().toString()
    assert {(r["parcel"], r["value"]) for r in results.collect()} == {(1, 10.0), (2, 12.0)}
    assert "Exchange" not in group.sizes()._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        s.merge_subjects(st.replace(s, scans=(9,)))
    twice = s.merge_sessions(s)
    assert twice.scans == (10, 10) and twice.cells.filter(F.size("y_") == 20).count() == s.cells.count()


def test_outputs_are_put_together(spark, files, tmp_path):
    folder, mask, _ = files
    s = st.Study.from_volumes(spark, f"{folder}/mask.nii", f"{folder}/design.csv", [f"{folder}/s1.nii"], 2.0)

    def estimate(voxels, y, seed):
        if len(voxels) == 5:
            raise ValueError("small")
        return {"nrl": [(int(v), c, None, float(v) + k) for v in voxels for k, c in enumerate("ab")], "hrf": [(None, None, 2.0 * i, h) for i, h in enumerate((1.0, 0.5))]}

    results = s.fit(estimate)
    assert results.filter("report <> 'ok'").count() == 1
    placed = st.joined_outputs(results, s, "nrl").filter("condition = 'b'").collect()
    assert len(placed) == 6 and all(mask[r["x"], r["y"], r["z"]] == 2 for r in placed)
    assert {(r["parcel"], r["at"], r["value"]) for r in st.stacked_outputs(results, "hrf").collect()} == {(2, 0.0, 1.0), (2, 2.0, 0.5)}
    onsets = np.zeros((2, 10, 2))
    onsets[0, 3, 0] = onsets[0, 4, 1] = onsets[1, 6, 0] = 1.0
    fit = {r["voxel"]: r["fit"] for r in st.fitted_signals(s, results, onsets, ["a", "b"]).collect()}
    v, line = next(iter(fit.items()))
    assert len(fit) == 6 and line == pytest.approx([0, 0, 0, v, v * 0.5, 0, v + 1, 0, 0, 0])
    s.save(str(tmp_path / "saved"))
    again = st.Study.from_volumes(spark, f"{tmp_path}/saved/mask.nii", f"{tmp_path}/saved/paradigm", [f"{tmp_path}/saved/bold_0.nii"], 2.0)
    assert sorted(map(str, again.cells.select("parcel", "x", "y", "z", "y_").collect())) == sorted(map(str, s.cells.select("parcel", "x", "y", "z", "y_").collect()))


def test_missing_cells_raise_and_masks_are_made(spark, files, tmp_path):
    folder, mask, bold = files
    small = spark.createDataFrame([("m", x, y, z, 1) for x in range(7) for y in range(2) for z in range(2)], "item string, x int, y int, z int, value int")
    volumes.write_volumes(small, str(tmp_path), "item", ["x", "y", "z"])
    with pytest.raises(ValueError, match="cover"):
        st.Study.from_volumes(spark, f"{tmp_path}/m.nii", f"{folder}/design.csv", [f"{folder}/s1.nii"], 2.0)
    bright = spark.createDataFrame([(x, y, z, t, (100.0 if 1 <= x <= 3 and z == 1 else 60.0 if (x, y, z) == (5, 5, 3) else 10.0) + t + 0.1 * y + 0.01 * x) for x in range(6) for y in range(6) for z in range(4) for t in range(2)], "x int, y int, z int, t int, value double")
    got = {(r["x"], r["y"], r["z"]) for r in st.mask_from_bold(bright, 0.4, 0.95).filter("value = 1").collect()}
    assert got == {(x, y, 1) for x in (1, 2, 3) for y in range(6)}


def test_a_study_on_a_surface(spark, tmp_path):
    coords = spark.createDataFrame([("m", i, float(i % 3), float(i // 3), 0.0) for i in range(6)], "item string, node int, x double, y double, z double")
    triangles = spark.createDataFrame([("m", 0, 1, 3), ("m", 1, 4, 3), ("m", 1, 2, 4), ("m", 2, 5, 4)], "item string, a int, b int, c int")
    volumes.write_meshes(coords, triangles, str(tmp_path), "item")
    series = spark.createDataFrame([("bold", n, t, 0.0 if n == 5 else n + 0.5 * t) for n in range(6) for t in range(4)], "item string, node int, t int, value double")
    volumes.write_textures(series, str(tmp_path), "item", time="t")
    labels = spark.createDataFrame([("labels", n, (0, 1, 1, 2, 1, 1)[n]) for n in range(6)], "item string, node int, value int")
    volumes.write_textures(labels, str(tmp_path), "item")
    (tmp_path / "design.txt").write_text('0 "a" 1. 0.\n')
    s = st.Study.from_surfaces(spark, f"{tmp_path}/m.gii", f"{tmp_path}/design.txt", [f"{tmp_path}/bold.gii"] * 2, 2.0, f"{tmp_path}/labels.gii")
    assert s.scans == (4, 4) and {r["voxel"]: (r["parcel"], r["y_"][5]) for r in s.cells.collect()} == {n: ((0, 1, 1, 2, 1)[n], n + 0.5) for n in (1, 2, 3, 4)}
    assert {(r["src"], r["dst"]): r["length"] for r in s.edge_lengths().collect()} == {(1, 2): 1.0, (2, 1): 1.0, (1, 4): 1.0, (4, 1): 1.0, (2, 4): 2**0.5, (4, 2): 2**0.5}
    assert st.Study.from_surfaces(spark, f"{tmp_path}/m.gii", f"{tmp_path}/design.txt", [f"{tmp_path}/bold.gii"], 2.0).cells.count() == 5
