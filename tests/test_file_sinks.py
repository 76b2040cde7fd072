import gzip
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsignal.sources import files, images, volumes


def tree(folder):
    """Files in their places; a task that still ran when its job failed may have left one below ``_temporary``."""
    found = {os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names if not f.endswith(".crc")}
    return {f for f in found if not f.startswith("_temporary")}


def test_files_are_written_whole_or_not_at_all(spark, tmp_path):
    rows = [(f"a/{i}.bin", bytes([i]) * (i + 1)) for i in range(9)]
    df = spark.createDataFrame(rows, "name string, content binary").repartition(4)
    files.write_files(df, str(tmp_path / "out"))
    assert tree(tmp_path / "out") == {n for n, _ in rows}
    assert {(r["name"], bytes(r["content"])) for r in files.read_files(spark, str(tmp_path / "out")).collect()} == {(n.split("/")[1], c) for n, c in rows}

    @F.udf("binary")
    def broken(c):
        if c[0] == 7:
            raise RuntimeError("no")
        return c

    with pytest.raises(Exception, match="no"):
        files.write_files(df.withColumn("content", broken("content")), str(tmp_path / "half"))
    assert tree(tmp_path / "half") == set()
    twice = df.union(df.limit(1))
    with pytest.raises(Exception, match="several rows"):
        files.write_files(twice, str(tmp_path / "twice"))
    assert tree(tmp_path / "twice") == set()
    with pytest.raises(Exception):
        files.write_files(df, str(tmp_path / "out"), replace=False)
    with pytest.raises(Exception, match="below the target"):
        files.write_files(spark.createDataFrame([("../x", b"1")], "name string, content binary"), str(tmp_path / "out"))


def test_volumes_there_and_back_by_slabs(spark, tmp_path):
    r = np.random.default_rng(4)
    data = {n: r.standard_normal((3, 4, 2, 6)) for n in ("one", "two")}
    rows = [(n, *map(int, p), float(v)) for n, d in data.items() for p, v in np.ndenumerate(d) for p in [p]]
    rows = [(n, *p, v) for n, *p, v in rows]
    cells = spark.createDataFrame(rows, "item string, x int, y int, z int, t int, value double").repartition(3)
    for packed in (False, True):
        folder = f"file://{tmp_path}/v{int(packed)}"
        volumes.write_volumes(cells, folder, "item", volumes.AXES, voxel=(2.0, 3.0, 4.0), packed=packed)
        back = volumes.load_volumes(spark, folder, slab_cells=48)
        assert back.rdd.getNumPartitions() == (2 if packed else 6)
        got = {(os.path.basename(x["path"]).split(".")[0], x["x"], x["y"], x["z"], x["t"]): x["value"] for x in back.collect()}
        assert got == {tuple(x[:5]): x[5] for x in rows}
    with open(tmp_path / "v0" / "one.nii", "rb") as f:
        assert volumes.header_of(f.read(352)).voxel == (2.0, 3.0, 4.0)
    # the other reader sees the same cells
    same = images.read_volumes(spark, str(tmp_path / "v0")).agg(F.sum("value"), F.count(F.lit(1))).first()
    assert same[0] == pytest.approx(sum(x[5] for x in rows)) and same[1] == len(rows)


def test_series_are_split_and_joined(spark, tmp_path):
    cells = spark.range(2 * 3 * 2 * 5).select((F.col("id") % 2).alias("x"), (F.expr("id div 2") % 3).alias("y"), (F.expr("id div 6") % 2).alias("z"), F.expr("id div 12").alias("t"), F.col("id").alias("value"))
    volumes.split_series(cells, str(tmp_path / "parts"), "bold")
    assert tree(tmp_path / "parts") == {f"bold_{i:06d}.nii" for i in range(5)}
    volumes.joined_series(spark, [str(tmp_path / "parts" / f"bold_{i:06d}.nii") for i in range(5)], str(tmp_path / "all"), "bold")
    got = {(r["x"], r["y"], r["z"], r["t"]): r["value"] for r in volumes.load_volumes(spark, str(tmp_path / "all")).collect()}
    assert got == {(r["x"], r["y"], r["z"], r["t"]): r["value"] for r in cells.collect()}
    volumes.split_and_save(cells.withColumn("error", F.when(F.col("t") == 0, "error").otherwise("v")).filter("t < 2"), str(tmp_path / "by"), "c", ["z", "error"], ["x", "y"], formatted=True)
    assert tree(tmp_path / "by") == {"c_z_1.nii", "c_z_2.nii", "c_z_1_error.nii", "c_z_2_error.nii"}
    volumes.split_and_save(cells.filter("t in (1, 3)"), str(tmp_path / "gaps"), "c", ["t"], ["x", "y", "z"], formatted=True)
    assert tree(tmp_path / "gaps") == {"c_t_1.nii", "c_t_3.nii"}
    flags = cells.filter("t = 0").select(F.lit("m").alias("item"), "x", "y", "z", (F.col("value") % 2 == 0).alias("value"))
    volumes.write_volumes(flags, str(tmp_path / "mask"), "item", ["x", "y", "z"])
    with open(tmp_path / "mask" / "m.nii", "rb") as f:
        assert volumes.header_of(f.read(352)).kind == np.int8


def test_surfaces_there_and_back(spark, tmp_path):
    coords = spark.createDataFrame([("m", 0, 0.0, 0.0, 0.5), ("m", 1, 1.0, 0.0, 0.0), ("m", 2, 0.0, 1.0, 0.0), ("m", 3, 1.0, 1.0, 0.0)], "item string, node int, x double, y double, z double")
    triangles = spark.createDataFrame([("m", 0, 1, 2), ("m", 1, 2, 3)], "item string, a int, b int, c int")
    volumes.write_meshes(coords, triangles, str(tmp_path / "mesh"), "item")
    got = images.read_surfaces(spark, str(tmp_path / "mesh")).collect()
    assert [r["value"] for r in got if r["array"] == 0][:3] == [0.0, 0.0, 0.5] and {(r["i"], r["j"]): r["value"] for r in got if r["intent"] == "NIFTI_INTENT_TRIANGLE"}[1, 2] == 3
    series = spark.createDataFrame([("t", n, t, n + 0.5 * t) for n in range(4) for t in range(3)], "item string, node int, t int, value double")
    volumes.write_textures(series, str(tmp_path / "tex"), "item", time="t")
    assert {(r["array"], r["i"]): r["value"] for r in images.read_surfaces(spark, str(tmp_path / "tex")).collect()} == {(t, n): n + 0.5 * t for n in range(4) for t in range(3)}
    volumes.write_textures(series.filter("t = 0").withColumn("value", F.col("node")), str(tmp_path / "labels"), "item")
    assert {r["intent"] for r in images.read_surfaces(spark, str(tmp_path / "labels")).collect()} == {"NIFTI_INTENT_LABEL"}


def test_packing_and_copying_by_pattern(spark, tmp_path):
    rows = [(f"s{i}/run_{j}.txt", f"{i} {j}".encode()) for i in range(2) for j in range(3)] + [("other.md", b"x")]
    files.write_files(spark.createDataFrame(rows, "name string, content binary"), str(tmp_path / "src"))
    copy = lambda **k: files.copy_matching(spark, str(tmp_path / "src"), r"(?P<who>s\d)/run_(?P<run>\d)\.txt", "{who}-{run}.txt", ["all", "r{run}"], str(tmp_path / "dst"), **k)
    plan = copy(dry=True)
    assert {tuple(r) for r in plan.collect()} == {(f"s{i}/run_{j}.txt", f"all/r{j}/s{i}-{j}.txt") for i in range(2) for j in range(3)} and not (tmp_path / "dst").exists()
    copy(replacements=[("all/", "some/")], change=lambda p: p.filter("name LIKE 's0%'"))
    assert tree(tmp_path / "dst") == {f"some/r{j}/s0-{j}.txt" for j in range(3)}
    assert (tmp_path / "dst/some/r2/s0-2.txt").read_bytes() == b"0 2"
    with pytest.raises(files.MissingTagError):
        files.copy_matching(spark, str(tmp_path / "src"), r"(?P<who>s\d).*", "{nobody}", [], str(tmp_path / "dst"))
    with pytest.raises(files.DuplicateTargetError):
        files.copy_matching(spark, str(tmp_path / "src"), r"(?P<who>s\d).*", "{who}", [], str(tmp_path / "dst"))
    packed = files.gzipped(files.read_files(spark, str(tmp_path / "dst")))
    assert {r["name"]: gzip.decompress(bytes(r["content"])) for r in packed.collect()} == {f"s0-{j}.txt.gz": f"0 {j}".encode() for j in range(3)}
    assert {r["name"] for r in files.gunzipped(packed).collect()} == {f"s0-{j}.txt" for j in range(3)}
