import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsignal import parcellate
from gridsignal.operators import sparse
from gridsignal.sources import volumes


def test_parcels_from_files_follow_the_features(spark, tmp_path):
    shape = (6, 4, 2)
    level = np.zeros(shape)
    level[3:] = 5.0
    level[:, 2:] += 20.0
    mask = np.ones(shape, int)
    mask[2:4, 0, 0] = 0
    r = np.random.default_rng(1)
    rows = [(n, *map(int, p), float(v)) for n, d in (("a", level + 0.1 * r.standard_normal(shape)), ("b", level), ("mask", mask)) for p, v in np.ndenumerate(d)]
    rows = [(n, p[0], p[1], p[2], v) for n, *p, v in rows]
    volumes.write_volumes(spark.createDataFrame(rows, "item string, x int, y int, z int, value double"), str(tmp_path), "item", ["x", "y", "z"])
    out = parcellate.parcellate_files(spark, [f"{tmp_path}/a.nii", f"{tmp_path}/b.nii"], f"{tmp_path}/mask.nii", str(tmp_path / "out"), "parcels", 4, weight=0.0)
    own = {}
    for q in out.collect():
        own.setdefault(q["parcel"], set()).add((q["x"], q["y"], q["z"]))
    assert own.pop(0) == {p for p in np.ndindex(*shape) if not mask[p]}
    assert {frozenset(c) for c in own.values()} == {frozenset(p for p in np.ndindex(*shape) if mask[p] and (p[0] >= 3) == a and (p[1] >= 2) == b) for a in (True, False) for b in (True, False)}
    back = volumes.load_volumes(spark, str(tmp_path / "out" / "parcels.nii"))
    assert back.join(out, ["x", "y", "z"]).filter("value <> parcel").isEmpty() and back.count() == 48
    with pytest.raises(ValueError):
        parcellate.parcellate_cells(out, 3, "kmeans")


def test_parcels_of_a_surface_and_of_components(spark):
    coords = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(12)], "node long, x double, y double, z double")
    triangles = spark.createDataFrame([(i, i + 1, i + 2) for i in range(10) if i not in (4, 5)], "a long, b long, c long")
    features = coords.select("node", F.array((F.col("node") >= 9).cast("double")).alias("features"))
    got = {r["node"]: r["parcel"] for r in parcellate.parcellate_surface(coords, triangles, features, 3, weight=0.0).collect()}
    groups = {frozenset(n for n in got if got[n] == p) for p in set(got.values())}
    assert frozenset(range(9, 12)) in groups and frozenset(range(6, 9)) in groups and sorted(got) == list(range(12))
    assert all(max(g) < 6 or min(g) >= 6 for g in groups)


def test_block_diagonal(spark):
    a = spark.createDataFrame([(0, 1, 2.0), (1, 1, 3.0)], "src long, dst long, value double")
    b = spark.createDataFrame([(0, 0, 5.0)], "src long, dst long, value double")
    got = {(r["src"], r["dst"], r["value"]) for r in sparse.block_diagonal([(a, 2), (b, 1)], 2).collect()}
    assert got == {(0, 1, 2.0), (1, 1, 3.0), (2, 2, 5.0), (3, 4, 2.0), (4, 4, 3.0), (5, 5, 5.0)}
    with pytest.raises(ValueError):
        sparse.block_diagonal([])
