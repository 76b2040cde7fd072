import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsignal.operators import graph, hull, mixtures, sparse


def in_hull(points, x):
    """Whether x is a mean of the points, by trying all simplices (small cases only)."""
    points = np.unique(points, axis=0)
    for k in range(1, points.shape[1] + 2):
        for some in itertools.combinations(points, k):
            a = np.vstack([np.array(some).T, np.ones(k)])
            w, *_ = np.linalg.lstsq(a, np.append(x, 1.0), rcond=None)
            if (w > -1e-9).all() and np.allclose(a @ w, np.append(x, 1.0), atol=1e-8):
                return True
    return False


@pytest.mark.parametrize("points", [
    [(0, 0), (5, 1), (2, 6), (4, 4)],
    [(0, 0), (2, 1), (6, 3), (4, 2)],
    [(3, 3)],
    [(0, 0, 0), (4, 0, 0), (0, 4, 0), (0, 0, 4), (1, 1, 1)],
    [(0, 0, 0), (4, 0, 0), (0, 4, 0), (4, 4, 0), (2, 2, 5)],
    [(0, 1, 0), (4, 1, 2), (1, 1, 4)],
    [(0, 0, 0), (2, 2, 2), (4, 4, 4)],
])
def test_cells_inside_hulls(spark, points):
    axes = ["x", "y", "z"][: len(points[0])]
    box = list(itertools.product(range(7), repeat=len(axes)))
    schema = ", ".join(f"{a} int" for a in axes)
    of = spark.createDataFrame([*points, *points, tuple([None] * len(axes))], schema).repartition(3)
    got = {tuple(r) for r in hull.inside_hull(spark.createDataFrame(box, schema), of, axes).collect()}
    assert got == {c for c in box if in_hull(np.array(points, float), np.array(c, float))}


def test_hull_of_many_points(spark):
    r = np.random.default_rng(3)
    points = np.unique(np.round(r.standard_normal((800, 3)) * 6).astype(int), axis=0)
    of = spark.createDataFrame([tuple(map(int, p)) for p in points], "x int, y int, z int").repartition(8)
    found = hull.hull_corners(of, ["x", "y", "z"])
    half = hull.faces(found)
    assert all((points @ n <= d + 1e-6).all() and (points @ n >= d - 1e-6).any() for n, d in half)
    assert hull.inside_hull(of, of, ["x", "y", "z"]).count() == len(points)
    # a cell beyond the farthest point of any face is outside
    n, d = half[0]
    out = spark.createDataFrame([tuple(float(v) for v in n * (d + 1))], "x double, y double, z double")
    assert hull.inside_hull(out, of, ["x", "y", "z"]).isEmpty()
    assert hull.inside_hull(of, of.limit(0), ["x", "y", "z"]).isEmpty()


def test_blocked_matrix(spark):
    r = np.random.default_rng(5)
    pairs = [(int(a), int(b), float(w)) for a, b, w in zip(r.integers(0, 40, 300), r.integers(0, 40, 300), r.integers(1, 5, 300), strict=True)]
    edges = spark.createDataFrame([*pairs, (None, 1, 1.0), (2, 3, None)], "src long, dst long, w double").repartition(4)
    dense = np.zeros((40, 40))
    for a, b, w in pairs:
        dense[a, b] += w
    m = sparse.graph_to_sparse(edges, "w", side=8)
    assert m.count() <= 25 and {(x["src"], x["dst"]): x["value"] for x in sparse.sparse_to_edges(m, 8).collect()} == {(int(a), int(b)): dense[a, b] for a, b in zip(*dense.nonzero(), strict=True)}
    x = spark.createDataFrame([(i, float(i % 7)) for i in range(0, 40, 2)], "node long, value double")
    v = np.array([float(i % 7) * (i % 2 == 0) for i in range(40)])
    for matrix, want in ((m, dense @ v), (sparse.transposed(m), dense.T @ v)):
        got = {z["node"]: z["value"] for z in sparse.times_vector(matrix, sparse.segments(x, side=8), side=8).collect()}
        assert got == pytest.approx({i: want[i] for i in got}) and all(want[i] == 0 for i in range(40) if i not in got)
    assert sparse.graph_to_sparse(edges.limit(0)).isEmpty()


def test_product_with_ones_gives_degrees(spark):
    cells = spark.range(30).select(F.col("id").alias("node"), (F.col("id") % 6).alias("x"), F.expr("id div 6").alias("y"))
    edges = graph.lattice_edges(cells, ["x", "y"])
    ones = sparse.segments(cells.withColumn("value", F.lit(1.0)), side=4)
    got = {r["node"]: r["value"] for r in sparse.times_vector(sparse.graph_to_sparse(edges, side=4), ones, side=4).collect()}
    assert got == {r["src"]: float(r["count"]) for r in edges.groupBy("src").count().collect()}


def test_informed_mixture(spark):
    rows = [("a", 1.0, 0.25), ("a", 3.0, 0.5), ("a", 8.0, 1.0), ("b", 2.0, 0.0), ("b", 4.0, 0.0), ("a", None, 0.5), ("a", 1.0, None)]
    got = {r["k"]: r for r in mixtures.informed_mixture(spark.createDataFrame(rows, "k string, v double, a double"), ["k"], "v", "a").collect()}
    a, w, x = got["a"], np.array([0.25, 0.5, 1.0]), np.array([1.0, 3.0, 8.0])
    for k, u in ((1, w), (0, 1 - w)):
        mean = (u * x).sum() / u.sum()
        assert [a[f"mean{k}"], a[f"var{k}"], a[f"weight{k}"]] == pytest.approx([mean, (u * (x - mean) ** 2).sum() / u.sum(), u.mean()])
    assert (got["b"]["mean1"], got["b"]["var1"], got["b"]["weight1"]) == (1e-6, 1e-6, 0.0)


def test_mixtures_reach_a_fixed_point(spark):
    r = np.random.default_rng(1)
    rows = [("a", float(x)) for x in [*r.normal(0, 1, 900), *r.normal(6, 2, 600)]] + [("b", float(x)) for x in [*r.normal(-3, 1, 400), *r.normal(3, 0.5, 800)]] + [("c", 2.0)] * 5 + [("a", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    fitted = mixtures.mixture_em(df, ["k"], "v", tolerance=1e-3)
    got = {x["k"]: x for x in fitted.collect()}
    assert [got["a"][p] for p in mixtures.PARAMETERS] == pytest.approx([0, 6, 1, 4, 0.6, 0.4], abs=0.45)
    assert [got["b"][p] for p in mixtures.PARAMETERS] == pytest.approx([-3, 3, 1, 0.25, 1 / 3, 2 / 3], abs=0.2)
    assert got["c"]["mean0"] == pytest.approx(2.0, abs=1e-3) and all(math.isfinite(got["c"][p]) for p in mixtures.PARAMETERS)
    # one more round moves nothing
    again = {x["k"]: x for x in mixtures.one_round(df, ["k"], "v", fitted.drop("rounds"), False).collect()}
    for k in "ab":
        assert [again[k][p] for p in mixtures.PARAMETERS] == pytest.approx([got[k][p] for p in mixtures.PARAMETERS], abs=2e-2)
