from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsignal.operators import agglomeration, graph, matching, parcellation


def grid(spark, mask):
    return spark.createDataFrame([(10 * x + y, x, y, v) for x, row in enumerate(mask) for y, v in enumerate(row) if v], "node long, x int, y int, label int")


MASK = [[1, 1, 0, 0, 1], [1, 0, 0, 0, 1], [0, 0, 1, 0, 1], [1, 1, 1, 0, 1], [1, 1, 0, 0, 0]]


def test_lattice_is_sane_and_wraps(spark):
    full = grid(spark, [[1] * 5] * 4)
    edges = graph.lattice_edges(full, ["x", "y"])
    assert graph.is_sane(edges) and edges.count() == 2 * (4 * 4 + 3 * 5)
    around = graph.lattice_edges(full, ["x", "y"], shape=[4, 5])
    assert graph.is_sane(around, constant_degree=True) and around.count() == 80
    assert not graph.is_sane(spark.createDataFrame([(1, 2)], "src long, dst long"))
    assert graph.eroded(full, ["x", "y"]).count() == 6


def test_components_and_search(spark):
    cells = grid(spark, MASK)
    edges = graph.lattice_edges(cells, ["x", "y"])
    got = graph.components_within(edges, cells, min_size=4)
    assert got.select("component").distinct().count() == 2
    everything = graph.components_within(edges, cells)
    assert everything.select("component").distinct().count() == 3
    found = graph.breadth_first(edges, cells.filter("node = 0").select("node"))
    assert {(r["node"], r["depth"]) for r in found.collect()} == {(0, 0), (1, 1), (10, 1)}


def test_sums_and_cliques(spark):
    cells = grid(spark, [[1, 2], [2, 2]])
    edges = graph.lattice_edges(cells, ["x", "y"])
    sums = {r["node"]: r["neighbour_sum"] for r in graph.neighbour_sum(edges, cells, value="label").collect()}
    assert sums == {0: 4, 1: 3, 10: 3, 11: 4}
    assert graph.homo_cliques(edges, cells).first()["cliques"] == 2.0
    assert graph.n_cliques(edges).first()["cliques"] == 4.0


def test_mesh(spark):
    triangles = spark.createDataFrame([(0, 1, 2), (1, 2, 3)], "a long, b long, c long")
    assert graph.mesh_edges(triangles).count() == 10
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 1), (3, 2)], "node long, label int")
    assert graph.mesh_contour(triangles, labels).collect()[0]["c"] == 3


def test_partitions(spark):
    a = [[1, 1, 0, 2], [1, 1, 2, 2], [0, 0, 2, 2], [0, 0, 0, 2], [0, 0, 0, 2]]
    b = [[1, 1, 0, 3], [2, 2, 2, 2], [0, 0, 2, 2], [0, 0, 0, 2], [0, 0, 0, 2]]
    make = lambda m: spark.createDataFrame([(x, y, v) for x, row in enumerate(m) for y, v in enumerate(row)], "x int, y int, parcel int")
    m = {(r["i"], r["j"]): r["n"] for r in parcellation.intersection_matrix(make(a), make(b), ["x", "y"]).collect()}
    assert m[1, 1] == 2 and m[1, 2] == 2 and m[2, 2] == 6 and m[2, 3] == 1
    assert parcellation.parcellation_distance(make(a), make(b), ["x", "y"]) == 3


@pytest.mark.parametrize("shape", [(3, 5)])
def test_best_matching_against_all(spark, shape):
    r = np.random.default_rng(sum(shape))
    profit = r.integers(0, 50, shape) * (r.random(shape) < 0.7)
    table = spark.createDataFrame([(i, j + 1, int(profit[i, j])) for i in range(shape[0]) for j in range(shape[1])], "i int, j int, n long")
    got = matching.best_matching(table).collect()
    assert len({x["i"] for x in got}) == len({x["j"] for x in got}) == len(got)
    wide = np.zeros((max(shape), max(shape)), int)
    wide[: shape[0], : shape[1]] = profit
    assert sum(x["n"] for x in got) == max(sum(wide[i, j] for i, j in enumerate(p)) for p in permutations(range(max(shape))))
    assert matching.best_matching(table.limit(0)).isEmpty()


def test_distance_and_alignment_of_the_golden_example(spark):
    # golden values of the API that is matched
    a = [[1, 1, 0, 3], [1, 1, 3, 3], [0, 1, 2, 2], [0, 2, 2, 2], [0, 0, 2, 0]]
    b = [[1, 1, 0, 3], [3, 3, 3, 3], [0, 2, 2, 3], [0, 2, 2, 2], [0, 0, 2, 0]]
    p, q = (spark.createDataFrame([(x, y, v) for x, row in enumerate(m) for y, v in enumerate(row)], "x int, y int, parcel int") for m in (a, b))
    assert parcellation.parcellation_distance(p, q, ["x", "y"]) == 4
    moved = q.withColumn("parcel", F.when(F.col("parcel") > 0, F.col("parcel") % 3 + 5).otherwise(0))
    assert {tuple(r) for r in parcellation.aligned(p, moved, ["x", "y"]).collect()} == {tuple(r) for r in q.collect()}
    with pytest.raises(AssertionError):
        parcellation.check_parcellations_agree(p, q, ["x", "y"], 3)
    differ = p.join(q.withColumnRenamed("parcel", "o"), ["x", "y"]).filter("parcel <> o").select("x", "y")
    parcellation.check_parcellations_agree(p, moved, ["x", "y"], allowed=differ)


def plain_ward(features, pairs, k):
    """The least node of each node's cluster, after merging the cheapest neighbouring pair of all, one by one."""
    own = {i: [i] for i in range(len(features))}
    near = {frozenset(p) for p in pairs}

    def cost(p):
        a, b = (own[i] for i in sorted(p))
        return len(a) * len(b) / (len(a) + len(b)) * ((np.mean(features[a], 0) - np.mean(features[b], 0)) ** 2).sum(), sorted(p)

    while len(own) > k and near:
        i, j = sorted(min(near, key=cost))
        own[i] += own.pop(j)
        near = {q for q in (frozenset(i if x == j else x for x in q) for q in near) if len(q) == 2}
    return {n: min(c) for c in own.values() for n in c}


def test_ward_against_merging_one_by_one(spark):
    nodes, edges, want = [], [], {}
    pairs = [(i, j) for i in range(24) for j in (i + 1, i + 6) if j < 24 and (j == i + 6 or j % 6)]
    for parcel in range(4):
        r = np.random.default_rng(parcel)
        # four quarters of a sheet of 6 by 4, told apart by more and more noisy features
        quarter = np.array([(i % 6 >= 3) + 2 * (i // 12) for i in range(24)])
        features = np.column_stack([10.0 * (quarter % 2), 14.0 * (quarter // 2)]) + (0.2 + parcel) * r.standard_normal((24, 2))
        base = 100 * parcel
        nodes += [(parcel, base + i, [float(x) for x in f]) for i, f in enumerate(features)]
        edges += [(base + i, base + j) for i, j in pairs] + [(base + j, base + i) for i, j in pairs]
        want |= {base + n: base + c for n, c in plain_ward(features, pairs, 4).items()}
    tables = spark.createDataFrame(nodes, "parcel long, node long, features array<double>"), spark.createDataFrame(edges, "src long, dst long")
    groups = {}
    for x in agglomeration.ward_spatial(*tables, 4).collect():
        groups.setdefault((x["parcel"], x["label"]), []).append(x["node"])
    assert sorted(groups) == [(p, k) for p in range(4) for k in (1, 2, 3, 4)]
    assert {n: min(g) for g in groups.values() for n in g} == want


def test_ward_and_merging(spark):
    nodes = spark.createDataFrame([(1, i, [float(i // 3)]) for i in range(9)], "parcel long, node long, features array<double>")
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(8)], "parcel long, src long, dst long")
    got = {r["node"]: r["label"] for r in agglomeration.ward_spatial(nodes, edges.union(edges.select("parcel", "dst", "src")), 3).collect()}
    assert [got[i] for i in range(9)] == [1, 1, 1, 2, 2, 2, 3, 3, 3]
    cells = spark.createDataFrame([(i, 1 if i < 5 else 2 if i < 6 else 3) for i in range(12)], "node long, parcel int")
    both = graph.both_ways(spark.createDataFrame([(i, i + 1) for i in range(11)] + [(5, 7)], "src long, dst long"))
    merged = {r["node"]: r["parcel"] for r in parcellation.merge_small(cells, both, 2).collect()}
    assert merged[5] == 3 and merged[0] == 1
    near = parcellation.voronoi(spark.createDataFrame([(0.0, 0.0), (9.0, 9.0)], "x double, y double"), ["x", "y"], [(1, 1), (8, 8)])
    assert sorted(r["parcel"] for r in near.collect()) == [1, 2]
    assert parcellation.round_n_parcels(347) == 300 and parcellation.round_n_parcels(47) == 50
    assert parcellation.keep_parcels(cells, [3, 1], renumber=True).agg(F.count_distinct("parcel")).first()[0] == 2


def one_by_one(parcel_of, edges, min_size):
    """Merging as defined: the smallest parcel that has a neighbour goes first."""
    now = dict(parcel_of)
    while True:
        best = None
        for p in set(now.values()) - {0}:
            size = sum(v == p for v in now.values())
            near = [now[b] for a, b in edges if now[a] == p and now[b] not in (0, p)]
            if size <= min_size and near and (best is None or (size, p) < best[:2]):
                best = size, p, max(set(near), key=lambda q: (near.count(q), -q))
        if best is None:
            return now
        now = {n: best[2] if p == best[1] else p for n, p in now.items()}


def test_all_small_parcels_merge(spark):
    rng = np.random.default_rng(3)
    labels = {i: int(p) for i, p in enumerate(np.repeat(np.arange(60), rng.integers(1, 6, 60)))}
    pairs = [(i, i + 1) for i in range(len(labels) - 1)] + [tuple(map(int, p)) for p in rng.integers(0, len(labels), (40, 2))]
    edges = graph.both_ways(spark.createDataFrame(pairs, "src long, dst long"))
    cells = spark.createDataFrame(list(labels.items()), "node long, parcel int")
    expected = one_by_one(labels, [tuple(r) for r in edges.collect()], 4)
    assert len(set(labels.values()) - set(expected.values())) > 20
    assert {r["node"]: r["parcel"] for r in parcellation.merge_small(cells, edges, 4).collect()} == expected
