import pytest

from gridsignal.operators.graph import connected_components


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 201)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[k] == 1 for k in range(1, 41))
    assert all(got[k] == 100 for k in range(100, 130))
    assert got[200] == got[201] == 200


def test_isolated_nodes_and_empty_graph(spark):
    edges = spark.createDataFrame([], "src long, dst long")
    nodes = spark.createDataFrame([(5,), (6,)], "node long")
    assert sorted(map(tuple, connected_components(edges, nodes).collect())) == [(5, 5), (6, 6)]


def test_heavy_nodes_are_dealt_with_apart(spark):
    hub = [(5, k) for k in range(10, 1600)] + [(2000, k) for k in range(2001, 3500)]
    edges = hub + [(3, 40), (1700, 1701), (1701, 1702), (3499, 4000)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {got[k] for k in (3, 5, *range(10, 1600))} == {3}
    assert {got[k] for k in (*range(2000, 3500), 4000)} == {2000}
    assert {got[k] for k in (1700, 1701, 1702)} == {1700}


def test_components_end_whole_or_with_an_error(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(60)], "src long, dst long")
    with pytest.raises(RuntimeError):
        connected_components(path, max_rounds=1)
    assert connected_components(path).filter("component <> 0").isEmpty()


def test_components_of_a_long_path_and_of_random_graphs(spark):
    import random

    r = random.Random(5)
    order = list(range(5000))
    r.shuffle(order)
    path = list(zip(order[:-1], order[1:], strict=True))
    forest = [(10_000 + i, 10_000 + r.randrange(i // 2, i)) for i in range(1, 3000)]
    rows = [(int(a), int(b)) for a, b in path + forest] + [(None, 3), (4, None)]
    edges = spark.createDataFrame(rows, "src int, dst int").repartition(16)
    out = connected_components(edges)
    assert [f.dataType.simpleString() for f in out.schema] == ["int", "int"]
    got = {x["node"]: x["component"] for x in out.collect()}
    top = {n: n for e in path + forest for n in e}

    def root(n):
        while top[n] != n:
            n = top[n]
        return n

    for a, b in forest:
        x, y = root(a), root(b)
        top[max(x, y)] = min(x, y)
    assert all(got[n] == 0 for n in order)
    assert got == {n: 0 if n < 10_000 else root(n) for n in top}
