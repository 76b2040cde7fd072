"""Pieces are connected, nearly even, and no row is lost."""

import random

import numpy as np
import pytest

from gridsignal.operators import fronts, splitting


def connected(cells):
    """Whether cells hang together along the axes."""
    left = set(cells)
    todo = [left.pop()] if left else []
    while todo:
        c = todo.pop()
        for i in range(len(c)):
            for s in (-1, 1):
                n = (*c[:i], c[i] + s, *c[i + 1 :])
                if n in left:
                    left.discard(n)
                    todo.append(n)
    return not left


def pieces(rows, label, axes=("x", "y")):
    out = {}
    for r in rows:
        out.setdefault((r["parcel"], r[label]), []).append(tuple(r[a] for a in axes))
    return out


U = [(x, y) for x in range(9) for y in range(9) if x < 2 or y < 2 or x > 6]
CROSS = [(x, y) for x in range(11) for y in range(11) if 4 <= x <= 6 or 4 <= y <= 6]
RING = [(x, y) for x in range(8) for y in range(8) if x in (0, 7) or y in (0, 7)]
STAR = [(0, 0), *[(s * i, 0) for i in range(1, 6) for s in (-1, 1)], *[(0, s * i) for i in range(1, 6) for s in (-1, 1)]]


@pytest.mark.parametrize(("shape", "parts"), [(U, 3), (U, 4), (CROSS, 4), (CROSS, 7), (RING, 5), ([(x, 0) for x in range(17)], 4), (U, 46), ([(0, 0)], 3)])
def test_patches_are_cut_into_connected_even_parts(shape, parts):
    labels = fronts.even_parts(np.array(shape), splitting.kernel_for(["x", "y"]), parts)
    sizes = np.bincount(labels)
    assert len(sizes) == min(parts, len(shape)) and sizes.max() - sizes.min() <= 1
    assert all(connected([c for c, own in zip(shape, labels, strict=True) if own == p]) for p in range(len(sizes)))


def test_shapes_that_cannot_be_even_stay_connected():
    labels = fronts.even_parts(np.array(STAR), splitting.kernel_for(["x", "y"]), 2)
    assert sorted(np.bincount(labels)) == [5, 16] or all(connected([c for c, own in zip(STAR, labels, strict=True) if own == p]) for p in (0, 1))
    r = random.Random(5)
    for _ in range(30):
        cells = {(0, 0)}
        while len(cells) < 60:
            x, y = r.choice(sorted(cells))
            cells.add(r.choice([(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)]))
        shape = sorted(cells)
        labels = fronts.even_parts(np.array(shape), splitting.kernel_for(["x", "y"]), r.randrange(2, 9))
        assert all(connected([c for c, own in zip(shape, labels, strict=True) if own == p]) for p in set(labels.tolist()))


@pytest.mark.parametrize("parts", [3, 12])
def test_a_parcel_of_several_patches(spark, parts, monkeypatch):
    monkeypatch.setattr(splitting, "PATCH", 40)
    cells = spark.createDataFrame([(x, y, 1) for x in range(12) for y in range(10)], "x int, y int, parcel int")
    got = pieces(splitting.split_parcels(cells, ["x", "y"], spark.createDataFrame([(1, parts)], "parcel int, n_parts int")).collect(), "piece")
    assert len(got) == parts and all(connected(c) for c in got.values()) and sum(map(len, got.values())) == 120
    assert max(map(len, got.values())) - min(map(len, got.values())) <= 2


def test_rows_and_columns_stay(spark):
    """A U-shaped parcel, one in two components, rows without parcel or coordinate, background, columns with clashing names."""
    rows = [(x, y, 5, "u", 1) for x, y in U] + [(x + 20, y, 6, "t", 1) for x in range(4) for y in range(4)] + [(x + 30, y, 6, "t", 1) for x in range(2) for y in range(2)]
    rows += [(1, 1, None, "n", 1), (2, 2, None, "n", 1), (None, 3, 5, "m", 1), (40, 30, 0, "b", 1), (50, 1, 7, "s", 1)]
    cells = spark.createDataFrame(rows, "x int, y int, parcel int, component string, node int").repartition(3)
    got = splitting.split_big_parcels(cells, ["x", "y"], 15).collect()
    assert len(got) == len(rows) and list(got[0].asDict()) == ["x", "y", "parcel", "component", "node"]
    assert sorted((r["x"], r["y"]) for r in got if r["parcel"] is None) == [(1, 1), (2, 2)]
    assert {r["parcel"] for r in got if r["component"] in "bs"} == {0, 7}
    own = pieces([r for r in got if r["component"] in "ut"], "component")
    assert all(connected(c) for c in own.values())
    assert sorted(len(c) for (_, k), c in own.items() if k == "u") == [11, 11, 12, 12] and sorted(len(c) for (_, k), c in own.items() if k == "t") == [4, 8, 8]
    again = splitting.split_big_parcels(cells, ["x", "y"], 1000)
    assert sorted(map(str, again.collect())) == sorted(map(str, cells.collect()))
    assert splitting.split_big_parcels(cells.limit(0), ["x", "y"], 5).isEmpty()


def test_block_of_cells_in_space(spark):
    """Three parcels of 27 cells, with sizes within a cell of each other: a golden case of the API that is matched."""
    block = [(x, y, z) for x in range(1, 4) for y in range(1, 4) for z in range(1, 4)]
    out = splitting.balanced_parcels(spark.createDataFrame(block, "x int, y int, z int"), ["x", "y", "z"], 3).collect()
    own = pieces(out, "parcel", ("x", "y", "z"))
    assert sorted(p for p, _ in own) == [1, 2, 3] and all(len(c) == 9 and connected(c) for c in own.values())
