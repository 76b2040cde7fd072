import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsignal.llm import negatives

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<double>, label int, rank int, score double, block string"


def plain(rows, k=5, n=10, step=100):
    """All pairs, by plain integers."""
    own = {}
    for i, v, label, *_ in rows:
        if i is None or label is None or v is None or not all(x is not None and math.isfinite(x) for x in v):
            continue
        own.setdefault(i, []).append(([math.floor(256 * x) for x in v], label))
    flat = [(i, v, label) for i, all_of in own.items() for v, label in all_of]
    out = set()
    for a in own:
        if a % step:
            continue
        v, label = min(own[a])
        scored = [(-sum(x * y for x, y in zip(v, w, strict=False)), i, other) for i, w, other in flat if i != a]
        for p, pid, _ in sorted(s for s in scored if s[2] == label)[:k]:
            inside = sorted((s, i) for s, i, other in scored if other != label and 30 * -p <= 100 * -s <= 90 * -p)
            out |= {(a, pid, r, i, -p, -s) for r, (s, i) in enumerate(inside[:n], 1)}
    return out


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(8)
    centres = r.standard_normal((5, 12))
    out = []
    for i in range(900):
        # norms from 0.01 to 10, so that buckets are pruned
        v = (centres[i % 5] + 0.7 * r.standard_normal(12)) * 10 ** r.uniform(-2, 1)
        out.append((i, [float(x) for x in v], int(i % 7), 1, 2.0, "x"))
    out[301] = (301, out[400][1], 1, 1, 2.0, "x")
    out[302] = (302, out[400][1], 2, 1, 2.0, "x")
    out += [(1000, None, 1, 1, 2.0, "x"), (1100, [1.0, None] * 6, 1, 1, 2.0, "x"), (1200, [NAN] * 12, 1, 1, 2.0, "x"), (1300, [INF] * 12, 1, 1, 2.0, "x"), (1400, [0.0] * 12, 1, 1, 2.0, "x")]
    out += [(None, [1.0] * 12, 1, 1, 2.0, "x"), (1500, [1.0] * 12, None, 1, 2.0, "x"), (1600, [-1.0] * 12, 9, 1, 2.0, "x"), (1700, [1.0] * 12, 9, 1, 2.0, "x"), (901, [1.0, 2.0], 3, 1, 2.0, "x")]
    return out


@pytest.mark.parametrize("block", [65536, 150])
def test_against_all_pairs(spark, rows, block, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", 4 if block == 150 else 131072)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = negatives.hard_negatives(df, F.col("vec_id") % 100 == 0).collect()
    want = plain(rows)
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    # a positive of negative score (1700 for 1600) has an empty window
    assert want and 1600 not in {w[0] for w in want}


def test_repeated_anchor_ids_do_not_depend_on_order(spark, rows):
    twice = rows[:300] + [(100, [0.5] * 12, 3, 1, 2.0, "x"), (100, [-9.0] + [0.1] * 11, 4, 1, 2.0, "x")] + rows[200:210]
    a, b = (sorted(map(tuple, negatives.hard_negatives(spark.createDataFrame(t, SCHEMA).coalesce(1), F.col("vec_id") % 100 == 0).collect())) for t in (twice, twice[::-1]))
    assert a == b and {tuple(x) for x in a} == plain(twice)


def test_few_rows_and_none(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for some in (df.limit(0), df.filter("vec_id = 100"), df.filter("vec_id in (100, 107)"), df.filter("label = 2")):
        assert negatives.hard_negatives(some, F.col("vec_id") % 100 == 0).isEmpty()


def test_buckets_are_pruned_by_length():
    r = np.random.default_rng(3)
    x = np.floor(256 * r.standard_normal((5000, 8)) * (10 ** r.uniform(-2, 1, 5000))[:, None])
    index = negatives.NormBuckets(x, np.arange(5000), np.arange(5000) % 2, bucket=100)
    found = index.search(x[:20], np.arange(20), np.zeros(20, int), True, [None] * 20, 5)
    assert len(found) == 20 and index.computed < 0.5 * 20 * 5000
    for a, _, at, score in found:
        s = index.x @ x[a]
        s[(index.ids == a) | (index.labels != 0)] = -np.inf
        assert sorted(score.tolist(), reverse=True) == score.tolist() == np.sort(s)[::-1][:5].tolist()
        assert (s[at] == score).all()


@pytest.mark.parametrize("size", [1e7, 1e14])
def test_large_parts_are_compared_exactly(spark, size):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in size * (3 + 1e-9 * r.standard_normal(6)) * (0.6 if i % 2 else 1)], i % 2, 0, 0.0, "") for i in range(240)]
    got = {tuple(x)[:4] for x in negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0).collect()}
    assert got == {w[:4] for w in plain(rows)} and got


def test_labels_that_an_expression_gives(spark, rows):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    moved = [(i, v, (c + 1) % 10 if c is not None and i is not None and i % 7 == 0 else c) for i, v, c, *_ in rows]
    assert {tuple(x) for x in negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0, label=label).collect()} == plain(moved)
