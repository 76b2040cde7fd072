import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsignal.llm import ann, topk, vectors

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(2)
    centres = r.standard_normal((6, 16))
    rows = [(i, [float(x) for x in centres[i % 6] + 0.4 * r.standard_normal(16)], 1, 2.0) for i in range(600)]
    rows[100] = (100, rows[50][1], 1, 2.0)
    rows[150] = (150, rows[50][1], 1, 2.0)
    rows += [(700, None, 1, 2.0), (750, [1.0, None] * 8, 1, 2.0), (800, [NAN] * 16, 1, 2.0), (850, [INF] * 16, 1, 2.0), (900, [0.0] * 16, 1, 2.0), (None, [1.0] * 16, 1, 2.0), (901, [1.0, 2.0], 1, 2.0)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score double").repartition(3)


def valid(rows, zero):
    out = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v)):
            out[i] = np.array(v + [0.0] * (16 - len(v)))
    return out


def ranked(got):
    out = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("block", [8192, 100])
def test_top_k_is_exact(table, block, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 5)
    rows, df = table
    own = {i: np.floor(256 * v) for i, v in valid(rows, True).items()}
    got = ranked(topk.top_k(df, F.col("vec_id") % 50 == 0).collect())
    assert set(got) == {i for i in own if i % 50 == 0}
    for q, found in got.items():
        best = sorted(((int(own[q] @ v), i) for i, v in own.items() if i != q), key=lambda x: (-x[0], x[1]))[:5]
        assert found == [(i, s) for s, i in best]


def test_m_tree_with_many_equal_rows():
    x = np.repeat(np.arange(4.0)[:, None], 3, 1).repeat(700, 0)
    ids = np.arange(len(x))[::-1].copy()
    rows, score = topk.MTree(x).search(np.ones(3), 5, ids, -1)
    assert score.tolist() == [9.0] * 5 and sorted(ids[rows]) == ids[rows].tolist() == [0, 1, 2, 3, 4]


def test_neighbours_reach_recall(table):
    rows, df = table
    own = valid(rows, False)
    got = ranked(ann.nearest(df, F.col("vec_id") % 50 == 0).collect())
    assert set(got) == {i for i in own if i % 50 == 0}
    hits = total = 0
    for q, found in got.items():
        cos = {i: float(own[q] @ v / np.linalg.norm(own[q]) / np.linalg.norm(v)) for i, v in own.items() if i != q}
        best = sorted(cos, key=lambda i: (-cos[i], i))[:5]
        hits += len(set(best) & {i for i, _ in found})
        total += 5
        for i, s in found:
            assert s == pytest.approx(cos[i], abs=1e-12)
    assert hits >= 0.95 * total


def test_few_candidates_and_none(spark, table):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    for search in (topk.top_k, ann.nearest):
        assert [r["vec_id"] for r in search(few, F.col("vec_id") % 50 == 0).orderBy("rank").collect()] == [2, 1]
        assert search(few.limit(0), F.col("vec_id") % 50 == 0).isEmpty()
        assert search(few.filter("vec_id = 0"), F.col("vec_id") % 50 == 0).isEmpty()


def exact_best(own, q, k=5):
    """The k best by plain integers; ``own`` is a list of (id, parts), ids may repeat."""
    ask = next(v for i, v in own if i == q)
    return sorted(((sum(a * b for a, b in zip(ask, v, strict=True)), i) for i, v in own if i != q), key=lambda x: (-x[0], x[1]))[:k]


@pytest.mark.parametrize("size", [1e7, 1e12, 1e290])
def test_top_k_with_large_parts(spark, size):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in size * (3 + 1e-9 * r.standard_normal(16))]) for i in range(200)]
    own = [(i, [int(math.floor(256 * x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ranked(topk.top_k(df, F.col("vec_id") % 50 == 0).collect())
    assert set(got) == {0, 50, 100, 150}
    for q, found in got.items():
        best = exact_best(own, q)
        if size < 1e20:
            assert [i for i, _ in found] == [i for _, i in best]
        assert [s for _, s in found] == [min(s, 2**63 - 1) for s, _ in best]


def test_integer_path_ranks_like_plain_integers():
    x = np.floor(256 * 1e100 * (3 + 1e-15 * np.random.default_rng(7).standard_normal((1500, 8))))
    own = [(i, [int(v) for v in row]) for i, row in enumerate(x)]
    rows, score = topk.MTree(x).search(x[4], 5, np.arange(1500), 4)
    assert list(zip(score, rows.tolist(), strict=True)) == exact_best(own, 4)


@pytest.mark.parametrize("search", [topk.top_k, ann.nearest])
def test_repeated_rows(spark, search):
    """A row is a candidate as often as it occurs; a repeated query id is searched once."""
    rows = [(0, [1.0, 0.0])] * 3 + [(1, [1.0, 0.1])] * 4 + [(2, [0.5, 0.5])] * 400 + [(50, [0.0, 1.0])]
    got = ranked(search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), F.col("vec_id") % 50 == 0).collect())
    assert [i for i, _ in got[0]] == [1, 1, 1, 1, 2]
    assert [i for i, _ in got[50]] == [2, 2, 2, 2, 2]


def test_large_copies_of_one_row_are_dealt_to_all_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 100)
    rows = spark.range(1000).select(F.lit(7).cast("long").alias("vec_id"), F.array(F.lit(1.0)).alias("vector"))
    seen = vectors.search_blocks(rows, F.col("vec_id") == 7, 2000, lambda x, ids: lambda y, own: (np.zeros(1, int), np.zeros(1, int), np.array([float(len(x))])), "double").collect()
    assert len(seen) == 10 and max(r["score"] for r in seen) < 250


def test_tables_of_queries_only_and_longer_queries(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [1.0, 1.0]), (2, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r)[2:] for r in topk.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 256 * 256 * 3), (2, 256 * 256 * 2)]
    assert [r["vec_id"] for r in ann.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [1, 2]


@pytest.mark.parametrize("search", [topk.top_k, ann.nearest])
def test_a_repeated_query_id_stands_for_its_least_vector(spark, search):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0]), (3, [0.5, 0.5])]
    found = [ranked(search(spark.createDataFrame(t, "vec_id long, embedding array<double>").coalesce(1), F.col("vec_id") % 50 == 0, 2).collect()) for t in (rows, rows[::-1], [rows[1], rows[0], *rows[2:]])]
    assert found[0] == found[1] == found[2] and [i for i, _ in found[0][0]] == [2, 3]
