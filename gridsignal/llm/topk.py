"""Exact top-k search by inner product with M-trees (Ciaccia, Patella and Zezula, 1997), searched best first.

Inner product is no metric. With M the largest norm in a block, x becomes (x, sqrt(M^2 - |x|^2)) and q becomes (q, 0);
then d(q, x)^2 = M^2 + |q|^2 - 2 q.x, so the nearest rows are those of highest inner product, and the triangle
inequality holds. A page holds entries with the distance to their parent's pivot, pivots of inner pages with a covering
radius too. An entry is skipped without computing its distance when |d(q, parent) - d(entry, parent)| - radius exceeds
the k-th best distance so far. Bounds have a margin for rounding, in proportion to the norms. Scores are exact: products
below 2^52 run as whole doubles; where norms allow larger ones, the rows that rounding leaves in doubt are scored in
Python's integers.

Defined results: vectors that are null or hold null or non-finite parts take no part, neither do those with a part that
scaling makes infinite (beyond 7e305) or rows without id; scores are ranked exactly up to 38 digits and returned as the
nearest long; beyond 38 digits they tie. Shorter vectors count as filled up with zeros; ties go to the smaller id; a repeated query id is searched once, by its least vector; an empty
table gives no rows; extra columns are ignored. A repeated row is a candidate as often as it occurs.
"""

from __future__ import annotations

import heapq
from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsignal.llm.vectors import search_blocks, top, valid_vectors, widened

PAGE = 512
FAN_OUT = 8
K = 5


#: Scores kept apart: the largest number of 38 digits.
LARGEST = 10**38 - 1


def unit_sized(x: np.ndarray) -> np.ndarray:
    """``x`` divided by a power of two, if its squares could overflow; as it is otherwise."""
    peak = float(np.abs(x).max()) if x.size else 0.0
    return x if peak < 2.0**100 else np.ldexp(x, -int(np.frexp(peak)[1]))


class Page:
    """Entries of a node: ``rows`` are objects (leaf) or pivots, ``vectors`` theirs, ``to_parent`` their distances to the node's pivot."""

    __slots__ = ("children", "radius", "rows", "to_parent", "vectors")

    def __init__(self, rows: np.ndarray, vectors: np.ndarray, to_parent: np.ndarray, radius: np.ndarray | None = None, children: list[Page] | None = None):
        self.rows, self.vectors, self.to_parent, self.radius, self.children = rows, vectors, to_parent, radius, children

    def scores(self, near: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Inner products of the entries at ``near``; a page that is mostly near is multiplied as it is."""
        return (self.vectors @ q)[near] if 2 * len(near) > len(self.rows) else self.vectors[near] @ q


class MTree:
    """A bulk-loaded tree over the rows of an integer matrix."""

    def __init__(self, x: np.ndarray, seed: int = 3):
        self.whole, self.x = x, unit_sized(x)
        self.norm2 = (self.x * self.x).sum(1)
        self.top2 = float(self.norm2.max()) if len(x) else 0.0
        self.last = np.sqrt(np.maximum(self.top2 - self.norm2, 0.0))
        self.rng = np.random.default_rng(seed)
        self.root = self._load(np.arange(len(x)), 0) if len(x) else None

    def _between(self, rows: np.ndarray, pivot: int) -> np.ndarray:
        d2 = self.norm2[rows] + self.norm2[pivot] - 2 * (self.x[rows] @ self.x[pivot]) + (self.last[rows] - self.last[pivot]) ** 2
        return np.sqrt(np.maximum(d2, 0.0))

    def _load(self, rows: np.ndarray, pivot: int) -> Page:
        if len(rows) <= PAGE:
            return Page(rows, self.x[rows], self._between(rows, pivot))
        seeds = self.rng.choice(rows, FAN_OUT, replace=False)
        nearest = np.stack([self._between(rows, s) for s in seeds], 1).argmin(1)
        pivots, radius, children = [], [], []
        if len(np.unique(nearest)) == 1:  # equal rows: any split will do
            nearest = np.arange(len(rows)) % FAN_OUT
        for i, s in enumerate(seeds):
            part = rows[nearest == i]
            if len(part):
                pivots.append(s)
                radius.append(self._between(part, s).max())
                children.append(self._load(part, s))
        own = np.array(pivots)
        return Page(own, self.x[own], self._between(own, pivot), np.array(radius), children)

    def _integers(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Inner products as Python integers."""
        own = [int(v) for v in q]
        out = np.empty(len(rows), object)
        out[:] = [sum(int(a) * b for a, b in zip(self.whole[r].tolist(), own, strict=True)) for r in rows]
        return out

    def search(self, whole_q: np.ndarray, k: int, ids: np.ndarray, own_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best by (score, smaller id), rows with ``own_id`` left out.

        ``whole_q`` is as wide as the rows. Scores are doubles, or Python integers where doubles could round.
        """
        q = unit_sized(whole_q)
        q2 = float(q @ q)
        base, largest = self.top2 + q2, np.sqrt(self.top2) * np.sqrt(q2)
        rounds = largest >= 2.0**52 or self.x is not self.whole or q is not whole_q
        doubt = len(q) * 2.0**-50 * largest if rounds else 0.0
        margin = 4 * np.sqrt((len(q) + 8) * 2.0**-52) * (1e-3 + np.sqrt(base))
        best_rows, best, rough = np.zeros(0, np.int64), np.zeros(0, object if rounds else float), np.zeros(0)
        reach = np.inf
        at_root = np.sqrt(max(base - 2 * float(self.x[0] @ q), 0.0))
        heap: list[tuple[float, int, float, Page]] = [(0.0, 0, at_root, self.root)]
        pushed = 1
        while heap:
            bound, _, to_pivot, page = heapq.heappop(heap)
            if bound > reach + margin:
                break
            near = np.flatnonzero(np.abs(to_pivot - page.to_parent) - (0.0 if page.radius is None else page.radius) <= reach + margin)
            rows, score = page.rows[near], page.scores(near, q)
            if page.children is None:
                keep = (score >= rough.min() - 2 * doubt if len(best) == k else np.ones(len(score), bool)) & (ids[rows] != own_id)
                if not keep.any():
                    continue
                rows, score = rows[keep], score[keep]
                exact = self._integers(rows, whole_q) if rounds else score
                rows, exact, score = np.concatenate([best_rows, rows]), np.concatenate([best, exact]), np.concatenate([rough, score])
                if rounds:
                    at = np.array(sorted(range(len(rows)), key=lambda i: (-exact[i], ids[rows[i]]))[:k])
                else:
                    at = top(exact, ids[rows], k)
                best_rows, best, rough = rows[at], exact[at], score[at]
                if len(best) == k:
                    reach = np.sqrt(max(base - 2 * rough.min(), 0.0))
            else:
                distance = np.sqrt(np.maximum(base - 2 * score, 0.0))
                for i, d in zip(near, distance, strict=True):
                    low = max(0.0, d - page.radius[i])
                    if low <= reach + margin:
                        heapq.heappush(heap, (low, pushed, d, page.children[i]))
                        pushed += 1
        return best_rows, best


def top_k(df: DataFrame, is_query, k: int = K, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the exact inner products of floor(scale * x)."""

    def index(x, ids):
        tree = MTree(np.floor(scale * x))

        def search(y, query_ids):
            # the rest of a query longer than all rows meets zeros
            y = widened(np.floor(scale * y), x)[0][:, : x.shape[1]]
            got = [tree.search(q, k, ids, i) for q, i in zip(y, query_ids, strict=True)]
            asked = np.repeat(np.arange(len(y)), [len(r) for r, _ in got])
            score = [Decimal(max(-LARGEST, min(LARGEST, int(s)))) for _, found in got for s in found]
            return asked, np.concatenate([r for r, _ in got]), score

        return search

    rows = valid_vectors(df, id_col, vector_col)
    rows = rows.filter(F.forall("vector", lambda v: F.abs(v * F.lit(float(scale))) < float("inf")))
    out = search_blocks(rows, is_query, k, index, "decimal(38,0)")
    ends = [F.lit(Decimal(e)).cast("decimal(38,0)") for e in (2**63 - 1, -(2**63))]
    return out.withColumn("score", F.greatest(F.least("score", ends[0]), ends[1]).cast("long"))


def op3_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products of every row whose vec_id is divisible by 50, over all other rows."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


QUERIES = {"op3_mtree_topk": op3_mtree_topk}
ORACLES = {
    "op3_mtree_topk": """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
         s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
               FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
         r AS (SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """
}
