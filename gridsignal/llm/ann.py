"""Approximate nearest neighbours by cosine with query-aware collision counting (Huang et al., 2015).

Unit vectors are projected on random lines; each line's values are sorted. Around a query's own value a window opens on
every line and widens level by level (virtual rehashing: nothing is hashed again). A vector that is inside the windows
of at least ``THRESHOLD`` lines is verified with its exact cosine. A query ends at the first level whose distance holds
k verified vectors: those nearer than the level's distance have by then passed the threshold with high probability.
There is no cap on verified vectors.

Chances: at the level's distance a line collides with probability 2 Phi(WIDTH / 2) - 1 = 0.84, so at least 31 of 48
lines do with probability above 0.998; at twice the distance the mean is 25.

Defined results: vectors that are null, zero, or hold null or non-finite parts take no part, neither do rows without
id; shorter vectors count as filled up with zeros; ties go to the smaller id; a repeated query id is searched once, by its least vector; with
fewer than k candidates all are found; an empty table gives no rows; extra columns are ignored. A repeated row is a
candidate as often as it occurs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsignal.llm.vectors import search_blocks, top, valid_vectors, widened

LINES = 48
THRESHOLD = 31
WIDTH = 2.8
#: Distance of the first level, and the factor from one to the next. Unit vectors are at most 2 apart.
FIRST, GROWTH, FARTHEST = 0.1, 1.3, 2.0
K = 5


def levels() -> np.ndarray:
    """Distances of the levels; at the last, farther than any vector, all that is left is verified."""
    out = [FIRST]
    while out[-1] <= 2 * FARTHEST:
        out.append(out[-1] * GROWTH)
    return np.array(out)


class SortedProjections:
    """The index of a block: its vectors' values on each line, sorted."""

    def __init__(self, unit: np.ndarray, seed: int = 17):
        self.lines = np.random.default_rng(seed).standard_normal((unit.shape[1], LINES))
        values = unit @ self.lines
        self.order = np.argsort(values, 0, kind="stable").T.astype(np.int32)
        self.values = np.take_along_axis(values.T, self.order, 1)
        self.size = len(unit)
        self.levels = levels()

    def windows(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each query's window on each line begins and ends at each level: (queries, lines, levels) positions."""
        at, half = q @ self.lines, WIDTH * self.levels / 2
        ends = [(np.searchsorted(v, a[:, None] - half), np.searchsorted(v, a[:, None] + half, "right")) for v, a in zip(self.values, at.T, strict=True)]
        return np.stack([lo for lo, _ in ends], 1), np.stack([hi for _, hi in ends], 1)

    def search(self, low: np.ndarray, high: np.ndarray, k: int, distance) -> np.ndarray:
        """Rows that were verified, by one query's windows; ``distance`` gives the exact distances of rows."""
        count = np.zeros(self.size, np.int64)
        done = np.zeros(self.size, bool)
        within: list[np.ndarray] = []
        for level, reach in enumerate(self.levels):
            if level == 0:
                fresh = [o[lo:hi] for o, lo, hi in zip(self.order, low[:, 0], high[:, 0], strict=True)]
            else:
                fresh = [o[lo:hi] for o, lo, hi in zip(self.order, low[:, level], low[:, level - 1], strict=True)]
                fresh += [o[lo:hi] for o, lo, hi in zip(self.order, high[:, level - 1], high[:, level], strict=True)]
            count += np.bincount(np.concatenate(fresh), minlength=self.size)
            new = np.flatnonzero((count >= THRESHOLD) & ~done)
            if len(new):
                done[new] = True
                within.append(distance(new))
            if sum(int((d <= reach).sum()) for d in within) >= k or done.all():
                return np.flatnonzero(done)
        return np.arange(self.size)  # nothing is farther than the last level: take what is left


def nearest(df: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (cosine of the original vectors in double precision)."""

    def block(x, ids):
        x_norm = np.linalg.norm(x, axis=1)
        unit = x / x_norm[:, None]
        index = SortedProjections(unit)

        def search(y, query_ids):
            y_norm = np.linalg.norm(y, axis=1)
            # the rest of a query longer than all rows meets zeros, but counts in its norm
            y = widened(y, x)[0][:, : x.shape[1]]
            asked, rows, scores = [], [], []
            for start in range(0, len(y), 128):
                q = y[start : start + 128] / y_norm[start : start + 128, None]
                low, high = index.windows(q)
                for i in range(len(q)):
                    others = ids != query_ids[start + i]
                    verified = index.search(low[i], high[i], k, lambda r, q=q[i], others=others: np.where(others[r], np.sqrt(np.maximum(2 - 2 * (unit[r] @ q), 0.0)), np.inf))
                    verified = verified[others[verified]]
                    score = (x[verified] @ y[start + i]) / (x_norm[verified] * y_norm[start + i])
                    at = top(score, ids[verified], k)
                    asked.append(np.full(len(at), start + i))
                    rows.append(verified[at])
                    scores.append(score[at])
            return np.concatenate(asked), np.concatenate(rows), np.concatenate(scores)

        return search

    return search_blocks(valid_vectors(df, id_col, vector_col, nonzero=True), is_query, k, block, "double")


def op10_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest found of every row whose vec_id is divisible by 50, over all other rows."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


QUERIES = {"op10_collision_counting": op10_collision_counting}
