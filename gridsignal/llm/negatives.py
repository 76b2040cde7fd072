"""Hard-negative mining by norm-bucketed search.

An anchor's positives are its best rows of the same label; a positive's negatives are the best rows of other labels
whose score lies in a window below the positive's score. Both are searches by inner product. Candidates are dealt to
blocks by ranges of their norm; a task sorts its block by norm, cuts it into buckets and puts them to the anchors from
the longest vectors on. By Cauchy and Schwarz no row of a bucket scores above |anchor| * (largest norm of the bucket),
so an anchor is done with a block at the first bucket where this bound is below what it still looks for: the least
lower limit of its windows, or, for windows that are full, their running k-th score. The same bound tells before
anything is sent which anchors a block can't serve, so those don't travel to it.

Blocks are of bounded size, anchors stream past them in batches, and a block returns at most k rows a window. Scores are
whole numbers: doubles below 2^52, Python's integers where norms allow larger ones.

Defined results: rows without id or label, and rows whose vector is null or has a part that is null, not finite or
infinite after scaling, take no part; shorter vectors count as filled up with zeros; a repeated anchor id stands for its
least vector and label, and rows with the anchor's own id are no candidates; any other repeated row is a candidate as often as it
occurs; ties go to the smaller id; a positive of negative score has an empty window, one of score 0 takes negatives of
score 0; anchors without positives and positives without negatives give no rows; scores beyond 38 digits count as
10^38 - 1 and are returned as the nearest long; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridsignal.llm.vectors import matrix, widened
from gridsignal.session import written

#: Rows in a block at most, and in a block of a table too small for ``BLOCKS`` larger ones (all about).
BLOCK_ROWS, LEAST_ROWS, BLOCKS = 65536, 8192, 64
#: Rows in a bucket, anchors put to a bucket at once, and anchors that one task puts to its block.
BUCKET, BATCH, BLOCK_ANCHORS = 1024, 256, 131072
LARGEST = 10**38 - 1
SCORE = "decimal(38,0)"



@dataclass(frozen=True)
class Span:
    """A window's lower and upper limit, as hundredths of the positive's score."""

    low: int = 30
    high: int = 90

    def limits(self, score: int) -> tuple[int, int]:
        """The least and the largest whole score inside the window; the first is larger if there is none."""
        return -(-self.low * score // 100), self.high * score // 100


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers held as doubles; Python's integers, up to 38 digits, if doubles could round."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)))
    with np.errstate(over="ignore"):
        largest = np.abs(a).max() * np.abs(b).max() * a.shape[1]
    if largest < 2.0**52:
        return a @ b.T
    whole = np.frompyfunc(int, 1, 1)
    within = np.frompyfunc(lambda s: max(-LARGEST, min(LARGEST, s)), 1, 1)
    return within(whole(a) @ whole(b).T)


def norms(x: np.ndarray) -> np.ndarray:
    """Euclidean norms, rounded up a little, without overflow of squares."""
    peak = np.abs(x).max(1, initial=0.0)
    with np.errstate(invalid="ignore", divide="ignore"):
        unit = np.where(peak[:, None] > 0, x / np.where(peak > 0, peak, 1)[:, None], 0.0)
        return np.sqrt((unit * unit).sum(1)) * peak * (1 + 1e-12)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by score from high to low, then by id."""
    if score.dtype == object:
        return np.array(sorted(range(len(score)), key=lambda i: (-score[i], ids[i]))[:k], np.int64)
    if len(score) > k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))][:k]


class NormBuckets:
    """A block's rows from the longest to the shortest, in buckets. ``computed`` counts the products that were needed."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, bucket: int | None = None):
        size = norms(x)
        order = np.argsort(-size, kind="stable")
        self.x, self.ids, self.labels = x[order], ids[order], labels[order]
        self.buckets = [slice(i, min(i + (bucket or BUCKET), len(x))) for i in range(0, len(x), bucket or BUCKET)]
        self.longest = [float(size[order[b.start]]) for b in self.buckets]
        self.computed = 0

    def search(self, anchors: np.ndarray, anchor_ids: np.ndarray, anchor_labels: np.ndarray, same: bool, windows: list[list[tuple[int, int]] | None], k: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(anchor, window, rows, scores) of each window's k best rows, inside the block.

        ``windows``: for each anchor its windows' limits (None: one window without limits). ``same``: rows of the
        anchor's label, otherwise rows of other labels.
        """
        length = norms(anchors)
        found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        least = [[-np.inf] if w is None else [low if low <= high else np.inf for low, high in w] for w in windows]
        alive = np.array([bool(w) for w in least], bool)
        for bucket, longest in zip(self.buckets, self.longest, strict=True):
            # what each anchor still looks for: the easiest of its windows decides
            needs = np.array([min((float(v) for v in w), default=np.inf) for w in least])
            alive &= length * longest >= needs
            asked = np.flatnonzero(alive)
            if not len(asked):
                break
            ids, labels = self.ids[bucket], self.labels[bucket]
            scores = exact_products(anchors[asked], self.x[bucket])
            self.computed += scores.size
            for a, score in zip(asked, scores, strict=True):
                fits = (ids != anchor_ids[a]) & ((labels == anchor_labels[a]) == same)
                for w, limits in enumerate([None] if windows[a] is None else windows[a]):
                    inside = fits if limits is None else fits & (score >= limits[0]) & (score <= limits[1])
                    floor = least[a][w]
                    at = np.flatnonzero(inside & (score >= floor))
                    if not len(at):
                        continue
                    rows, own = at + bucket.start, score[at]
                    if (a, w) in found:
                        rows, own = np.concatenate([found[a, w][0], rows]), np.concatenate([found[a, w][1], own])
                    top = best(own, self.ids[rows], k)
                    found[a, w] = rows[top], own[top]
                    if len(top) == k:
                        least[a][w] = own[top[-1]]
        return [(a, w, rows, own) for (a, w), (rows, own) in found.items()]


def no_scores() -> Column:
    return F.lit(None).cast(f"array<{SCORE}>")


def labelled_vectors(df: DataFrame, label: Column, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, label, vector (whole numbers as doubles), norm of the rows that take part; batch by batch, no row moves."""
    fields = [("vec_id", pa.int64()), ("label", pa.int64()), ("vector", pa.list_(pa.float64())), ("norm", pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(2)
            ends = rows.offsets.to_numpy()
            flat = rows.values.slice(ends[0], ends[-1] - ends[0]).to_numpy(zero_copy_only=False).astype(float)
            with np.errstate(over="ignore", invalid="ignore"):
                flat = np.floor(flat * scale)
            # nulls inside a vector are NaN here
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])[ends - ends[0]]
            keep = np.flatnonzero((np.diff(bad) == 0) & rows.is_valid().to_numpy(zero_copy_only=False))
            whole = pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), pa.array(flat))
            table = pa.table([batch.column(0), batch.column(1), whole], ["vec_id", "label", "vector"]).take(keep)
            size = norms(matrix(table.column("vector"))) if len(keep) else np.zeros(0)
            yield from table.append_column("norm", pa.array(size)).cast(pa.schema(fields)).combine_chunks().to_batches()

    own = df.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    return own.filter("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").mapInArrow(run, "vec_id long, label long, vector array<double>, norm double")


def search_blocks(blocks: DataFrame, bounds: list[float], anchors: DataFrame, same: bool, k: int, span: Span) -> DataFrame:
    """anchor_id, window (place in the anchor's ``scores``, 0 without), vec_id, score, rank: the k best of each window.

    ``blocks``: the rows, with ``block``; ``bounds``: each block's largest norm. ``anchors``: vec_id, label, vector, norm,
    ``scores`` (of its positives; null: one window without limits) and ``need`` (the least score it looks for, null: any).
    """
    n_blocks = len(bounds)
    slices = max(1, -(-anchors.count() // BLOCK_ANCHORS))
    # a number a block of up to 65,536 rows; beyond 4096 blocks all have the largest norm's bound
    longest = F.array(*[F.lit(b) for b in bounds]) if n_blocks <= 4096 else F.array_repeat(F.lit(max(bounds)), n_blocks)
    serves = lambda b: F.col("need").isNull() | (F.col("norm") * F.element_at(longest, b + 1) * (1 + 1e-9) >= F.col("need"))
    to = F.explode(F.filter(F.sequence(F.lit(0), F.lit(n_blocks - 1)), serves))
    asked = anchors.select("vec_id", "label", "vector", "scores", to.alias("block"), F.lit(True).alias("asked"), F.pmod(F.xxhash64("vec_id"), F.lit(slices)).cast("int").alias("slice"))
    data = blocks.select("vec_id", "label", "vector", no_scores().alias("scores"), "block", F.lit(False).alias("asked"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    both = data.unionByName(asked).select("vec_id", "label", "vector", "scores", "asked", (F.col("block") * slices + F.col("slice")).cast("int").alias("task"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        block: NormBuckets | None = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            asks = part.column("asked").to_numpy()
            held += [part.filter(~asks)] if not asks.all() else []
            if not asks.any():
                continue
            if held:
                rows, held = pa.concat_tables(held).combine_chunks(), []
                block = NormBuckets(matrix(rows.column("vector")), rows.column("vec_id").to_numpy(), rows.column("label").to_numpy())
            if block is None:
                continue
            now = part.filter(asks)
            for start in range(0, now.num_rows, BATCH):
                some = now.slice(start, BATCH)
                own = some.column("vec_id").to_numpy()
                # the rest of an anchor longer than all rows meets zeros
                y = widened(matrix(some.column("vector")), block.x)[0][:, : block.x.shape[1]]
                windows = [None if w is None else [span.limits(int(x)) for x in w] for w in some.column("scores").to_pylist()]
                found = block.search(y, own, some.column("label").to_numpy(), same, windows, k)
                out = [(int(own[a]), w, int(block.ids[r]), Decimal(int(s))) for a, w, best_rows, score in found for r, s in zip(best_rows, score, strict=True)]
                cols = list(zip(*out, strict=True)) or [()] * 4
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["anchor_id", "window", "vec_id", "score"])

    # a partition is a task's block, rows before anchors
    placed = both.repartitionById(n_blocks * slices, F.col("task")).sortWithinPartitions("asked")
    found = placed.mapInArrow(run, f"anchor_id long, window int, vec_id long, score {SCORE}")
    order = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)


def hard_negatives(df: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, span: Span = Span(), label: Column | str = "label", scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:  # noqa: B008
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on ``vec_id``; ``label`` the label's column or expression over ``df``.
    """
    rows = labelled_vectors(df, F.col(label) if isinstance(label, str) else label, scale, id_col, vector_col)
    count = rows.count()
    n_blocks = max(1, -(-count // BLOCK_ROWS), min(BLOCKS, count // LEAST_ROWS))
    # ranges of the norm, rows of one norm told apart by a hash; written, as the ranges come from a sample
    tie = F.xxhash64("vec_id", "vector", F.monotonically_increasing_id())
    blocks = written(rows.withColumn("tie", tie).repartitionByRange(n_blocks, F.desc("norm"), "tie").withColumn("block", F.spark_partition_id()).drop("tie"))
    # a row a block
    found = {r["block"]: r["longest"] for r in blocks.groupBy("block").agg(F.max("norm").alias("longest")).collect()}
    bounds = [float(found.get(b, 0.0)) for b in range(max(found, default=0) + 1)]
    own = F.min_by(F.struct("label", "vector", "norm"), F.struct("vector", "label"))
    anchors = blocks.filter(is_anchor).groupBy("vec_id").agg(own.alias("own")).select("vec_id", "own.*")
    first = search_blocks(blocks, bounds, anchors.select("*", no_scores().alias("scores"), F.lit(None).cast("double").alias("need")), True, positives, span)
    first = written(first.select("anchor_id", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # five scores an anchor
    wanted = first.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "positive_score"))).alias("found"))
    scores = F.transform("found", lambda w: w["positive_score"])
    # windows of negative scores are empty
    need = F.array_min(F.transform(F.filter(scores, lambda s: s >= 0), lambda s: s.cast("double"))) * F.lit(span.low / 100)
    asking = anchors.join(wanted, "vec_id").select("vec_id", "label", "vector", "norm", scores.alias("scores"), need.alias("need")).filter("need IS NOT NULL")
    second = search_blocks(blocks, bounds, asking, False, negatives, span)
    named = first.select("anchor_id", (F.col("rank") - 1).alias("window"), "positive_id", "positive_score")
    out = second.select("anchor_id", "window", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(named, ["anchor_id", "window"])
    ends = [F.lit(Decimal(e)).cast(SCORE) for e in (2**63 - 1, -(2**63))]
    as_long = lambda c: F.greatest(F.least(F.col(c), ends[0]), ends[1]).cast("long").alias(c)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", as_long("positive_score"), as_long("negative_score"))


def op11_norm_bucketed_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hard negatives for each of the five positives of every anchor, labels damaged as the contract says."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, label=label)


QUERIES = {"op11_norm_bucketed_negatives": op11_norm_bucketed_negatives}
ORACLES = {
    "op11_norm_bucketed_negatives": """
    WITH v AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
                      list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
               WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
         s AS (SELECT q.vec_id AS anchor_id, q.label = c.label AS same, c.vec_id,
                      CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
               FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
         p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
               QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
         n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
                      CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
               FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
    """
}
