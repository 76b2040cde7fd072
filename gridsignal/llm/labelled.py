"""What the two classifiers share: labelled training rows and byte n-grams of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsignal.llm.text import LOWER, SEPARATOR

#: Bytes of text handled at once in a task.
CHUNK = 1 << 20


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (null: as an empty text)."""
    return (F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def training_rows(docs: DataFrame, labels: DataFrame, label: str, keep: Column, max_rows: int, seed: int = 11) -> DataFrame:
    """Columns text, y and weight of a class-wise sample of at most about ``max_rows`` labelled rows a class.

    Rows are chosen by a hash of doc_id, so reruns agree. ``weight`` restores the classes' shares. Rows without label or
    text are left out. A doc_id labelled more than once counts once, with its largest label.
    """
    y = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).filter(keep)
    totals = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a class
    share = F.lit(1.0)
    for value, n in totals.items():
        if n > max_rows:
            share = F.when(F.col("y") == value, F.lit(max_rows / n)).otherwise(share)
    drawn = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 40)) / float(1 << 40)) < share
    chosen = y.filter(drawn).withColumn("weight", 1.0 / share)
    # at most about max_rows ids a class, whatever the tables hold: sent to the texts, which then needn't be shuffled
    return docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "y", "weight")


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each, one row at least."""
    sizes = np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(float)) if len(texts) else np.zeros(0)
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, "right")))
        yield lo, hi
        lo = hi


class Bytes:
    """The bytes of some texts, each text between two spaces, every separator a space.

    ``data``: the bytes; ``real``: where a byte is not a space that follows a space; ``since``: how many bytes back the
    space before the current word stands (0 at a space's own place counts from the word before it); ``row``: first and
    last place of each text.
    """

    def __init__(self, texts: pa.Array, lower: bool):
        raw = [b"" if t is None else t.encode() for t in texts.to_pylist()]
        joined = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
        sep = SEPARATOR[joined]
        self.data = np.where(sep, np.uint8(0x20), LOWER[joined] if lower else joined)
        self.real = np.ones(len(joined), bool)
        self.real[0] = False
        self.real[1:] = ~(sep[1:] & sep[:-1])
        place = np.arange(len(joined))
        last = np.maximum.accumulate(np.where(sep, place, 0))
        self.since = np.zeros(len(joined), np.int64)
        self.since[1:] = place[1:] - last[:-1]
        sizes = np.array([len(r) for r in raw], np.int64)
        self.lo = 1 + np.concatenate([[0], np.cumsum(sizes + 1)])[:-1] if len(raw) else np.zeros(0, np.int64)
        self.hi = self.lo + sizes + 1
        ends_word = sep.copy()
        ends_word[0] = False
        ends_word[1:] &= ~sep[:-1]
        self.words = self.sums(ends_word.astype(np.float64)).astype(np.int64)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of ``values`` over each text and the space after it."""
        total = np.concatenate([[0.0], np.cumsum(values)])
        return total[self.hi] - total[self.lo]

    def grams(self, n: int, whole: bool = False) -> np.ndarray:
        """For each byte, the last ``n`` (up to 4) bytes as one number, none from before the space that opens the word.

        ``whole``: 0 where fewer than n bytes of the word, spaces included, are there.
        """
        out = self.data.astype(np.uint32)
        for i in range(1, n):
            before = np.zeros(len(out), np.uint32)
            before[i:] = self.data[:-i]
            ok = self.since >= i
            if whole and i == n - 1:
                return np.where(ok, out | (before << np.uint32(8 * i)), np.uint32(0))
            out |= np.where(ok, before << np.uint32(8 * i), np.uint32(0))
        return out


def scored(docs: DataFrame, score, folds: int, held: int, cut: float) -> DataFrame:
    """doc_id, held_out, score and predicted; ``score`` maps an Arrow array of texts to an array of numbers.

    One scan, no shuffle. ``score`` is called on about CHUNK bytes of text at a time.
    """
    schema = docs.select("doc_id").schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            got = [score(texts.slice(lo, hi - lo)) for lo, hi in chunks(texts)]
            values = np.concatenate(got) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.float64())], ["doc_id", "score"])

    out = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
    return out.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic regression on one feature, by Newton's method."""
    mean, spread = np.average(x, weights=weight), max(float(np.sqrt(np.cov(x, aweights=weight))) if len(x) > 1 else 1.0, 1e-9)
    z = np.stack([(x - mean) / spread, np.ones(len(x))], 1)
    beta = np.zeros(2)
    w = weight / weight.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (w * (p - y)) + ridge * beta * [1, 0]
        hess = (z * (w * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ z + np.diag([ridge, 1e-9])
        step = np.linalg.solve(hess, grad)
        beta -= step
        if np.abs(step).max() < 1e-10:
            break
    return beta[0] / spread, beta[1] - beta[0] * mean / spread
