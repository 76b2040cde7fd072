"""Quality by supervised subword embeddings.

A text is the average of learned vectors of its words and of the character n-grams of its words, all hashed into one
table; a softmax layer turns the average into class probabilities. Vectors and layer are trained together by stochastic
gradient descent in numpy, on a sample of at most ``max_rows`` labelled rows a class, in one task.

With two classes the softmax depends on the difference of the classes' outputs only, which is the average, over the
text's features, of (vector . difference of the output weights). Scoring so needs one number for each table entry.

Defined results: null and empty texts have the average 0 and the score of the layer's bias; without labels of both
classes every score is 0.5; repeated rows are scored alike; a score equal to the cut is predicted 1; extra columns are
ignored. A text of any length is scored whole, in memory in proportion to it alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsignal.llm.labelled import Bytes, chunks, fold, read, scored, training_rows
from gridsignal.llm.text import Words

BUCKET_BITS = 18
#: Character n-grams of these lengths, the spaces around a word included.
LENGTHS = (2, 3, 4)
DIMENSIONS = 8
MAX_ROWS = 4_000
EPOCHS = 12
RATE = 20.0
CUT = 0.3


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every feature: each word and each character n-gram of it."""
    words = Words(texts)
    buckets = [(words.number >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
    rows = [words.doc]
    b = Bytes(texts, lower=False)
    row = np.repeat(np.arange(len(texts)), b.hi - b.lo)
    for n in LENGTHS:
        gram = b.grams(n, whole=True)[1:]
        ok = b.real[1:] & (gram != 0)
        spread = (gram[ok].astype(np.uint64) + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        buckets.append((spread >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
        rows.append(row[ok])
    return np.concatenate(buckets), np.concatenate(rows)


class Subwords:
    """The learned table: ``gain[bucket]`` is vector . (output weights of class 1 - class 0); ``bias`` likewise."""

    def __init__(self, gain: np.ndarray, bias: float):
        self.gain, self.bias = gain, bias

    def score(self, texts: pa.Array) -> np.ndarray:
        bucket, row = features(texts)
        n = np.bincount(row, minlength=len(texts))
        total = np.bincount(row, self.gain[bucket], len(texts))
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + self.bias, -500, 500)))


def train(texts: pa.Array, y: np.ndarray, weight: np.ndarray, seed: int = 5, batch: int = 64) -> Subwords:
    """Stochastic gradient descent on the log-loss of the softmax over mean vectors; the rate falls to 0 linearly."""
    size = 1 << BUCKET_BITS
    if len(np.unique(y)) < 2:
        return Subwords(np.zeros(size, np.float32), 0.0)
    kept = []
    for lo, hi in chunks(texts):
        bucket, row = features(texts.slice(lo, hi - lo))
        pair, n = np.unique(row * size + bucket, return_counts=True)
        row = pair >> BUCKET_BITS
        share = n / np.bincount(row, n, hi - lo)[row]
        kept.append(((row + lo).astype(np.int32), (pair & (size - 1)).astype(np.int32), share.astype(np.float32)))
    row, bucket, value = (np.concatenate(k) for k in zip(*kept, strict=True))
    first = np.searchsorted(row, np.arange(len(y) + 1))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (size, DIMENSIONS)) / DIMENSIONS
    out, bias = np.zeros((2, DIMENSIONS)), np.zeros(2)
    target = np.eye(2)[y]
    w = weight / weight.mean()
    steps = EPOCHS * -(-len(y) // batch)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), batch):
            docs = order[lo : lo + batch]
            at = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
            of = np.repeat(np.arange(len(docs)), first[docs + 1] - first[docs])
            f, v = bucket[at], value[at]
            keys, inv = np.unique(f, return_inverse=True)
            own = vectors[keys]
            mean = np.stack([np.bincount(of, v * own[inv, k], len(docs)) for k in range(DIMENSIONS)], 1)
            logit = mean @ out.T + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            error = (p - target[docs]) * w[docs, None] / len(docs)
            rate = RATE * (1 - step / steps)
            back = error @ out
            grad = np.stack([np.bincount(inv, v * back[of, k], len(keys)) for k in range(DIMENSIONS)], 1)
            out -= rate * error.T @ mean
            bias -= 0.05 * rate * error.sum(0)
            vectors[keys] -= rate * grad
            step += 1
    return Subwords((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, keep, max_rows: int = MAX_ROWS) -> Subwords:
    """Train in one task on the sample; the driver receives the table only."""
    rows = training_rows(docs, labels, "quality", keep, max_rows)

    def run(table: pa.Table) -> pa.Table:
        # in the order of a value, as rows arrive in any order
        table = table.sort_by([("text", "ascending"), ("y", "ascending")]).combine_chunks()
        model = train(table.column("text").chunk(0), table.column("y").to_numpy().astype(int), table.column("weight").to_numpy())
        return pa.table({"gain": [model.gain.tobytes()], "bias": [model.bias]})

    # the sample has a bound, so one task can hold it
    got = rows.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(run, "gain binary, bias double").collect()
    if not got:
        return Subwords(np.zeros(1 << BUCKET_BITS, np.float32), 0.0)
    return Subwords(np.frombuffer(bytes(got[0]["gain"]), np.float32), got[0]["bias"])


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, cut: float = CUT, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; rows whose crc32(doc_id) mod ``folds`` is ``held`` never train."""
    model = fit(docs, labels, fold(F.col("doc_id"), folds) != held, max_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return scored(docs, lambda texts: shared.value.score(texts), folds, held, cut)


def op5_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {"op5_subword_quality": op5_subword_quality}
