"""Toxicity by two class-conditional Kneser-Ney models over the characters of words.

One model is trained on texts labelled toxic, one on ordinary texts. Both predict each byte of a word, and the space
that ends it, from up to ORDER - 1 bytes before it, none from before the word. The highest order has each class's own
counts; the orders below are shared: Kneser-Ney continuation counts (how many different bytes precede an n-gram) pooled
over the classes. An expression that is rare in one class thus backs off to what both classes know, and only well-seen
spellings tell the classes apart. A text's feature is the difference of its log-likelihoods divided by its number of
words and SHORT more, so that one odd spelling doesn't decide on a text of few words; a logistic curve fitted on the
training rows makes it a score.

As the backoff distribution is shared, an n-gram unseen in both classes contributes log(backoff weight toxic / ordinary)
of its context only. The model is thus two sorted tables: n-gram -> contribution, context -> contribution. Its size is
bounded by the sample: at most ``max_rows`` labelled rows a class.

Defined results: null and empty texts have feature 0 and the score that goes with it; without labels, or if all labelled
texts are empty, every score is 0.5; with labels of one class only, 1 - 1e-13 (toxic) or 1e-13; repeated rows are scored
alike; a score equal to the cut is predicted toxic; extra columns are ignored. A text of any length is scored in pieces
of memory in proportion to it alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsignal.llm.labelled import Bytes, chunks, fold, logistic, read, scored, training_rows
from gridsignal.llm.parts import give_back

ORDER = 4
DISCOUNT = 0.75
#: Words added to each text's number of words.
SHORT = 20
#: Labelled rows of a class that are used at most (about; chosen by hash).
MAX_ROWS = 20_000
CUT = 0.7


class KneserNeyPair:
    """The two sorted tables, and the logistic curve."""

    def __init__(self, counts: pd.DataFrame, order: int = ORDER, discount: float = DISCOUNT):
        """``counts``: columns gram (number of up to ``order`` bytes), c0, c1: occurrences in ordinary and toxic texts."""
        self.order = order
        gram = counts["gram"].to_numpy(np.int64)
        by_class = [counts["c0"].to_numpy(float), counts["c1"].to_numpy(float)]
        lower = self._shared(gram, by_class[0] + by_class[1], discount)
        context = gram >> 8
        ctx, at = np.unique(context, return_inverse=True)
        logs, weights = [], []
        for c in by_class:
            total = np.bincount(at, c, len(ctx))
            freed = np.bincount(at, np.minimum(c, discount), len(ctx))
            back = np.where(total > 0, freed / np.maximum(total, 1), 1.0)
            p = np.where(total[at] > 0, np.maximum(c - discount, 0) / np.maximum(total[at], 1), 0.0) + back[at] * lower
            logs.append(np.log(p))
            weights.append(np.log(back))
        order_of = np.argsort(gram)
        self.grams, self.gain = gram[order_of].astype(np.uint32), (logs[1] - logs[0])[order_of]
        self.contexts, self.back_gain = ctx.astype(np.uint32), weights[1] - weights[0]
        self.slope, self.intercept = 0.0, 0.0

    @staticmethod
    def _shared(gram: np.ndarray, pooled: np.ndarray, discount: float) -> np.ndarray:
        """Pooled probability of each n-gram's last byte given all but the first byte of its context.

        No byte stands before the space that opens a word; n-grams from there on have their own pooled counts.
        """
        probability = np.full(len(gram), 1 / 256)
        for keep in (1, 2, 3):
            mask = (1 << (8 * keep)) - 1
            short = np.where(gram > mask, gram & mask, gram)
            # continuation count: different longer n-grams that end in this one
            keys, at = np.unique(short, return_inverse=True)
            kinds = np.bincount(at, minlength=len(keys)).astype(float)
            opening = (keys <= mask >> 8) | (keys >> (8 * (keep - 1)) == 0x20) if keep > 1 else np.zeros(len(keys), bool)
            own = np.bincount(at, pooled, len(keys))
            count = np.where(opening, own, kinds)
            ctx, of = np.unique(keys >> 8, return_inverse=True)
            total = np.bincount(of, count, len(ctx))
            freed = np.bincount(of, np.minimum(count, discount), len(ctx))
            p = (np.maximum(count - discount, 0) / total[of])[at] + (freed / total)[of][at] * probability
            probability = p
        return probability

    def feature(self, texts: pa.Array) -> np.ndarray:
        """Difference of the log-likelihoods over the number of words and SHORT, for each text."""
        b = Bytes(texts, lower=True)
        at = np.flatnonzero(b.real)
        gram = b.grams(self.order)[at]
        values = np.zeros(len(at))
        if len(self.grams):
            i = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
            seen = self.grams[i] == gram
            values[seen] = self.gain[i[seen]]
            rest = np.flatnonzero(~seen)
            ctx = gram[rest] >> np.uint32(8)
            j = np.minimum(np.searchsorted(self.contexts, ctx), len(self.contexts) - 1)
            known = self.contexts[j] == ctx
            values[rest[known]] = self.back_gain[j[known]]
        full = np.zeros(len(b.data))
        full[at] = values
        return b.sums(full) / (b.words + SHORT)

    def score(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.feature(texts) + self.intercept, -500, 500)))


def count_grams(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, c0, c1 over all rows (text, y): counted in each task, then added up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, y = batch.column("text"), batch.column("y").to_numpy(zero_copy_only=False)
            for lo, hi in chunks(texts):
                b = Bytes(texts.slice(lo, hi - lo), lower=True)
                toxic = np.zeros(len(b.data), bool)
                for k in np.flatnonzero(y[lo:hi] == 1):
                    toxic[b.lo[k] : b.hi[k]] = True
                gram = b.grams(order)
                parts = []
                for cls in (False, True):
                    keys, n = np.unique(gram[b.real & (toxic == cls)], return_counts=True)
                    parts.append((keys, n * (not cls), n * cls))
                keys, c0, c1 = (np.concatenate(p).astype(np.int64) for p in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(c0), pa.array(c1)], ["gram", "c0", "c1"])

    return rows.mapInArrow(count, "gram long, c0 long, c1 long").groupBy("gram").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def fit(docs: DataFrame, labels: DataFrame, keep, max_rows: int = MAX_ROWS) -> KneserNeyPair:
    """Train on the labelled rows that satisfy ``keep`` (a condition on doc_id), at most about ``max_rows`` a class.

    The driver receives the n-gram counts and one number for each training row; both are bounded by the sample.
    """
    rows = training_rows(docs, labels, "toxic", keep, max_rows)
    model = KneserNeyPair(count_grams(rows).toPandas())
    if not len(model.grams):
        return model
    own = rows.sparkSession.sparkContext.broadcast(model)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            x = [own.value.feature(texts.slice(lo, hi - lo)) for lo, hi in chunks(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0)), batch.column("y"), batch.column("weight")], ["x", "y", "weight"])

    got = rows.mapInArrow(features, "x double, y int, weight double").toPandas()
    if got["y"].nunique() == 2:
        model.slope, model.intercept = logistic(got["x"].to_numpy(), got["y"].to_numpy(float), got["weight"].to_numpy(), ridge=1e-6)
    else:
        model.intercept = 30.0 if got["y"].max() == 1 else -30.0
    return model


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, cut: float = CUT, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; rows whose crc32(doc_id) mod ``folds`` is ``held`` never train."""
    model = fit(docs, labels, fold(F.col("doc_id"), folds) != held, max_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return scored(docs, lambda texts: shared.value.score(texts), folds, held, cut)


def keep_accepted(docs: DataFrame, model: KneserNeyPair, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``cut``, unchanged. One scan, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            low = [shared.value.score(texts.slice(lo, hi - lo)) < cut for lo, hi in chunks(texts)]
            yield batch.filter(pa.array(np.concatenate(low) if low else np.zeros(0, bool)))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def op4_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {"op4_kneser_ney_toxicity": op4_kneser_ney_toxicity}
