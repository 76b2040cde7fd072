import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridsignal.llm import quality, toxicity
from gridsignal.llm.labelled import logistic
from gridsignal.llm.text import Words
from tests.llm.conftest import EXTRA, SCHEMA, words

INSULTS = ["scoundrel", "nincompoop", "blockhead", "scoundrels"]


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(4)
    docs, labels = [], []
    for i in range(400):
        text = words(i, 60).split()
        toxic, junk = i % 5 == 0, i % 7 == 0
        if toxic:
            for _ in range(4):
                text[r.randrange(len(text))] = r.choice(INSULTS)
        if junk:
            text = [w.upper() + "!!" for w in text]
        docs.append((i, " ".join(text), "en", "s", 1, *EXTRA))
        if i % 3:
            labels.append((i, int(not junk), int(toxic), 9.0))
    docs += [(1000, None, None, None, None, *EXTRA), (1001, "", "en", "s", 0, *EXTRA), (None, words(1, 60), None, None, None, *EXTRA), docs[0]]
    labels += [(None, 1, 1, 0.0), (5000, 1, 1, 0.0), (2, None, None, 0.0)]
    return spark.createDataFrame(docs, SCHEMA).repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, score double")


@pytest.mark.parametrize("score", [toxicity.toxicity_scores, quality.quality_scores])
def test_held_out_rows_are_told_apart(labelled, score):
    docs, labels = labelled
    got = score(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    cut = 0.7 if score is toxicity.toxicity_scores else 0.3
    assert all(r["predicted"] == int(r["score"] >= cut) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400]
    truth = (lambda i: i % 5 == 0) if score is toxicity.toxicity_scores else (lambda i: i % 7 != 0)
    right = sum(r["predicted"] == truth(r["doc_id"]) for r in held)
    assert right >= 0.95 * len(held)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, score(docs, labels).collect()), key=str)


@pytest.mark.parametrize("score", [toxicity.toxicity_scores, quality.quality_scores])
def test_without_rows_or_labels(labelled, no_docs, score):
    docs, labels = labelled
    assert score(no_docs, labels).isEmpty()
    got = score(docs, labels.limit(0)).select("score").distinct().collect()
    assert [r["score"] for r in got] == [0.5]


def test_only_accepted_rows_stay_unchanged(labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels, F.lit(True))
    kept = toxicity.keep_accepted(docs, model)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert {1000, 1001, None} <= ids
    assert sum(i % 5 == 0 for i in ids if i is not None and i < 400) <= 4
    assert sum(i % 5 != 0 for i in ids if i is not None and i < 400) >= 316


SPLIT = re.compile(rb"[^\x20\x09-\x0D]+")
TEXTS = ["You scoundrel, you", "a  blockhead\tand a", "", "plain words of a plain text", "\u00e9t\u00e9 plain", "a", "x yz"]


def spelled(text, order):
    """Every byte of every word and the space after it, with the bytes before it from the opening space on."""
    out = []
    for word in SPLIT.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())):
        s = b" " + word + b" "
        out += [s[max(0, i - order + 1) : i + 1] for i in range(1, len(s))]
    return out


def lower_orders(gram, pooled, discount, keep=3):
    """Shared probability of the last byte given at most ``keep`` - 1 bytes: Kneser-Ney counts, own counts at a word's opening."""
    if keep == 0:
        return 1 / 256
    ends = {}
    for g, n in pooled.items():
        ends.setdefault(g[-keep:], []).append(n)
    count = {e: sum(n) if keep > 1 and (e[:1] == b" " or len(e) < keep) else len(n) for e, n in ends.items()}
    end = gram[-keep:]
    same = [c for e, c in count.items() if e[:-1] == end[:-1]]
    total = sum(same)
    return max(count[end] - discount, 0) / total + sum(min(c, discount) for c in same) / total * lower_orders(gram, pooled, discount, keep - 1)


def test_kneser_ney_against_plain_counts():
    order, d = toxicity.ORDER, toxicity.DISCOUNT
    train = [(words(i, 12) + (" scoundrel blockhead" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(30)]
    own = [Counter(g for t, y in train if y == cls for g in spelled(t, order)) for cls in (0, 1)]
    pooled = own[0] + own[1]

    def log_probability(gram, cls):
        same = {g: n for g, n in own[cls].items() if g[:-1] == gram[:-1]}
        total = sum(same.values())
        back = sum(min(n, d) for n in same.values()) / total if total else 1.0
        if gram in pooled:
            return math.log((max(own[cls][gram] - d, 0) / total if total else 0.0) + back * lower_orders(gram, pooled, d))
        return math.log(back)  # the shared rest is the same for both classes

    as_number = lambda g: int.from_bytes(g, "big")
    grams = sorted(pooled, key=as_number)
    frame = pd.DataFrame({"gram": [as_number(g) for g in grams], "c0": [own[0][g] for g in grams], "c1": [own[1][g] for g in grams]})
    got = toxicity.KneserNeyPair(frame).feature(pa.array(TEXTS + [t for t, _ in train[:4]]))
    for text, value in zip(TEXTS + [t for t, _ in train[:4]], got, strict=True):
        terms = [log_probability(g, 1) - log_probability(g, 0) for g in spelled(text, order)]
        assert value == pytest.approx(sum(terms) / (len(SPLIT.findall(text.encode())) + toxicity.SHORT), abs=1e-9)


def test_counts_of_the_sample(spark):
    rows = [(t, i % 2, 1.0) for i, t in enumerate(TEXTS)]
    got = toxicity.count_grams(spark.createDataFrame(rows, "text string, y int, weight double").repartition(3)).collect()
    want = [Counter(int.from_bytes(g, "big") for t, y, _ in rows if y == cls for g in spelled(t, toxicity.ORDER)) for cls in (0, 1)]
    assert {r["gram"]: (r["c0"], r["c1"]) for r in got} == {g: (want[0][g], want[1][g]) for g in want[0] | want[1]}


def test_logistic_curve_is_at_the_least_loss():
    r = np.random.default_rng(1)
    x = r.standard_normal(300)
    y = (r.random(300) < 1 / (1 + np.exp(-(1.5 * x - 0.5)))).astype(float)
    weight = r.uniform(1, 3, 300)
    loss = lambda s, i: np.average(np.log1p(np.exp(-(2 * y - 1) * (s * x + i))), weights=weight)
    s, i = logistic(x, y, weight, ridge=1e-6)
    assert all(loss(s, i) < loss(s + a, i + b) for a, b in ((0.05, 0), (-0.05, 0), (0, 0.05), (0, -0.05)))


def test_subword_score_is_the_softmax_of_mean_vectors():
    """Features named one by one, their vectors averaged and put through the layer."""
    bits = quality.BUCKET_BITS
    r = np.random.default_rng(3)
    vectors, out, bias = r.standard_normal((1 << bits, 8)), r.standard_normal((2, 8)), r.standard_normal(2)
    model = quality.Subwords(vectors @ (out[1] - out[0]), float(bias[1] - bias[0]))
    for text, got in zip(TEXTS, model.score(pa.array(TEXTS)), strict=True):
        buckets = [int(n) >> (64 - bits) for n in Words(pa.array([text])).number]
        for word in SPLIT.findall(text.encode()):
            s = b" " + word + b" "
            for n in quality.LENGTHS:
                for at in range(len(s) - n + 1):
                    spread = (int.from_bytes(s[at : at + n], "big") + n) * 0x9E3779B97F4A7C15 % (1 << 64)
                    buckets.append(spread >> (64 - bits))
        mean = np.mean([vectors[b] for b in buckets], 0) if buckets else np.zeros(8)
        e = np.exp(out @ mean + bias)
        assert got == pytest.approx(e[1] / e.sum(), abs=1e-9)


@pytest.mark.parametrize("score", [toxicity.toxicity_scores, quality.quality_scores])
def test_very_long_texts_and_one_class(spark, score):
    long = "plain text and scoundrel " * 100_000
    docs = spark.createDataFrame([(1, long), (2, "plain"), (3, None), (2, "plain")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 1) for i in range(4)], "doc_id long, quality int, toxic int")
    got = {(r["doc_id"], r["score"]) for r in score(docs, labels).collect()}
    assert len(got) == 3 and len({s for _, s in got}) == 1
