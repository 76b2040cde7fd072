"""Events spread by a kernel, step by step."""

import datetime
from collections import defaultdict

import numpy as np
import pytest

from gridsignal.functions import signal
from gridsignal.plans import registry


def spread(rows, kernel):
    out = defaultdict(float)
    for by, t, v in rows:
        for lag, k in enumerate(kernel):
            out[by, None if t is None else t + lag] += (v or 0.0) * k
    return out


def test_convolution_against_plain_sums(spark):
    rng = np.random.default_rng(3)
    rows = [(str(k), int(t), float(v)) for k, t, v in zip(rng.integers(0, 3, 60), rng.integers(-40, 40, 60), rng.normal(size=60), strict=True)]
    rows += [("a", 0, 1.0), ("a", 5, 2.0), ("a", 9, None), ("a", 10, 1.0), ("a", 10, 3.0), ("a", 1000, 1.0), (None, 4, 1.0), ("a", None, 2.0), ("a", None, 3.0)]
    for kernel in ([1.0, -0.5, 0.25, 2.0, 0.0], [3.0]):
        out = signal.convolved(spark.createDataFrame(rows, "k string, t long, v double").repartition(5), ["k"], "t", "v", np.array(kernel)).collect()
        want = spread(rows, kernel)
        assert len(out) == len(want)
        assert {(r["k"], r["t"]): r["v"] for r in out} == pytest.approx(want)


def test_canonical_response_shuffles_no_row_a_weight(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    hours = [(1, 0), (1, 1), (1, 7), (1, 200), (1, 5000), (2, 3), (None, 9), (2, None), (2, None)]
    rows = [(u, None if h is None else start + datetime.timedelta(hours=h)) for u, h in hours]
    spark.createDataFrame(rows, "user_id long, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    df = registry.QUERIES["canonical_response"](spark, str(tmp_path))
    first = int((start - datetime.datetime(1970, 1, 1)).total_seconds()) // 21600
    want = spread([(u, None if h is None else first + h // 6, 1.0) for u, h in hours], signal.canonical_response(25.0, 0.5))
    assert {(r["user_id"], r["scan"]): r["response"] for r in df.collect()} == pytest.approx(want, abs=1e-6)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # top down: rows are made after the last exchange
    assert "Exchange" in plan and plan.index("Generate") < plan.index("Exchange")
