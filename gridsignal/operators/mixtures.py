"""Two-class Gaussian mixtures on aggregated sufficient statistics.

A round is one grouping: each row adds its weights to the sums of its group, and a group's parameters are one row. The
parameters of all groups are sent to the rows where they are few (counted first), and joined with them otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsignal.session import written

#: Least variance, and the value of a class that has no weight.
LEAST = 1e-6
#: Groups whose parameters are sent to all tasks.
BROADCAST_GROUPS = 100_000
PARAMETERS = ["mean0", "mean1", "var0", "var1", "weight0", "weight1"]


def informed_mixture(df: DataFrame, by: list[str], value: str, alpha: str) -> DataFrame:
    """(by, mean0, mean1, var0, var1, weight0, weight1): both classes' parameters, given each row's weight in class 1.

    Rows with a null value or weight take no part. A class without weight has mean and variance ``LEAST``; variances are
    ``LEAST`` at least.
    """
    a, x = F.col(alpha).cast("double"), F.col(value).cast("double")
    rows = df.select(*by, x.alias("_x"), a.alias("_a")).filter("_x IS NOT NULL AND _a IS NOT NULL")
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.sum("_a").alias("_w1"), F.sum(1 - F.col("_a")).alias("_w0"), F.sum(F.col("_a") * F.col("_x")).alias("_s1"), F.sum((1 - F.col("_a")) * F.col("_x")).alias("_s0"), F.sum(F.col("_a") * F.col("_x") * F.col("_x")).alias("_q1"), F.sum((1 - F.col("_a")) * F.col("_x") * F.col("_x")).alias("_q0"))

    def of(k: int) -> tuple[Column, Column]:
        w, s, q = F.col(f"_w{k}"), F.col(f"_s{k}"), F.col(f"_q{k}")
        mean = s / F.when(w > 0, w)
        var = q / F.when(w > 0, w) - mean * mean
        return F.coalesce(mean, F.lit(LEAST)), F.greatest(F.coalesce(var, F.lit(LEAST)), F.lit(LEAST))

    (m0, v0), (m1, v1) = of(0), of(1)
    return sums.select(*by, m0.alias("mean0"), m1.alias("mean1"), v0.alias("var0"), v1.alias("var1"), (F.col("_w0") / F.col("_n")).alias("weight0"), (F.col("_w1") / F.col("_n")).alias("weight1"))


def posterior(value: Column) -> Column:
    """A row's weight in class 1, by the parameters beside it; by logarithms, so that far values don't underflow."""
    log = lambda k: F.log(F.greatest(F.col(f"weight{k}"), F.lit(1e-300))) - F.log(F.col(f"var{k}")) / 2 - F.pow(value - F.col(f"mean{k}"), F.lit(2.0)) / (2 * F.col(f"var{k}"))
    apart = log(0) - log(1)
    return 1 / (1 + F.exp(F.least(F.greatest(apart, F.lit(-700.0)), F.lit(700.0))))


def started(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Parameters to begin with: a deviation below and above each group's mean."""
    x = F.col(value).cast("double")
    sums = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"))
    var = F.greatest(F.col("_s") * F.col("_s"), F.lit(LEAST))
    return sums.select(*by, (F.col("_m") - F.col("_s")).alias("mean0"), (F.col("_m") + F.col("_s")).alias("mean1"), var.alias("var0"), var.alias("var1"), F.lit(0.5).alias("weight0"), F.lit(0.5).alias("weight1"))


def one_round(df: DataFrame, by: list[str], value: str, parameters: DataFrame, broadcast: bool) -> DataFrame:
    rows = df.select(*by, F.col(value).cast("double").alias("_v"))
    told = rows.join(F.broadcast(parameters) if broadcast else parameters, by)
    return informed_mixture(told.select(*by, "_v", posterior(F.col("_v")).alias("_alpha")), by, "_v", "_alpha")


def mixture_em(df: DataFrame, by: list[str], value: str, tolerance: float = 1e-6, n_max: int = 200, start: DataFrame | None = None) -> DataFrame:
    """(by, parameters, rounds): each group's mixture by expectation and maximisation, class 0 being the lower one.

    A group ends when no parameter moves by more than ``tolerance`` times its group's deviation; ended groups take no
    part in later rounds. Groups that haven't ended after ``n_max`` rounds are returned as they are, with ``rounds`` n_max.
    """
    now = written((started(df, by, value) if start is None else start).withColumn("rounds", F.lit(0)))
    few = now.count() <= BROADCAST_GROUPS
    done: list[DataFrame] = []
    for step in range(1, n_max + 1):
        new = one_round(df, by, value, now.drop("rounds"), few)
        old = now.select(*by, *[F.col(p).alias(f"_{p}") for p in PARAMETERS])
        size = F.sqrt(F.greatest("var0", "var1"))
        moved = F.greatest(*[F.abs(F.col(p) - F.col(f"_{p}")) / (size if p.startswith("mean") else size * size if p.startswith("var") else F.lit(1.0)) for p in PARAMETERS])
        met = written(new.join(old, by).withColumn("_ended", moved <= tolerance).select(*by, *PARAMETERS, F.lit(step).alias("rounds"), "_ended"))
        done.append(met.filter("_ended").drop("_ended"))
        now = met.filter("NOT _ended").drop("_ended")
        if now.isEmpty():
            break
    out = now
    for d in done:
        out = out.unionByName(d)
    swap = F.col("mean0") > F.col("mean1")
    pick = lambda p, k: F.when(swap, F.col(f"{p}{1 - k}")).otherwise(F.col(f"{p}{k}")).alias(f"{p}{k}")
    return out.select(*by, *[pick(p, k) for p in ("mean", "var", "weight") for k in (0, 1)], "rounds")


def density(value: Column) -> Column:
    """The mixture's density at a value, by the parameters beside it."""
    return sum((F.col(f"weight{k}") * F.exp(-F.pow(value - F.col(f"mean{k}"), F.lit(2.0)) / (2 * F.col(f"var{k}"))) / F.sqrt(2 * math.pi * F.col(f"var{k}")) for k in (0, 1)), F.lit(0.0))
