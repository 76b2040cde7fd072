"""Mixtures, posterior probability maps, ROC curves, autocorrelation and random draws."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_sum(x: Column) -> Column:
    """Sum of doubles that hold decimals (below 10^18, at most 10 places), such as money: the double next to the exact sum, whatever
    the order of rows. If any other value is among them, the plain sum.
    """
    places = x.try_cast("decimal(28,10)")
    decimals = F.bool_and(F.coalesce(places.cast("double") == x, x.isNull()))
    return F.coalesce(F.when(decimals, F.try_sum(places).cast("double")), F.sum(x))


def normal_isf(p: float) -> float:
    """Upper quantile of the standard normal law, by bisection on its tail."""
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(mid / math.sqrt(2.0)) > p else (lo, mid)
    return (lo + hi) / 2


#: Coefficients of Hart's rational approximation of the normal tail (1968, no. 5666), highest power first: fixed values.
HART_OVER = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
HART_UNDER = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def phi(x: Column) -> Column:
    """Standard normal distribution function of a column, to about 15 digits."""
    z = F.abs(x)

    def horner(coefficients: tuple[float, ...]) -> Column:
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * z + c
        return out

    bell = F.exp(-z * z / 2)
    far = z + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        far = z + F.lit(k) / far
    tail = F.when(z < 7.07106781186547, bell * horner(HART_OVER) / horner(HART_UNDER)).otherwise(bell / far / math.sqrt(2 * math.pi))
    return F.when(x > 0, 1.0 - tail).otherwise(tail)


def student_tail(t: Column, dof: int) -> Column:
    """P(T > t) of Student's law with a whole number of degrees of freedom, by its finite sum of cosines."""
    angle = F.atan(t / math.sqrt(dof))
    cos2, odd = F.pow(F.cos(angle), F.lit(2.0)), dof % 2
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    # term j is the one before times cos^2 (2j - 1 + odd) / (2j + odd)
    grow = lambda s, j: F.struct((s["term"] * cos2 * (2.0 * j - 1 + odd) / (2.0 * j + odd)).alias("term"), (s["total"] + s["term"] * cos2 * (2.0 * j - 1 + odd) / (2.0 * j + odd)).alias("total"))
    n = dof // 2 - 1 if not odd else (dof - 3) // 2
    steps = F.sequence(F.lit(1), F.lit(n)) if n >= 1 else F.array().cast("array<int>")
    total = F.aggregate(steps, start, grow, lambda s: s["total"])
    if odd:
        inside = 2 / math.pi * (angle + (F.sin(angle) * F.cos(angle) * total if dof > 1 else F.lit(0.0)))
    else:
        inside = F.sin(angle) * total
    return 0.5 - inside / 2


def t_and_p(df: DataFrame, beta: str, deviation: str, dof: int, null_hypothesis: bool = True) -> DataFrame:
    """Add ``t`` = beta / deviation and ``p``: the chance of more than t under Student's law, or under N(beta, deviation^2)."""
    out = df.withColumn("t", F.col(beta) / F.col(deviation))
    return out.withColumn("p", student_tail(F.col("t"), dof) if null_hypothesis else 1.0 - phi((F.col("t") - F.col(beta)) / F.col(deviation)))


def cumulative_frequencies(df: DataFrame, value: str, threshold: float | None = None) -> DataFrame:
    """(bin, centre, density, cumulated): a histogram with Scott's bin width, up to the first centre above ``threshold``.

    A first pass finds the bins (one row), a second counts them. Without spread all values are one bin.
    """
    v = F.col(value)
    ends = df.filter(v.isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), (F.max(v) - F.min(v)).alias("span"), F.stddev_pop(v).alias("s")).first()
    if not ends["n"]:
        return df.sparkSession.createDataFrame([], "bin long, centre double, density double, cumulated double")
    bins = max(1, int(ends["span"] / (3.5 * ends["s"] / ends["n"] ** 0.33))) if ends["s"] else 1
    width = ends["span"] / bins if ends["span"] else 1.0
    at = F.least(F.floor((v - ends["lo"]) / width), F.lit(bins - 1))
    counts = df.filter(v.isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("k"))
    grid = df.sparkSession.range(bins).select(F.col("id").alias("bin")).join(counts, "bin", "left")
    density = F.coalesce("k", F.lit(0)) / (ends["n"] * width)
    out = grid.select("bin", (ends["lo"] + (F.col("bin") + 0.5) * width).alias("centre"), density.alias("density"))
    # as many rows as bins, whose number grows with the cube root of the rows
    upto = Window.partitionBy(F.lit(0)).orderBy("bin")
    out = out.withColumn("cumulated", F.sum(F.col("density") * width).over(upto))
    return out if threshold is None else out.filter(F.col("centre") <= threshold)


def ppm_a_apost(components: DataFrame, by: list[str], alpha: float = 0.05, rounds: int = 60) -> DataFrame:
    """(by, ppm): the value that a mixture exceeds with probability ``alpha``; components have mean, variance, prop.

    Bisection inside one expression over a group's few components.
    """
    parts = components.groupBy(*by).agg(
        F.collect_list(F.struct("mean", F.sqrt(F.greatest("variance", F.lit(1e-6))).alias("sd"), "prop")).alias("c"),
        F.min(F.col("mean") - 40 * F.sqrt("variance") - 1).alias("lo"),
        F.max(F.col("mean") + 40 * F.sqrt("variance") + 1).alias("hi"),
    )

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        above = F.aggregate("c", F.lit(0.0), lambda t, x: t + x["prop"] * (1.0 - phi((mid - x["mean"]) / x["sd"]))) > alpha
        return F.struct(F.when(above, mid).otherwise(s["lo"]).alias("lo"), F.when(above, s["hi"]).otherwise(mid).alias("hi"))

    ends = F.struct(F.col("lo").alias("lo"), F.col("hi").alias("hi"))
    return parts.select(*by, F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), ends, halve, lambda s: (s["lo"] + s["hi"]) / 2).alias("ppm"))


def gm_mean(means: Column, props: Column) -> Column:
    """Mixture mean over a group's components; an aggregate."""
    return F.sum(props * means)


def gm_var(means: Column, variances: Column, props: Column) -> Column:
    """Mixture variance over a group's components; an aggregate."""
    return F.sum(props * (means * means + variances)) - F.pow(F.sum(props * means), F.lit(2.0))


def gm_cdf(x: Column, means: Column, variances: Column, props: Column) -> Column:
    """Mixture distribution function at ``x``; an aggregate. A variance of 0 counts as 1e-6."""
    return F.sum(props * phi((x - means) / F.sqrt(F.when(variances == 0, 1e-6).otherwise(variances))))


def ppm_a_norm(mean: Column, variance: Column, alpha: float = 0.0) -> Column:
    """P(N(mean, variance) > alpha)."""
    return 1.0 - phi((F.lit(alpha) - mean) / F.sqrt(variance))


def ppm_g_norm(mean: Column, variance: Column, gamma: float = 0.95) -> Column:
    """The value that N(mean, variance) exceeds with probability gamma."""
    return mean + F.sqrt(variance) * F.lit(normal_isf(gamma))


def ppm_g_mcmc(sample: Column, gamma: float = 0.0) -> Column:
    """Share of samples above gamma; an aggregate."""
    return F.avg((sample > gamma).cast("double"))


def ppm_g_apost(means: Column, variances: Column, props: Column, gamma: float = 0.0) -> Column:
    return 1.0 - gm_cdf(F.lit(gamma), means, variances, props)


def plotting_quantile(sample: Column, p: float, a: float = 0.4, b: float = 0.4) -> Column:
    """Quantile by the plotting positions (k - a) / (n + 1 - a - b); an aggregate over one group of bounded size."""
    xs = F.sort_array(F.collect_list(sample))
    n = F.size(xs)
    at = F.lit(p) * (n + (1 - a - b)) + F.lit(a)
    k = F.greatest(F.lit(1), F.least(n - 1, F.floor(at))).cast("int")
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), at - k))
    return F.when(n == 1, xs[0]).otherwise((1 - part) * F.get(xs, k - 1) + part * F.get(xs, k))


def plotting_quantiles(df: DataFrame, by: list[str], value: str, p: float, name: str = "quantile", a: float = 0.4, b: float = 0.4) -> DataFrame:
    """(by, name): ``plotting_quantile`` of each group, by ranks, so that a group's values are in no array and a frequent group
    is several tasks' work. Null values take no part."""
    from gridsignal.operators.ranking import number_within

    ranked = number_within(df.filter(F.col(value).isNotNull()).select(*by, value), by, [value], "_k", 1)
    sizes = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    at = F.lit(p) * (F.col("_n") + (1 - a - b)) + F.lit(a)
    low = F.greatest(F.lit(1), F.least(F.col("_n") - 1, F.floor(at)))
    sizes = sizes.withColumn("_low", low).withColumn("_part", F.when(F.col("_n") == 1, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), at - F.col("_low")))))
    near = ranked.join(sizes, by).filter((F.col("_k") == F.col("_low")) | (F.col("_k") == F.col("_low") + 1))
    weight = F.when(F.col("_k") == F.col("_low"), 1 - F.col("_part")).otherwise(F.col("_part"))
    return near.groupBy(*by).agg(F.sum(weight * F.col(value)).alias(name))


def ppm_a_mcmc(sample: Column, alpha: float = 0.05) -> Column:
    return plotting_quantile(sample, 1 - alpha)


def mark_wrong_labels(label: Column, truth: Column, active: int = 1, inactive: int = 0, false_pos: int = 2, false_neg: int = 3) -> Column:
    right = F.when(truth == active, active).otherwise(inactive)
    return F.when(label == truth, right).otherwise(F.when(label == active, false_pos).otherwise(false_neg))


def threshold_label(p: Column, threshold: float) -> Column:
    return F.when(p >= threshold, 1).otherwise(0)


def roc_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """(score, fpr, tpr, tp, fp): one row for each different score, from high to low.

    Rows are first counted by score; running sums go over the counts. They are taken within ranges of the score, so that
    no task orders all scores.
    """
    counts = df.groupBy(score).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("n"))
    from gridsignal.operators.scans import running_sums

    out = running_sums(counts, [F.desc(score)], {"p": "tp", "n": "fp"})
    total = counts.agg(F.sum("p").alias("_P"), F.sum("n").alias("_N"))
    out = out.crossJoin(F.broadcast(total))  # one row
    return out.select(score, (F.col("fp") / F.col("_N")).alias("fpr"), (F.col("tp") / F.col("_P")).alias("tpr"), "tp", "fp")


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: area under the ROC curve, ties counted half. Trapezoids need only each step's own counts."""
    from gridsignal.operators.scans import running_sums

    counts = df.groupBy(score).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("n"))
    out = running_sums(counts, [F.desc(score)], {"p": "tp"})
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2.0))
    return out.agg((area / (F.sum("p") * F.sum("n"))).alias("auc"))


def acorr(df: DataFrame, by: list[str], time: str, value: str, max_lags: int = 10) -> DataFrame:
    """(by, lag, acorr): autocorrelation at lags 1.., over n times the variance; constant series give 1."""
    key = Window.partitionBy(*by)
    centred = df.select(*by, time, (F.col(value) - F.avg(value).over(key)).alias("d"))
    order = key.orderBy(time)
    lags = [F.sum(F.col("d") * F.col(f"l{h}")).alias(f"s{h}") for h in range(1, max_lags + 1)]
    shifted = centred.select(*by, "d", *[F.lag("d", h).over(order).alias(f"l{h}") for h in range(1, max_lags + 1)])
    sums = shifted.groupBy(*by).agg(F.sum(F.col("d") * F.col("d")).alias("v"), *lags)
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("lag"), F.coalesce(F.col(f"s{h}"), F.lit(0.0)).alias("s")) for h in range(1, max_lags + 1)]))
    out = sums.select(*by, "v", each.alias("e"))
    return out.select(*by, "e.lag", F.when(F.col("v") == 0, F.lit(1.0)).otherwise(F.col("e.s") / F.col("v")).alias("acorr"))


# draws: columns that depend on a seed


def gaussian(mean: float, variance: float, seed: int) -> Column:
    return F.randn(seed) * math.sqrt(variance) + mean


def uniform(low: float, high: float, seed: int) -> Column:
    return F.rand(seed) * (high - low) + low


def log_normal(mean: float, variance: float, seed: int) -> Column:
    s2 = math.log(1 + variance / mean**2)
    return F.exp(F.randn(seed) * math.sqrt(s2) + (math.log(mean) - s2 / 2))


def gamma(mean: float, variance: float, seed: int) -> Column:
    """Gamma law of a whole shape mean^2 / variance (rounded, 1 at least), as a sum of exponentials; its mean is kept."""
    shape = max(1, round(mean * mean / variance))
    return sum((-F.log(1.0 - F.rand(seed + i)) for i in range(shape)), F.lit(0.0)) * (mean / shape)


def beta(a: int, b: int, seed: int) -> Column:
    """Beta law of whole shapes, from two gamma draws."""
    x, y = gamma(a, a, seed), gamma(b, b, seed + a)
    return x / (x + y)


def truncated_normal(low: float, high: float, seed: int) -> Column:
    """Standard normal law between two bounds, by bisection of its distribution function at a uniform draw."""
    u, ends = F.rand(seed), F.struct(F.lit(low).cast("double").alias("lo"), F.lit(high).cast("double").alias("hi"))
    p_low, p_high = (0.5 * math.erfc(-x / math.sqrt(2)) for x in (low, high))
    goal = u * (p_high - p_low) + p_low

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        above = phi(mid) > goal
        return F.struct(F.when(above, s["lo"]).otherwise(mid).alias("lo"), F.when(above, mid).otherwise(s["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(60)), ends, halve, lambda s: (s["lo"] + s["hi"]) / 2)


def gm_sample(means: list[float], variances: list[float], props: list[float], seed: int) -> Column:
    """Draws of a Gaussian mixture."""
    u, upto, out = F.rand(seed), np.cumsum(props), None
    for m, v, c in reversed(list(zip(means, variances, upto, strict=True))):
        own = F.randn(seed + 1) * math.sqrt(v) + m
        out = own if out is None else F.when(u < float(c), own).otherwise(out)
    return out


def positive_normal(rng: np.random.Generator, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """Draws of normal laws restricted to positive values, by rejection from a shifted exponential in the tail."""
    out = np.empty(len(mean))
    todo = np.arange(len(mean))
    while len(todo):
        m, s = mean[todo], sd[todo]
        a = np.maximum(-m / s, 0.0)
        rate = (a + np.sqrt(a * a + 4)) / 2
        z = np.where(m >= 0, rng.standard_normal(len(todo)), a + rng.exponential(1 / rate))
        ok = np.where(m >= 0, m + s * z > 0, rng.random(len(todo)) < np.exp(-((z - rate) ** 2) / 2))
        out[todo[ok]] = (m + s * z)[ok]
        todo = todo[~ok]
    return out
