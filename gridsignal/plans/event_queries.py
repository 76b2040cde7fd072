"""Event time-series queries: a session is a day, a condition an event type, an onset seconds since midnight."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridsignal.functions import series, signal, stats
from gridsignal.operators import events as ev
from gridsignal.plans.register import query
from gridsignal.session import table

EVENTS = """
    e AS (SELECT event_id, user_id, value, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS session, event_type AS condition,
                 epoch(ts) - floor(epoch(ts) / 86400) * 86400 AS onset FROM events)
"""


def micros():
    """Microseconds since 1970, whatever the session's time zone."""
    return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")


def onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = micros() / 1e6
    day = F.floor(seconds / 86400)
    out = table(spark, sf_dir, "events").select("event_id", "user_id", "value", day.alias("session"), F.col("event_type").alias("condition"), (seconds - day * 86400).alias("onset"))
    return ev.with_default_durations(out)


@query(
    "joined_onsets",
    f"""
    WITH {EVENTS}, d AS (SELECT session, max(onset) AS t_end FROM e GROUP BY 1),
         s AS (SELECT session, coalesce(sum(t_end) OVER (ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM d)
    SELECT event_id, condition, round(onset + shift, 3) AS onset FROM e JOIN s USING (session)
    """,
)
def joined_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.joined_onsets(onsets(spark, sf_dir)).select("event_id", "condition", F.round("onset", 3).alias("onset"))


@query(
    "raster_events",
    f"""
    WITH {EVENTS}, h AS (SELECT DISTINCT session, condition, CAST(round_even(onset / 3600, 0) AS BIGINT) AS bin FROM e),
         g AS (SELECT session, condition, bin FROM (SELECT DISTINCT session, condition FROM e) CROSS JOIN range(25) t(bin))
    SELECT g.session, g.condition, g.bin, CAST(h.bin IS NOT NULL AS INTEGER) AS active FROM g LEFT JOIN h ON g.session = h.session AND g.condition = h.condition AND g.bin = h.bin
    """,
)
def raster_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.raster(onsets(spark, sf_dir), 3600.0, 86400.0)


@query(
    "extend_events",
    f"""
    WITH {EVENTS}, b AS (SELECT DISTINCT session, condition, CAST(round_even(onset / 1800, 0) AS BIGINT) AS o, CAST(round_even(value * 100 / 1800, 0) AS BIGINT) AS d FROM e)
    SELECT DISTINCT session, condition, o + k AS bin FROM b CROSS JOIN range(200) t(k) WHERE k = 0 OR k < d
    """,
)
def extend_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.sampled(onsets(spark, sf_dir).withColumn("duration", F.col("value") * 100), 1800.0)


@query(
    "isi_stats",
    f"""
    WITH {EVENTS}, g AS (SELECT user_id, onset + session * 86400 AS t, onset + session * 86400 - lag(onset + session * 86400) OVER (PARTITION BY user_id ORDER BY onset + session * 86400) AS gap FROM e)
    SELECT user_id, round(avg(gap), 2) AS mean_isi, round(stddev_pop(gap), 2) AS std_isi, round(max(t), 2) AS last_onset, count(*) AS n_events FROM g GROUP BY 1
    """,
)
def isi_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ev.intervals(onsets(spark, sf_dir).withColumn("t", F.col("onset") + F.col("session") * 86400), ["user_id"], "t")
    return out.select("user_id", *[F.round(c, 2).alias(c) for c in ("mean_isi", "std_isi", "last_onset")], "n_events")


@query(
    "merge_onsets",
    f"WITH {EVENTS} SELECT session, CASE WHEN contains(condition, 'c') THEN 'merged' ELSE condition END AS condition, count(*) AS n, round(min(onset), 3) AS first_onset FROM e WHERE condition <> 'view' GROUP BY 1, 2",
)
def merge_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ev.merge_onsets(onsets(spark, sf_dir), "merged", "c", ["view"])
    return out.groupBy("session", "condition").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("onset"), 3).alias("first_onset"))


@query(
    "onset_matrix",
    f"""
    WITH {EVENTS}, h AS (SELECT DISTINCT session, condition, CAST(round_even(onset / 3600, 0) AS BIGINT) AS bin FROM e)
    SELECT session, condition, CAST((bin + lag) / 2 AS BIGINT) AS scan, CAST(lag AS INTEGER) AS lag, 1 AS x FROM h CROSS JOIN range(6) t(lag) WHERE (bin + lag) % 2 = 0
    """,
)
def onset_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.onset_matrix(ev.sampled(onsets(spark, sf_dir), 3600.0), 6, 2)


@query("contrast", "SELECT user_id, round(coalesce(avg(value) FILTER (event_type = 'click'), 0) - 2 * coalesce(avg(value) FILTER (event_type = 'view'), 0), 4) AS effect FROM events GROUP BY 1")
def contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["click", "view"]
    wide = table(spark, sf_dir, "events").groupBy("user_id").agg(*[F.coalesce(F.avg(F.when(F.col("event_type") == k, F.col("value"))), F.lit(0.0)).alias(k) for k in kinds])
    return wide.select("user_id", F.round(series.weighted_sum(series.contrast_vector("click - 2*view", kinds), kinds), 4).alias("effect"))


DAILY = "d AS (SELECT event_type, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, count(*) AS n FROM events GROUP BY 1, 2)"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", F.floor(micros() / 86400e6).alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "acorr",
    f"""
    WITH {DAILY}, c AS (SELECT event_type, day, n - avg(n) OVER (PARTITION BY event_type) AS d FROM d),
         l AS (SELECT event_type, d, lag AS h, lag(d, CAST(lag AS INTEGER)) OVER (PARTITION BY event_type, lag ORDER BY day) AS p FROM c CROSS JOIN range(1, 6) t(lag))
    SELECT event_type, CAST(h AS INTEGER) AS lag, round(CASE WHEN sum(d * d) = 0 THEN 1 ELSE coalesce(sum(d * p), 0) / sum(d * d) END, 6) AS acorr FROM l GROUP BY 1, 2
    """,
)
def acorr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.acorr(daily(spark, sf_dir), ["event_type"], "day", "n", 5).withColumn("acorr", F.round("acorr", 6))


@query(
    "linear_drift",
    "SELECT user_id, round(regr_slope(value, epoch(ts) / 86400 - 19700), 4) AS slope, round(regr_intercept(value, epoch(ts) / 86400 - 19700), 4) AS intercept FROM events GROUP BY 1",
)
def linear_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "value", (micros() / 86400e6 - 19700).alias("t"))
    out = signal.without_trend(rows, ["user_id"], "t", "value").groupBy("user_id").agg(F.max("slope").alias("slope"), F.max("intercept").alias("intercept"))
    return out.select("user_id", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query(
    "gaussian_blur",
    f"""
    WITH {DAILY}, k AS (SELECT o, exp(-o * o / 2.0) / (SELECT sum(exp(-o * o / 2.0)) FROM range(-2, 3) r(o)) AS w FROM range(-2, 3) r(o)),
         s AS (SELECT event_type, day + o AS day, n * w AS c FROM d CROSS JOIN k)
    SELECT event_type, day, round(sum(c), 6) AS n FROM s GROUP BY 1, 2 HAVING count(*) = 5
    """,
)
def gaussian_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.blurred(daily(spark, sf_dir), ["event_type"], "day", "n", 2).select("event_type", "day", F.round("n", 6).alias("n"))


@query(
    "resample_grid",
    f"""
    WITH {DAILY}, k AS (SELECT event_type, day AS t0, n AS v0, lead(day) OVER w AS t1, lead(n) OVER w AS v1 FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day))
    SELECT event_type, CAST(g AS DOUBLE) AS day, round(v0 + (g - t0) * (v1 - v0) / (t1 - t0), 6) AS n FROM k CROSS JOIN (SELECT a + i * 0.5 AS g FROM (SELECT min(day) AS a, max(day) AS b FROM d), LATERAL (SELECT unnest(range(CAST(2 * (b - a) AS BIGINT))) AS i)) WHERE g >= t0 AND g < t1
    """,
)
def resample_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = daily(spark, sf_dir)
    ends = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    grid = [ends["a"] + i * 0.5 for i in range(int(2 * (ends["b"] - ends["a"])))] if ends["a"] is not None else []
    out = signal.resampled(days, ["event_type"], "day", "n", grid)
    return out.select("event_type", "day", F.round("n", 6).alias("n"))


@query(
    "mixture_moments",
    """
    WITH c AS (SELECT event_type, avg(value) AS m, var_pop(value) AS v, count(*) / (SELECT count(*) FROM events) AS p FROM events GROUP BY 1)
    SELECT round(sum(p * m), 6) AS mean, round(sum(p * (m * m + v)) - pow(sum(p * m), 2), 4) AS variance FROM c
    """,
)
def mixture_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    n = rows.count()
    c = rows.groupBy("event_type").agg(F.avg("value").alias("m"), F.var_pop("value").alias("v"), (F.count(F.lit(1)) / n).alias("p"))
    return c.agg(F.round(stats.gm_mean(F.col("m"), F.col("p")), 6).alias("mean"), F.round(stats.gm_var(F.col("m"), F.col("v"), F.col("p")), 4).alias("variance"))


@query("ppm_gamma_mcmc", "SELECT user_id, round(avg(CAST(value > 50 AS INTEGER)), 6) AS ppm FROM events GROUP BY 1")
def ppm_gamma_mcmc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(stats.ppm_g_mcmc(F.col("value"), 50.0), 6).alias("ppm"))


@query("ppm_norm_quantile", "SELECT user_id, round(avg(value) + stddev_pop(value) * -1.6448536269514722, 4) AS ppm FROM events GROUP BY 1")
def ppm_norm_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(stats.ppm_g_norm(F.avg("value"), F.var_pop("value")), 4).alias("ppm"))


@query("ppm_norm")
def ppm_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows only: neither side's SQL has the error function."""
    out = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    return out.select("user_id", stats.ppm_a_norm(F.col("m"), F.greatest("v", F.lit(1e-6)), 50.0).alias("ppm"))


@query(
    "rank_events",
    "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS rank FROM events",
)
def rank_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("rank"))
