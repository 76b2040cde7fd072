"""Queries of experiments' events: a session is a day, a condition an event type, an onset seconds since midnight."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsignal.operators import events as ev
from gridsignal.operators import volumes
from gridsignal.paradigm import Paradigm
from gridsignal.plans.event_queries import EVENTS, onsets
from gridsignal.plans.register import query

#: Events that last as many seconds as their value says.
LASTING = f"{EVENTS}, l AS (SELECT event_id, session, condition, onset, value AS duration FROM e), d AS (SELECT session, max(onset + duration) AS t_end FROM l GROUP BY 1)"
SHIFTS = "s AS (SELECT session, coalesce(sum(t_end) OVER (ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM d)"


def paradigm(spark: SparkSession, sf_dir: str) -> Paradigm:
    rows = onsets(spark, sf_dir).select("event_id", "session", "condition", "onset", F.col("value").alias("duration"))
    return Paradigm(rows)


@query("paradigm_joined", f"WITH {LASTING}, {SHIFTS} SELECT event_id, 0 AS session, condition, round(onset + shift, 3) AS onset, round(duration, 4) AS duration FROM l JOIN s USING (session)")
def paradigm_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = paradigm(spark, sf_dir).join_sessions().events
    return out.select("event_id", "session", "condition", F.round("onset", 3).alias("onset"), F.round("duration", 4).alias("duration"))


@query("paradigm_length", f"WITH {LASTING} SELECT round(max(t_end), 3) AS t_max, round(sum(t_end), 3) AS joined FROM d")
def paradigm_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = paradigm(spark, sf_dir)
    joined = own.join_sessions().get_t_max().withColumnRenamed("t_max", "joined")
    return own.get_t_max().crossJoin(F.broadcast(joined)).select(F.round("t_max", 3).alias("t_max"), F.round("joined", 3).alias("joined"))  # one row each


@query(
    "paradigm_durations",
    f"WITH {LASTING} SELECT condition, session, row_number() OVER (PARTITION BY condition ORDER BY session, onset, duration) - 1 AS position, round(duration, 4) AS duration FROM l",
)
def paradigm_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paradigm(spark, sf_dir).get_joined_durations().select("condition", "session", F.col("position").cast("long").alias("position"), F.round("duration", 4).alias("duration"))


@query(
    "paradigm_dims",
    f"""
    WITH {LASTING} SELECT session, condition, count(*) AS n, round(min(onset), 3) AS first_onset, round(arg_min(duration, onset * 1e6 + duration), 4) AS first_duration,
        round(sum(duration), 3) AS total FROM l GROUP BY 1, 2
    """,
)
def paradigm_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = paradigm(spark, sf_dir)
    both = own.get_joined_onsets_dim().join(own.get_joined_durations_dim(), ["session", "condition"])
    total = F.aggregate("durations", F.lit(0.0), lambda t, x: t + x)
    return both.select("session", "condition", F.size("onsets").cast("long").alias("n"), F.round(F.get("onsets", F.lit(0)), 3).alias("first_onset"), F.round(F.get("durations", F.lit(0)), 4).alias("first_duration"), F.round(total, 3).alias("total"))


@query("paradigm_conditions", "SELECT DISTINCT event_type AS condition FROM events WHERE event_type <> 'view'")
def paradigm_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paradigm(spark, sf_dir).delete_condition("view").get_stimulus_names()


@query(
    "paradigm_joined_raster",
    f"""
    WITH {EVENTS}, h AS (SELECT DISTINCT session, condition, CAST(round_even(onset / 3600, 0) AS BIGINT) AS bin FROM e), k AS (SELECT session, row_number() OVER (ORDER BY session) - 1 AS r FROM (SELECT DISTINCT session FROM e)),
         g AS (SELECT session, condition, bin FROM (SELECT DISTINCT session, condition FROM e) CROSS JOIN range(25) t(bin))
    SELECT g.condition, k.r * 25 + g.bin AS bin, CAST(h.bin IS NOT NULL AS INTEGER) AS active FROM g JOIN k ON k.session = g.session LEFT JOIN h ON g.session = h.session AND g.condition = h.condition AND g.bin = h.bin
    """,
)
def paradigm_joined_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    spikes = Paradigm(onsets(spark, sf_dir).select("session", "condition", "onset", F.lit(0.0).alias("duration")))
    return spikes.get_joined_and_rastered(3600.0, 86400.0).withColumn("bin", F.col("bin").cast("long"))


@query(
    "paradigm_info",
    f"""
    WITH {LASTING}, g AS (SELECT condition, session, onset - lag(onset) OVER (PARTITION BY condition, session ORDER BY onset) AS gap, onset, duration FROM l)
    SELECT condition, count(DISTINCT session) AS n_sessions, count(*) AS n_events, CASE WHEN max(duration) > 0 THEN 'block' ELSE 'event' END AS kind, round(avg(gap), 3) AS mean_isi, round(max(onset), 3) AS last_onset FROM g GROUP BY 1
    """,
)
def paradigm_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = paradigm(spark, sf_dir).get_info()
    return out.select("condition", "n_sessions", "n_events", "kind", F.round("mean_isi", 3).alias("mean_isi"), F.round("last_onset", 3).alias("last_onset"))


@query("paradigm_file", f"WITH {EVENTS} SELECT CAST(session AS INTEGER) AS session, condition, count(*) AS n, round(sum(onset), 1) AS onsets, 1.0::DOUBLE AS amplitude FROM e GROUP BY 1, 2")
def paradigm_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written to a text file in the shared folder and read back."""
    import uuid

    from gridsignal.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/paradigm-{uuid.uuid4().hex}"
    Paradigm(onsets(spark, sf_dir).select("session", "condition", "onset", "duration")).save_csv(path)
    out = Paradigm.from_csv(spark, path).events
    return out.groupBy("session", "condition").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("onset"), 1).alias("onsets"), F.max("amplitude").alias("amplitude"))


@query("session_dict", """
    WITH e AS (SELECT n_regionkey AS session, CASE WHEN n_nationkey % 2 = 0 THEN 'a' ELSE 'b' END AS condition, n_nationkey * 1.5 AS onset, CASE WHEN n_nationkey % 2 = 0 THEN 2.0 ELSE 0.0 END AS duration FROM nation),
         d AS (SELECT session, max(onset + duration) AS t_end FROM e GROUP BY 1), s AS (SELECT session, coalesce(sum(t_end) OVER (ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM d)
    SELECT 0 AS session, condition, CAST(onset + shift AS DOUBLE) AS onset, CAST(duration AS DOUBLE) AS duration FROM e JOIN s USING (session)
""")
def session_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as the sessions of a design given as nested dicts, nations as its events; the sessions joined."""
    from gridsignal.session import table

    design: dict[str, dict] = {}
    for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").collect():  # a table of 25 rows at any scale
        own = design.setdefault(f"run{r['n_regionkey']}", {"onsets": {"a": [], "b": []}, "stimulusLength": {"a": []}})
        own["onsets"]["b" if r["n_nationkey"] % 2 else "a"].append(r["n_nationkey"] * 1.5)
        own["stimulusLength"]["a"] += [] if r["n_nationkey"] % 2 else [2.0]
    return Paradigm.from_session_dict(spark, design).join_sessions().events.select("session", "condition", "onset", "duration")


@query("stimulus_step", "WITH t AS (SELECT DISTINCT floor(epoch(ts) / 60) * 60 - floor(epoch(ts) / 86400) * 86400 AS onset FROM events) SELECT CAST(60 AS DOUBLE) AS step, count(*) AS n FROM t")
def stimulus_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid on which events at whole minutes lie, with scans every two minutes."""
    minutes = onsets(spark, sf_dir).select((F.floor(F.col("onset") / 60) * 60.0).alias("onset")).distinct()
    return minutes.agg(F.count(F.lit(1)).alias("n")).withColumn("step", F.lit(float(ev.grid_step(minutes, 120.0, 720, 1.0))))


INDUCED = f"""
    {EVENTS}, h AS (SELECT DISTINCT session, condition, CAST(round_even(onset / 3600, 0) AS BIGINT) AS bin FROM e), a AS (SELECT DISTINCT condition, bin FROM h),
    r AS (SELECT lag, 1.0 / (1 + lag) AS w FROM range(5) t(lag)), x AS (SELECT condition, bin + lag AS bin, sum(w) AS xh FROM a CROSS JOIN r GROUP BY 1, 2),
    v AS (SELECT user_id AS voxel, condition, avg(value) AS level FROM e GROUP BY 1, 2), sig AS (SELECT voxel, bin, sum(level * xh) AS signal FROM v JOIN x USING (condition) GROUP BY 1, 2)
"""


@query("induced_signal", f"WITH {INDUCED} SELECT voxel, CAST(bin / 2 AS BIGINT) AS scan, round(signal, 4) AS signal FROM sig WHERE bin % 2 = 0 AND bin < 27")
def induced_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = onsets(spark, sf_dir)
    active = ev.sampled(rows, 3600.0).select("condition", "bin").distinct()
    response = spark.range(5).select(F.col("id").alias("lag"), (1.0 / (1 + F.col("id"))).alias("h"))
    levels = rows.groupBy(F.col("user_id").alias("voxel"), "condition").agg(F.avg("value").alias("level"))
    out = ev.down_sampled(ev.induced_signal(levels, active, response), 2, 28)
    return out.select("voxel", "scan", F.round("signal", 4).alias("signal"))


@query(
    "usable_signals",
    """
    WITH s AS (SELECT user_id, event_type, list(value ORDER BY ts, event_id) AS y FROM events GROUP BY 1, 2)
    SELECT user_id, event_type, CAST(len(y) AS INTEGER) AS n FROM s WHERE len(list_distinct(y)) > 1
    """,
)
def usable_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridsignal.session import table

    order = F.sort_array(F.collect_list(F.struct("ts", "event_id", "value")))
    rows = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.transform(order, lambda s: s["value"]).alias("y"))
    return volumes.usable_signals(rows).select("user_id", "event_type", F.size("y").alias("n"))


@query(
    "signal_summary",
    """
    WITH s AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS t FROM events)
    SELECT event_type, CAST(t AS INTEGER) AS t, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM s GROUP BY 1, 2
    """,
)
def signal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridsignal.session import table

    order = F.sort_array(F.collect_list(F.struct("ts", "event_id", "value")))
    rows = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.transform(order, lambda s: s["value"]).alias("y"))
    return volumes.signal_summary(rows, ["event_type"]).select("event_type", "t", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(
    "joined_signals",
    f"WITH {EVENTS}, s AS (SELECT user_id, list(value ORDER BY session, onset, event_id) AS y FROM e GROUP BY 1) SELECT user_id, CAST(len(y) AS INTEGER) AS n, round(y[1], 6) AS first, round(y[len(y)], 6) AS last FROM s",
)
def joined_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.sort_array(F.collect_list(F.struct("onset", "event_id", "value")))
    rows = onsets(spark, sf_dir).groupBy("user_id", "session").agg(F.transform(order, lambda s: s["value"]).alias("y"))
    out = volumes.joined_sessions(rows, ["user_id"])
    return out.select("user_id", F.size("y").alias("n"), F.round(F.get("y", F.lit(0)), 6).alias("first"), F.round(F.element_at("y", -1), 6).alias("last"))
