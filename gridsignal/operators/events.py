"""Event time-series: tables ``(session, condition, onset, duration, amplitude)`` with times in seconds.

Grids have the step ``dt``; a time falls on the bin nearest to it, halves to the even bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bin_of(time: Column, dt: float) -> Column:
    return F.rint(time / dt).cast("long")


def n_bins(t_max: Column, dt: float) -> Column:
    """Bins of a grid from 0 to ``t_max``: one more than whole steps if dt divides t_max, else the nearest number to (t_max + dt) / dt."""
    whole = F.abs(t_max / dt - F.rint(t_max / dt)) < 1e-9
    return F.when(whole, F.rint(t_max / dt) + 1).otherwise(F.rint((t_max + dt) / dt)).cast("long")


def with_default_durations(events: DataFrame) -> DataFrame:
    """Missing durations are 0: spikes."""
    duration = F.coalesce(F.col("duration"), F.lit(0.0)) if "duration" in events.columns else F.lit(0.0)
    return events.withColumn("duration", duration)


def session_durations(events: DataFrame) -> DataFrame:
    """(session, t_end): the end of each session's last event."""
    return with_default_durations(events).groupBy("session").agg(F.max(F.col("onset") + F.col("duration")).alias("t_end"))


def joined_onsets(events: DataFrame, durations: DataFrame | None = None) -> DataFrame:
    """Shift each session by the durations of the earlier ones, so that all sessions form one.

    ``durations`` (session, t_end): one row a session, so the running sum is over few rows; it meets events on session.
    """
    ends = durations if durations is not None else session_durations(events)
    before = Window.partitionBy(F.lit(0)).orderBy("session").rowsBetween(Window.unboundedPreceding, -1)
    shifts = ends.select("session", F.coalesce(F.sum("t_end").over(before), F.lit(0.0)).alias("shift"))
    return events.join(shifts, "session").withColumn("onset", F.col("onset") + F.col("shift")).drop("shift")


def merge_onsets(events: DataFrame, new_condition: str, part: str, discard: list[str] | None = None) -> DataFrame:
    """Conditions whose name holds ``part`` become one; those in ``discard`` go."""
    out = events.filter(~F.col("condition").isin(discard)) if discard else events
    return out.withColumn("condition", F.when(F.col("condition").contains(part), F.lit(new_condition)).otherwise(F.col("condition")))


def delete_condition(events: DataFrame, condition: str) -> DataFrame:
    return events.filter(F.col("condition") != condition)


def sampled(events: DataFrame, dt: float) -> DataFrame:
    """(session, condition, bin): the bins that events cover, each once; an event covers its own bin at least."""
    events = with_default_durations(events)
    at, length = bin_of(F.col("onset"), dt), bin_of(F.col("duration"), dt)
    return events.select("session", "condition", F.explode(F.sequence(at, F.greatest(at, at + length - 1))).alias("bin")).distinct()


def raster(events: DataFrame, dt: float, t_max: float) -> DataFrame:
    """(session, condition, bin, active) for every bin of the grid; events beyond it are left out."""
    last = n_bins(F.lit(float(t_max)), dt) - 1
    grid = events.select("session", "condition").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    hits = sampled(events, dt).withColumn("hit", F.lit(1))
    return grid.join(hits, ["session", "condition", "bin"], "left").withColumn("active", F.coalesce("hit", F.lit(0))).drop("hit")


def onset_matrix(active: DataFrame, n_lags: int, step: int = 1) -> DataFrame:
    """Rows (session, condition, scan, lag) with x = 1 of the matrix X[scan, lag] = bin(scan x step - lag).

    ``active``: session, condition, bin of the active bins. Each bin gives its own entries, so nothing is joined.
    """
    lagged = active.select("session", "condition", "bin", F.explode(F.sequence(F.lit(0), F.lit(n_lags - 1))).alias("lag"))
    at = F.col("bin") + F.col("lag")
    return lagged.filter(at % step == 0).select("session", "condition", (at / step).cast("long").alias("scan"), "lag", F.lit(1).alias("x"))


def intervals(events: DataFrame, by: list[str], time: str = "onset") -> DataFrame:
    """Mean and population deviation of the time between successive events, last event and number of events."""
    gap = F.col(time) - F.lag(time).over(Window.partitionBy(*by).orderBy(time))
    return events.withColumn("_gap", gap).groupBy(*by).agg(F.avg("_gap").alias("mean_isi"), F.stddev_pop("_gap").alias("std_isi"), F.max(time).alias("last_onset"), F.count(F.lit(1)).alias("n_events"))


def design_kind(events: DataFrame) -> Column:
    """``block`` if any event lasts, else ``event``; an aggregate."""
    return F.when(F.max("duration") > 0, "block").otherwise("event")


def grid_step(events: DataFrame, tr: float, n_scans: int, dt_min: float) -> float:
    """The smallest positive gap among the onsets and the scan grid, not below ``dt_min``."""
    spark = events.sparkSession
    scans = spark.range(n_scans).select((F.col("id") * tr).alias("t"))
    times = events.select(F.col("onset").alias("t")).union(scans).distinct()
    # neighbours lie in the same bucket of one scan's length, or on either side of its edge, where a scan stands
    near = Window.partitionBy(F.floor(F.col("t") / tr)).orderBy("t")
    inner = times.withColumn("gap", F.col("t") - F.lag("t").over(near))
    upto = times.withColumn("gap", (F.floor(F.col("t") / tr) + 1) * tr - F.col("t"))
    least = inner.select("gap").union(upto.select("gap")).filter(F.col("gap") > 1e-12).agg(F.min("gap")).first()[0]
    return max(dt_min, least if least is not None else dt_min)


def induced_signal(levels: DataFrame, active: DataFrame, response: DataFrame) -> DataFrame:
    """(voxel, bin, signal): sum over conditions of level x (active bins convolved with the response).

    ``levels``: voxel, condition, level; ``active``: condition, bin; ``response``: lag, h.
    """
    shape = active.crossJoin(F.broadcast(response)).groupBy("condition", (F.col("bin") + F.col("lag")).alias("bin")).agg(F.sum("h").alias("xh"))
    return levels.join(shape, "condition").groupBy("voxel", "bin").agg(F.sum(F.col("level") * F.col("xh")).alias("signal"))


def down_sampled(signal: DataFrame, factor: int, n: int) -> DataFrame:
    """Every ``factor``-th of ``n`` bins but the last bin, numbered as scans."""
    return signal.filter((F.col("bin") % factor == 0) & (F.col("bin") < n - 1)).withColumn("scan", (F.col("bin") / factor).cast("long")).drop("bin")
