"""An experiment's events as one object: a table ``(session, condition, onset, duration)`` and its sessions' lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsignal.operators import events as ev
from gridsignal.sources.paradigm import read_paradigm, write_paradigm


class Paradigm:
    """``events``: session, condition, onset[, duration]; ``durations``: session, t_end (by default each session's last end)."""

    def __init__(self, events: DataFrame, durations: DataFrame | None = None):
        self.events = ev.with_default_durations(events)
        self.durations = ev.session_durations(self.events) if durations is None else durations

    @classmethod
    def from_csv(cls, spark: SparkSession, path: str, delimiter: str | None = None) -> Paradigm:
        return cls(read_paradigm(spark, path, delimiter))

    @classmethod
    def from_session_dict(cls, spark: SparkSession, sessions: dict[str, dict], durations: DataFrame | None = None) -> Paradigm:
        """``{session: {"onsets": {condition: [..]}, "stimulusLength": {condition: [..]}}}``; sessions are numbered from 0 in
        the order of their names. A design's own numbers, written by hand."""
        rows = []
        for number, name in enumerate(sorted(sessions)):
            lengths = sessions[name].get("stimulusLength", {})
            for condition, onsets in sessions[name]["onsets"].items():
                own = lengths.get(condition) or [0.0] * len(onsets)
                rows += [(number, condition, float(t), float(d)) for t, d in zip(onsets, own, strict=True)]
        return cls(spark.createDataFrame(rows, "session int, condition string, onset double, duration double"), durations)

    def save_csv(self, path: str) -> None:
        write_paradigm(self.events, path)

    def delete_condition(self, condition: str) -> Paradigm:
        return Paradigm(ev.delete_condition(self.events, condition), self.durations)

    def get_stimulus_names(self) -> DataFrame:
        return self.events.select("condition").distinct()

    def get_t_max(self) -> DataFrame:
        """One row: the longest session's length."""
        return self.durations.agg(F.max("t_end").alias("t_max"))

    def get_joined_onsets(self) -> DataFrame:
        """Events with onsets counted from the first session's start."""
        return ev.joined_onsets(self.events, self.durations)

    def get_joined_onsets_dim(self) -> DataFrame:
        """(session, condition, onsets): each session's own onsets, sorted."""
        return self.events.groupBy("session", "condition").agg(F.sort_array(F.collect_list("onset")).alias("onsets"))

    def get_joined_durations(self) -> DataFrame:
        """(condition, session, position, duration): all sessions' durations in the order of the joined onsets."""
        return self._placed(self.events).select("condition", "session", "position", "duration")

    def get_joined_durations_dim(self) -> DataFrame:
        """(session, condition, durations): each session's durations in the order of its onsets."""
        pairs = F.sort_array(F.collect_list(F.struct("onset", "duration")))
        return self.events.groupBy("session", "condition").agg(F.transform(pairs, lambda p: p["duration"]).alias("durations"))

    @staticmethod
    def _placed(events: DataFrame) -> DataFrame:
        """Events with ``position``, from 0 in their condition: a session's place comes from the counts of the ones before."""
        from pyspark.sql import Window

        counts = events.groupBy("condition", "session").agg(F.count(F.lit(1)).alias("_n"))
        before = Window.partitionBy("condition").orderBy("session").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.select("condition", "session", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        inside = Window.partitionBy("condition", "session").orderBy("onset", "duration")
        placed = events.withColumn("_at", F.row_number().over(inside) - 1)
        return placed.join(counts, ["condition", "session"]).withColumn("position", F.col("_at") + F.col("_before")).drop("_at", "_before")

    def join_sessions(self) -> Paradigm:
        """One session, as long as the sum of all; its number is 0."""
        joined = self.get_joined_onsets().withColumn("session", F.lit(0))
        return Paradigm(joined, self.durations.agg(F.sum("t_end").alias("t_end")).select(F.lit(0).alias("session"), "t_end"))

    def get_rastered(self, dt: float, t_max: float) -> DataFrame:
        return ev.raster(self.events, dt, t_max)

    def get_joined_and_rastered(self, dt: float, t_max: float) -> DataFrame:
        """(condition, bin, active): the sessions' grids one after the other."""
        grid = self.get_rastered(dt, t_max)
        size = int(round(t_max / dt)) + 1 if abs(t_max / dt - round(t_max / dt)) < 1e-9 else int(round((t_max + dt) / dt))
        order = F.dense_rank().over(_by_session())
        ranks = grid.select("session").distinct().withColumn("_rank", order - 1)
        return grid.join(F.broadcast(ranks), "session").select("condition", (F.col("_rank") * size + F.col("bin")).alias("bin"), "active")

    def get_info(self) -> DataFrame:
        """(condition, n_sessions, n_events, kind, mean_isi, std_isi, last_onset); gaps don't reach over sessions."""
        gaps = ev.intervals(self.events, ["condition", "session"])
        per = gaps.groupBy("condition").agg(
            F.count(F.lit(1)).alias("n_sessions"),
            (F.sum(F.col("mean_isi") * (F.col("n_events") - 1)) / F.nullif(F.sum(F.when(F.col("mean_isi").isNotNull(), F.col("n_events") - 1)), F.lit(0))).alias("mean_isi"),
            F.max("last_onset").alias("last_onset"),
        )
        kinds = self.events.groupBy("condition").agg(F.count(F.lit(1)).alias("n_events"), ev.design_kind(self.events).alias("kind"))
        return per.join(kinds, "condition").select("condition", "n_sessions", "n_events", "kind", "mean_isi", "last_onset")


def _by_session():
    """Sessions in their order; they are an experiment's few runs."""
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0)).orderBy("session")
