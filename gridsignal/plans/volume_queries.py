"""Volume queries: cells are (part size, brand number), or days of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsignal.operators import volumes
from gridsignal.plans.graph_queries import GRID, grid
from gridsignal.plans.register import query
from gridsignal.session import table
from gridsignal.streaming.binning import binned


@query("crop_box", f"WITH {GRID}, k AS (SELECT x, y, CASE WHEN v >= 4 AND x > 5 THEN v ELSE 0 END AS v FROM c), b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM k WHERE v <> 0) SELECT CAST(x - x0 AS INTEGER) AS x, CAST(y - y0 AS INTEGER) AS y, v FROM k, b WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1")
def crop_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid(spark, sf_dir).select("x", "y", F.when((F.col("v") >= 4) & (F.col("x") > 5), F.col("v")).otherwise(0).alias("v"))
    return volumes.crop(cells, ["x", "y"], "v")


@query("sub_sample", f"WITH {GRID} SELECT CAST(floor(x / 2) AS BIGINT) AS x, CAST(floor(y / 2) AS BIGINT) AS y, round(avg(v), 6) AS v FROM c GROUP BY 1, 2")
def sub_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volumes.sub_sample(grid(spark, sf_dir), ["x", "y"], "v", 2).withColumn("v", F.round("v", 6))


@query("rebin", f"WITH {GRID} SELECT t.x, u.y, c.v FROM range(17) t(x), range(40) u(y), c WHERE c.x = CAST(floor(t.x * 51 / 17) AS BIGINT) AND c.y = CAST(floor(u.y * 25 / 40) AS BIGINT)")
def rebin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volumes.rebin(grid(spark, sf_dir), ["x", "y"], "v", {"x": 51, "y": 25}, {"x": 17, "y": 40})


@query("flip_in_parcels", "SELECT s_suppkey, CASE WHEN s_nationkey IN (3, 7) THEN -s_acctbal ELSE s_acctbal END AS s_acctbal, CASE WHEN s_nationkey = 5 THEN 0 ELSE s_nationkey END AS s_nationkey FROM supplier")
def flip_in_parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey")
    return volumes.remove_parcels(volumes.flip_in_parcels(rows, "s_acctbal", "s_nationkey", [3, 7]), "s_nationkey", [5])


@query("binned_events", "SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2000-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def binned_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = binned(rows, "ts", ["event_type"], "6 hours", value="value")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
