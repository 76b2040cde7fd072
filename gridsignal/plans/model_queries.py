"""Model fits on the events table: a voxel is a user, a scan a quarter of a day, a parcel a group of users.

Users have no place in the tables: in the order of their ids they fill parcels of bounded size, row by row of a sheet, and
the neighbours on the sheet are the joint models' neighbours.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsignal.functions.signal import polynomial_basis
from gridsignal.operators import graph, models
from gridsignal.operators.ranking import global_row_number
from gridsignal.plans.event_queries import micros
from gridsignal.plans.register import query
from gridsignal.session import table

DT = 0.25
#: Users of a parcel at most, and of a row of its sheet.
PARCEL, WIDTH = 100, 10


def scan():
    """Quarters of a day since 1970."""
    return F.floor(micros() / (86400e6 * DT)).cast("long")


def span(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """The first scan that has an event, and the number of scans to the last one."""
    ends = table(spark, sf_dir, "events").agg(F.min(scan()).alias("lo"), F.max(scan()).alias("hi")).first()
    return (ends["lo"], ends["hi"] - ends["lo"] + 1) if ends["lo"] is not None else (0, 1)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's number of events in each scan, from the first scan of all to the last."""
    first, n = span(spark, sf_dir)
    counts = table(spark, sf_dir, "events").groupBy("user_id", (scan() - first).cast("int").alias("scan")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("scan", "n"))).alias("m"))
    y = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return rows.select(F.col("user_id").alias("voxel"), y.alias("y"))


def in_parcels(voxels: DataFrame) -> DataFrame:
    """Add parcel, and line and place on its sheet: as many parcels as ``PARCEL`` needs, of equal sizes but for one."""
    ranked = global_row_number(voxels, ["voxel"], "rank")
    n = ranked.count()
    parcels = max(1, -(-n // PARCEL))
    parted = ranked.withColumn("parcel", F.expr(f"rank * {parcels} div {max(n, 1)}")).withColumn("at", F.expr(f"rank - (parcel * {n} + {parcels - 1}) div {parcels}"))
    return parted.select("parcel", *voxels.columns, F.expr(f"at div {WIDTH}").alias("line"), F.expr(f"at % {WIDTH}").alias("place"))


def sheet_edges(parted: DataFrame) -> DataFrame:
    """(parcel, src, dst): neighbours on the parcels' sheets, in both directions."""
    cells = parted.select("parcel", "line", "place", "voxel")
    edges = graph.lattice_edges(cells, ["parcel", "line", "place"], "voxel", [(0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)])
    return graph.parcel_edges(edges, cells, "voxel")


#: Every user's signal over the whole span of scans.
SIGNALS = """
    q AS (SELECT user_id, CAST(floor(epoch(ts) / 21600) AS BIGINT) AS scan FROM events), ends AS (SELECT min(scan) AS lo, max(scan) - min(scan) + 1 AS n FROM q),
    s AS (SELECT user_id, scan, CAST(count(*) AS DOUBLE) AS n FROM q GROUP BY 1, 2),
    g AS (SELECT u.user_id, i AS t, coalesce(s.n, 0) AS y, ends.n FROM (SELECT DISTINCT user_id FROM q) u, ends, LATERAL (SELECT unnest(range(ends.n)) AS i) LEFT JOIN s ON s.user_id = u.user_id AND s.scan = ends.lo + i)
"""


@query("glm_ols", f"WITH {SIGNALS} SELECT user_id, round(regr_intercept(y, t), 6) AS intercept, round(regr_slope(y, t), 6) AS slope, round((regr_syy(y, t) - regr_slope(y, t) * regr_sxy(y, t)) / (any_value(n) - 2), 6) AS s2 FROM g GROUP BY 1")
def glm_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = span(spark, sf_dir)[1]
    out = models.glm(signals(spark, sf_dir), np.column_stack([np.ones(n), np.arange(n)]))
    return out.select(F.col("voxel").alias("user_id"), F.round(F.col("beta")[0], 6).alias("intercept"), F.round(F.col("beta")[1], 6).alias("slope"), F.round("s2", 6).alias("s2"))


@query("glm_ar1", f"""
    WITH {SIGNALS}, k AS (SELECT user_id, regr_intercept(y, t) AS a, regr_slope(y, t) AS b FROM g GROUP BY 1),
    r AS (SELECT user_id, t, y, n, y - a - b * t AS r, lag(y - a - b * t) OVER w AS r1, lag(y) OVER w AS y1 FROM g JOIN k USING (user_id) WINDOW w AS (PARTITION BY user_id ORDER BY t)),
    h AS (SELECT user_id, coalesce(sum(r * r1) / nullif(sum(r * r), 0), 0) AS rho FROM r GROUP BY 1),
    w AS (SELECT user_id, rho, n, CASE WHEN t = 0 THEN sqrt(1 - rho * rho) * y ELSE y - rho * y1 END AS wy, CASE WHEN t = 0 THEN sqrt(1 - rho * rho) ELSE 1 - rho END AS w0,
                 CASE WHEN t = 0 THEN 0 ELSE t - rho * (t - 1) END AS w1 FROM r JOIN h USING (user_id)),
    m AS (SELECT user_id, any_value(rho) AS rho, any_value(n) AS n, sum(w0 * w0) AS s00, sum(w0 * w1) AS s01, sum(w1 * w1) AS s11, sum(w0 * wy) AS b0, sum(w1 * wy) AS b1, sum(wy * wy) AS yy FROM w GROUP BY 1),
    f AS (SELECT *, (b0 * s11 - b1 * s01) / (s00 * s11 - s01 * s01) AS c0, (b1 * s00 - b0 * s01) / (s00 * s11 - s01 * s01) AS c1 FROM m)
    SELECT user_id, round(rho, 5) AS rho, round(c0, 5) AS intercept, round(c1, 6) AS slope, round((yy - c0 * b0 - c1 * b1) / (n - 2), 5) AS s2,
           round(c1 / sqrt((yy - c0 * b0 - c1 * b1) / (n - 2) * s00 / (s00 * s11 - s01 * s01)), 4) AS t_slope FROM f
""")
def glm_ar1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same line with residuals that follow AR(1), against two passes in SQL."""
    n = span(spark, sf_dir)[1]
    out = models.glm_ar1(signals(spark, sf_dir), np.column_stack([np.ones(n), np.arange(n)]), {"slope": np.array([0.0, 1.0])})
    return out.select(F.col("voxel").alias("user_id"), F.round("rho", 5).alias("rho"), F.round(F.col("beta")[0], 5).alias("intercept"), F.round(F.col("beta")[1], 6).alias("slope"), F.round("s2", 5).alias("s2"), F.round("t_slope", 4).alias("t_slope"))


def onsets(spark: SparkSession, sf_dir: str, conditions: list[str], lags: int) -> np.ndarray:
    """X of the scans in which a type of event is more frequent than on average (a row a scan and type)."""
    first, n = span(spark, sf_dir)
    out = np.zeros((len(conditions), n, lags))
    kinds = table(spark, sf_dir, "events").filter(F.col("event_type").isin(conditions)).groupBy("event_type", (scan() - first).alias("scan")).count().collect()
    for m, kind in enumerate(conditions):
        counts = np.zeros(n)
        for r in kinds:
            if r["event_type"] == kind:
                counts[r["scan"]] = r["count"]
        bins = (counts > counts.mean() + counts.std()).astype(float)
        for lag in range(lags):
            out[m, lag:, lag] = bins[: n - lag]
    return out


# The joint models are no queries of the entry point: they are numerical estimators on bounded parcels.


def _fit(spark: SparkSession, sf_dir: str, make, linked: bool = True) -> DataFrame:
    estimate = make(onsets(spark, sf_dir, ["click", "view"], 6), polynomial_basis(span(spark, sf_dir)[1], 3))
    parted = in_parcels(signals(spark, sf_dir))
    return models.without_crashed(models.fit_parcels(parted, estimate, edges=sheet_edges(parted)) if linked else models.fit_voxels(parted, estimate))


def rfir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(spark, sf_dir, lambda x, drift: models.rfir(x, drift, DT), linked=False)


def vem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(spark, sf_dir, lambda x, drift: models.variational_jde(x, drift, DT, []))


def gibbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(spark, sf_dir, lambda x, drift: models.gibbs_jde(x, drift, DT, []))
