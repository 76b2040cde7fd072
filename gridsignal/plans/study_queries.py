"""Studies on bucketed tables, matchings, agglomeration, hulls, mixtures and sparse matrices on the driver tables."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsignal.operators import agglomeration, hull, mixtures, models, parcellation, sparse
from gridsignal.operators import graph as graphs
from gridsignal.plans.graph_queries import GRID, grid
from gridsignal.plans.model_queries import SIGNALS, signals, span
from gridsignal.plans.register import query
from gridsignal.session import table
from gridsignal.study import Study


def study(spark: SparkSession, sf_dir: str) -> Study:
    """Users in seven parcels and two groups of subjects, by their ids, on a table laid out by parcel."""
    rows = signals(spark, sf_dir).select((F.col("voxel") % 7 + 1).cast("int").alias("parcel"), "voxel", "y")
    n = span(spark, sf_dir)[1]
    own = [Study.from_signals(rows.filter(F.col("voxel") % 2 == k), 21600.0, n, subject=str(k)) for k in (0, 1)]
    return own[0].merge_subjects(own[1]).bucketed(f"study_{uuid.uuid4().hex}", 8)


@query("study_summary", f"WITH {SIGNALS}, c AS (SELECT user_id % 7 AS parcel, user_id % 2 AS subject, count(DISTINCT user_id) AS m, any_value(n) AS n FROM g GROUP BY 1, 2) SELECT count(DISTINCT subject) AS n_subjects, count(DISTINCT parcel) AS n_parcels, CAST(sum(m) AS BIGINT) AS n_voxels, any_value(n) AS n_scans, min(m) AS least, max(m) AS largest FROM c")
def study_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study(spark, sf_dir).summary().withColumn("n_scans", F.col("n_scans").cast("long"))


@query("parcel_slopes", f"WITH {SIGNALS}, m AS (SELECT user_id % 2 AS subject, user_id % 7 + 1 AS parcel, t, avg(y) AS y FROM g GROUP BY 1, 2, 3) SELECT CAST(subject AS VARCHAR) AS subject, CAST(parcel AS INTEGER) AS parcel, round(regr_slope(y, t), 6) AS slope FROM m WHERE parcel NOT IN (2, 5) GROUP BY 1, 2")
def parcel_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trend of each subject's and parcel's mean signal, two parcels left out."""
    own = study(spark, sf_dir).discard_parcels([2, 5]).averaged()
    n = sum(own.scans)
    fitted = models.glm(own.cells, np.column_stack([np.ones(n), np.arange(n)]), signal="y_")
    return fitted.select("subject", "parcel", F.round(F.col("beta")[1], 6).alias("slope"))


@query("parcel_fit", f"WITH {SIGNALS} SELECT user_id % 7 + 1 AS parcel, round(avg(y), 6) AS mean, round(var_pop(y), 6) AS variance FROM g GROUP BY 1")
def parcel_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each parcel's mean and variance over all its voxels and scans, of both subjects, by a fit of each parcel."""

    def moments(voxels: np.ndarray, y: np.ndarray, seed: int) -> dict:
        return {"mean": [(None, None, None, float(y.mean()))], "variance": [(None, None, None, float(y.var()))]}

    out = models.without_crashed(study(spark, sf_dir).fit(moments))
    wide = out.groupBy("parcel").agg(*[F.round(F.max(F.when(F.col("name") == n, F.col("value"))), 6).alias(n) for n in ("mean", "variance")])
    return wide


# matchings of parcellations

LABELS = """
    a AS (SELECT c_custkey, c_nationkey % 4 + 1 AS i, CASE WHEN c_custkey % 11 = 0 THEN 0 WHEN c_custkey % 3 = 0 THEN (c_nationkey + 2) % 4 + 5 ELSE (c_nationkey + 1) % 4 + 5 END AS j FROM customer),
    m AS (SELECT i, j, count(*) AS n FROM a WHERE j > 0 GROUP BY 1, 2), v AS (SELECT unnest([5, 6, 7, 8]) AS j),
    perms AS (SELECT [p.j, q.j, r.j, s.j] AS js FROM v p, v q, v r, v s WHERE p.j <> q.j AND p.j <> r.j AND p.j <> s.j AND q.j <> r.j AND q.j <> s.j AND r.j <> s.j),
    best AS (SELECT js, sum(n) AS n FROM perms JOIN m ON m.j = js[m.i] GROUP BY js ORDER BY n DESC, js LIMIT 1)
"""


def labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    other = F.when(F.col("c_custkey") % 11 == 0, 0).when(F.col("c_custkey") % 3 == 0, (F.col("c_nationkey") + 2) % 4 + 5).otherwise((F.col("c_nationkey") + 1) % 4 + 5)
    return rows.select("c_custkey", (F.col("c_nationkey") % 4 + 1).alias("parcel")), rows.select("c_custkey", other.alias("parcel"))


@query("parcellation_distance", f"WITH {LABELS} SELECT (SELECT count(*) FROM a) - CAST(n AS BIGINT) AS distance FROM best")
def parcellation_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(parcellation.parcellation_distance(*labelled(spark, sf_dir), ["c_custkey"]),)], "distance long")


@query("aligned_parcels", f"WITH {LABELS} SELECT c_custkey, CAST(list_position(js, a.j) AS BIGINT) AS parcel FROM a, best WHERE j > 0 UNION ALL SELECT c_custkey, 0 FROM a WHERE j = 0")
def aligned_parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parcellation.aligned(*labelled(spark, sf_dir), ["c_custkey"]).withColumn("parcel", F.col("parcel").cast("long"))


# agglomeration


@query("ward_chain", """
    WITH RECURSIVE d AS (SELECT CAST(epoch_us(date_trunc('day', ts)) // 86400000000 AS BIGINT) AS day, avg(value) AS x FROM events GROUP BY 1),
    st(k, cs) AS (
        SELECT count(*), list({'first': day, 'n': 1.0::DOUBLE, 's': x} ORDER BY day) FROM d
        UNION ALL
        SELECT k - 1, list_slice(cs, 1, p - 1) || [{'first': cs[p].first, 'n': cs[p].n + cs[p + 1].n, 's': cs[p].s + cs[p + 1].s}] || list_slice(cs, p + 2, k)
        FROM (SELECT k, cs, list_position(costs, list_min(costs)) AS p FROM (SELECT k, cs, list_transform(range(1, k), lambda i: cs[i].n * cs[i + 1].n / (cs[i].n + cs[i + 1].n) * pow(cs[i].s / cs[i].n - cs[i + 1].s / cs[i + 1].n, 2)) AS costs FROM st WHERE k > 6))
    ), c AS (SELECT list_transform(cs, lambda x: x.first) AS firsts FROM st WHERE k = 6)
    SELECT day, CAST(len(list_filter(firsts, lambda f: f <= day)) AS INTEGER) AS label FROM d, c
""")
def ward_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days in six runs of like mean values: each day is a neighbour of the next."""
    from gridsignal.plans.event_queries import micros

    days = table(spark, sf_dir, "events").groupBy(F.floor(micros() / 86400e6).cast("long").alias("node")).agg(F.avg("value").alias("x"))
    nodes = days.select(F.lit(1).cast("long").alias("parcel"), "node", F.array("x").alias("features"))
    edges = days.select(F.col("node").alias("src"), F.explode(F.array(F.col("node") - 1, F.col("node") + 1)).alias("dst"))
    return agglomeration.ward_spatial(nodes, edges, 6).select(F.col("node").alias("day"), "label")


# hulls, matrices, mixtures


@query("hull_cells", f"""
    WITH {GRID}, k AS (SELECT x, y FROM c WHERE v >= 4 AND abs(x - 25) + abs(y - 12) <= 18), e AS (SELECT x, min(y) AS y FROM k GROUP BY 1 UNION SELECT x, max(y) FROM k GROUP BY 1),
    h AS (SELECT a.x, a.y, b.x - a.x AS dx, b.y - a.y AS dy FROM e a, e b WHERE (a.x, a.y) <> (b.x, b.y) AND NOT EXISTS (SELECT 1 FROM e o WHERE (b.x - a.x) * (o.y - a.y) - (b.y - a.y) * (o.x - a.x) < 0))
    SELECT c.x, c.y FROM c WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.dx * (c.y - h.y) - h.dy * (c.x - h.x) < 0) AND EXISTS (SELECT 1 FROM h)
""")
def hull_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the sheet inside the convex hull of the frequent ones about its middle."""
    cells = grid(spark, sf_dir)
    of = cells.filter((F.col("v") >= 4) & (F.abs(F.col("x") - 25) + F.abs(F.col("y") - 12) <= 18))
    return hull.inside_hull(cells, of, ["x", "y"]).select("x", F.col("y").cast("long").alias("y"))


@query("sparse_product", f"WITH {GRID} SELECT ed.src AS node, count(*) AS degree, CAST(sum(b.v) AS DOUBLE) AS neighbours FROM ed JOIN c b ON b.node = ed.dst GROUP BY 1")
def sparse_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adjacency matrix of the sheet times a vector of ones and times the cells' counts."""
    cells = grid(spark, sf_dir)
    matrix = sparse.graph_to_sparse(graphs.lattice_edges(cells, ["x", "y"]))
    ones = sparse.times_vector(matrix, sparse.segments(cells.withColumn("one", F.lit(1)), value="one"))
    counts = sparse.times_vector(matrix, sparse.segments(cells, value="v"))
    return ones.select("node", F.col("value").cast("long").alias("degree")).join(counts.select("node", F.col("value").alias("neighbours")), "node")


@query("informed_mixture", """
    WITH w AS (SELECT event_type, value, least(greatest(value / 100, 0), 1) AS a FROM events),
    m AS (SELECT event_type, sum(a * value) / sum(a) AS mean1, sum((1 - a) * value) / sum(1 - a) AS mean0, avg(a) AS weight1 FROM w GROUP BY 1)
    SELECT event_type, round(any_value(mean0), 4) AS mean0, round(any_value(mean1), 4) AS mean1, round(greatest(sum((1 - a) * pow(value - mean0, 2)) / sum(1 - a), 1e-6), 3) AS var0,
           round(greatest(sum(a * pow(value - mean1, 2)) / sum(a), 1e-6), 3) AS var1, round(1 - any_value(weight1), 6) AS weight0, round(any_value(weight1), 6) AS weight1 FROM w JOIN m USING (event_type) GROUP BY 1
""")
def informed_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", "value", F.least(F.greatest(F.col("value") / 100, F.lit(0.0)), F.lit(1.0)).alias("alpha"))
    return _rounded(mixtures.informed_mixture(rows, ["event_type"], "value", "alpha"))


def _rounded(out: DataFrame) -> DataFrame:
    digits = {"mean": 4, "var": 3, "weight": 6}
    return out.select("event_type", *[F.round(p, digits[p[:-1]]).alias(p) for p in mixtures.PARAMETERS])


@query("mixture_round", """
    WITH s AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS sd FROM events GROUP BY 1),
    w AS (SELECT event_type, value, 1 / (1 + exp(greatest(least((pow(value - m - sd, 2) - pow(value - m + sd, 2)) / (2 * greatest(sd * sd, 1e-6)), 700), -700))) AS a FROM events JOIN s USING (event_type)),
    m AS (SELECT event_type, sum(a * value) / sum(a) AS mean1, sum((1 - a) * value) / sum(1 - a) AS mean0, avg(a) AS weight1 FROM w GROUP BY 1)
    SELECT event_type, round(any_value(mean0), 4) AS mean0, round(any_value(mean1), 4) AS mean1, round(greatest(sum((1 - a) * pow(value - mean0, 2)) / sum(1 - a), 1e-6), 3) AS var0,
           round(greatest(sum(a * pow(value - mean1, 2)) / sum(a), 1e-6), 3) AS var1, round(1 - any_value(weight1), 6) AS weight0, round(any_value(weight1), 6) AS weight1 FROM w JOIN m USING (event_type) GROUP BY 1
""")
def mixture_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round of expectation and maximisation for each type's values, from a deviation below and above the mean."""
    rows = table(spark, sf_dir, "events").select("event_type", "value")
    start = mixtures.started(rows, ["event_type"], "value")
    return _rounded(mixtures.one_round(rows, ["event_type"], "value", start, False))
