"""Queries of meshes, components, split parcels, statistics, bases, trees and names.

Cells are (part size, brand number); a triangle joins a cell, its right and its upper neighbour.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsignal.functions import series, signal, stats
from gridsignal.operators import graph, parcellation, splitting
from gridsignal.plans.graph_queries import GRID, grid
from gridsignal.plans.register import query
from gridsignal.session import table, written

MESH = f"{GRID}, tri AS (SELECT c.node AS a, r.node AS b, u.node AS c FROM c JOIN c r ON r.x = c.x + 1 AND r.y = c.y JOIN c u ON u.x = c.x AND u.y = c.y + 1), me AS (SELECT DISTINCT src, dst FROM (SELECT unnest([a, b, a, c, b, c]) AS src, unnest([b, a, c, a, c, b]) AS dst FROM tri))"


def triangles(cells: DataFrame) -> DataFrame:
    near = cells.select("node", "x", "y")
    right = near.select(F.col("node").alias("b"), (F.col("x") - 1).alias("x"), "y")
    up = near.select(F.col("node").alias("c"), "x", (F.col("y") - 1).alias("y"))
    return near.withColumnRenamed("node", "a").join(right, ["x", "y"]).join(up, ["x", "y"]).select("a", "b", "c")


@query("mesh_edges", f"WITH {MESH} SELECT src, dst FROM me")
def mesh_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.mesh_edges(triangles(grid(spark, sf_dir)))


@query("mesh_contour", f"WITH {MESH}, l AS (SELECT node, v % 2 AS k FROM c) SELECT a, b, tri.c FROM tri JOIN l p ON p.node = a JOIN l q ON q.node = b JOIN l r ON r.node = tri.c WHERE p.k <> q.k OR q.k <> r.k")
def mesh_contour(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid(spark, sf_dir)
    return graph.mesh_contour(triangles(cells), cells.select("node", (F.col("v") % 2).alias("label")))


@query(
    "sub_mesh",
    f"""
    WITH RECURSIVE {MESH}, r AS (SELECT min(a) AS node, 0 AS depth FROM tri UNION SELECT me.dst, r.depth + 1 FROM r JOIN me ON me.src = r.node WHERE r.depth < 4),
         k AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS id FROM (SELECT DISTINCT node FROM r))
    SELECT p.id AS a, q.id AS b, s.id AS c FROM tri JOIN k p ON p.node = a JOIN k q ON q.node = b JOIN k s ON s.node = tri.c
    """,
)
def sub_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid(spark, sf_dir)
    mesh = triangles(cells)
    centre = mesh.agg(F.min("a")).first()[0]
    return graph.sub_mesh(cells.select("node", "x", "y"), mesh, centre, 4)[1]


@query("sub_graph", f"WITH {GRID}, k AS (SELECT node FROM c WHERE v % 2 = 0) SELECT src, dst FROM ed WHERE src IN (SELECT node FROM k) AND dst IN (SELECT node FROM k)")
def sub_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid(spark, sf_dir)
    return graph.sub_graph(graph.lattice_edges(cells, ["x", "y"]), cells.filter("v % 2 = 0"))


@query("pooled_graph", f"WITH {GRID}, n AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS id FROM (SELECT DISTINCT src AS node FROM ed)) SELECT p.id AS src, q.id AS dst FROM ed JOIN n p ON p.node = src JOIN n q ON q.node = dst")
def pooled_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pooled(graph.lattice_edges(grid(spark, sf_dir), ["x", "y"]))


@query("parcel_graphs", f"WITH {GRID} SELECT p.v % 3 AS parcel, src, dst FROM ed JOIN c p ON p.node = src JOIN c q ON q.node = dst WHERE p.v % 3 = q.v % 3")
def parcel_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid(spark, sf_dir)
    return graph.parcel_edges(graph.lattice_edges(cells, ["x", "y"]), cells.select("node", (F.col("v") % 3).alias("parcel")))


@query("clique_count", f"WITH {GRID} SELECT count(*) / 2 AS cliques FROM ed")
def clique_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.n_cliques(graph.lattice_edges(grid(spark, sf_dir), ["x", "y"]))


WITHIN = f"{GRID}, k AS (SELECT node, x, y, v % 3 AS g FROM c), e2 AS (SELECT a.node AS src, b.node AS dst FROM k a JOIN k b ON abs(a.x - b.x) + abs(a.y - b.y) = 1 AND a.g = b.g), r AS (SELECT node, node AS root FROM k UNION SELECT e2.dst, r.root FROM r JOIN e2 ON e2.src = r.node), m AS (SELECT node, min(root) AS component FROM r GROUP BY 1)"


@query("components_within", f"WITH RECURSIVE {WITHIN} SELECT node, component FROM m WHERE component IN (SELECT component FROM m GROUP BY 1 HAVING count(*) >= 4)")
def components_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid(spark, sf_dir)
    return graph.components_within(graph.lattice_edges(cells, ["x", "y"]), cells.select("node", (F.col("v") % 3).alias("label")), 4)


@query("largest_component", f"WITH RECURSIVE {WITHIN} SELECT node FROM m WHERE component = (SELECT component FROM m GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1)")
def largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid(spark, sf_dir)
    inside = graph.parcel_edges(graph.lattice_edges(cells, ["x", "y"]), cells.select("node", (F.col("v") % 3).alias("parcel")))
    return graph.largest_component(inside.select("src", "dst"), cells)


@query("eroded", f"WITH {GRID} SELECT a.x, a.y FROM c a JOIN c b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY 1, 2 HAVING count(*) = 9")
def eroded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.eroded(grid(spark, sf_dir), ["x", "y"]).withColumn("y", F.col("y").cast("long"))


@query("lattice_3d", f"WITH {GRID}, k AS (SELECT x % 5 AS x, y, x // 5 AS z, node FROM c) SELECT a.node AS src, b.node AS dst FROM k a JOIN k b ON abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1")
def lattice_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid(spark, sf_dir).select((F.col("x") % 5).alias("x"), "y", F.expr("x div 5").cast("int").alias("z"), "node")
    return graph.lattice_edges(cells, ["x", "y", "z"], kernel="3D-6n")


@query("mask_at", f"""
    WITH {GRID}, m AS (SELECT node, w.wraps, x - 1 + i AS p, CAST(y AS BIGINT) + j AS q FROM c, range(-1, 2) a(i), range(-1, 2) b(j), (VALUES (true), (false)) w(wraps) WHERE v >= 3)
    SELECT node, wraps, CAST(CASE WHEN p < 0 THEN 49 WHEN p >= 50 THEN 0 ELSE p END AS INTEGER) AS x, CAST(CASE WHEN q < 0 THEN 24 WHEN q >= 25 THEN 0 ELSE q END AS INTEGER) AS y
    FROM m WHERE wraps OR p BETWEEN 0 AND 49 AND q BETWEEN 0 AND 24
""")
def mask_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine cells around each frequent pair of size and brand, cut off at the sheet's edge or wrapped around it."""
    at = grid(spark, sf_dir).filter("v >= 3").select("node", (F.col("x") - 1).alias("at_x"), F.col("y").cast("long").alias("at_y"))
    offsets = F.explode(F.array(*[F.struct(F.lit(i).alias("x"), F.lit(j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("o")
    masks = at.select("node", "at_x", "at_y", offsets).select("node", "at_x", "at_y", "o.x", "o.y")
    parts = [graph.centred_at(masks, ["x", "y"], {"x": F.col("at_x"), "y": F.col("at_y")}, {"x": 50, "y": 25}, w).select("node", F.lit(w).alias("wraps"), "x", "y") for w in (True, False)]
    return parts[0].unionByName(parts[1])


@query("cell_distance", f"WITH {GRID} SELECT node, round(sqrt(pow(x - 3, 2) + pow(y - 4, 2)), 6) AS d FROM c")
def cell_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir).select("node", F.round(graph.distance([F.col("x"), F.col("y")], [F.lit(3), F.lit(4)]), 6).alias("d"))


BANDS = f"""
    {GRID}, k AS (SELECT node, x, y, x // 13 AS parcel FROM c), e2 AS (SELECT a.node AS src, b.node AS dst FROM k a JOIN k b ON abs(a.x - b.x) + abs(a.y - b.y) = 1 AND a.parcel = b.parcel),
    r AS (SELECT node, node AS root FROM k UNION SELECT e2.dst, r.root FROM r JOIN e2 ON e2.src = r.node),
    m AS (SELECT node, min(root) AS component FROM r GROUP BY 1), z AS (SELECT parcel, component, count(*) AS n FROM m JOIN k USING (node) GROUP BY 1, 2)
"""


def banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir).select("node", "x", "y", F.expr("x div 13").cast("long").alias("parcel"))


def described(pieces: DataFrame, label: str) -> DataFrame:
    """parcel, component, size, connected parts of each piece (label) of the bands' components, by the final labels alone."""
    edges = written(graph.lattice_edges(pieces, ["x", "y"]))
    inside = lambda by: graph.parcel_edges(edges, pieces.select("node", F.col(by).alias("parcel"))).select("src", "dst")
    whole = graph.connected_components(inside("band"), pieces.select("node"))
    parts = graph.connected_components(inside(label), pieces.select("node")).withColumnRenamed("component", "part")
    rows = pieces.join(whole, "node").join(parts, "node").groupBy("band", label).agg(F.min("component").alias("component"), F.count(F.lit(1)).alias("size"), F.count_distinct("part").alias("parts"))
    return rows.select(F.col("band").alias("parcel"), "component", "size", "parts")


def _pieces_sql(quota: str) -> str:
    """Sizes of each component's pieces: all within a cell of each other, each in one part."""
    return f"""WITH RECURSIVE {BANDS}, q AS (SELECT parcel, component, n, CAST({quota} AS BIGINT) AS k FROM z)
    SELECT parcel, component, CAST(CASE WHEN i < n % k THEN n // k + 1 ELSE n // k END AS BIGINT) AS size, CAST(1 AS BIGINT) AS parts FROM q, LATERAL (SELECT unnest(range(k)) AS i)"""


@query("split_big_parcels", _pieces_sql("CASE WHEN parcel > 0 AND sum(n) OVER (PARTITION BY parcel) > 30 THEN ceil(n / 30.0) ELSE 1 END") + " WHERE parcel > 0")
def split_big_parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of at most 30 cells of the bands of parts (the first is background): each connected, as even as can be."""
    cells = banded(spark, sf_dir)
    out = splitting.split_big_parcels(cells.withColumn("band", F.col("parcel")), ["x", "y"], 30)
    return described(written(out.filter("parcel <> 0").withColumn("label", F.col("parcel"))), "label")


@query("balanced_parcels", _pieces_sql("greatest(round_even(48.0 * n / sum(n) OVER (), 0), 1)").replace("x // 13 AS parcel", "0 AS parcel"))
def balanced_parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheet of parts in 48 parcels, shared among its components by size."""
    cells = banded(spark, sf_dir)
    out = splitting.balanced_parcels(cells.select("x", "y"), ["x", "y"], 48).withColumnRenamed("parcel", "label")
    return described(written(cells.select("node", "x", "y", F.lit(0).cast("long").alias("band")).join(out, ["x", "y"])), "label")


@query("parcel_ranks", "SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INTEGER) AS rank FROM customer WHERE c_nationkey NOT IN (3, 7)")
def parcel_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parcellation.discard_parcels(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), [3, 7], "c_nationkey")
    return parcellation.with_ranks(rows, "c_nationkey", ["c_custkey"]).select("c_custkey", "rank")


@query("rounded_counts", "SELECT c_nationkey, CAST(CASE WHEN count(*) >= 100 THEN round_even(count(*) / 100.0, 0) * 100 WHEN count(*) >= 10 THEN round_even(count(*) / 10.0, 0) * 10 ELSE count(*) END AS BIGINT) AS n FROM customer GROUP BY 1")
def rounded_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = parcellation.parcel_sizes(table(spark, sf_dir, "customer"), "c_nationkey")
    return sizes.select("c_nationkey", parcellation.rounded_count(F.col("size")).alias("n"))


# statistics

SIMPSON = "q AS (SELECT i / 200.0 AS t, CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END / 600.0 AS w FROM range(2001) r(i))"
USERS = "u AS (SELECT user_id, avg(value) AS m, greatest(var_pop(value), 1e-6) AS v FROM events GROUP BY 1)"


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("m"), F.greatest(F.var_pop("value"), F.lit(1e-6)).alias("v"))


@query("ppm_norm_tail", f"WITH {SIMPSON}, {USERS}, z AS (SELECT user_id, least(greatest((50 - m) / sqrt(v), -10), 10) AS z FROM u) SELECT user_id, round(0.5 - sum(w * z / 10 * exp(-pow(z * t / 10, 2) / 2)) / sqrt(2 * pi()), 6) AS ppm FROM z, q GROUP BY 1")
def ppm_norm_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chance of more than 50, against the integral of the density."""
    return users(spark, sf_dir).select("user_id", F.round(stats.ppm_a_norm(F.col("m"), F.col("v"), 50.0), 6).alias("ppm"))


MIXED = f"{SIMPSON}, k AS (SELECT user_id, event_type, avg(value) AS m, greatest(var_pop(value), 1e-2) AS v, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS p FROM events GROUP BY 1, 2), z AS (SELECT user_id, event_type, p, least(greatest((50 - m) / sqrt(v), -10), 10) AS z FROM k), c AS (SELECT user_id, event_type, any_value(p) AS p, 0.5 + sum(w * z / 10 * exp(-pow(z * t / 10, 2) / 2)) / sqrt(2 * pi()) AS f FROM z, q GROUP BY 1, 2)"


def mixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("mean"), F.greatest(F.var_pop("value"), F.lit(1e-2)).alias("variance"), F.count(F.lit(1)).alias("n"))
    total = rows.groupBy("user_id").agg(F.sum("n").alias("total"))
    return rows.join(total, "user_id").select("user_id", "mean", "variance", (F.col("n") / F.col("total")).alias("prop"))


@query("mixture_cdf", f"WITH {MIXED} SELECT user_id, round(sum(p * f), 6) AS cdf, round(1 - sum(p * f), 6) AS ppm FROM c GROUP BY 1")
def mixture_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = (F.col("mean"), F.col("variance"), F.col("prop"))
    return mixtures(spark, sf_dir).groupBy("user_id").agg(F.round(stats.gm_cdf(F.lit(50.0), *columns), 6).alias("cdf"), F.round(stats.ppm_g_apost(*columns, 50.0), 6).alias("ppm"))


@query("mixture_quantile", "SELECT DISTINCT user_id, 0.05::DOUBLE AS tail FROM events")
def mixture_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value that a mixture exceeds with probability 0.05, and the chance to exceed it."""
    parts = mixtures(spark, sf_dir)
    at = stats.ppm_a_apost(parts, ["user_id"], 0.05)
    beyond = F.col("prop") * (1.0 - stats.phi((F.col("ppm") - F.col("mean")) / F.sqrt("variance")))
    return parts.join(at, "user_id").groupBy("user_id").agg(F.round(F.sum(beyond), 6).alias("tail"))


@query("ppm_alpha_mcmc", """
    WITH s AS (SELECT user_id, list(value ORDER BY value) AS x FROM events GROUP BY 1), p AS (SELECT user_id, x, len(x) AS n, 0.95 * (len(x) + 0.2) + 0.4 AS place FROM s),
         k AS (SELECT *, CAST(greatest(1, least(n - 1, floor(place))) AS BIGINT) AS k FROM p)
    SELECT user_id, round(CASE WHEN n = 1 THEN x[1] ELSE (1 - greatest(0, least(1, place - k))) * x[k] + greatest(0, least(1, place - k)) * x[k + 1] END, 6) AS ppm FROM k
""")
def ppm_alpha_mcmc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.plotting_quantiles(table(spark, sf_dir, "events"), ["user_id"], "value", 0.95, "ppm").withColumn("ppm", F.round("ppm", 6))


@query("threshold_labels", "SELECT event_id, CAST(value / 100 >= 0.5 AS INTEGER) AS label FROM events")
def threshold_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", stats.threshold_label(F.col("value") / 100, 0.5).alias("label"))


@query("student_test", f"WITH {SIMPSON}, {USERS}, z AS (SELECT user_id, m / sqrt(v) AS t0, atan(m / sqrt(v) / sqrt(7)) AS angle FROM u) SELECT user_id, round(t0, 6) AS t, round(0.5 - sum(w * angle / 10 * pow(cos(angle * q.t / 10), 6)) * 16 / (5 * pi()), 6) AS p FROM z, q GROUP BY 1, t0")
def student_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chance of more than t, against the integral over the angle, in which the tails have an end."""
    rows = users(spark, sf_dir).select("user_id", "m", F.sqrt("v").alias("sd"))
    return stats.t_and_p(rows, "m", "sd", 7).select("user_id", F.round("t", 6).alias("t"), F.round("p", 6).alias("p"))


@query("cumulative_frequencies", """
    WITH e AS (SELECT count(*) AS n, min(value) AS lo, max(value) - min(value) AS span, stddev_pop(value) AS s FROM events), b AS (SELECT *, CAST(floor(span / (3.5 * s / pow(n, 0.33))) AS BIGINT) AS k FROM e),
         c AS (SELECT least(CAST(floor((value - lo) / (span / k)) AS BIGINT), k - 1) AS bin, count(*) AS m FROM events, b GROUP BY 1), g AS (SELECT i AS bin, coalesce(m, 0) AS m FROM range(1000) r(i) JOIN b ON i < b.k LEFT JOIN c ON c.bin = i)
    SELECT bin, round(sum(m) OVER (ORDER BY bin) / n, 6) AS cumulated FROM g, b QUALIFY lo + (bin + 0.5) * span / k <= 60
""")
def cumulative_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.cumulative_frequencies(table(spark, sf_dir, "events"), "value", 60.0).select("bin", F.round("cumulated", 6).alias("cumulated"))


# bases and signals


SERIES = "s AS (SELECT user_id, list(value ORDER BY ts, event_id) AS y, count(*) AS n FROM events GROUP BY 1), f AS (SELECT user_id, n, CAST(i - 1 AS DOUBLE) AS t, y[i] AS v FROM s, LATERAL (SELECT unnest(range(1, n + 1)) AS i))"


def whole_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's values in the order of time, as an array."""
    order = F.sort_array(F.collect_list(F.struct("ts", "event_id", "value")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(order, lambda s: s["value"]).alias("y"))


@query("difference_matrix", f"WITH {SERIES} SELECT user_id, CAST(i AS INTEGER) AS i, round(coalesce(y[i], 0) * CASE WHEN i > 0 THEN 1 ELSE 0 END - 2 * y[i + 1] + coalesce(y[i + 2], 0), 6) + 0.0 AS v FROM s, LATERAL (SELECT unnest(range(n)) AS i)")
def difference_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second central differences of each user's values, zeros beyond the ends."""
    out = whole_signals(spark, sf_dir).select("user_id", signal.differenced(F.col("y"), 2).alias("d"))
    return out.select("user_id", F.posexplode("d").alias("i", "v")).withColumn("v", F.round("v", 6) + 0.0)


@query("smoothness_matrix", f"WITH {SERIES}, d AS (SELECT user_id, coalesce(y[i], 0) * CASE WHEN i > 0 THEN 1 ELSE 0 END - 2 * y[i + 1] + coalesce(y[i + 2], 0) AS d FROM s, LATERAL (SELECT unnest(range(n)) AS i)) SELECT user_id, round(sum(d * d) / pow(0.5, 4), 2) AS roughness FROM d GROUP BY 1")
def smoothness_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the smoothness prior takes of each user's values: the quadratic form of its precision matrix."""
    return whole_signals(spark, sf_dir).select("user_id", F.round(signal.roughness(F.col("y"), 0.5), 2).alias("roughness"))


@query("canonical_response", """
    WITH n AS (SELECT user_id, CAST(floor(epoch(ts) / 21600) AS BIGINT) AS scan, count(*) AS n FROM events GROUP BY 1, 2),
         t AS (SELECT i, i * 0.5 AS t FROM range(51) r(i)), g AS (SELECT i, CASE WHEN i IN (0, 50) THEN 0 ELSE exp(5 * ln(t) - t - lgamma(6)) - exp(15 * ln(t) - t - lgamma(16)) / 6 END AS h FROM t),
         k AS (SELECT i, h / sqrt(sum(h * h) OVER ()) AS h FROM g)
    SELECT user_id, scan + i AS scan, round(sum(n * h), 6) + 0.0 AS response FROM n, k GROUP BY 1, 2
""")
def canonical_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events by quarter of a day, convolved with the canonical response."""
    from gridsignal.plans.event_queries import micros

    scans = table(spark, sf_dir, "events").select("user_id", F.floor(micros() / 21600e6).cast("long").alias("scan"), F.lit(1).alias("n"))
    out = signal.convolved(scans, ["user_id"], "scan", "n", signal.canonical_response(25.0, 0.5))
    return out.select("user_id", "scan", (F.round("n", 6) + 0.0).alias("response"))


@query("kernel_weights", """
    WITH d AS (SELECT o_orderpriority AS priority, date_diff('month', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS month, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2),
         k AS (SELECT o, exp(-o * o / 3.0) / sum(exp(-o * o / 3.0)) OVER () AS w FROM range(-3, 4) r(o))
    SELECT priority, CAST(month + o AS BIGINT) AS month, round(sum(total * w), 2) AS total FROM d, k GROUP BY 1, 2 HAVING count(*) = 7
""")
def kernel_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly totals of each priority smoothed by the Gaussian kernel, where all seven months are there."""
    month = (F.year("o_orderdate") - 1992) * 12 + F.month("o_orderdate") - 1
    totals = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority"), month.cast("long").alias("month")).agg(F.sum("o_totalprice").alias("total"))
    return signal.blurred(totals, ["priority"], "month", "total", 3).withColumn("total", F.round("total", 2))


@query("undrifted", f"WITH {SERIES}, k AS (SELECT user_id, CASE WHEN count(*) > 1 THEN regr_slope(v, t) ELSE 0 END AS b, CASE WHEN count(*) > 1 THEN regr_intercept(v, t) ELSE any_value(v) END AS a FROM f GROUP BY 1) SELECT f.user_id, CAST(t AS INTEGER) AS t, round(v - a - b * t, 4) + 0.0 AS v FROM f JOIN k USING (user_id)")
def undrifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = signal.undrifted(whole_signals(spark, sf_dir), "y", lambda n: signal.polynomial_basis(n, 1))
    return out.select("user_id", F.posexplode("y").alias("t", "v")).withColumn("v", F.round("v", 4) + 0.0)


@query("drift_energy", f"WITH {SERIES}, p AS (SELECT user_id, k, sum(v * CASE k WHEN 0 THEN 1 / sqrt(n) ELSE cos(pi() * k * (2 * t + 1) / (2 * n)) * sqrt(2.0 / n) END) AS c FROM f, LATERAL (SELECT unnest(range(greatest(1, CAST(floor(2 * n / 13.0 + 1) AS BIGINT) - 1))) AS k) GROUP BY 1, 2) SELECT user_id, round(sum(c * c), 4) AS energy FROM p GROUP BY 1")
def drift_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy of the slow part: coefficients on a constant and the cosines slower than 13 scans."""
    c = signal.cosine_coefficients(F.col("y"), 13.0, 1.0)
    return whole_signals(spark, sf_dir).select("user_id", F.round(F.aggregate(c, F.lit(0.0), lambda t, x: t + x * x), 4).alias("energy"))


@query("finer_signal", f"WITH {SERIES} SELECT user_id, CAST(i AS INTEGER) AS i, round(y[i // 4 + 1] + (y[i // 4 + 2] - y[i // 4 + 1]) * (i % 4) / 4.0, 6) AS v FROM s, LATERAL (SELECT unnest(range((n - 1) * 4)) AS i)")
def finer_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whole_signals(spark, sf_dir).withColumn("y", signal.resampled_signal(F.col("y"), 4))
    return rows.select("user_id", F.posexplode("y").alias("i", "v")).withColumn("v", F.round("v", 6))


@query("closest_value", f"WITH {SERIES}, o AS (SELECT user_id, n, list_sort(y) AS x FROM s), d AS (SELECT user_id, i, abs(x[i] - 50) AS d FROM o, LATERAL (SELECT unnest(range(1, n + 1)) AS i)) SELECT user_id, CAST(arg_min(i, d * 1000 - i * 1e-9) - 1 AS INTEGER) AS place FROM d GROUP BY 1")
def closest_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole_signals(spark, sf_dir).select("user_id", signal.closest(F.array_sort("y"), F.lit(50.0)).alias("place"))


# trees and names


@query("tree_leaves", "SELECT n_regionkey, CAST(max(CASE WHEN n_nationkey % 5 = 0 THEN n_nationkey END) AS INTEGER) AS leaf, CAST(count(*) + 1 AS INTEGER) AS n, CAST(sum(n_nationkey * 2) + 200 AS BIGINT) AS doubled FROM nation GROUP BY 1")
def tree_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested maps by region: a leaf by its path, a leaf set, all leaves doubled, and the branches as rows."""
    nation = table(spark, sf_dir, "nation")
    inner = nation.groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("t"), F.max(F.when(F.col("n_nationkey") % 5 == 0, F.struct("n_nationkey", "n_name")))["n_name"].alias("name"))
    more = inner.withColumn("t", series.set_leaf(F.col("t"), "new", F.lit(100))).withColumn("leaf", F.try_element_at("t", F.col("name")))
    doubled = series.apply_to_leaves(F.col("t"), lambda v: v * 2)
    rows = series.branches(more.select(F.create_map(F.col("n_regionkey"), doubled).alias("tree")), "tree", ["n_regionkey", "n_name"])
    sums = rows.groupBy("n_regionkey").agg(F.count(F.lit(1)).cast("int").alias("n"), F.sum("leaf").alias("doubled"))
    return more.filter(series.get_leaf(F.col("t"), "new") == 100).select("n_regionkey", "leaf").join(sums, "n_regionkey")


@query("durations_as_text", """
    WITH s AS (SELECT o_orderkey, o_orderkey * 0.125 AS s FROM orders)
    SELECT o_orderkey, CASE WHEN s >= 3600 THEN CAST(floor(s / 3600) AS BIGINT) || 'H' ELSE '' END || CASE WHEN s >= 60 THEN CAST(floor((s % 3600) / 60) AS BIGINT) || 'min' ELSE '' END || printf('%.3fsec', CAST(s % 60 AS DOUBLE)) AS t FROM s
""")
def durations_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", series.format_duration(F.col("o_orderkey") * 0.125).alias("t"))


@query("grid_cliques", "SELECT n_nationkey, CAST((n_nationkey + 1) + 3 + 2 * n_nationkey * 2 - 2 AS BIGINT) AS n FROM nation")
def grid_cliques(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of neighbours in grids of n + 1 by 3 cells."""
    return table(spark, sf_dir, "nation").select("n_nationkey", series.pairs_in_grid(F.col("n_nationkey") + 1, F.lit(3)).cast("long").alias("n"))
