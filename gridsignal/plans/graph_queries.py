"""Graph, parcellation, score and series queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsignal.functions import series, stats
from gridsignal.operators import graph, parcellation
from gridsignal.plans.register import query
from gridsignal.session import table

GRID = """
    g AS (SELECT p_size AS x, dense_rank() OVER (ORDER BY p_brand) - 1 AS y, v FROM (SELECT p_size, p_brand, count(*) AS v FROM part GROUP BY 1, 2)),
    c AS (SELECT x * 1000 + y AS node, x, y, v FROM g),
    ed AS (SELECT a.node AS src, b.node AS dst FROM c a JOIN c b ON abs(a.x - b.x) + abs(a.y - b.y) = 1)
"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    part = table(spark, sf_dir, "part")
    brands = part.select("p_brand").distinct().withColumn("y", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("p_brand")) - 1)
    cells = part.groupBy("p_size", "p_brand").agg(F.count(F.lit(1)).alias("v")).join(brands, "p_brand").withColumnRenamed("p_size", "x")
    return cells.select((F.col("x").cast("long") * 1000 + F.col("y")).alias("node"), "x", "y", "v")


@query("lattice_edges", f"WITH {GRID} SELECT src, dst FROM ed")
def lattice_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.lattice_edges(grid(spark, sf_dir), ["x", "y"])


@query("graph_sane", "SELECT true AS sane")
def graph_sane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(graph.is_sane(graph.lattice_edges(grid(spark, sf_dir), ["x", "y"])),)], "sane boolean")


@query("neighbour_sum", f"WITH {GRID} SELECT c.node, CAST(coalesce(sum(b.v), 0) AS BIGINT) AS neighbour_sum FROM c LEFT JOIN ed ON c.node = ed.src LEFT JOIN c b ON b.node = ed.dst GROUP BY 1")
def neighbour_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid(spark, sf_dir)
    return graph.neighbour_sum(graph.lattice_edges(cells, ["x", "y"]), cells, value="v")


@query("homo_cliques", f"WITH {GRID} SELECT CAST(sum(CAST(a.v % 2 = b.v % 2 AS INTEGER)) AS DOUBLE) / 2 AS cliques FROM ed JOIN c a ON a.node = src JOIN c b ON b.node = dst")
def homo_cliques(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid(spark, sf_dir)
    return graph.homo_cliques(graph.lattice_edges(cells, ["x", "y"]), cells.withColumn("label", F.col("v") % 2))


@query(
    "connected_components",
    f"""
    WITH RECURSIVE {GRID}, k AS (SELECT * FROM c WHERE v >= 2), e2 AS (SELECT a.node AS src, b.node AS dst FROM k a JOIN k b ON abs(a.x - b.x) + abs(a.y - b.y) = 1),
         r AS (SELECT node, node AS root FROM k UNION SELECT e2.dst, r.root FROM r JOIN e2 ON e2.src = r.node)
    SELECT node, min(root) AS component FROM r GROUP BY 1
    """,
)
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid(spark, sf_dir).filter("v >= 2")
    return graph.connected_components(graph.lattice_edges(cells, ["x", "y"]), cells)


@query(
    "breadth_first",
    f"""
    WITH RECURSIVE {GRID}, r AS (SELECT min(node) AS node, 0 AS depth FROM c UNION SELECT ed.dst, r.depth + 1 FROM r JOIN ed ON ed.src = r.node WHERE r.depth < 6)
    SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY 1
    """,
)
def breadth_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid(spark, sf_dir)
    return graph.breadth_first(graph.lattice_edges(cells, ["x", "y"]), cells.agg(F.min("node").alias("node")), 6)


@query(
    "parcellation_report",
    """
    WITH s AS (SELECT c_nationkey AS parcel, count(*) AS size FROM customer GROUP BY 1), i AS (SELECT * FROM s WHERE parcel <> 0)
    SELECT count(*) AS n_parcels, min(size) AS min_size, max(size) AS max_size, arg_min(parcel, size * 1000 + parcel) AS smallest, count(*) FILTER (size < 10) AS below_10,
           count(*) FILTER (size > 400) AS above_400, count(*) FILTER (size > 1000) AS above_1000, arg_max(parcel, size * 1000 - parcel) AS biggest,
           (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM s WHERE parcel = 0) AS background FROM i
    """,
)
def parcellation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parcellation.parcellation_report(table(spark, sf_dir, "customer"), "c_nationkey")


@query("discard_small_parcels", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) >= 60)")
def discard_small_parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parcellation.discard_small(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), 60, "c_nationkey")


@query("keep_parcels", "SELECT s_suppkey, CASE s_nationkey WHEN 7 THEN 1 WHEN 3 THEN 2 ELSE 3 END AS s_nationkey FROM supplier WHERE s_nationkey IN (7, 3, 11)")
def keep_parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parcellation.keep_parcels(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), [7, 3, 11], "s_nationkey", renumber=True)


@query("intersection_matrix", "SELECT p_brand AS i, p_type AS j, count(*) AS n FROM part GROUP BY 1, 2")
def intersection_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    a, b = rows.select("p_partkey", F.col("p_brand").alias("parcel")), rows.select("p_partkey", F.col("p_type").alias("parcel"))
    return parcellation.intersection_matrix(a, b, ["p_partkey"])


@query(
    "voronoi_labels",
    """
    WITH s AS (SELECT vec_id AS seed, embedding AS e FROM embeddings WHERE vec_id < 10),
         d AS (SELECT v.vec_id, s.seed, list_sum(list_transform(range(1, 65), lambda i: (CAST(v.embedding[i] AS DOUBLE) - CAST(s.e[i] AS DOUBLE)) ** 2)) AS d FROM embeddings v CROSS JOIN s)
    SELECT vec_id, arg_min(seed, d) AS seed FROM d GROUP BY 1
    """,
)
def voronoi_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return parcellation.nearest_vector(rows, "embedding", rows.filter("vec_id < 10"), "vec_id").select("vec_id", "seed")


SCORES = "s AS (SELECT n_chars, quality FROM documents JOIN labels USING (doc_id)), c AS (SELECT n_chars, sum(CAST(quality = 1 AS INTEGER)) AS p, sum(CAST(quality <> 1 AS INTEGER)) AS n FROM s GROUP BY 1), r AS (SELECT n_chars, p, n, sum(p) OVER (ORDER BY n_chars DESC) AS tp, sum(n) OVER (ORDER BY n_chars DESC) AS fp FROM c)"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").select("n_chars", "quality")


@query("roc_curve", f"WITH {SCORES} SELECT n_chars, round(fp / (SELECT sum(n) FROM c), 6) AS fpr, round(tp / (SELECT sum(p) FROM c), 6) AS tpr FROM r")
def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.roc_curve(scores(spark, sf_dir), "n_chars", "quality").select("n_chars", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query("auc", f"WITH {SCORES} SELECT round(sum(n * (tp - p / 2.0)) / (sum(n) * sum(p)), 6) AS auc FROM r")
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.auc(scores(spark, sf_dir), "n_chars", "quality").select(F.round("auc", 6).alias("auc"))


@query("mark_labels", "SELECT doc_id, CASE WHEN quality = toxic THEN quality WHEN quality = 1 THEN 2 ELSE 3 END AS mark FROM labels")
def mark_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", stats.mark_wrong_labels(F.col("quality"), F.col("toxic")).alias("mark"))


NAMES = "f AS (SELECT o_orderpriority AS prefix, o_orderkey AS number FROM orders)"


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "orders").select(F.concat("o_orderpriority", F.lit("_"), F.col("o_orderkey").cast("string"), F.lit(".nii")).alias("name"))
    return series.file_series(names).withColumn("prefix", F.rtrim("prefix", F.lit("_")))


@query("file_series", f"WITH {NAMES} SELECT prefix, 'nii' AS ext, number FROM f")
def file_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbers(spark, sf_dir)


@query("file_series_all", """
    SELECT CASE p_size % 3 WHEN 0 THEN p_type WHEN 1 THEN regexp_replace(p_brand, '[0-9]+$', '') ELSE p_brand || '_' END AS prefix, CASE p_size % 3 WHEN 2 THEN 'nii.gz' ELSE 'txt' END AS ext,
           CASE p_size % 3 WHEN 1 THEN CAST(regexp_extract(p_brand, '[0-9]+$') AS BIGINT) WHEN 2 THEN p_partkey END AS number, count(*) AS n FROM part GROUP BY 1, 2, 3
""")
def file_series_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed volumes, texts of brands, whose names end in a number, and of types, which belong to no series."""
    kind = F.col("p_size") % 3
    name = F.when(kind == 0, F.concat("p_type", F.lit(".txt"))).when(kind == 1, F.concat("p_brand", F.lit(".txt"))).otherwise(F.concat_ws("_", "p_brand", F.concat(F.col("p_partkey").cast("string"), F.lit(".nii.gz"))))
    return series.file_series(table(spark, sf_dir, "part").select(name.alias("name")), others=True).groupBy("prefix", "ext", "number").agg(F.count(F.lit(1)).alias("n"))


@query("condense_series", f"WITH {NAMES}, i AS (SELECT DISTINCT prefix, number FROM f), k AS (SELECT *, number - row_number() OVER (PARTITION BY prefix ORDER BY number) AS g FROM i) SELECT prefix, min(number) AS first, max(number) AS last, count(*) AS n FROM k GROUP BY prefix, g")
def condense_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.condensed(numbers(spark, sf_dir), ["prefix"])


@query("missing_in_series", f"WITH {NAMES} SELECT prefix, max(number) - min(number) + 1 - count(DISTINCT number) AS n_missing FROM f GROUP BY 1")
def missing_in_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.missing(numbers(spark, sf_dir), ["prefix"])


@query("find_duplicates", "SELECT p_size AS v, array_to_string(list(p_partkey ORDER BY p_partkey), ',') AS positions FROM part GROUP BY 1 HAVING count(*) > 1")
def find_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.duplicates(table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("v")), "p_partkey", "v")
    return out.select("v", F.array_join("positions", ",").alias("positions"))


@query("cartesian_args", "SELECT r_name, c_mktsegment, CAST(k AS INTEGER) AS k FROM region CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) CROSS JOIN range(3) t(k)")
def cartesian_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.cartesian(table(spark, sf_dir, "region").select("r_name"), table(spark, sf_dir, "customer").select("c_mktsegment").distinct(), spark.range(3).select(F.col("id").cast("int").alias("k")))


@query("name_functions", "SELECT page_id, 'pre_page' || page_id || '_s.nii.gz' AS both, 'page' || page_id || '.csv' AS other, true AS gz FROM pages")
def name_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("page"), F.col("page_id").cast("string"), F.lit(".nii.gz"))
    return table(spark, sf_dir, "pages").select("page_id", series.add_prefix(series.add_suffix(name, "_s"), "pre_").alias("both"), series.replace_ext(name, "csv").alias("other"), series.has_ext(name, "nii").alias("gz"))
