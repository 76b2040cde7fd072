"""Labelled-array queries on the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsignal.cuboid import Cuboid, merge, stack_cuboids
from gridsignal.plans.register import query
from gridsignal.session import table

CELLS = "SELECT l_returnflag, l_linestatus, l_suppkey, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3"
AXES = ["l_returnflag", "l_linestatus", "l_suppkey"]


def quantities(spark: SparkSession, sf_dir: str) -> Cuboid:
    return Cuboid.from_table(table(spark, sf_dir, "lineitem"), AXES, "l_quantity", F.sum, "v")


def _reduction(name: str, sql: str) -> None:
    @query(f"axis_{name}", f"SELECT l_returnflag, l_linestatus, round({sql}, 4) AS {name}_v FROM ({CELLS}) GROUP BY 1, 2")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = getattr(quantities(spark, sf_dir), name)("l_suppkey").df
        return out.select("l_returnflag", "l_linestatus", F.round("v", 4).alias(f"{name}_v"))


for _name, _sql in {"mean": "avg(v)", "std": "stddev_pop(v)", "var": "var_pop(v)", "min": "min(v)", "max": "max(v)", "ptp": "max(v) - min(v)", "sum": "sum(v)"}.items():
    _reduction(_name, _sql)


@query("sub_cuboid", "SELECT p_type, p_size, round(avg(p_retailprice), 4) AS price FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) GROUP BY 1, 2")
def sub_cuboid(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    brand = part.agg(F.min("p_brand")).first()[0]
    cube = Cuboid.from_table(part.filter(F.col("p_brand") == brand), ["p_brand", "p_type", "p_size"], "p_retailprice", F.avg, "price")
    return cube.sub_cuboid(p_brand=brand).df.withColumn("price", F.round("price", 4))


@query(
    "sub_cuboid_positions",
    """
    WITH c AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2),
         s AS (SELECT p_size, dense_rank() OVER (ORDER BY p_size) - 1 AS k FROM (SELECT DISTINCT p_size FROM c))
    SELECT p_brand, p_size, n FROM c JOIN s USING (p_size) WHERE k >= 10 AND k < 30 AND (k - 10) % 5 = 0
    """,
)
def sub_cuboid_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = Cuboid.from_table(table(spark, sf_dir, "part"), ["p_brand", "p_size"], F.lit(1), F.count, "n")
    return cube.sub_cuboid_from_slices(p_size=slice(10, 30, 5)).df


@query(
    "rescale_values",
    """
    WITH e AS (SELECT p_brand, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY 1)
    SELECT p_partkey, p_brand, round(coalesce((p_retailprice - lo) / nullif(hi - lo, 0), 0), 6) AS scaled FROM part JOIN e USING (p_brand)
    """,
)
def rescale_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = Cuboid(table(spark, sf_dir, "part"), ["p_brand", "p_partkey"], "p_retailprice")
    out = cube.rescale_values(axis="p_partkey").df
    return out.select("p_partkey", "p_brand", F.round("p_retailprice", 6).alias("scaled"))


def _by_customer(spark: SparkSession, sf_dir: str, total: Callable[[Column], Column] = F.sum) -> tuple[Cuboid, Cuboid]:
    spent = Cuboid.from_table(table(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice", total, "v")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("v"))
    return spent, Cuboid(customers, ["o_custkey"], "v")


SPENT = "WITH s AS (SELECT o_custkey, sum(o_totalprice) AS v FROM orders GROUP BY 1)"


@query("cuboid_add", f"{SPENT} SELECT o_custkey, round(v + c_acctbal, 2) AS v FROM s JOIN customer ON o_custkey = c_custkey")
def cuboid_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    spent, balance = _by_customer(spark, sf_dir)
    return (spent + balance).df.withColumn("v", F.round("v", 2))


@query("cuboid_divide", f"{SPENT} SELECT o_custkey, round(v / nullif(c_acctbal, 0), 4) AS v FROM s JOIN customer ON o_custkey = c_custkey")
def cuboid_divide(spark: SparkSession, sf_dir: str) -> DataFrame:
    spent, balance = _by_customer(spark, sf_dir)
    return (spent / balance).df.withColumn("v", F.round("v", 4))


@query(
    "expand_grid",
    """
    WITH c AS (SELECT c_nationkey, c_mktsegment, sum(c_acctbal) AS v FROM customer GROUP BY 1, 2)
    SELECT n.c_nationkey, m.c_mktsegment, round(coalesce(v, 0), 2) AS v
    FROM (SELECT DISTINCT c_nationkey FROM c) n CROSS JOIN (SELECT DISTINCT c_mktsegment FROM c) m LEFT JOIN c ON c.c_nationkey = n.c_nationkey AND c.c_mktsegment = m.c_mktsegment
    """,
)
def expand_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = Cuboid.from_table(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], "c_acctbal", F.sum, "v")
    return cube.fill_grid().df.withColumn("v", F.round("v", 2))


@query(
    "flatten_mask",
    """
    SELECT c_acctbal AS v, row_number() OVER (ORDER BY c_nationkey, c_custkey) - 1 AS position FROM customer WHERE c_acctbal > 0
    """,
)
def flatten_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.col("c_acctbal").alias("v"))
    mask = Cuboid(rows.withColumn("m", (F.col("v") > 0).cast("int")), ["c_nationkey", "c_custkey"], "m")
    return Cuboid(rows, ["c_nationkey", "c_custkey"], "v").flatten(mask).df


@query(
    "expand_mask",
    """
    WITH m AS (SELECT c_nationkey, c_custkey, c_acctbal > 0 AS inside FROM customer),
         p AS (SELECT c_nationkey, c_custkey, row_number() OVER (ORDER BY c_nationkey, c_custkey) - 1 AS position FROM m WHERE inside)
    SELECT m.c_nationkey, m.c_custkey, CAST(coalesce(position * 2, 0) AS DOUBLE) AS v FROM m LEFT JOIN p USING (c_custkey)
    """,
)
def expand_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", (F.col("c_acctbal") > 0).cast("int").alias("m"))
    mask = Cuboid(rows, ["c_nationkey", "c_custkey"], "m")
    n = rows.filter("m = 1").count()
    flat = Cuboid(spark.range(n).select(F.col("id").alias("position"), (F.col("id") * 2).cast("double").alias("v")), ["position"], "v")
    return flat.expand(mask, "position").df


@query(
    "map_onto",
    """
    WITH d AS (SELECT r_regionkey AS n_regionkey, CAST(length(r_name) AS DOUBLE) AS v FROM region WHERE r_regionkey > 0)
    SELECT n_nationkey, coalesce(v, 0) AS v FROM nation LEFT JOIN d USING (n_regionkey)
    """,
)
def map_onto(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region").filter("r_regionkey > 0").select(F.col("r_regionkey").alias("n_regionkey"), F.length("r_name").cast("double").alias("v"))
    mapping = Cuboid(table(spark, sf_dir, "nation"), ["n_nationkey"], "n_regionkey")
    return Cuboid(region, ["n_regionkey"], "v").map_onto(mapping).df


@query("explode_mask", "SELECT s_nationkey AS parcel, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS position, s_acctbal FROM supplier")
def explode_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier")
    return Cuboid(rows, ["s_suppkey"], "s_acctbal").explode(Cuboid(rows, ["s_suppkey"], "s_nationkey"))


@query("merge_parcels", "SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN s_acctbal ELSE 0 END AS s_acctbal FROM supplier")
def merge_parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier")
    mask = Cuboid(rows, ["s_suppkey"], "s_nationkey")
    parcels = Cuboid(rows, ["s_suppkey"], "s_acctbal").explode(mask).filter("parcel % 2 = 0")
    return merge(parcels, mask, "s_acctbal").df.select("s_suppkey", "s_acctbal")


@query(
    "stack_cuboids",
    """
    SELECT 'lo' AS which, o_orderpriority, min(o_totalprice) AS v FROM orders GROUP BY 2 UNION ALL SELECT 'hi', o_orderpriority, max(o_totalprice) FROM orders GROUP BY 2
    """,
)
def stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = Cuboid(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderkey"], "o_totalprice")
    parts = [cube.min("o_orderkey"), cube.max("o_orderkey")]
    return stack_cuboids(parts, "which", ["lo", "hi"]).df.withColumnRenamed("o_totalprice", "v")


@query("unstack", "SELECT n_regionkey, CAST(to_json(list({'n_nationkey': n_nationkey, 'n_name': n_name} ORDER BY n_nationkey)) AS VARCHAR) AS cells FROM nation GROUP BY 1")
def unstack(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = Cuboid(table(spark, sf_dir, "nation"), ["n_regionkey", "n_nationkey"], "n_name")
    return cube.unstack(["n_nationkey"]).select("n_regionkey", F.to_json("cells").alias("cells"))


@query("tree_round_trip", "SELECT n_regionkey, n_nationkey, n_name FROM nation")
def tree_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridsignal.cuboid import tree_to_cuboid

    cube = Cuboid(table(spark, sf_dir, "nation"), ["n_regionkey", "n_nationkey"], "n_name")
    return tree_to_cuboid(cube.to_tree(["n_regionkey"], "n_nationkey"), ["n_regionkey"], "n_nationkey", "n_name").df


@query("repeat_axis", "SELECT r_regionkey, r_name, CAST(k AS INTEGER) AS copy FROM region CROSS JOIN range(3) t(k)")
def repeat_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Cuboid(table(spark, sf_dir, "region"), ["r_regionkey"], "r_name").repeat(3, "copy").df


@query("fill_axes", "SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS v FROM orders")
def fill_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = Cuboid(table(spark, sf_dir, "orders").withColumnRenamed("o_totalprice", "v"), ["o_custkey", "o_orderkey"], "v")
    return cube.fill(cube.sum("o_orderkey")).df.withColumn("v", F.round("v", 2))


@query("arithmetic_expression", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax) + sqrt(l_quantity), 3) AS v FROM lineitem")
def arithmetic_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.expr("l_extendedprice * (1 - l_discount) * (1 + l_tax) + sqrt(l_quantity)"), 3).alias("v"))


@query(
    "axis_mean_expand",
    """
    WITH cells AS (SELECT l_returnflag, l_linestatus, avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem GROUP BY 1, 2),
         grid AS (SELECT a.l_returnflag, b.l_linestatus FROM (SELECT DISTINCT l_returnflag FROM lineitem) a, (SELECT DISTINCT l_linestatus FROM lineitem) b)
    SELECT g.l_returnflag, g.l_linestatus, round(coalesce(m, 0), 4) AS mean_qty, round(coalesce(s, 0), 4) AS std_qty
    FROM grid g LEFT JOIN cells c ON g.l_returnflag = c.l_returnflag AND g.l_linestatus = c.l_linestatus
    """,
)
def axis_mean_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    cells = df.groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_quantity").alias("m"), F.stddev_pop("l_quantity").alias("s"))
    grid = df.select("l_returnflag").distinct().crossJoin(df.select("l_linestatus").distinct())
    out = grid.join(cells, ["l_returnflag", "l_linestatus"], "left")
    return out.select("l_returnflag", "l_linestatus", F.round(F.coalesce("m", F.lit(0.0)), 4).alias("mean_qty"), F.round(F.coalesce("s", F.lit(0.0)), 4).alias("std_qty"))
