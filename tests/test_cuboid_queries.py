"""Arithmetic queries on small tables made for them."""

import math

import pytest
from pyspark.sql import functions as F

from gridsignal.functions.stats import exact_sum
from gridsignal.plans import registry


@pytest.fixture
def folder(spark, tmp_path):
    def put(orders, customers):
        spark.createDataFrame(orders, "o_custkey long, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
        spark.createDataFrame(customers, "c_custkey long, c_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
        return str(tmp_path)

    return put


def answers(spark, name, at):
    return {r["o_custkey"]: r["v"] for r in registry.QUERIES[name](spark, at).collect()}


def test_floor_divide_at_whole_quotients(spark, folder):
    at = folder([(1, 0.7), (1, 0.1), (2, 0.1), (2, 0.7), (3, 5.0), (4, None)], [(1, 0.1), (2, 0.1), (3, 0.0), (4, 2.0)])
    assert answers(spark, "cuboid_floor_divide", at) == {1: 8.0, 2: 8.0, 3: None, 4: None}


def test_powers_of_customers_with_orders_alone(spark, folder):
    at = folder([(1, 3.0), (1, 4.0), (2, None), (5, 1.0)], [(1, 200.0), (2, -100.0), (3, 300.0)])
    assert answers(spark, "cuboid_pow", at) == {1: 8.0, 2: -1.0}


def test_exact_sums_of_decimals_and_plain_sums_of_others(spark):
    rows = [("money", x) for x in (0.7, 0.1, None, -1e17, 1e17, 0.1, 0.1)] + [("third", x) for x in (1 / 3, 0.25)] + [("big", x) for x in (1e300, 1.5)]
    rows += [("nan", x) for x in (float("nan"), 1.5)] + [("endless", x) for x in (float("inf"), 1.5)] + [("none", None)]
    got = {r["k"]: r["s"] for r in spark.createDataFrame(rows, "k string, x double").repartition(3).groupBy("k").agg(exact_sum(F.col("x")).alias("s")).collect()}
    assert math.isnan(got.pop("nan"))
    assert got == {"money": 1.0, "third": 1 / 3 + 0.25, "big": 1e300, "endless": math.inf, "none": None}
