"""Running sums over a whole table without ordering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsignal.session import ensure_checkpoint_dir


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Add, for each column -> name of ``sums``, the sum over this row and all before it in the order.

    Ranges of the order are summed in their own tasks; the ranges' totals, one row each, give the offsets.
    """
    ensure_checkpoint_dir(df.sparkSession)
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).checkpoint()
    totals = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums])
    upto = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.select("*", *[F.sum(c).over(upto).alias(n) for c, n in sums.items()])
    # one row a range: bounded by the number of shuffle partitions
    out = out.join(F.broadcast(offsets), "_range")
    for c, n in sums.items():
        out = out.withColumn(n, F.col(n) + F.col(f"_o_{c}"))
    return out.drop("_range", *[f"_o_{c}" for c in sums])
