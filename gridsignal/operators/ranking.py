"""Row numbers over a whole table without ordering it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridsignal.session import ensure_checkpoint_dir


def global_row_number(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """Add ``name``: the row's place in the order of ``order``, from ``start``.

    Rows are dealt out by ranges of the order and written once, as the ranges come from a sample; each range is numbered
    in its own task, and the ranges' counts (one row each) give the offsets.
    """
    ensure_checkpoint_dir(df.sparkSession)
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).checkpoint()
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_range").orderBy(*order)
    # one row a range: bounded by the number of shuffle partitions
    out = ranged.withColumn("_at", F.row_number().over(within) - 1).join(F.broadcast(offsets), "_range")
    return out.withColumn(name, (F.col("_offset") + F.col("_at") + start).cast("long")).drop("_range", "_at", "_offset")


def number_within(df: DataFrame, by: list[str], order: list[str], name: str, start: int = 0) -> DataFrame:
    """Add ``name``: the row's place in its group. Rows are numbered over the whole table, groups' first numbers (one row a
    group) are taken off, so a group that holds a third of all rows is several tasks' work. Groups may be null."""
    ranked = global_row_number(df, [*by, *order], "_whole")
    first = ranked.groupBy(*by).agg(F.min("_whole").alias("_first")).select(*[F.col(b).alias(f"_by_{b}") for b in by], "_first")
    same = [F.col(b).eqNullSafe(F.col(f"_by_{b}")) for b in by]
    return ranked.join(first, same).select(*df.columns, (F.col("_whole") - F.col("_first") + start).alias(name))
