import pytest
from pyspark.sql import functions as F

from gridsignal.functions import series, stats


def test_names_with_and_without_numbers(spark):
    names = ["a_01.nii", "img_12.nii.gz", "d.1/none.txt", "none", ".hidden", "a..b", "x7", "y8.", "5.n1", "z3.tar~"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    with_number = {("a_", "nii", 1), ("img_", "nii.gz", 12), ("y", "", 8), ("z", "tar~", 3)}
    assert {tuple(r) for r in series.file_series(df).collect()} == with_number
    rest = {("d.1/none", "txt", None), ("none", "", None), (".hidden", "", None), ("a.", "b", None), ("x7", "", None), ("5", "n1", None)}
    assert {tuple(r) for r in series.file_series(df, others=True).collect()} == with_number | rest


def test_quantiles_by_ranks_are_those_of_arrays(spark):
    rows = [("a", float((7 * i) % 23)) for i in range(23)] + [("b", 4.0), ("c", 1.0), ("c", 3.0), ("a", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    for p in (0.05, 0.5, 0.95):
        want = {r["k"]: r["q"] for r in df.groupBy("k").agg(stats.plotting_quantile(F.col("v"), p).alias("q")).collect()}
        assert {r["k"]: r["q"] for r in stats.plotting_quantiles(df, ["k"], "v", p, "q").collect()} == pytest.approx(want)


def test_rows_of_repeated_values(spark):
    df = spark.createDataFrame([(0, "x"), (1, "y"), (2, "x"), (3, "x"), (4, None), (5, None)], "i int, v string")
    assert {tuple(r) for r in series.duplicate_rows(df, "i", "v").collect()} == {("x", 0, 3), ("x", 2, 3), ("x", 3, 3)}
