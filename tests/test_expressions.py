import math

import pytest

from gridsignal.functions.expressions import ArithmeticExpression
from pyspark.sql import functions as F


def test_remainders_and_parts_are_those_of_the_language(spark):
    values = [(-5.0, 3.0), (5.0, -3.0), (-7.0, 4.0), (7.5, 2.0), (-6.0, 3.0), (0.0, 5.0), (1e-310, 2.0), (1.7e308, -0.3), (-0.75, 0.5), (8.0, 1.0), (2.0**60 + 512, 7.0)]
    df = spark.createDataFrame(values, "a double, b double")
    made = lambda text: ArithmeticExpression(text, a=F.col("a"), b=F.col("b")).add_default_functions().evaluate()
    got = df.select(made("a % b").alias("r"), made("fmod(a, b)").alias("f"), made("fabs(a)").alias("s"), made("frexp(a)").alias("p"), made("modf(a)").alias("m"), made("ldexp(a, 3)").alias("l"), made("-a % 4").alias("n"), "a", "b").collect()
    assert len(got) == len(values)
    for row in got:
        a, b = row["a"], row["b"]
        assert row["r"] == a % b and row["f"] == math.fmod(a, b) and row["s"] == math.fabs(a) and row["n"] == -a % 4
        assert tuple(row["p"]) == math.frexp(a) and tuple(row["m"]) == math.modf(a)
        assert row["l"] == (math.ldexp(a, 3) if abs(a) < 1e300 else math.inf)


@pytest.mark.parametrize("text", ["-7 % 4", "7 % -4", "-5 % 3 + 1", "2 ** 3 % 5"])
def test_constant_remainders(spark, text):
    assert spark.range(1).select(ArithmeticExpression(text).evaluate().alias("x")).first()[0] == eval(text)


def test_whole_numbers_and_zero_divisors(spark):
    row = spark.createDataFrame([(-5, 3, 0)], "a int, b int, z int").select(*[ArithmeticExpression(t, a=F.col("a"), b=F.col("b"), z=F.col("z")).evaluate().alias(n) for n, t in (("x", "a % b"), ("y", "a % -b"), ("w", "a % z"))]).first()
    assert tuple(row) == (1, -2, None)
