"""Expressions, experiments, trees, split parcels and statistics on small tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridsignal.cuboid import Cuboid
from gridsignal.functions import expressions, series, signal, stats, trees
from gridsignal.operators import graph, splitting
from gridsignal.paradigm import Paradigm


def test_expressions(spark):
    df = spark.createDataFrame([(4.0, 2)], "a double, b int")
    e = expressions.ArithmeticExpression("-a ** 2 + sqrt(a) * (b - half) % 3", a=F.col("a"), b=F.col("b"), half=lambda: 0.5).add_default_functions()
    assert df.select(e.evaluate()).first()[0] == -16 + (2 * 1.5) % 3
    with pytest.raises(expressions.ExpressionNameError) as error:
        expressions.ArithmeticExpression("x + y * sin(a)", a=1).check()
    assert error.value.names == ["x", "y", "sin"]
    for wrong in ("a +", "a.b", "[a]", "a < 2", "'a'"):
        with pytest.raises(expressions.ExpressionSyntaxError):
            expressions.ArithmeticExpression(wrong, a=1).check()


def test_paradigm_of_two_sessions(spark):
    onsets = {"c1": [1.2, 5.6, 7.4], "c2": [2.3, 3.6, 6.4, 9.8]}
    own = Paradigm.from_session_dict(spark, {"s1": {"onsets": onsets}, "s2": {"onsets": onsets}})
    joined = own.join_sessions().events.filter("condition = 'c1'").orderBy("onset").collect()
    assert [round(r["onset"], 6) for r in joined] == [1.2, 5.6, 7.4, 11.0, 15.4, 17.2] and {r["session"] for r in joined} == {0}
    assert own.get_t_max().first()[0] == 9.8 and {r[0] for r in own.get_stimulus_names().collect()} == {"c1", "c2"}
    assert [r["position"] for r in own.get_joined_durations().filter("condition = 'c2'").orderBy("position").collect()] == list(range(8))
    assert own.get_joined_and_rastered(0.5, 10.0).groupBy("condition").agg(F.sum("active")).orderBy("condition").collect()[0][1] == 6
    info = {r["condition"]: r for r in own.get_info().collect()}
    assert info["c1"]["n_sessions"] == 2 and info["c1"]["kind"] == "event" and info["c1"]["mean_isi"] == pytest.approx(3.1)


def test_trees(spark):
    leaves = spark.createDataFrame([("a", 1, "x", 10), ("a", 2, "x", 20), ("b", 1, "y", 30)], "k string, l int, m string, v int")
    assert trees.swap_layers(leaves, ["k", "l", "m"], "k", "m").columns == ["m", "l", "k", "v"]
    nested = {r["k"]: r["tree"] for r in trees.tree(leaves, ["k", "l", "m"], "v").collect()}
    assert nested == {"a": {1: {"x": 10}, 2: {"x": 20}}, "b": {1: {"y": 30}}}
    stacked = trees.stack_trees([leaves, leaves.withColumn("v", F.col("v") + 1)], ["k", "l", "m"], "v")
    assert {tuple(r["v"]) for r in stacked.collect()} == {(10, 11), (20, 21), (30, 31)}
    assert trees.unstack_trees(stacked, ["k", "l", "m"], "v").filter("tree = 1").agg(F.sum("v")).first()[0] == 63


def test_parcels_are_cut_evenly(spark):
    block = [(x, y, z) for x in range(3) for y in range(3) for z in range(3)]
    cells = spark.createDataFrame([(*c, 5) for c in block] + [(9, 9, 9, 7)], "x int, y int, z int, parcel int")
    out = splitting.split_big_parcels(cells, ["x", "y", "z"], 9)
    sizes = {r["parcel"]: r["count"] for r in out.groupBy("parcel").count().collect()}
    assert sorted(sizes.values()) == [1, 9, 9, 9] and sizes[7] == 1 and sizes[5] == 9
    balanced = splitting.balanced_parcels(cells.select("x", "y", "z"), ["x", "y", "z"], 3)
    assert sorted(r["count"] for r in balanced.groupBy("parcel").count().collect()) == [1, 9, 9, 9]
    assert splitting.split_big_parcels(cells.limit(0), ["x", "y", "z"], 9).isEmpty()


def test_statistics(spark):
    df = spark.range(1).select(*[stats.phi(F.lit(x)).alias(f"p{i}") for i, x in enumerate((-8.0, -1.5, 0.0, 2.0))], *[stats.student_tail(F.lit(1.5), n).alias(f"s{n}") for n in (1, 2, 3, 4, 9, 30)])
    row = df.first()
    assert [row[f"p{i}"] for i in range(4)] == pytest.approx([0.5 * math.erfc(-x / math.sqrt(2)) for x in (-8.0, -1.5, 0.0, 2.0)], rel=1e-12)
    assert [row[f"s{n}"] for n in (1, 2, 3, 4, 9, 30)] == pytest.approx([0.187167, 0.136197, 0.115292, 0.104, 0.083925, 0.072033], abs=1e-5)
    draws = spark.range(20_000).select(stats.truncated_normal(-1.0, 2.0, 3).alias("t"), stats.gamma(6.0, 12.0, 5).alias("g"), stats.beta(2, 3, 7).alias("b"))
    got = draws.agg(F.min("t"), F.max("t"), F.avg("g"), F.var_pop("g"), F.avg("b")).first()
    assert got[0] >= -1 and got[1] <= 2 and got[2] == pytest.approx(6, abs=0.15) and got[3] == pytest.approx(12, abs=1) and got[4] == pytest.approx(0.4, abs=0.01)


def test_arrays_and_places(spark):
    row = spark.createDataFrame([([0.0, 4.0, 2.0],)], "y array<double>").select(signal.resampled_signal(F.col("y"), 2).alias("r"), signal.closest(F.array(*map(F.lit, (1, 3, 5))), F.lit(4)).alias("c")).first()
    assert row["r"] == [0.0, 2.0, 4.0, 3.0] and row["c"] == 2
    names = spark.createDataFrame([("a_01.nii",), ("a_2.nii",), ("b.x.7.gz",), ("nodigits.nii",), ("5.n1",), ("none",), ("line\n8.e~",)], "name string")
    got = {(r["prefix"], r["ext"], r["number"]) for r in series.file_series(names).collect()}
    assert got == {("a_", "nii", 1), ("a_", "nii", 2), ("b.x.", "gz", 7), ("line\n", "e~", 8)}
    cube = Cuboid(spark.createDataFrame([("a", 1, 2.0), ("b", 2, 3.0)], "r string, c int, v double"), ["r", "c"], "v")
    assert cube.to_html_table("r", "c").count("<td>") == 4 and "a & 2.0 & " in cube.to_latex("r", "c")
    with pytest.raises(ValueError):
        cube.to_html_table("r", "c", limit=1)


def test_graph_pieces(spark):
    r = random.Random(3)
    edges = [(r.randrange(40), r.randrange(40)) for _ in range(25)]
    table = spark.createDataFrame(edges, "src long, dst long")
    nodes = spark.range(40).select(F.col("id").alias("node"))
    sizes = graph.connected_components(table, nodes).groupBy("component").count()
    most = sizes.agg(F.max("count")).first()[0]
    assert graph.largest_component(table, nodes).count() == most
    pooled = graph.pooled(table).collect()
    ends = sorted({n for e in edges for n in e})
    assert sorted((x["src"], x["dst"]) for x in pooled) == sorted((ends.index(a), ends.index(b)) for a, b in edges)
