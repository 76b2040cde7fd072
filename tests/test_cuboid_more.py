import os

import pytest
from pyspark.sql import functions as F

from gridsignal.cuboid import Cuboid, merge
from gridsignal.operators.ranking import number_within


@pytest.fixture(scope="module")
def cube(spark):
    rows = [(a, b, c, d, 10.0 * a + b + (0.5 if c == "u" else 0) + 100 * d) for a in (1, 2) for b in (3, 5, 9) for c in "uv" for d in (0, 1)]
    return Cuboid(spark.createDataFrame(rows, "a int, b int, c string, d int, v double"), ["a", "b", "c", "d"], "v")


def test_tables_of_several_axes(cube):
    html = cube.to_html_table(["a", "b"], ["c", "d"])
    assert html.count("<td>") == 24 and html.count("<tr>") == 8
    assert "<th>1</th><th>3</th><td>13.5</td><td>113.5</td><td>13.0</td><td>113.0</td>" in html
    latex = cube.to_latex(["a"], ["b"], inner=["c", "d"])
    assert "1 & 13.5 | 113.5 | 13.0 | 113.0 & 15.5" in latex and latex.startswith("\\begin{tabular}{lrrr}\n & 3 & 5 & 9 \\\\")
    with pytest.raises(ValueError):
        cube.to_html_table(["a"], ["b"])
    with pytest.raises(ValueError):
        cube.to_html_table(["a", "b"], ["c", "d"], limit=3)


def test_arrays_to_files_and_back(spark, cube, tmp_path):
    cube.save(str(tmp_path), "cube", by=["c", "d"], voxel=(2.0, 2.0, 1.0))
    assert sorted(os.listdir(tmp_path)) == [f"cube_c_{c}_d_{d}.nii" for c in "uv" for d in (0, 1)]
    back = Cuboid.load(spark, str(tmp_path / "cube_c_u_d_1.nii"))
    got = {(r["x"], r["y"]): r["intensity"] for r in back.df.collect()}
    assert back.axes == ["x", "y", "z"] and got == {(i, j): 10.0 * a + b + 100.5 for i, a in enumerate((1, 2)) for j, b in enumerate((3, 5, 9))}
    assert cube.extra_info() == {"axes": [{"name": "a", "type": "int", "size": 2}, {"name": "b", "type": "int", "size": 3}, {"name": "c", "type": "string", "size": 2}, {"name": "d", "type": "int", "size": 2}], "value": "v", "type": "double"}


def test_rows_are_numbered_within_groups(spark):
    rows = [("a", i) for i in range(20)] + [("b", 3), ("b", 1), (None, 7), (None, 8)]
    got = {(r["k"], r["i"]): r["n"] for r in number_within(spark.createDataFrame(rows, "k string, i int").repartition(5), ["k"], ["i"], "n", 1).collect()}
    assert got == {("a", i): i + 1 for i in range(20)} | {("b", 1): 1, ("b", 3): 2, (None, 7): 1, (None, 8): 2}


def test_explode_and_merge(spark):
    mask = Cuboid(spark.createDataFrame([(x, y, (x + y) % 3) for x in range(4) for y in range(3)], "x int, y int, m int"), ["x", "y"], "m")
    data = Cuboid(spark.createDataFrame([(x, y, t, 1.0 * x + 10 * y + 100 * t) for x in range(4) for y in range(3) for t in range(2)], "x int, y int, t int, v double"), ["x", "y", "t"], "v")
    parts = data.explode(mask)
    assert {r["parcel"] for r in parts.collect()} == {0, 1, 2} and parts.filter("parcel = 1").agg(F.max("position")).first()[0] == 3
    assert merge(parts, mask, "v").df.select("x", "y", "t", "v").exceptAll(data.df.select("x", "y", "t", "v")).isEmpty()
