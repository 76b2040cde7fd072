import pytest

from gridsignal.cuboid import Cuboid, merge, stack_cuboids, tree_to_cuboid


def cells(c):
    return {tuple(r[a] for a in c.axes): r[c.value] for r in c.df.collect()}


@pytest.fixture(scope="module")
def block(spark):
    rows = [(x, y, z, float(30 * x + 6 * y + z)) for x in range(4) for y in range(5) for z in range(6)]
    return Cuboid(spark.createDataFrame(rows, "axial int, coronal int, sagittal int, value double"), ["axial", "coronal", "sagittal"])


def test_slices_and_orientation(block):
    assert cells(block.sub_cuboid(axial=2, coronal=1)) == {(z,): 66.0 + z for z in range(6)}
    assert cells(block.sub_cuboid_from_slices(axial=3, coronal=slice(1, 3), sagittal=0)) == {(1,): 96.0, (2,): 102.0}
    assert block.set_MRI_orientation().axes == ["sagittal", "coronal", "axial"]
    assert block.swapaxes("axial", "sagittal").axes == ["sagittal", "coronal", "axial"]
    assert block.roll("axial").axes == ["coronal", "sagittal", "axial"]
    with pytest.raises(ValueError):
        block.sub_cuboid(nowhere=1)


def test_reductions(block):
    assert cells(block.sum())[()] == sum(range(120))
    assert cells(block.mean("sagittal"))[(0, 0)] == 2.5
    assert cells(block.std("sagittal"))[(1, 1)] == pytest.approx(1.707825127659933)
    assert cells(block.ptp("axial"))[(0, 0)] == 90.0


def test_arithmetic_needs_the_same_axes(block):
    twice = block + block
    assert cells(twice)[(3, 4, 5)] == 238.0
    assert cells(2 * block - block)[(3, 4, 5)] == 119.0
    assert cells(block / 0)[(0, 0, 1)] is None
    with pytest.raises(ValueError):
        block.add(block.mean("axial"))
    assert (block * 1).equals(block)
    assert not block.equals(twice)


def test_rescale(block, spark):
    scaled = cells(block.rescale_values(axis="sagittal"))
    assert scaled[(0, 0, 0)] == 0.0 and scaled[(0, 0, 5)] == 1.0
    flat = Cuboid(spark.createDataFrame([(0, 3.0), (1, 3.0)], "a int, value double"), ["a"])
    assert set(cells(flat.rescale_values(v_min=2.0)).values()) == {2.0}


def test_expand_and_flatten_follow_row_order(spark):
    mask = Cuboid(spark.createDataFrame([(0, 0, 0), (0, 1, 1), (0, 2, 0), (1, 0, 0), (1, 1, 1), (1, 2, 1)], "x int, y int, m int"), ["x", "y"], "m")
    flat = Cuboid(spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "position long, value double"), ["position"])
    wide = flat.expand(mask, "position")
    assert cells(wide) == {(0, 0): 0.0, (0, 1): 1.0, (0, 2): 0.0, (1, 0): 0.0, (1, 1): 2.0, (1, 2): 3.0}
    assert cells(wide.flatten(mask)) == {(0,): 1.0, (1,): 2.0, (2,): 3.0}


def test_map_onto(spark):
    data = Cuboid(spark.createDataFrame([(t, r, float(10 * t + r)) for t in range(4) for r in (2, 6)], "time int, roi int, value double"), ["time", "roi"])
    where = Cuboid(spark.createDataFrame([(0, 0, 2), (1, 0, 6), (2, 3, 0)], "x int, y int, roi int"), ["x", "y"], "roi")
    got = cells(data.map_onto(where))
    assert got[(3, 0, 0)] == 32.0 and got[(3, 1, 0)] == 36.0 and got[(3, 2, 3)] == 0.0
    with pytest.raises(ValueError):
        data.map_onto(Cuboid(where.df.withColumnRenamed("roi", "ROI"), ["x", "y"], "ROI"))


def test_explode_and_merge_are_inverse(spark, block):
    mask = Cuboid(block.df.selectExpr("axial", "coronal", "(axial * coronal) % 4 AS m").distinct(), ["axial", "coronal"], "m")
    flat = block.mean("sagittal")
    back = merge(flat.explode(mask), mask, "value")
    assert cells(back) == cells(flat)


def test_stack_tree_repeat(spark, block):
    low, high = block.min("sagittal"), block.max("sagittal")
    both = stack_cuboids([low, high], "which", ["min", "max"])
    assert both.axes == ["which", "axial", "coronal"] and cells(both)[("max", 0, 0)] == 5.0
    tree = low.to_tree(["axial"], "coronal")
    assert cells(tree_to_cuboid(tree, ["axial"], "coronal")) == cells(low)
    assert cells(low.repeat(2, "r"))[(0, 0, 1)] == 0.0
    assert low.repeat(1, "r").squeeze(["r"]).axes == ["axial", "coronal"]
    with pytest.raises(ValueError):
        stack_cuboids([low, block], "which")
