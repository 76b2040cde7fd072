import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsignal.sources import textures, volumes


def test_formats_of_textures():
    assert [(t, v.tolist()) for t, v in textures.decode_tex(b"ascii\nFLOAT\n2\n0 3 1.5 2 -1\n4 2 0 7\n")] == [(0, [1.5, 2.0, -1.0]), (4, [0.0, 7.0])]
    big = b"binarABCD" + struct.pack(">I", 3) + b"S16" + struct.pack(">I", 1) + struct.pack(">2I", 0, 2) + struct.pack(">2h", -5, 300)
    assert [v.tolist() for _, v in textures.decode_tex(big)] == [[-5.0, 300.0]]
    steps = [(0, np.array([1, 2, 3])), (1, np.array([4, 5, 6]))]
    assert [(t, v.tolist()) for t, v in textures.decode_tex(textures.encode_tex(steps))] == [(0, [1, 2, 3]), (1, [4, 5, 6])]
    for bad in (b"nothing", b"ascii\nCHAR\n0\n", b"binarXXXX"):
        with pytest.raises(ValueError):
            textures.decode_tex(bad)


def test_textures_and_headers_of_files(spark, tmp_path):
    values = spark.createDataFrame([(k, n, t, n + 0.25 * t) for k in "ab" for n in range(5) for t in range(3)], "item string, node long, t int, value double")
    textures.write_tex(values, str(tmp_path / "tex"), "item", time="t")
    got = {(r["path"].split("/")[-1], r["node"], r["t"]): r["value"] for r in textures.read_tex(spark, str(tmp_path / "tex")).collect()}
    assert got == {(f"{k}.tex", n, t): n + 0.25 * t for k in "ab" for n in range(5) for t in range(3)}
    cells = values.filter("t = 0").select("item", F.col("node").alias("x"), F.lit(0).alias("y"), F.col("node").alias("value"))
    for packed in (False, True):
        volumes.write_volumes(cells, str(tmp_path / f"v{packed}"), "item", ["x", "y"], voxel=(1.5, 2.0, 3.0), packed=packed)
        heads = textures.read_headers(spark, str(tmp_path / f"v{packed}")).collect()
        assert len(heads) == 2 and all((r["shape"], r["voxel"], r["type"]) == ([5, 1], [1.5, 2.0, 3.0], "int32") for r in heads)
