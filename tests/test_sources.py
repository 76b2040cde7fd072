import base64
import gzip
import zlib

import numpy as np
from pyspark.sql import functions as F

from gridsignal.operators import volumes
from gridsignal.sources import images, paradigm
from gridsignal.streaming.binning import binned


def test_paradigm_delimiters(spark, tmp_path):
    (tmp_path / "a.csv").write_text('0 "audio" 1.5 0\n0 "video" 3.0\n1 "audio" 2.25 4. 1.\n\n')
    (tmp_path / "b.csv").write_text("0,audio,1.5,0\n0,video,3.0\n1,audio,2.25,4.,1.\nnot an event\n")
    a, b = (sorted(map(tuple, paradigm.read_paradigm(spark, f"{tmp_path}/{n}.csv").collect())) for n in "ab")
    assert a == b == [(0, "audio", 1.5, 0.0, 1.0), (0, "video", 3.0, 0.0, 1.0), (1, "audio", 2.25, 4.0, 1.0)]
    paradigm.write_paradigm(paradigm.read_paradigm(spark, f"{tmp_path}/a.csv"), f"{tmp_path}/out")
    assert sorted(map(tuple, paradigm.read_paradigm(spark, f"{tmp_path}/out").collect())) == a


def test_nifti_round_trip(spark, tmp_path):
    data = np.arange(2 * 3 * 4 * 2, dtype=float).reshape(2, 3, 4, 2)
    data[0, 0, 0, 0] = np.nan
    (tmp_path / "bold.nii.gz").write_bytes(gzip.compress(images.encode_nifti(data, (2.0, 2.0, 3.0))))
    mask = np.zeros((2, 3, 4), int)
    mask[0, 1, :2] = 1, 2
    (tmp_path / "mask.nii").write_bytes(images.encode_nifti(mask))
    assert images.decode_nifti(images.encode_nifti(data, (2.0, 2.0, 3.0)))[1] == (2.0, 2.0, 3.0)
    bold = images.read_volumes(spark, f"{tmp_path}/bold.nii.gz")
    assert bold.count() == data.size and bold.filter("isnan(value)").isEmpty()
    got = images.masked_signals(bold, images.read_volumes(spark, f"{tmp_path}/mask.nii", drop_zero=True)).orderBy("parcel").collect()
    assert [(r["parcel"], r["signal"]) for r in got] == [(1, data[0, 1, 0].tolist()), (2, data[0, 1, 1].tolist())]


def test_gifti(spark, tmp_path):
    values = np.array([[1, 2], [3, 4], [5, 6]], "<i4")
    blob = base64.b64encode(zlib.compress(values.tobytes())).decode()
    head = 'Intent="NIFTI_INTENT_TRIANGLE" DataType="NIFTI_TYPE_INT32" ArrayIndexingOrder="RowMajorOrder" Dimensionality="2" Dim0="3" Dim1="2" Endian="LittleEndian"'
    (tmp_path / "m.gii").write_text(f'<GIFTI><DataArray {head} Encoding="GZipBase64Binary"><Data>{blob}</Data></DataArray></GIFTI>')
    got = images.read_surfaces(spark, f"{tmp_path}/m.gii").orderBy("i", "j").collect()
    assert [r["value"] for r in got] == [1, 2, 3, 4, 5, 6] and got[0]["intent"] == "NIFTI_INTENT_TRIANGLE"


def test_volume_operators(spark):
    cells = spark.createDataFrame([(x, y, int(2 <= x <= 3 and y == 1)) for x in range(6) for y in range(4)], "x long, y long, v int")
    assert {(r["x"], r["y"]) for r in volumes.crop(cells, ["x", "y"], "v").collect()} == {(0, 0), (1, 0)}
    assert volumes.crop(cells, ["x", "y"], "v", 1).count() == 12
    assert volumes.sub_sample(cells, ["x", "y"], "v", 2).agg(F.sum("v")).first()[0] == 0.5
    assert volumes.sub_sample(cells, ["x", "y"], "v", 2, mean=False).count() == 6
    signals = spark.createDataFrame([(0, [0.0, 0.0]), (1, [2.0, 2.0]), (2, [1.0, float("nan")]), (3, [1.0, 2.0]), (4, [])], "i int, y array<double>")
    assert [r["i"] for r in volumes.usable_signals(signals).collect()] == [3]
    sessions = spark.createDataFrame([(7, 1, [3.0]), (7, 0, [1.0, 2.0])], "voxel int, session int, y array<double>")
    assert volumes.joined_sessions(sessions, ["voxel"]).first()["y"] == [1.0, 2.0, 3.0]
    assert volumes.signal_summary(sessions.filter("session = 0"), ["voxel"]).count() == 2


def test_stream_and_batch_bin_alike(spark, tmp_path):
    rows = spark.range(100).select((F.timestamp_seconds(F.col("id") * 97 + 1_700_000_000)).alias("ts"), (F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    rows.write.parquet(f"{tmp_path}/in")
    batch = sorted(map(tuple, binned(rows, "ts", ["k"], "10 minutes", value="v").collect()))
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    run = binned(stream, "ts", ["k"], "10 minutes", value="v").writeStream.outputMode("complete").format("memory").queryName("binned_rows").option("checkpointLocation", f"{tmp_path}/state").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(map(tuple, spark.table("binned_rows").collect())) == batch
