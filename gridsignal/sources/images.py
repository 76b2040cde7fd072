"""Volume and surface files as long tables, read by the executors.

Files are listed and opened by Spark's ``binaryFile`` source, so any store will do; each file is decoded in one task and
handed on slice by slice. NIfTI-1 (``.nii``, ``.nii.gz``) and GIFTI (``.gii``) are understood. NaN becomes 0 on request,
as in a missing-value convention.
"""

from __future__ import annotations

import base64
import gzip
import struct
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: NIfTI-1 data type codes (fixed values of the format).
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
#: GIFTI data types (fixed values of the format).
GIFTI_TYPES = {"NIFTI_TYPE_UINT8": "u1", "NIFTI_TYPE_INT16": "i2", "NIFTI_TYPE_INT32": "i4", "NIFTI_TYPE_FLOAT32": "f4", "NIFTI_TYPE_FLOAT64": "f8"}


def decode_nifti(raw: bytes) -> tuple[np.ndarray, tuple[float, ...]]:
    """Array in file order (x, y, z, t, ...) and voxel sizes."""
    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    order = "<" if struct.unpack("<i", raw[:4])[0] == 348 else ">"
    dims = struct.unpack(f"{order}8h", raw[40:56])
    code = struct.unpack(f"{order}h", raw[70:72])[0]
    sizes = struct.unpack(f"{order}8f", raw[76:108])
    offset, slope, inter = struct.unpack(f"{order}3f", raw[108:120])
    if code not in NIFTI_TYPES:
        raise ValueError(f"unknown data type {code}")
    shape = dims[1 : dims[0] + 1]
    data = np.frombuffer(raw, np.dtype(NIFTI_TYPES[code]).newbyteorder(order), int(np.prod(shape)), int(offset))
    data = data.reshape(shape, order="F").astype(float)
    return (data * slope + inter if slope not in (0.0, 1.0) or inter else data), sizes[1:4]


def encode_nifti(data: np.ndarray, voxel: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> bytes:
    """A NIfTI-1 file of an array; booleans are stored as bytes."""
    data = data.astype("i1") if data.dtype == bool else data.astype("f8") if data.dtype == float else data.astype("i4")
    code = next(c for c, t in NIFTI_TYPES.items() if np.dtype(t) == data.dtype)
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, data.ndim, *data.shape, *[1] * (7 - data.ndim))
    struct.pack_into("<2h", head, 70, code, data.dtype.itemsize * 8)
    struct.pack_into("<8f", head, 76, 1.0, *voxel, *[1.0] * 4)
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    head[344:348] = b"n+1\0"
    return bytes(head) + data.tobytes(order="F")


def decode_gifti(raw: bytes) -> list[tuple[str, np.ndarray]]:
    """(intent, array) of each data array."""
    out = []
    for node in ET.fromstring(raw).iter("DataArray"):
        shape = tuple(int(node.get(f"Dim{i}")) for i in range(int(node.get("Dimensionality", "1"))))
        kind = np.dtype(GIFTI_TYPES[node.get("DataType")]).newbyteorder("<" if node.get("Endian") == "LittleEndian" else ">")
        text = (node.findtext("Data") or "").strip()
        if node.get("Encoding") == "ASCII":
            flat = np.array(text.split(), float)
        else:
            blob = base64.b64decode(text)
            flat = np.frombuffer(zlib.decompress(blob) if node.get("Encoding") == "GZipBase64Binary" else blob, kind)
        out.append((node.get("Intent"), flat.astype(float).reshape(shape, order="C" if node.get("ArrayIndexingOrder") != "ColumnMajorOrder" else "F")))
    return out


def read_volumes(spark: SparkSession, path: str, remove_nans: bool = True, drop_zero: bool = False) -> DataFrame:
    """(path, x, y, z, t, value) of every cell; axes that a file lacks are 0. ``drop_zero`` leaves background out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw in zip(batch["path"], batch["content"], strict=True):
                data, _ = decode_nifti(raw)
                data = data.reshape(data.shape + (1,) * (4 - data.ndim))
                for t in range(data.shape[3]):
                    cells = np.nan_to_num(data[:, :, :, t]) if remove_nans else data[:, :, :, t]
                    x, y, z = (np.nonzero(cells) if drop_zero else np.unravel_index(np.arange(cells.size), cells.shape))
                    yield pd.DataFrame({"path": name, "x": x, "y": y, "z": z, "t": t, "value": cells[x, y, z]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, x int, y int, z int, t int, value double")


def read_surfaces(spark: SparkSession, path: str) -> DataFrame:
    """(path, array, intent, i, j, value) of every entry of every data array; j is 0 in one-dimensional arrays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw in zip(batch["path"], batch["content"], strict=True):
                for k, (intent, data) in enumerate(decode_gifti(raw)):
                    grid = data.reshape(len(data), -1)
                    i, j = np.unravel_index(np.arange(grid.size), grid.shape)
                    yield pd.DataFrame({"path": name, "array": k, "intent": intent, "i": i, "j": j, "value": grid.ravel()})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, array int, intent string, i int, j int, value double")


def masked_signals(bold: DataFrame, mask: DataFrame) -> DataFrame:
    """(parcel, x, y, z, y_t array): signals of the cells whose mask value is not 0, in time order."""
    from pyspark.sql import functions as F

    inside = mask.filter("value <> 0").select("x", "y", "z", F.col("value").cast("int").alias("parcel"))
    series = F.transform(F.sort_array(F.collect_list(F.struct("t", "value"))), lambda s: s["value"])
    return bold.join(inside, ["x", "y", "z"]).groupBy("parcel", "x", "y", "z").agg(series.alias("signal"))
