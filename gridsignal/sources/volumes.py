"""Volumes and surfaces to files, and volumes from files slab by slab.

Writing: an item's cells are put together in one task, as a file is one task's work, and leave it as (name, content) for
``files.write_files``. An item is what fits a file: split larger arrays by an axis (``split_items``). Reading: a file's header tells
its shape; unpacked files are read by ranges of their last axis, so a long series is the work of many tasks.
"""

from __future__ import annotations

import base64
import gzip
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from gridsignal.sources.files import opened, write_files
from gridsignal.sources.images import GIFTI_TYPES, NIFTI_TYPES, decode_nifti, encode_nifti

FORMAT = "gridsignal_volumes"
AXES = ["x", "y", "z", "t"]
#: Cells of a slab, about.
SLAB_CELLS = 1 << 22


@dataclass
class Slab(InputPartition):
    """Planes ``start`` to ``end`` of a file's last axis of several cells."""

    path: str
    start: int
    end: int
    whole: bool


@dataclass
class Header:
    shape: tuple[int, ...]
    kind: np.dtype
    offset: int
    slope: float
    inter: float
    voxel: tuple[float, ...]


def header_of(raw: bytes) -> Header:
    """What a NIfTI-1 header tells."""
    order = "<" if struct.unpack("<i", raw[:4])[0] == 348 else ">"
    dims = struct.unpack(f"{order}8h", raw[40:56])
    code = struct.unpack(f"{order}h", raw[70:72])[0]
    if code not in NIFTI_TYPES:
        raise ValueError(f"unknown data type {code}")
    offset, slope, inter = struct.unpack(f"{order}3f", raw[108:120])
    return Header(dims[1 : dims[0] + 1], np.dtype(NIFTI_TYPES[code]).newbyteorder(order), int(offset), slope, inter, struct.unpack(f"{order}8f", raw[76:108])[1:4])


def cells_of(data: np.ndarray, first: tuple[int, ...], path: str, remove_nans: bool) -> pa.RecordBatch:
    """Rows of a block of a volume whose corner is ``first``."""
    places = np.unravel_index(np.arange(data.size), data.shape, order="F")
    flat = data.ravel(order="F").astype(float)
    flat = np.where(np.isnan(flat), 0.0, flat) if remove_nans else flat
    full = [p + f for p, f in zip(places, first, strict=True)] + [np.zeros(data.size, int)] * (4 - data.ndim)
    return pa.RecordBatch.from_arrays([pa.array([path] * data.size), *[pa.array(p.astype(np.int32)) for p in full], pa.array(flat)], ["path", *AXES, "value"])


class VolumeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.cells = options["path"], int(options.get("slabcells", SLAB_CELLS))
        self.remove_nans = options.get("removenans", "true") == "true"

    def partitions(self) -> list[Slab]:
        store, top = opened(self.path)
        info = store.get_file_info(top)
        found = [i.path for i in store.get_file_info(fs.FileSelector(top, recursive=True)) if i.type == fs.FileType.File] if info.type == fs.FileType.Directory else [top]
        out: list[Slab] = []
        for path in sorted(p for p in found if p.endswith((".nii", ".nii.gz")) and "/_temporary/" not in p):
            if path.endswith(".gz"):
                out.append(Slab(path, 0, 0, True))
                continue
            with store.open_input_file(path) as f:
                shape = header_of(f.read(352)).shape
            plane = int(np.prod(shape[:-1]))
            step = max(1, self.cells // max(plane, 1))
            out += [Slab(path, i, min(i + step, shape[-1]), False) for i in range(0, shape[-1], step)]
        return out or [Slab("", 0, 0, True)]

    def read(self, slab: Slab) -> Iterator[pa.RecordBatch]:
        if not slab.path:
            return
        store, _ = opened(self.path)
        if slab.whole:
            with store.open_input_stream(slab.path, compression=None) as f:
                data, _ = decode_nifti(f.read())
            shape, start, end = data.shape, 0, data.shape[-1]
        else:
            with store.open_input_file(slab.path) as f:
                head = header_of(f.read(352))
                shape, start, end = head.shape, slab.start, slab.end
                plane = int(np.prod(shape[:-1])) * head.kind.itemsize
                f.seek(head.offset + start * plane)
                data = np.frombuffer(f.read((end - start) * plane), head.kind).reshape((*shape[:-1], end - start), order="F")
            if head.slope not in (0.0, 1.0) or head.inter:
                data = data * head.slope + head.inter
        if len(shape) > 4:
            raise ValueError(f"{slab.path} has {len(shape)} axes, rows have four")
        for i in range(end - start):
            yield cells_of(data[..., i : i + 1], (*[0] * (len(shape) - 1), start + i), slab.path, self.remove_nans)


class VolumeSource(DataSource):
    """``spark.read.format("gridsignal_volumes").load(path)``: options ``slabCells`` and ``removeNans``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, x int, y int, z int, t int, value double"

    def reader(self, schema: StructType) -> VolumeReader:
        return VolumeReader({k.lower(): v for k, v in self.options.items()})


def load_volumes(spark: SparkSession, path: str, slab_cells: int = SLAB_CELLS, remove_nans: bool = True) -> DataFrame:
    """(path, x, y, z, t, value) of all cells of one volume or of a folder's, a slab a task."""
    spark.dataSource.register(VolumeSource)
    return spark.read.format(FORMAT).option("slabCells", str(slab_cells)).option("removeNans", str(remove_nans).lower()).load(path)


def encoded_volumes(cells: DataFrame, item: str, axes: list[str], value: str = "value", voxel: tuple[float, float, float] = (1.0, 1.0, 1.0), packed: bool = False) -> DataFrame:
    """(name, content): each item's cells as a NIfTI-1 file, missing cells 0. ``axes`` (x first) count from 0, at most seven.

    Whole-number values are written as integers of four bytes, booleans as bytes. An item's cells are one task's work.
    """
    if len(axes) > 7:
        raise ValueError("a volume has seven axes at most")
    kind = cells.schema[value].dataType.simpleString()
    whole = bool if kind == "boolean" else np.int32 if kind in ("tinyint", "smallint", "int", "bigint") else float

    def encode(rows: pd.DataFrame) -> pd.DataFrame:
        places = [rows[a].to_numpy().astype(int) for a in axes]
        data = np.zeros([int(p.max()) + 1 for p in places], whole)
        data[tuple(places)] = rows[value].fillna(0).to_numpy().astype(whole)
        raw = encode_nifti(data, voxel)
        return pd.DataFrame({"name": [str(rows[item].iloc[0])], "content": [gzip.compress(raw, mtime=0) if packed else raw]})

    ends = ".nii.gz" if packed else ".nii"
    named = cells.filter(F.col(item).isNotNull()).select(F.concat(F.col(item).cast("string"), F.lit(ends)).alias(item), *axes, value)
    return named.groupBy(item).applyInPandas(encode, "name string, content binary")


def write_volumes(cells: DataFrame, folder: str, item: str, axes: list[str], value: str = "value", voxel: tuple[float, float, float] = (1.0, 1.0, 1.0), packed: bool = False) -> None:
    """One NIfTI-1 file an item (see ``encoded_volumes``), all of them or none."""
    write_files(encoded_volumes(cells, item, axes, value, voxel, packed), folder)


def split_items(cells: DataFrame, name: str, by: list[str], formatted: bool = False) -> Column:
    """The item of each cell when an array is split by axes: ``name`` with ``_axis_value`` for each of them.

    The axis ``error`` adds ``_error`` where its value is ``error`` and nothing elsewhere. ``formatted`` writes whole
    numbers without gaps from 1, filled up with zeros to equal lengths.
    """
    parts: list[Column] = [F.lit(name)]
    for axis in by:
        if axis == "error":
            parts.append(F.when(F.col(axis) == "error", "_error").otherwise(""))
            continue
        text = F.col(axis).cast("string")
        if formatted and cells.schema[axis].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
            ends = cells.agg(F.min(axis).alias("lo"), F.max(axis).alias("hi"), F.count_distinct(axis).alias("n")).first()
            if ends["n"] and ends["hi"] - ends["lo"] + 1 == ends["n"]:
                text = F.lpad((F.col(axis) + (1 if ends["lo"] == 0 else 0)).cast("string"), len(str(ends["hi"])), "0")
        parts += [F.lit(f"_{axis}_"), text]
    return F.concat(*parts)


def split_and_save(cells: DataFrame, folder: str, name: str, by: list[str], axes: list[str], value: str = "value", formatted: bool = False, packed: bool = False) -> None:
    """A file for each combination of the axes ``by``; the other axes are the files' own."""
    write_volumes(cells.withColumn("_item", split_items(cells, name, by, formatted)), folder, "_item", axes, value, packed=packed)


def split_series(cells: DataFrame, folder: str, name: str, packed: bool = False) -> None:
    """A file for each t of a volume (x, y, z, t, value): ``name_000000`` and so on."""
    write_volumes(cells.withColumn("_item", F.format_string(f"{name.replace('%', '%%')}_%06d", F.col("t"))), folder, "_item", AXES[:3], packed=packed)


def joined_series(spark: SparkSession, paths: list[str], folder: str, name: str, packed: bool = False) -> None:
    """Volumes of three axes, in the order given, as one of four."""
    parts = [load_volumes(spark, p).select("x", "y", "z", F.lit(i).alias("t"), "value") for i, p in enumerate(paths)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    write_volumes(out.withColumn("_item", F.lit(name)), folder, "_item", AXES, packed=packed)


# surfaces


def encode_gifti(arrays: list[tuple[str, np.ndarray]], meta: dict[str, str] | None = None) -> bytes:
    """A GIFTI file of arrays with their intents; whole numbers as 32-bit integers, others as 32-bit floats, packed."""
    from xml.sax.saxutils import escape

    codes = {t: n for n, t in GIFTI_TYPES.items()}
    out = ['<?xml version="1.0" encoding="UTF-8"?>', f'<GIFTI Version="1.0" NumberOfDataArrays="{len(arrays)}">']
    if meta:
        out += ["<MetaData>", *[f"<MD><Name>{escape(k)}</Name><Value>{escape(v)}</Value></MD>" for k, v in meta.items()], "</MetaData>"]
    for intent, data in arrays:
        kind = "i4" if np.issubdtype(data.dtype, np.integer) or data.dtype == bool else "f4"
        dims = " ".join(f'Dim{i}="{n}"' for i, n in enumerate(data.shape))
        blob = base64.b64encode(zlib.compress(np.ascontiguousarray(data.astype(f"<{kind}")).tobytes())).decode()
        out.append(f'<DataArray Intent="{intent}" DataType="{codes[kind]}" ArrayIndexingOrder="RowMajorOrder" Dimensionality="{data.ndim}" {dims} Encoding="GZipBase64Binary" Endian="LittleEndian" ExternalFileName="" ExternalFileOffset="">')
        out.append(f"<Data>{blob}</Data></DataArray>")
    return "\n".join([*out, "</GIFTI>", ""]).encode()


def encoded_textures(values: DataFrame, item: str, node: str = "node", value: str = "value", time: str | None = None) -> DataFrame:
    """(name, content): each item's values by node, from 0, as a GIFTI texture; with ``time`` one array a step.

    Whole numbers have the intent of labels, other values none.
    """
    kind = values.schema[value].dataType.simpleString()
    whole = kind in ("boolean", "tinyint", "smallint", "int", "bigint")

    def encode(rows: pd.DataFrame) -> pd.DataFrame:
        arrays = []
        for _, own in rows.groupby(time) if time else [(0, rows)]:
            data = np.zeros(int(rows[node].max()) + 1, np.int32 if whole else float)
            data[own[node].to_numpy().astype(int)] = own[value].fillna(0).to_numpy()
            arrays.append(("NIFTI_INTENT_LABEL" if whole else "NIFTI_INTENT_NONE", data))
        return pd.DataFrame({"name": [str(rows[item].iloc[0])], "content": [encode_gifti(arrays)]})

    named = values.filter(F.col(item).isNotNull()).select(F.concat(F.col(item).cast("string"), F.lit(".gii")).alias(item), node, value, *([time] if time else []))
    return named.groupBy(item).applyInPandas(encode, "name string, content binary")


def encoded_meshes(coords: DataFrame, triangles: DataFrame, item: str) -> DataFrame:
    """(name, content): each item's mesh as a GIFTI file, from ``coords`` (item, node from 0, x, y, z) and ``triangles`` (item, a, b, c)."""

    def encode(key: tuple, points: pd.DataFrame, faces: pd.DataFrame) -> pd.DataFrame:
        if points.empty or key[0] is None:
            return pd.DataFrame({"name": [], "content": []})
        place = points.sort_values("node")[["x", "y", "z"]].to_numpy(float)
        corners = faces.sort_values(["a", "b", "c"])[["a", "b", "c"]].to_numpy().astype(np.int32).reshape(-1, 3)
        return pd.DataFrame({"name": [f"{key[0]}.gii"], "content": [encode_gifti([("NIFTI_INTENT_POINTSET", place), ("NIFTI_INTENT_TRIANGLE", corners)])]})

    return coords.groupBy(item).cogroup(triangles.groupBy(item)).applyInPandas(encode, "name string, content binary")


def write_textures(values: DataFrame, folder: str, item: str, node: str = "node", value: str = "value", time: str | None = None) -> None:
    write_files(encoded_textures(values, item, node, value, time), folder)


def write_meshes(coords: DataFrame, triangles: DataFrame, folder: str, item: str) -> None:
    write_files(encoded_meshes(coords, triangles, item), folder)
