"""BrainVISA textures (``.tex``) and the headers of volumes, read by the executors.

A texture file begins with ``ascii``, or with ``binar`` and the order of bytes, then has the values' type, the number of
steps, and for each step its number, the number of nodes and their values.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsignal.sources.files import write_files
from gridsignal.sources.volumes import header_of

#: Types of values and marks of the order of bytes (fixed values of the format).
TEX_TYPES = {"FLOAT": "f4", "DOUBLE": "f8", "S16": "i2", "U16": "u2", "S32": "i4", "U32": "u4"}
ORDERS = {b"DCBA": "<", b"ABCD": ">"}


def decode_tex(raw: bytes) -> list[tuple[int, np.ndarray]]:
    """(step, values by node) of a texture."""
    if raw[:5] == b"ascii":
        words = raw[5:].split()
        kind, n_steps, at, out = words[0].decode(), int(words[1]), 2, []
        if kind not in TEX_TYPES:
            raise ValueError(f"unknown texture type {kind!r}")
        for _ in range(n_steps):
            step, n = int(words[at]), int(words[at + 1])
            out.append((step, np.array(words[at + 2 : at + 2 + n], float)))
            at += 2 + n
        return out
    if raw[:5] != b"binar" or raw[5:9] not in ORDERS:
        raise ValueError("no texture")
    order = ORDERS[raw[5:9]]
    size = struct.unpack_from(f"{order}I", raw, 9)[0]
    kind = raw[13 : 13 + size].decode()
    if kind not in TEX_TYPES:
        raise ValueError(f"unknown texture type {kind!r}")
    n_steps = struct.unpack_from(f"{order}I", raw, 13 + size)[0]
    at, width, out = 17 + size, np.dtype(TEX_TYPES[kind]).itemsize, []
    for _ in range(n_steps):
        step, n = struct.unpack_from(f"{order}2I", raw, at)
        out.append((step, np.frombuffer(raw, np.dtype(TEX_TYPES[kind]).newbyteorder(order), n, at + 8).astype(float)))
        at += 8 + n * width
    return out


def encode_tex(steps: list[tuple[int, np.ndarray]]) -> bytes:
    """A binary texture; whole numbers as 32-bit integers, other values as 32-bit floats."""
    whole = all(np.issubdtype(v.dtype, np.integer) or v.dtype == bool for _, v in steps)
    kind = b"S32" if whole else b"FLOAT"
    out = [b"binarDCBA", struct.pack("<I", len(kind)), kind, struct.pack("<I", len(steps))]
    for step, values in steps:
        out += [struct.pack("<2I", step, len(values)), values.astype("<i4" if whole else "<f4").tobytes()]
    return b"".join(out)


def read_tex(spark: SparkSession, path: str) -> DataFrame:
    """(path, t, node, value) of the values of one texture or of a folder's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw in zip(batch["path"], batch["content"], strict=True):
                for step, values in decode_tex(bytes(raw)):
                    yield pd.DataFrame({"path": name, "t": step, "node": np.arange(len(values)), "value": values})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tex").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, t int, node long, value double")


def write_tex(values: DataFrame, folder: str, item: str, node: str = "node", value: str = "value", time: str | None = None) -> None:
    """A texture an item below a folder; nodes count from 0, nodes that an item lacks are 0. An item is one task's work."""
    whole = values.schema[value].dataType.simpleString() in ("boolean", "tinyint", "smallint", "int", "bigint")

    def encode(rows: pd.DataFrame) -> pd.DataFrame:
        steps = []
        for step, own in rows.groupby(time) if time else [(0, rows)]:
            data = np.zeros(int(rows[node].max()) + 1, np.int64 if whole else float)
            data[own[node].to_numpy().astype(int)] = own[value].fillna(0).to_numpy()
            steps.append((int(step), data))
        return pd.DataFrame({"name": [str(rows[item].iloc[0])], "content": [encode_tex(steps)]})

    named = values.filter(F.col(item).isNotNull()).select(F.concat(F.col(item).cast("string"), F.lit(".tex")).alias(item), node, value, *([time] if time else []))
    write_files(named.groupBy(item).applyInPandas(encode, "name string, content binary"), folder)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, shape, voxel, type) of volumes: the sizes of their axes and of a voxel along the first three."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            opened = (gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw for raw in map(bytes, batch["content"]))
            heads = [header_of(raw[:352]) for raw in opened]
            yield pd.DataFrame({"path": batch["path"], "shape": [list(h.shape) for h in heads], "voxel": [[float(v) for v in h.voxel] for h in heads], "type": [h.kind.name for h in heads]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.col("path").rlike(r"\.nii(\.gz)?$"))
    return files.select("path", "content").mapInPandas(run, "path string, shape array<int>, voxel array<double>, type string")
