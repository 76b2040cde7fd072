"""MAT-files of level 5 as tables, and the designs that SPM keeps in them.

Files are opened by Spark's ``binaryFile`` and decoded by the executors. A file becomes one row a leaf of its nested
structures: ``place`` tells the way to it (``SPM.Sess(1).U(2).ons``, places of elements from 1), ``numbers`` or ``text`` its
content, ``shape`` its size. What is asked of a design are queries on that table.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsignal.functions.series import contrast_name

#: Types of data elements and classes of arrays (fixed values of the format).
ELEMENTS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
TEXTS = {16: "utf-8", 17: "utf-16", 18: "utf-32"}
MATRIX, COMPRESSED = 14, 15
CELL, STRUCT, OBJECT, CHAR, SPARSE = 1, 2, 3, 4, 5

Leaf = tuple[str, list[int], list[float] | None, str | None]


def elements(raw: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    """(type, content) of the data elements in a part of a file."""
    at = 0
    while at + 8 <= len(raw):
        kind, size = struct.unpack_from(f"{order}2I", raw, at)
        if kind >> 16:
            # a small element: its size and type share four bytes, its content the next four
            yield kind & 0xFFFF, raw[at + 4 : at + 4 + (kind >> 16)]
            at += 8
            continue
        yield kind, raw[at + 8 : at + 8 + size]
        at += 8 + size + (0 if kind == COMPRESSED else -size % 8)


def numbers(kind: int, raw: bytes, order: str) -> np.ndarray:
    if kind not in ELEMENTS:
        raise ValueError(f"no numbers in an element of type {kind}")
    return np.frombuffer(raw, np.dtype(ELEMENTS[kind]).newbyteorder(order))


def leaves(raw: bytes, order: str, place: str | None = None) -> Iterator[Leaf]:
    """The leaves of an array; ``place`` of a nested one, which has no name of its own."""
    parts = elements(raw, order)
    flags = next(parts, None)
    if flags is None:  # an element without content is an empty array
        return
    kind = int(numbers(*flags, order)[0]) & 0xFF
    shape = [int(n) for n in numbers(*next(parts), order)]
    name = next(parts)[1].split(b"\0")[0].decode("latin-1")
    place = name if place is None else place
    size = int(np.prod(shape))
    here = lambda i: f"{place}({i + 1})" if size > 1 else place
    if kind in (CELL, STRUCT, OBJECT):
        fields = [""]
        if kind != CELL:
            if kind == OBJECT:
                next(parts)
            width = int(numbers(*next(parts), order)[0])
            text = next(parts)[1]
            fields = [text[i : i + width].split(b"\0")[0].decode("latin-1") for i in range(0, len(text), width)]
        for i in range(size):
            for f in fields:
                content = next(parts)[1]
                own = f"{place}{{{i + 1}}}" if kind == CELL else f"{here(i)}.{f}"
                yield from leaves(content, order, own)
    elif kind == CHAR:
        code, content = next(parts, (4, b""))
        if code in TEXTS:
            suffix = "" if code == 16 else "-le" if order == "<" else "-be"
            text = content.decode(TEXTS[code] + suffix)
        else:
            text = "".join(chr(c) for c in numbers(code, content, order))
        if len(shape) == 2 and shape[0] > 1:  # rows of characters, column by column
            text = "\n".join("".join(text[r :: shape[0]]) for r in range(shape[0]))
        yield place, shape, None, text
    elif kind == SPARSE:
        rows, cols, values = (numbers(*next(parts), order) for _ in range(3))
        full = np.zeros(shape)
        for c in range(shape[1]):
            full[rows[cols[c] : cols[c + 1]], c] = values[cols[c] : cols[c + 1]]
        yield place, shape, full.ravel(order="F").tolist(), None
    else:
        code, content = next(parts, (9, b""))
        yield place, shape, numbers(code, content, order).astype(float).tolist(), None


def decode_mat(raw: bytes) -> list[Leaf]:
    """(place, shape, numbers, text) of all leaves; numbers column by column, the real parts of complex ones."""
    if raw[126:128] not in (b"IM", b"MI"):
        raise ValueError("no MAT-file of level 5")
    order = "<" if raw[126:128] == b"IM" else ">"
    out: list[Leaf] = []
    for kind, content in elements(raw[128:], order):
        if kind == COMPRESSED:
            kind, content = next(elements(zlib.decompress(content), order))
        if kind == MATRIX:
            out += leaves(content, order)
    return out


def read_mat(spark: SparkSession, path: str) -> DataFrame:
    """(path, place, shape, numbers, text) of the leaves of one file or of a folder's; an executor opens each file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw in zip(batch["path"], batch["content"], strict=True):
                rows = decode_mat(bytes(raw))
                yield pd.DataFrame({"path": [name] * len(rows), "place": [r[0] for r in rows], "shape": [r[1] for r in rows], "numbers": [r[2] for r in rows], "text": [r[3] for r in rows]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, place string, shape array<int>, numbers array<double>, text string")


def _at(place: Column, name: str) -> Column:
    """The place (from 1) of an element of ``name`` in a place; 1 where there is but one."""
    return F.coalesce(F.nullif(F.regexp_extract(place, rf"\.{name}\((\d+)\)", 1), F.lit("")).cast("int"), F.lit(1))


def spm_events(leaves_: DataFrame) -> DataFrame:
    """(path, session, condition, onset, duration) of the designs in ``SPM`` structures, sessions from 1, in seconds.

    Onsets in scans are multiplied by the repetition time. A condition named ``sessN name`` belongs to session N. Single
    durations hold for all of a condition's onsets.
    """
    inputs = leaves_.filter(F.col("place").rlike(r"^SPM\.Sess(\(\d+\))?\.U(\(\d+\))?\.(name(\{1\})?|ons|dur)$"))
    field = F.regexp_extract("place", r"\.(name|ons|dur)(\{1\})?$", 1)
    keyed = inputs.select("path", _at(F.col("place"), "Sess").alias("session"), _at(F.col("place"), "U").alias("u"), field.alias("field"), "shape", "numbers", "text")
    pick = lambda f, c: F.max(F.when(F.col("field") == f, F.col(c)))
    # the first column of each array: an input's rows
    first = lambda f: F.slice(pick(f, "numbers"), F.lit(1), F.coalesce(F.get(pick(f, "shape"), F.lit(0)), F.lit(0)))
    rows = keyed.groupBy("path", "session", "u").agg(pick("name", "text").alias("name"), first("ons").alias("ons"), first("dur").alias("dur"))
    unit = leaves_.groupBy("path").agg(F.max(F.when(F.col("place") == "SPM.xBF.UNITS", F.col("text"))).alias("units"), F.max(F.when(F.col("place") == "SPM.xY.RT", F.get("numbers", F.lit(0)))).alias("tr"))
    factor = F.when(F.col("units") == "scans", F.col("tr")).otherwise(1.0)
    own = F.regexp_extract("name", r"^sess(\d) (.*)$", 1)
    session = F.when(own != "", own.try_cast("int")).otherwise(F.col("session"))
    condition = F.when(own != "", F.regexp_extract("name", r"^sess(\d) (.*)$", 2)).otherwise(F.col("name"))
    length = F.coalesce(F.get("dur", F.when(F.size("dur") == 1, 0).otherwise(F.col("i"))), F.lit(0.0))
    events = rows.join(unit, "path").select("path", session.alias("session"), condition.alias("condition"), "dur", factor.alias("factor"), F.posexplode("ons").alias("i", "onset"))
    return events.select("path", "session", "condition", (F.col("onset") * F.col("factor")).alias("onset"), (length * F.col("factor")).alias("duration"))


def spm_repetition_time(leaves_: DataFrame) -> DataFrame:
    """(path, tr)"""
    return leaves_.filter("place = 'SPM.xY.RT'").select("path", F.get("numbers", F.lit(0)).alias("tr"))


def spm_regressors(leaves_: DataFrame) -> DataFrame:
    """(path, column, name): the design matrix's columns from 1."""
    names = leaves_.filter(F.col("place").rlike(r"^SPM\.xX\.name\{\d+\}$"))
    return names.select("path", F.regexp_extract("place", r"\{(\d+)\}$", 1).cast("int").alias("column"), F.col("text").alias("name"))


def spm_contrasts(leaves_: DataFrame) -> DataFrame:
    """(path, contrast, expression) of the contrasts of kind T, as expressions of the first session's conditions.

    Characters other than letters, digits, ``_`` and ``-`` are left out of the names.
    """
    cons = leaves_.filter(F.col("place").rlike(r"^SPM\.xCon(\(\d+\))?\.(name|c|STAT)$"))
    field = F.regexp_extract("place", r"\.(name|c|STAT)$", 1)
    pick = lambda f, c: F.max(F.when(F.col("field") == f, F.col(c)))
    rows = cons.select("path", _at(F.col("place"), "xCon").alias("k"), field.alias("field"), "numbers", "text").groupBy("path", "k").agg(pick("name", "text").alias("name"), pick("c", "numbers").alias("c"), pick("STAT", "text").alias("stat"))
    first = leaves_.filter(F.col("place").rlike(r"^SPM\.Sess(\(1\))?\.U(\(\d+\))?\.name(\{1\})?$")).select("path", _at(F.col("place"), "U").alias("u"), F.col("text").alias("name"))
    # a design's few conditions
    order = F.transform(F.array_sort(F.collect_list(F.struct("u", "name"))), lambda s: s["name"])
    conditions = first.groupBy("path").agg(order.alias("conditions"))

    @F.udf("string")
    def expression(c: list[float], names: list[str]) -> str:
        return contrast_name(list(c[: len(names)]), list(names))

    out = rows.filter("stat = 'T'").join(conditions, "path")
    return out.select("path", F.regexp_replace("name", r"[^\w-]", "").alias("contrast"), expression(F.slice("c", F.lit(1), F.size("conditions")), "conditions").alias("expression"))
