"""Graphs as blocked sparse matrices.

A matrix is a table with a row for each block that has entries: ``row_block``, ``col_block``, and arrays ``rows``, ``cols``
(places inside the block) and ``values``. A block has ``SIDE`` rows and columns, so its arrays are bounded; a hub's entries
are spread over as many blocks as it has columns in. Vectors are tables of segments of the same size. A product joins blocks
with segments, not entries with values, and adds inside a block before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE = 1024


def graph_to_sparse(edges: DataFrame, weight: str | None = None, side: int = SIDE) -> DataFrame:
    """Blocks of the matrix with an entry (src, dst) for each edge, 1 or its weight; repeated edges are added up.

    Nodes are whole numbers from 0. Edges with a null end or weight are left out.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    cells = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), w.alias("w")).dropna().groupBy("src", "dst").agg(F.sum("w").alias("w"))
    part = lambda c: (F.expr(f"{c} div {side}"), (F.col(c) % side).cast("int"))
    (rb, r), (cb, c) = part("src"), part("dst")
    placed = cells.select(rb.alias("row_block"), cb.alias("col_block"), F.struct(r.alias("r"), c.alias("c"), "w").alias("e"))
    blocks = placed.groupBy("row_block", "col_block").agg(F.sort_array(F.collect_list("e")).alias("e"))
    return blocks.select("row_block", "col_block", *[F.col(f"e.{f}").alias(n) for n, f in (("rows", "r"), ("cols", "c"), ("values", "w"))])


def sparse_to_edges(matrix: DataFrame, side: int = SIDE) -> DataFrame:
    """(src, dst, value) of the entries."""
    e = F.explode(F.arrays_zip("rows", "cols", "values")).alias("e")
    return matrix.select("row_block", "col_block", e).select((F.col("row_block") * side + F.col("e.rows")).alias("src"), (F.col("col_block") * side + F.col("e.cols")).alias("dst"), F.col("e.values").alias("value"))


def segments(values: DataFrame, node: str = "node", value: str = "value", side: int = SIDE) -> DataFrame:
    """(block, places, values) of a vector given by rows; rows with nulls count as 0."""
    rows = values.select(F.col(node).cast("long").alias("n"), F.col(value).cast("double").alias("v")).dropna()
    placed = rows.select(F.expr(f"n div {side}").alias("block"), F.struct((F.col("n") % side).cast("int").alias("p"), "v").alias("e"))
    return placed.groupBy("block").agg(F.collect_list("e").alias("e")).select("block", F.col("e.p").alias("places"), F.col("e.v").alias("values"))


def times_vector(matrix: DataFrame, vector: DataFrame, side: int = SIDE) -> DataFrame:
    """(node, value): the product with ``segments``; rows of the matrix without entries are left out."""
    met = matrix.join(vector.select(F.col("block").alias("col_block"), "places", F.col("values").alias("x")), "col_block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sums = [], []
            for block, rows, cols, values, places, x in zip(*(c.to_numpy(zero_copy_only=False) for c in batch.columns), strict=True):
                own = np.zeros(side)
                if places is not None:
                    np.add.at(own, places, x)
                found, at = np.unique(rows, return_inverse=True)
                nodes.append(int(block) * side + found.astype(np.int64))
                sums.append(np.bincount(at, values * own[cols], len(found)))
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sums))], ["node", "value"])

    parts = met.select("row_block", "rows", "cols", "values", "places", "x").mapInArrow(run, "node long, value double")
    return parts.groupBy("node").agg(F.sum("value").alias("value"))


def transposed(matrix: DataFrame) -> DataFrame:
    """The matrix with rows and columns swapped; no entry moves to another block's row."""
    return matrix.select(F.col("col_block").alias("row_block"), F.col("row_block").alias("col_block"), F.col("cols").alias("rows"), F.col("rows").alias("cols"), "values")


def block_diagonal(parts: list[tuple[DataFrame, int]], repeat: int = 1) -> DataFrame:
    """(src, dst, value) of square matrices (src, dst, value; number of rows) one after the other on the diagonal.

    ``repeat``: the whole list as often again. Every entry is moved by the rows before its part; nothing is joined.
    """
    out, before = None, 0
    for _ in range(repeat):
        for entries, size in parts:
            own = entries.select((F.col("src") + before).cast("long").alias("src"), (F.col("dst") + before).cast("long").alias("dst"), F.col("value").cast("double").alias("value"))
            out, before = own if out is None else out.unionByName(own), before + size
    if out is None:
        raise ValueError("no matrices")
    return out
