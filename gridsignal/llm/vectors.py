"""What the two vector searches share: valid vectors, and a query set met with all rows in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a block at most, and in a block of a table too small to give ``BLOCKS`` larger ones (all about).
BLOCK_ROWS, LEAST_ROWS, BLOCKS = 65536, 8192, 64
#: Queries that one task puts to its block; beyond, the block is copied.
BLOCK_QUERIES = 131072

#: index(vectors, vec_ids) -> search; search(queries, query_ids) -> (query index, row index, score) of the block's best rows
Search = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
Index = Callable[[np.ndarray, np.ndarray], Search]


def valid_vectors(df: DataFrame, id_col: str, vector_col: str, nonzero: bool = False) -> DataFrame:
    """vec_id and vector (array of double) of the rows with an id whose vector has neither null nor non-finite parts."""
    v = F.col(vector_col).cast("array<double>")
    out = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector")).filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = out.filter(F.coalesce(whole, F.lit(False)))
    return out.filter(F.exists("vector", lambda x: x != 0)) if nonzero else out


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column; shorter rows are filled up with zeros."""
    rows = column.combine_chunks()
    rows = rows.chunk(0) if isinstance(rows, pa.ChunkedArray) else rows
    sizes = np.diff(rows.offsets.to_numpy())
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(float)
    width = int(sizes.max()) if len(sizes) else 0
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def widened(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def search_blocks(rows: DataFrame, is_query, k: int, index: Index, score_type: str) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best rows of each query, ties to the smaller vec_id.

    Rows are dealt to blocks of bounded size, copies of one row too. A task has one block: it reads the block's rows
    first and indexes them once, then the queries stream past in batches, so its memory doesn't grow with their number.
    A row is copied only for every ``BLOCK_QUERIES`` queries, a query goes to each block, and a block returns at most k
    rows a query. A repeated query id is searched once, by its least vector (component by component); rows with the query's
    own id are no candidates.
    """
    sizes = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(is_query).alias("queries")).first()
    blocks = max(1, -(-sizes["rows"] // BLOCK_ROWS), min(BLOCKS, sizes["rows"] // LEAST_ROWS))
    slices = max(1, -(-sizes["queries"] // BLOCK_QUERIES))
    dealt = F.pmod(F.xxhash64("vec_id", "vector", F.monotonically_increasing_id()), F.lit(blocks))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = rows.select("vec_id", "vector", dealt.alias("block"), F.lit(False).alias("asked")).select("*", every(slices).alias("slice"))
    # the order of rows must not decide which vector a repeated id stands for
    queries = rows.filter(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asked = queries.select("vec_id", "vector", every(blocks).alias("block"), F.lit(True).alias("asked"), F.pmod(F.xxhash64("vec_id"), F.lit(slices)).alias("slice"))
    both = data.unionByName(asked).select("vec_id", "vector", "asked", (F.col("block") * slices + F.col("slice")).cast("int").alias("task"))
    kind = pa.float64() if score_type == "double" else pa.decimal128(38, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        ids, search = np.zeros(0, np.int64), None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            asks = part.column("asked").to_numpy()
            held += [part.filter(~asks)] if not asks.all() else []
            if not asks.any():
                continue
            if held:
                block = pa.concat_tables(held).combine_chunks()
                ids, held = block.column("vec_id").to_numpy(), []
                search = index(matrix(block.column("vector")), ids)
            if search is None:
                continue
            now = part.filter(asks)
            for at in range(0, now.num_rows, 1024):
                some = now.slice(at, 1024)
                own = some.column("vec_id").to_numpy()
                q, r, score = search(matrix(some.column("vector")), own)
                out = [pa.array(own[q], pa.int64()), pa.array(ids[r], pa.int64()), pa.array(score).cast(kind) if isinstance(score, np.ndarray) else pa.array(score, kind)]
                yield pa.RecordBatch.from_arrays(out, ["query_id", "vec_id", "score"])

    # a partition is a task's block, rows before queries
    placed = both.repartitionById(blocks * slices, F.col("task")).sortWithinPartitions("asked")
    found = placed.mapInArrow(run, f"query_id long, vec_id long, score {score_type}")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, by score from high to low, then by id."""
    if len(score) > k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= cut)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))][:k]
