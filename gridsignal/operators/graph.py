"""Graphs as edge tables: lattices, meshes, neighbour sums, search from a root and connected components.

An undirected graph is a DataFrame ``(src, dst)``. Iterative operators cut their lineage with tables or
``checkpoint()``s in the session's checkpoint folder, so lost executors cost no restart.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsignal.session import ensure_checkpoint_dir, written


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, once; self loops are dropped."""
    pairs = edges.select("src", "dst").filter(F.col("src") != F.col("dst"))
    return pairs.union(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


#: Edges that a task contracts at once.
CHUNK_EDGES = 1 << 20


def least_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ends of some edges, and for each the least end of its component among these edges."""
    keys, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    top = np.arange(len(keys))
    while True:
        x, y = top[a], top[b]
        apart = x != y
        if not apart.any():
            return keys, keys[top]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(top, np.maximum(x, y), np.minimum(x, y))
        while True:
            higher = top[top]
            if (higher == top).all():
                break
            top = higher


def contracted(edges: DataFrame) -> DataFrame:
    """``(key, least)``: each end of the edges (src, dst), once for each chunk of a partition that has it, with the least
    end it is joined with inside the chunk. So a node of any number of edges gives one row a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in chain(batches, [None]):
            if batch is not None and batch.num_rows:
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
                size += batch.num_rows
            if held and (batch is None or size >= CHUNK_EDGES):
                keys, least = least_ends(*(np.concatenate(x) for x in zip(*held, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(least)], ["key", "least"])
                held, size = [], 0

    return edges.mapInArrow(run, "key long, least long")


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, max_rounds: int | None = None) -> DataFrame:
    """``(node, component)``: the smallest node reachable from each node, itself included. Nodes are whole numbers.

    Edges are contracted inside partitions, which leaves a node one row a partition, whatever its degree; each node then
    takes the least of its rows as its label, and an edge joins labels from there on. From the second round on nodes go
    by a random order, a bijective hash of their numbers, so each round leaves half of them at most on average and the
    rounds grow with the logarithm of the longest path. The labels of all rounds are put together at the end.
    ``nodes`` (column ``node``) adds nodes without edges. Null ends are ignored. Rounds go on until no edge is left; with
    ``max_rounds``, an error tells that some were by then.
    """
    kind = edges.schema["src"].dataType
    now = contracted(edges.filter(F.col("src") != F.col("dst")).select(F.col("src").cast("long"), F.col("dst").cast("long")))
    levels: list[DataFrame] = []
    while True:
        if len(levels) == max_rounds:
            raise RuntimeError(f"components not found in {max_rounds} rounds")
        met = written(now.withColumn("label", F.min("least").over(Window.partitionBy("key"))))
        label = met.select("key", "label").distinct()
        levels.append(label)
        ends = label.select(F.col("key").alias("least"), F.col("label").alias("other"))
        left = met.select("label", "least").distinct().join(ends, "least").filter("label <> other")
        now = written(contracted(left.select(F.xxhash64("label"), F.xxhash64("other"))))
        if now.isEmpty():
            break
    out = levels[0].select(F.col("key").alias("node"), "label")
    if len(levels) > 1:
        out = out.join(later_labels(levels), "label", "left").select("node", F.coalesce("component", "label").alias("label"))
    out = out.select(F.col("node").cast(kind).alias("node"), F.col("label").cast(kind).alias("component"))
    if nodes is None:
        return out
    return nodes.select("node").distinct().join(out, "node", "full").select("node", F.coalesce("component", "node").alias("component"))


def later_labels(levels: list[DataFrame]) -> DataFrame:
    """``(label, component)``: the least label of the first level that the later levels join each with, if they have it."""
    hashed = lambda c, n: hashed(F.xxhash64(c), n - 1) if n else c
    last = len(levels) - 1
    found = levels[last].select("key", F.col("label").alias("root"))
    for j in range(last - 1, 0, -1):
        on = found.select(F.col("key").alias("_key"), "root")
        # a label that no later level has goes by the name it would have in the last one
        found = levels[j].join(on, F.xxhash64("label") == F.col("_key"), "left").select("key", F.coalesce("root", hashed(F.col("label"), last - j)).alias("root"))
    roots = written(levels[0].select("label").distinct().join(found, F.xxhash64("label") == F.col("key")).select("label", "root"))
    least = written(roots.groupBy("root").agg(F.min("label").alias("component")))
    return roots.join(least, "root").select("label", "component")


#: Neighbour offsets of the usual kernels.
KERNELS = {
    "2D-4n": [(-1, 0), (0, -1), (0, 1), (1, 0)],
    "2D-8n": [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)],
    "3D-6n": [(-1, 0, 0), (0, -1, 0), (0, 0, -1), (0, 0, 1), (0, 1, 0), (1, 0, 0)],
    "3D-26n": [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)],
}


def lattice_edges(cells: DataFrame, axes: list[str], node: str = "node", kernel: str | list[tuple[int, ...]] = "2D-4n", shape: list[int] | None = None) -> DataFrame:
    """Edges between cells that are neighbours by the kernel, in both directions.

    Each cell proposes its neighbours' coordinates, and a join keeps those that are cells. With ``shape`` the lattice
    wraps around.
    """
    offsets = KERNELS[kernel] if isinstance(kernel, str) else kernel
    steps = F.array(*[F.struct(*[F.lit(o).alias(a) for a, o in zip(axes, off, strict=True)]) for off in offsets])
    near = cells.select(F.col(node).alias("src"), *axes, F.explode(steps).alias("o"))
    place = [F.col(a) + F.col(f"o.{a}") for a in axes]
    if shape:
        place = [F.pmod(p, F.lit(n)) for p, n in zip(place, shape, strict=True)]
    near = near.select("src", *[p.alias(a) for p, a in zip(place, axes, strict=True)])
    out = near.join(cells.select(F.col(node).alias("dst"), *axes), axes).select("src", "dst").filter("src <> dst")
    return out.distinct() if shape else out


def mesh_edges(triangles: DataFrame) -> DataFrame:
    """Edges of the triangles (a, b, c), in both directions."""
    pairs = F.array(*[F.struct(F.col(x).alias("src"), F.col(y).alias("dst")) for x in "abc" for y in "abc" if x != y])
    return triangles.select(F.explode(pairs).alias("e")).select("e.src", "e.dst").distinct()


def is_sane(edges: DataFrame, constant_degree: bool = False) -> bool:
    """Symmetric, without repeated edges or loops, and of one degree if asked."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    ok = edges.join(back, ["src", "dst"], "left_anti").isEmpty() and edges.filter("src = dst").isEmpty()
    ok = ok and edges.groupBy("src", "dst").count().filter("count > 1").isEmpty()
    if ok and constant_degree:
        ok = edges.groupBy("src").count().select("count").distinct().count() <= 1
    return ok


def neighbour_sum(edges: DataFrame, values: DataFrame, node: str = "node", value: str = "value") -> DataFrame:
    """Sum of each node's neighbours' values; 0 for nodes without neighbours."""
    near = edges.join(values.select(F.col(node).alias("dst"), F.col(value).alias("_v")), "dst").groupBy("src").agg(F.sum("_v").alias("_s"))
    return values.select(node).join(near, F.col(node) == F.col("src"), "left").select(node, F.coalesce("_s", F.lit(0)).alias("neighbour_sum"))


def homo_cliques(edges: DataFrame, labels: DataFrame, node: str = "node", label: str = "label", weight: str | None = None) -> DataFrame:
    """One row: (weighted) number of edges whose ends have equal labels; ``edges`` holds both directions."""
    a = labels.select(F.col(node).alias("src"), F.col(label).alias("_a"))
    b = labels.select(F.col(node).alias("dst"), F.col(label).alias("_b"))
    hit = F.when(F.col("_a") == F.col("_b"), F.col(weight) if weight else F.lit(1)).otherwise(0)
    return edges.join(a, "src").join(b, "dst").agg((F.coalesce(F.sum(hit), F.lit(0)) / 2).alias("cliques"))


def n_cliques(edges: DataFrame) -> DataFrame:
    return edges.agg((F.count(F.lit(1)) / 2).alias("cliques"))


def sub_graph(edges: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """Edges with both ends among ``nodes``."""
    ends = nodes.select(node).distinct()
    return edges.join(ends.withColumnRenamed(node, "src"), "src", "left_semi").join(ends.withColumnRenamed(node, "dst"), "dst", "left_semi").select("src", "dst")


def parcel_edges(edges: DataFrame, parcels: DataFrame, node: str = "node", parcel: str = "parcel") -> DataFrame:
    """(parcel, src, dst): edges inside a parcel."""
    a = parcels.select(F.col(node).alias("src"), F.col(parcel).alias("parcel"))
    b = parcels.select(F.col(node).alias("dst"), F.col(parcel).alias("_b"))
    return edges.join(a, "src").join(b, "dst").filter("parcel = _b").select("parcel", "src", "dst")


def breadth_first(edges: DataFrame, roots: DataFrame, max_depth: int | None = None, node: str = "node") -> DataFrame:
    """(node, depth) of all nodes within ``max_depth`` steps of a root; the frontier alone is joined and written each round."""
    found = [written(roots.select(F.col(node).alias("node")).distinct().withColumn("depth", F.lit(0)))]
    out, depth = found[0], 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = found[-1].join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = written(step.join(out.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        found.append(frontier)
        out = out.union(frontier)
    return out


def components_within(edges: DataFrame, labels: DataFrame, min_size: int = 0, node: str = "node", label: str = "label") -> DataFrame:
    """(node, component): components of the edges inside each label, of ``min_size`` nodes at least."""
    inside = parcel_edges(edges, labels.withColumnRenamed(label, "parcel") if label != "parcel" else labels, node)
    out = connected_components(inside.select("src", "dst"), labels.select(F.col(node).alias("node")))
    sizes = out.groupBy("component").count().filter(F.col("count") >= min_size).select("component")
    return out.join(sizes, "component").select("node", "component")


def eroded(cells: DataFrame, axes: list[str]) -> DataFrame:
    """Cells of a volume that have all their neighbours (8 in the plane, 26 in space)."""
    kernel = KERNELS["2D-8n" if len(axes) == 2 else "3D-26n"]
    named = cells.select(*axes).withColumn("node", F.struct(*axes))
    full = lattice_edges(named, axes, "node", kernel).groupBy("src").count().filter(F.col("count") == len(kernel))
    return named.join(full, F.col("node") == F.col("src"), "left_semi").select(*axes)


def mesh_contour(triangles: DataFrame, labels: DataFrame, node: str = "node", label: str = "label") -> DataFrame:
    """Triangles whose corners have different labels."""
    out = triangles
    for c in "abc":
        out = out.join(labels.select(F.col(node).alias(c), F.col(label).alias(f"_{c}")), c)
    return out.filter("_a <> _b OR _b <> _c").select(*triangles.columns)


def largest_component(edges: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """Nodes of the component that has most of them, ties to the one with the smallest node."""
    out = written(connected_components(edges, nodes.select(F.col(node).alias("node"))))
    best = out.groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("component"))  # one row
    return out.join(F.broadcast(best), "component").select(F.col("node").alias(node))


def sub_mesh(coords: DataFrame, triangles: DataFrame, centre: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """Coordinates and triangles of the nodes within ``radius`` steps of ``centre``, numbered anew from 0 in their order."""
    from gridsignal.operators.ranking import global_row_number

    root = coords.sparkSession.createDataFrame([(centre,)], "node long")
    near = breadth_first(mesh_edges(triangles), root, radius)
    new = written(global_row_number(near.select("node"), ["node"], "new"))
    out = triangles
    for c in "abc":
        out = out.join(new.select(F.col("node").alias(c), F.col("new").alias(f"_{c}")), c)
    return coords.join(new, "node").drop("node").withColumnRenamed("new", "node"), out.select(*[F.col(f"_{c}").alias(c) for c in "abc"])


def pooled(edges: DataFrame) -> DataFrame:
    """Edges with their nodes numbered from 0 in the order of the nodes."""
    from gridsignal.operators.ranking import global_row_number

    ends = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    new = written(global_row_number(ends, ["node"], "new"))
    a, b = new.select(F.col("node").alias("src"), F.col("new").alias("_a")), new.select(F.col("node").alias("dst"), F.col("new").alias("_b"))
    return edges.join(a, "src").join(b, "dst").select(F.col("_a").alias("src"), F.col("_b").alias("dst"))


def centred_at(offsets: DataFrame, axes: list[str], place: dict[str, int | Column], shape: dict[str, int], wraps: bool = False) -> DataFrame:
    """Cells of a mask of offsets put at ``place`` (numbers or columns): those inside ``shape``, or at the opposite edge if it ``wraps``."""
    out = offsets
    for a in axes:
        moved = F.col(a) + place[a]
        if wraps:
            moved = F.when(moved < 0, shape[a] - 1).when(moved >= shape[a], 0).otherwise(moved)
        out = out.withColumn(a, moved.cast("int")).filter(F.col(a).between(0, shape[a] - 1))
    return out


def distance(a: list[Column], b: list[Column]) -> Column:
    """Euclidean distance of two places."""
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0)))
