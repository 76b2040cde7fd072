"""Cutting parcels into connected pieces of nearly equal size, by competing fronts.

A parcel's connected components are cut one by one. A component of bounded size is a patch, and one task cuts it
(``fronts.py``). A larger one is first shared among fronts by joins and groupings: a front starts as a run of the component's
cells along a path that goes back and forth through its box; where a run falls apart, the front keeps its largest part and
the other cells are free; then fronts take free neighbours, the poorest front first, until none is left. Each front is a
connected patch of about the bounded size, and has its share of the parts. Where the parts themselves are larger than that, the
fronts are the parts, and rich ones hand border cells to poorer neighbours: only cells whose neighbours inside the front hang
together without them, and a front takes part in one move a round, so every piece stays connected. These rounds go on until
sizes differ by one at most, or until a number of rounds have brought them no nearer to that.

So no task holds more than a patch, whatever a parcel's size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsignal.operators.fronts import even_parts
from gridsignal.operators.graph import KERNELS, connected_components, lattice_edges, parcel_edges
from gridsignal.operators.ranking import global_row_number
from gridsignal.session import written

#: Rounds of exchange that may pass without coming nearer to even sizes, and cells of a patch, about.
PATIENCE, PATCH = 4, 16_384


def kernel_for(axes: list[str]) -> list[tuple[int, ...]]:
    """Neighbours along each axis."""
    if len(axes) == 2:
        return KERNELS["2D-4n"]
    return [tuple(s if i == j else 0 for j in range(len(axes))) for i in range(len(axes)) for s in (-1, 1)]


def back_and_forth(axes: list[Column]) -> list[Column]:
    """Keys of a path through a box whose neighbours are cells next to each other: each axis turns round at its ends."""
    keys, turns = [axes[0]], axes[0]
    for a in axes[1:]:
        keys.append(F.when(F.pmod(turns, F.lit(2)) == 0, a).otherwise(-a))
        turns = turns + a
    return keys


def runs_of(cells: DataFrame, axes: list[str]) -> DataFrame:
    """node, component, front: runs of equal length along the path, the component's longest axis first. Has ``parts``, ``size``."""
    spans = cells.groupBy("component").agg(*[(F.max(a) - F.min(a)).alias(f"_s{i}") for i, a in enumerate(axes)])
    order = F.sort_array(F.array(*[F.struct((-F.col(f"_s{i}")).cast("double").alias("s"), F.lit(i + 1).alias("i")) for i in range(len(axes))]))
    placed = cells.join(spans.select("component", order.alias("_order")), "component")
    side = F.array(*[F.col(a).cast("long") for a in axes])
    along = [F.element_at(side, F.element_at("_order", i + 1)["i"]) for i in range(len(axes))]
    keys = back_and_forth(along)
    placed = placed.select("node", "component", "parts", "size", *[k.alias(f"_k{i}") for i, k in enumerate(keys)])
    ranked = written(global_row_number(placed, ["component", *[f"_k{i}" for i in range(len(keys))], "node"], "_rank"))
    first = ranked.groupBy("component").agg(F.min("_rank").alias("_first"))
    return ranked.join(first, "component").select("node", "component", F.expr("(_rank - _first) * parts div size").alias("front"))


def whole_fronts(fronts: DataFrame, edges: DataFrame) -> DataFrame:
    """Each front keeps its largest connected part, ties to the one with the least node; other cells have no front."""
    inside = fronts.withColumn("parcel", F.struct("component", "front"))
    parts = connected_components(parcel_edges(edges, inside).select("src", "dst"), fronts.select("node")).withColumnRenamed("component", "_part")
    named = written(fronts.join(parts, "node"))
    sizes = named.groupBy("component", "front", "_part").agg(F.count(F.lit(1)).alias("n"))
    kept = sizes.groupBy("component", "front").agg(F.max_by("_part", F.struct("n", -F.col("_part"))).alias("_kept"))
    return named.join(kept, ["component", "front"]).select("node", "component", F.when(F.col("_part") == F.col("_kept"), F.col("front")).alias("front"))


def grown(fronts: DataFrame, edges: DataFrame) -> DataFrame:
    """Fronts take free neighbours in rounds, the poorest front first, until no cell is free."""
    now = written(fronts)
    while not now.filter("front IS NULL").isEmpty():
        sizes = now.filter("front IS NOT NULL").groupBy("component", "front").agg(F.count(F.lit(1)).alias("n"))
        held = now.filter("front IS NOT NULL").join(sizes, ["component", "front"]).select(F.col("node").alias("dst"), "front", "n")
        free = now.filter("front IS NULL").select(F.col("node").alias("src"))
        taken = edges.join(free, "src").join(held, "dst").groupBy(F.col("src").alias("node")).agg(F.min_by("front", F.struct("n", "front")).alias("_to"))
        now = written(now.join(taken, "node", "left").select("node", "component", F.coalesce("front", "_to").alias("front")))
    return now


def with_sizes(now: DataFrame) -> DataFrame:
    """The cells with ``n``, their front's size."""
    return now.join(now.groupBy("component", "front").agg(F.count(F.lit(1)).alias("n")), ["component", "front"])


def uneven(sized: DataFrame) -> DataFrame:
    """component, spread (sum of squared sizes) of the components whose fronts differ by more than a cell."""
    spread = sized.groupBy("component").agg(F.max("n").alias("_hi"), F.min("n").alias("_lo"), F.sum("n").alias("spread"))
    return spread.filter("_hi - _lo > 1").select("component", "spread")


def loose(inside: DataFrame, givers: DataFrame) -> DataFrame:
    """The nodes of ``givers`` whose neighbours inside their front hang together without them.

    ``inside``: edges with both ends in one front. Two neighbours hang together if a third cell of the front is next to
    both, or if they are next to each other.
    """
    near = inside.join(givers.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("src").alias("c"), F.col("dst").alias("x"))
    beyond = near.join(inside.select(F.col("src").alias("x"), F.col("dst").alias("z")), "x").filter("z <> c")
    direct = beyond.join(near.select("c", F.col("x").alias("z")), ["c", "z"]).select("c", F.array("x", "z").alias("group"))
    groups = beyond.groupBy("c", "z").agg(F.collect_set("x").alias("group")).select("c", "group").unionByName(direct)
    # a cell has as many neighbours as the kernel: these arrays are small
    groups = groups.groupBy("c").agg(F.collect_list("group").alias("groups"))
    own = near.groupBy("c").agg(F.collect_set("x").alias("xs")).join(groups, "c", "left")
    step = lambda have: F.aggregate(F.coalesce("groups", F.array().cast("array<array<long>>")), have, lambda a, g: F.when(F.arrays_overlap(a, g), F.array_union(a, g)).otherwise(a))
    reached = F.aggregate("xs", F.slice("xs", 1, 1), lambda have, _: step(have))
    return own.filter(F.size(F.array_intersect(reached, F.col("xs"))) == F.size("xs")).select(F.col("c").alias("node"))


def moves_of(sized: DataFrame, edges: DataFrame, tried: int) -> DataFrame:
    """(node, _to): the cells that change their front in this round, at most one in which a front takes part."""
    a = sized.select(F.col("node").alias("src"), "component", "front", "n")
    b = sized.select(F.col("node").alias("dst"), F.col("component").alias("_c"), F.col("front").alias("to"), F.col("n").alias("to_n"))
    met = edges.join(a, "src").join(b, "dst").filter("component = _c").drop("_c")
    chance = F.xxhash64("src", "dst", F.lit(tried))
    # a difference of one is only swapped, which moves it on to other neighbours
    border = met.filter("front <> to AND n > to_n").select(F.col("src").alias("node"), "component", "front", "to", (F.col("n") - F.col("to_n")).alias("gap"), chance.alias("chance"))
    safe = loose(met.filter("front = to").select("src", "dst"), border.select("node").distinct())
    gives = border.join(safe, "node", "left_semi").groupBy("component", "front").agg(F.max(F.struct("gap", "chance", "node", "to")).alias("rank"))
    # one row a front
    gives = written(gives.select("component", "front", F.col("rank.node").alias("node"), F.col("rank.to").alias("to"), "rank"))
    ends = gives.select("component", "front", "rank").unionByName(gives.select("component", F.col("to").alias("front"), "rank"))
    top = ends.groupBy("component", "front").agg(F.max("rank").alias("top"))
    moves = gives.join(top, ["component", "front"]).filter("rank = top").drop("top")
    return moves.join(top.select("component", F.col("front").alias("to"), "top"), ["component", "to"]).filter("rank = top").select("node", F.col("to").alias("_to"))


def exchanged(now: DataFrame, edges: DataFrame, patience: int = PATIENCE) -> DataFrame:
    """Rich fronts hand loose border cells to poorer neighbours until sizes are even, or no round has helped for ``patience`` rounds."""
    best: tuple[int, int] | None = None
    done: list[DataFrame] = []
    tried, stalled = 0, 0
    while True:
        sized = written(with_sizes(now))
        open_ = uneven(sized)
        total = open_.agg(F.count(F.lit(1)).alias("n"), F.sum("spread").alias("spread")).first()
        found = (total["n"], total["spread"] or 0)
        stalled = 0 if best is None or found < best else stalled + 1
        best = found if best is None else min(best, found)
        if not total["n"] or stalled > patience:
            done.append(sized)
            break
        done.append(sized.join(open_, "component", "left_anti"))
        work = sized.join(open_, "component", "left_semi")
        now = work.join(moves_of(work, edges, tried), "node", "left").select("node", "component", F.coalesce("_to", "front").alias("front"))
        tried += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("node", "component", "front")


def fronts_of(nodes: DataFrame, edges: DataFrame, axes: list[str], kernel: list[tuple[int, ...]]) -> DataFrame:
    """node, component, front (from 0) of ``nodes`` (node, component, parts, axes): each component in ``parts`` connected fronts.

    ``edges``: both directions, inside components. A component in one part has the front 0.
    """
    sizes = nodes.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    wide = F.ceil(F.col("size") / PATCH).cast("long")
    sized = written(nodes.join(sizes, "component").withColumn("parts", F.least("parts", "size").cast("long")).withColumn("patches", F.least("parts", wide)))
    own = sized.select("node", "component", "parts", "size", *axes)
    out = own.filter("parts <= 1").select("node", "component", F.lit(0).cast("long").alias("front"))
    patches = sized.filter("parts > 1 AND patches = 1").select(*own.columns, F.lit(0).cast("long").alias("patch"))
    large = sized.filter("parts > 1 AND patches > 1")
    if not large.isEmpty():
        inside = written(edges.join(large.select(F.col("node").alias("src")), "src", "left_semi"))
        runs = runs_of(large.select("node", "component", F.col("patches").alias("parts"), "size", *axes), axes)
        shared = written(grown(written(whole_fronts(runs, inside)), inside))
        counts = large.groupBy("component").agg(F.first("parts").alias("parts"), F.first("patches").alias("patches"), F.first("size").alias("size"))
        whole = shared.join(counts.filter("parts = patches").select("component"), "component", "left_semi")
        # parts larger than a patch
        out = out.unionByName(exchanged(whole, inside).select("node", "component", "front")) if not whole.isEmpty() else out
        finer = shared.join(counts.filter("parts > patches"), "component").join(large.select("node", *axes), "node")
        own_sizes = finer.groupBy("component", "front").agg(F.count(F.lit(1)).alias("n"))
        quota = F.greatest(F.rint(F.col("parts") * F.col("n") / F.col("size")).cast("long"), F.lit(1))
        finer = finer.join(own_sizes, ["component", "front"]).select("node", "component", quota.alias("parts"), "size", *axes, F.col("front").alias("patch"))
        patches = patches.unionByName(finer)

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        labels = even_parts(rows[axes].to_numpy().astype(np.int64), kernel, int(rows["parts"].iloc[0]))
        return pd.DataFrame({"node": rows["node"], "component": rows["component"], "patch": rows["patch"], "label": labels})

    done = written(patches.groupBy("component", "patch").applyInPandas(cut, "node long, component long, patch long, label long"))
    # a patch's fronts come after those of the ones before it
    found = done.select("component", "patch", "label").distinct()
    numbered = global_row_number(found, ["component", "patch", "label"], "front")
    return out.unionByName(done.join(numbered, ["component", "patch", "label"]).select("node", "component", "front"))


def in_components(cells: DataFrame, axes: list[str], kernel: list[tuple[int, ...]]) -> tuple[DataFrame, DataFrame]:
    """The cells (parcel, axes) with ``node`` and ``component``, and the edges inside parcels."""
    named = written(global_row_number(cells, ["parcel", *axes], "node"))
    places = named.select("node", *axes, "parcel")
    edges = written(parcel_edges(lattice_edges(places, axes, "node", kernel), places).select("src", "dst"))
    return written(named.join(connected_components(edges, named.select("node")), "node")), edges


def split_parcels(cells: DataFrame, axes: list[str], parts: DataFrame, parcel: str = "parcel", kernel: list[tuple[int, ...]] | None = None, by_size: int | None = None) -> DataFrame:
    """``cells`` (axes, parcel) with ``piece`` (from 1 in each parcel): connected pieces of nearly equal size.

    ``parts``: parcel, n_parts. A parcel of several components shares its parts among them by size, one each at least, so it
    has more pieces than asked for if it has more components; with ``by_size``, a component of a listed parcel has as few
    parts as hold it at that size. Parcels that ``parts`` lacks stay whole (piece 1), as do rows without parcel or
    coordinate; no row is lost. Axes hold whole numbers.
    """
    whole = F.col(parcel).isNotNull()
    for a in axes:
        whole = whole & F.col(a).isNotNull()
    listed = parts.select(F.col(parcel).alias("parcel"), F.col("n_parts").cast("long").alias("_k")).filter("_k >= 1")
    # names of their own, so that no column of the cells gets in the way
    sides = [f"x{i}" for i in range(len(axes))]
    packed = cells.select(F.col(parcel).alias("parcel"), *[F.col(a).cast("long").alias(s) for a, s in zip(axes, sides, strict=True)], F.struct(*cells.columns).alias("_row"), whole.alias("_whole"))
    work = packed.filter("_whole").drop("_whole").join(listed.select("parcel"), "parcel", "left_semi")
    rest = packed.filter("NOT _whole").unionByName(packed.filter("_whole").join(listed.select("parcel"), "parcel", "left_anti").select(packed.columns))
    rest = rest.select("_row.*", F.lit(1).cast("long").alias("piece"))
    if work.isEmpty():
        return rest
    named, edges = in_components(work, sides, kernel or kernel_for(axes))
    sizes = named.groupBy("parcel", "component").agg(F.count(F.lit(1)).alias("_n"))
    totals = sizes.groupBy("parcel").agg(F.sum("_n").alias("_total")).join(listed, "parcel")
    share = F.ceil(F.col("_n") / by_size) if by_size else F.greatest(F.rint(F.col("_k") * F.col("_n") / F.col("_total")), F.lit(1.0))
    quotas = sizes.join(totals, "parcel").select("component", share.cast("long").alias("parts"))
    nodes = named.join(quotas, "component").select("node", "component", "parts", *sides)
    fronts = written(fronts_of(nodes, edges, sides, kernel or kernel_for(axes)))
    out = named.drop("component").join(fronts, "node")
    labels = out.select("parcel", "component", "front").distinct()
    numbered = written(global_row_number(labels, ["parcel", "component", "front"], "_place"))
    first = numbered.groupBy("parcel").agg(F.min("_place").alias("_first"))
    pieces = numbered.join(first, "parcel").select("component", "front", (F.col("_place") - F.col("_first") + 1).alias("piece"))
    return out.join(pieces, ["component", "front"]).select("_row.*", "piece").unionByName(rest)


def renumbered(pieces: DataFrame, parcel: str = "parcel") -> DataFrame:
    """Pieces as parcels of their own: the first keeps its parcel's number, others get new ones above the largest."""
    more = global_row_number(pieces.filter("piece > 1").select(parcel, "piece").distinct(), [parcel, "piece"], "_new", 1)
    largest = pieces.agg(F.max(parcel).alias("_max"))  # one row
    named = more.crossJoin(F.broadcast(largest)).select(parcel, "piece", (F.col("_max") + F.col("_new")).alias("_label"))
    out = pieces.join(named, [parcel, "piece"], "left")
    return out.select(*[F.coalesce("_label", parcel).alias(c) if c == parcel else F.col(c) for c in pieces.columns if c != "piece"])


def split_big_parcels(cells: DataFrame, axes: list[str], max_size: int = 400, parcel: str = "parcel", background: int = 0) -> DataFrame:
    """Parcels of more than ``max_size`` cells in connected pieces, for each component as few as hold it at that size.

    Background and rows without parcel stay. A front that exchange leaves above ``max_size`` is cut again.
    """
    now = cells
    while True:
        sizes = now.filter(F.col(parcel) != background).groupBy(parcel).agg(F.count(F.lit(1)).alias("n"))
        parts = written(sizes.filter(F.col("n") > max_size).select(parcel, F.ceil(F.col("n") / max_size).alias("n_parts")))
        if parts.isEmpty():
            return now
        now = written(renumbered(split_parcels(now, axes, parts, parcel, by_size=max_size), parcel))


def balanced_parcels(cells: DataFrame, axes: list[str], n_parcels: int, kernel: list[tuple[int, ...]] | None = None) -> DataFrame:
    """(axes, parcel): the cells' connected components, each cut into its share of ``n_parcels``, one at least; from 1."""
    one = cells.select(*axes).withColumn("parcel", F.lit(1).cast("long"))
    parts = cells.sparkSession.createDataFrame([(1, n_parcels)], "parcel long, n_parts long")
    return split_parcels(one, axes, parts, kernel=kernel).select(*axes, F.col("piece").alias("parcel"))
