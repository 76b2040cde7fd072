"""Parcellations: tables ``(position, parcel)`` with 0 as background, and what is computed on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsignal.operators.matching import best_matching

#: Seeds that the plan of ``nearest_vector`` may hold.
MOST_SEEDS = 10_000


def parcel_sizes(df: DataFrame, parcel: str = "parcel") -> DataFrame:
    return df.groupBy(parcel).agg(F.count(F.lit(1)).alias("size"))


def parcellation_report(df: DataFrame, parcel: str = "parcel") -> DataFrame:
    """One row: number of parcels, smallest and biggest (id and size), how many are small or big, background size."""
    sizes = parcel_sizes(df, parcel)
    inside = sizes.filter(F.col(parcel) != 0)
    ties = F.struct("size", F.col(parcel))
    rest = sizes.filter(F.col(parcel) == 0).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("background"))
    report = inside.agg(
        F.count(F.lit(1)).alias("n_parcels"),
        F.min("size").alias("min_size"),
        F.max("size").alias("max_size"),
        F.min(ties)[parcel].alias("smallest"),
        F.max(F.struct("size", (-F.col(parcel)).alias("p")))["p"].alias("_big"),
        F.count_if(F.col("size") < 10).alias("below_10"),
        F.count_if(F.col("size") > 400).alias("above_400"),
        F.count_if(F.col("size") > 1000).alias("above_1000"),
    )
    return report.withColumn("biggest", -F.col("_big")).drop("_big").crossJoin(rest)  # one row each


def discard_small(df: DataFrame, min_size: int, parcel: str = "parcel") -> DataFrame:
    """Rows of parcels with ``min_size`` rows at least; sizes are aggregated first, so a large parcel is never in one task."""
    keep = parcel_sizes(df, parcel).filter(F.col("size") >= min_size).select(parcel)
    return df.join(keep, parcel, "left_semi")


def discard_parcels(df: DataFrame, parcels: Sequence, parcel: str = "parcel") -> DataFrame:
    return df.filter(~F.col(parcel).isin(list(parcels)))


def keep_parcels(df: DataFrame, parcels: Sequence, parcel: str = "parcel", renumber: bool = False) -> DataFrame:
    """Rows of the listed parcels, optionally renumbered from 1 in the order listed."""
    out = df.filter(F.col(parcel).isin(list(parcels)))
    return out.withColumn(parcel, F.array_position(F.array(*[F.lit(p) for p in parcels]), F.col(parcel)).cast("int")) if renumber else out


def intersection_matrix(a: DataFrame, b: DataFrame, position: list[str], parcel: str = "parcel") -> DataFrame:
    """(i, j, n): positions with label i in ``a`` and j in ``b``."""
    both = a.select(*position, F.col(parcel).alias("i")).join(b.select(*position, F.col(parcel).alias("j")), position)
    return both.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))


def matched_parcels(a: DataFrame, b: DataFrame, position: list[str], parcel: str = "parcel") -> DataFrame:
    """(i, j, n): which parcel of ``b`` goes with which of ``a``, so that most positions agree; background goes with none."""
    return best_matching(intersection_matrix(a, b, position, parcel).filter("i <> 0 AND j <> 0"))


def parcellation_distance(a: DataFrame, b: DataFrame, position: list[str], parcel: str = "parcel", mask: DataFrame | None = None) -> int:
    """Fewest positions to remove so that the partitions agree, among those outside ``a``'s background or, with ``mask``
    (the position's columns), among its positions."""
    inside = a.filter(F.col(parcel) != 0) if mask is None else a.join(mask.select(*position).distinct(), position, "left_semi")
    agreed = matched_parcels(inside, b, position, parcel).agg(F.sum("n")).first()[0] or 0
    return inside.count() - agreed


def aligned(a: DataFrame, b: DataFrame, position: list[str], parcel: str = "parcel") -> DataFrame:
    """``b`` with the numbers of the parcels of ``a`` that its parcels go with; parcels that go with none become background."""
    pairs = matched_parcels(a, b, position, parcel).select(F.col("j").alias(parcel), F.col("i").alias("_to"))
    return b.join(pairs, parcel, "left").select(*[F.coalesce("_to", F.lit(0)).cast(b.schema[parcel].dataType).alias(parcel) if c == parcel else F.col(c) for c in b.columns])


def check_parcellations_agree(a: DataFrame, b: DataFrame, position: list[str], tolerance: int = 0, parcel: str = "parcel", allowed: DataFrame | None = None) -> None:
    """Raise unless at most ``tolerance`` positions differ or, with ``allowed`` (positions), none but those do."""
    if allowed is None:
        far = parcellation_distance(a, b, position, parcel)
        if far > tolerance:
            raise AssertionError(f"{far} positions differ, {tolerance} may")
        return
    inside = a.filter(F.col(parcel) != 0)
    same = aligned(inside, b, position, parcel).select(*position, F.col(parcel).alias("_other"))
    apart = inside.join(same, position, "left").filter(F.coalesce(F.col("_other") != F.col(parcel), F.lit(True)))
    far = apart.join(allowed.select(*position), position, "left_anti").count()
    if far:
        raise AssertionError(f"{far} positions differ that may not")


def voronoi(df: DataFrame, coords: list[str], seeds: list[tuple], label: str = "parcel") -> DataFrame:
    """Label (from 1) of the nearest seed, ties to the first; the seeds are part of the plan, so nothing is joined."""
    far: list[Column] = [sum((F.col(c) - F.lit(x)) ** 2 for c, x in zip(coords, s, strict=True)) for s in seeds]
    distances = F.array(*far)
    return df.withColumn(label, F.array_position(distances, F.array_min(distances)).cast("int"))


def nearest_vector(df: DataFrame, vector: str, seeds: DataFrame, seed_id: str, label: str = "seed") -> DataFrame:
    """Id of the seed vector with the least squared distance, ties to the smaller id. ``seeds`` become part of the plan, so
    there may be ``MOST_SEEDS`` at most."""
    few = seeds.select(seed_id, vector).limit(MOST_SEEDS + 1).collect()
    if len(few) > MOST_SEEDS:
        raise ValueError(f"more than {MOST_SEEDS} seeds")
    rows = sorted((r[seed_id], [float(x) for x in r[vector]]) for r in few)
    array = F.array(*[F.array(*[F.lit(x) for x in v]) for _, v in rows])
    distances = F.transform(array, lambda s: F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), s, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x))
    ids = F.array(*[F.lit(i) for i, _ in rows]).cast(f"array<{dict(seeds.dtypes)[seed_id]}>")
    return df.withColumn("_d", distances).withColumn(label, F.element_at(ids, F.array_position("_d", F.array_min("_d")).cast("int"))).drop("_d")


def merge_small(df: DataFrame, edges: DataFrame, min_size: int, node: str = "node", parcel: str = "parcel") -> DataFrame:
    """Parcels of at most ``min_size`` nodes join the neighbour they share most edges with, the smallest of all first.

    Background neither joins nor is joined. A small parcel that comes before all its small neighbours isn't touched by
    other moves until its turn, so all such parcels move in one round. Rounds work on the table of parcels and their
    shared edges, and go on until no small parcel has a neighbour. ``edges`` holds both directions.
    """
    from gridsignal.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    nodes = df.select(node, parcel)
    a = nodes.select(F.col(node).alias("src"), F.col(parcel).alias("p"))
    b = nodes.select(F.col(node).alias("dst"), F.col(parcel).alias("q"))
    links = edges.join(a, "src").join(b, "dst").filter("p <> q AND p <> 0 AND q <> 0").groupBy("p", "q").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    sizes = parcel_sizes(nodes, parcel).select(F.col(parcel).alias("p"), "size").filter("p <> 0").checkpoint()
    owner = sizes.select("p", F.col("p").alias("now")).checkpoint()
    while True:
        small = sizes.filter(F.col("size") <= min_size)
        near = links.join(small, "p").join(small.select(F.col("p").alias("q"), F.col("size").alias("q_size")), "q", "left")
        leads = F.col("q_size").isNull() | (F.struct("size", "p") < F.struct(F.col("q_size").alias("size"), F.col("q").alias("p")))
        moves = near.groupBy("p").agg(F.max_by("q", F.struct("n", -F.col("q"))).alias("to"), F.bool_and(leads).alias("leads")).filter("leads").select("p", "to").checkpoint()
        if moves.isEmpty():
            break
        to_q = moves.select(F.col("p").alias("q"), F.col("to").alias("q_to"))
        moved = links.join(moves, "p", "left").join(to_q, "q", "left").select(F.coalesce("to", "p").alias("p"), F.coalesce("q_to", "q").alias("q"), "n")
        links = moved.filter("p <> q").groupBy("p", "q").agg(F.sum("n").alias("n")).checkpoint()
        sizes = sizes.join(moves, "p", "left").groupBy(F.coalesce("to", "p").alias("p")).agg(F.sum("size").alias("size")).checkpoint()
        owner = owner.join(moves.select(F.col("p").alias("now"), "to"), "now", "left").select("p", F.coalesce("to", "now").alias("now")).checkpoint()
    return nodes.join(owner.withColumnRenamed("p", parcel), parcel, "left").select(node, F.coalesce("now", parcel).alias(parcel))


def round_n_parcels(n: int) -> int:
    """To hundreds, tens or units, by size."""
    step = 100 if n >= 100 else 10 if n >= 10 else 1
    return int(round(n / step) * step)


def rounded_count(n: Column) -> Column:
    """``round_n_parcels`` of a column."""
    step = F.when(n >= 100, 100).when(n >= 10, 10).otherwise(1)
    return (F.rint(n / step) * step).cast("long")


def with_ranks(df: DataFrame, parcel: str, order: list[str]) -> DataFrame:
    """Add ``rank`` (from 1) of each row in its parcel."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(parcel).orderBy(*order)))
