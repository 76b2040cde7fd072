"""Parcellations of volumes and surfaces from features: by agglomeration, by seeds, or by sizes alone.

Cells are rows of places and an array of features. Each connected component of the mask gets its share of the parcels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsignal.operators import graph, parcellation
from gridsignal.operators.agglomeration import ward_spatial
from gridsignal.operators.ranking import global_row_number, number_within
from gridsignal.operators.splitting import balanced_parcels, kernel_for
from gridsignal.session import written
from gridsignal.sources.volumes import load_volumes, write_volumes
from gridsignal.study import Study

AXES = ["x", "y", "z"]
METHODS = ("ward", "balanced")


def shared_out(components: DataFrame, n_parcels: int) -> DataFrame:
    """(component, n_clusters): each component's share of the parcels by its nodes (node, component), one at least."""
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))  # one row
    return sizes.crossJoin(F.broadcast(total)).select("component", F.greatest(F.rint(F.col("n") * n_parcels / F.col("total")), F.lit(1.0)).cast("int").alias("n_clusters"))


def by_features(nodes: DataFrame, edges: DataFrame, n_parcels: int) -> DataFrame:
    """(node, parcel) from 1: connected parcels of like features (node, features), by Ward's criterion."""
    found = written(graph.connected_components(edges, nodes.select("node")))
    own = written(nodes.join(found.withColumnRenamed("component", "parcel"), "node"))
    labels = ward_spatial(own, edges, shared_out(found, n_parcels).withColumnRenamed("component", "parcel"))
    numbers = global_row_number(labels.select("parcel", "label").distinct(), ["parcel", "label"], "number", 1)
    return labels.join(numbers, ["parcel", "label"]).select("node", F.col("number").alias("parcel"))


def with_places(cells: DataFrame, axes: Sequence[str], features: str, weight: float) -> DataFrame:
    """Features with the places added, scaled so that all coordinates together vary by ``weight``."""
    tall = F.array(*[F.col(a).cast("double") for a in axes])
    # one row: the deviation of all coordinates taken together
    spread = cells.select(F.explode(tall).alias("v")).agg(F.stddev_pop("v").alias("_sd"))
    scaled = F.transform(tall, lambda v: v * weight / F.coalesce(F.nullif(F.col("_sd"), F.lit(0.0)), F.lit(1.0)))
    return cells.crossJoin(F.broadcast(spread)).withColumn(features, F.concat(features, scaled) if weight else F.col(features)).drop("_sd")


def parcellate_cells(cells: DataFrame, n_parcels: int, method: str = "ward", weight: float = 10.0, axes: Sequence[str] = tuple(AXES)) -> DataFrame:
    """(axes, parcel) of cells (axes, features). ``ward`` looks at features and, by ``weight``, at places; ``balanced`` at sizes alone."""
    axes = list(axes)
    if method not in METHODS:
        raise ValueError(f"{method!r} is none of {', '.join(METHODS)}")
    if method == "balanced":
        return balanced_parcels(cells, axes, n_parcels)
    named = written(global_row_number(with_places(cells, axes, "features", weight), axes, "node"))
    edges = written(graph.lattice_edges(named, axes, "node", kernel_for(axes)))
    return named.select("node", *axes).join(by_features(named.select("node", "features"), edges, n_parcels), "node").select(*axes, "parcel")


def parcellate_files(spark: SparkSession, features: Sequence[str], mask: str, folder: str, name: str, n_parcels: int, method: str = "ward", weight: float = 10.0) -> DataFrame:
    """Parcels of a mask's cells by several volumes of features, written to ``name.nii``; parcels of one cell become background.

    Returns (x, y, z, parcel) of all the mask's cells.
    """
    space = load_volumes(spark, mask).select(*AXES, (F.col("value") != 0).alias("inside"))
    tall = None
    for i, path in enumerate(features):
        own = load_volumes(spark, path).select(*AXES, F.lit(i).alias("i"), "value")
        tall = own if tall is None else tall.unionByName(own)
    arrays = F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda s: s["value"])
    cells = tall.join(space.filter("inside").select(*AXES), AXES).groupBy(*AXES).agg(arrays.alias("features"))
    return _saved(parcellate_cells(cells, n_parcels, method, weight), space.select(*AXES), folder, name)


def _saved(parcels: DataFrame, space: DataFrame, folder: str, name: str) -> DataFrame:
    parcels = written(parcels)
    large = parcellation.discard_small(parcels, 2).select(*AXES, "parcel")
    out = written(space.join(large, AXES, "left").select(*AXES, F.coalesce("parcel", F.lit(0)).cast("int").alias("parcel")))
    write_volumes(out.withColumn("_item", F.lit(name)), folder, "_item", AXES, "parcel")
    return out


def parcellation_for_study(study: Study, average_size: int = 250, method: str = "ward", contrasts: dict[str, str] | None = None, weight: float = 10.0, **design: float) -> DataFrame:
    """(x, y, z, parcel): parcels of about ``average_size`` voxels that answer alike to the design.

    Features are the levels of the linear model's conditions or, with ``contrasts``, their t. Of several subjects the mean.
    """
    fitted = study.glm(contrasts, **design)
    _, names = study.design(**design)
    n = sum(1 for x in names if not x.startswith("drift"))
    values = F.array(*[F.col(f"t_{k}") for k in contrasts]) if contrasts else F.slice("beta", 1, n)
    tall = fitted.select(*AXES, F.posexplode(values).alias("i", "v")).groupBy(*AXES, "i").agg(F.avg("v").alias("v"))
    cells = tall.groupBy(*AXES).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("features"))
    cells = written(cells)
    return parcellate_cells(cells, max(1, parcellation.round_n_parcels(cells.count() / average_size)), method, weight)


def parcellate_surface(coords: DataFrame, triangles: DataFrame, features: DataFrame, n_parcels: int, weight: float = 10.0) -> DataFrame:
    """(node, parcel) of a mesh's nodes: coords (node, x, y, z), triangles (a, b, c), features (node, features)."""
    edges = written(graph.mesh_edges(triangles))
    nodes = written(with_places(coords.join(features, "node"), AXES, "features", weight).select("node", "features"))
    return by_features(nodes, graph.sub_graph(edges, nodes), n_parcels)


def ranks_in_parcels(parcels: DataFrame, order: Sequence[str] = tuple(AXES)) -> DataFrame:
    """The rows with ``position``, from 0 in their parcel."""
    return number_within(parcels, ["parcel"], list(order), "position")
