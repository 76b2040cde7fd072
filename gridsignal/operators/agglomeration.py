"""Ward's clustering where only neighbouring clusters may merge, by reciprocal nearest neighbours.

The tree is built on a table of clusters (size, sum of features) and one of neighbouring clusters. In each round every
cluster names its cheapest neighbour, and all pairs that name each other merge at once; a merge's height is the rise of the
squared error, or its parts' height if that is larger. The tree of a graph is then cut: of n nodes in k clusters, the
n - k lowest merges are made. Rounds go on until no cluster has a neighbour, about the logarithm of the nodes many on
ordinary features. Merges of one round don't depend on each other, so the tree is that of merging the cheapest pair of
all, one by one, as long as no merge brings a third cluster nearer than both its parts were (it can where that cluster was a
neighbour of one part only).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsignal.operators.graph import connected_components
from gridsignal.operators.ranking import global_row_number
from gridsignal.session import written


def rise(n1: str, s1: str, n2: str, s2: str):
    """What merging two clusters adds to the squared error."""
    gap = F.aggregate(F.zip_with(s1, s2, lambda a, b: (a / F.col(n1) - b / F.col(n2)) * (a / F.col(n1) - b / F.col(n2))), F.lit(0.0), lambda t, x: t + x)
    return F.col(n1) * F.col(n2) / (F.col(n1) + F.col(n2)) * gap


def ward_merges(nodes: DataFrame, edges: DataFrame, features: str = "features") -> DataFrame:
    """(parcel, a, b, height): the merges of each parcel's tree; a and b are nodes of the two clusters.

    ``nodes``: parcel, node (whole number, of one parcel only), features (array of double); ``edges``: src, dst, in both
    directions, inside parcels. A cluster is named by its least node. Nodes with null features take no part.
    """
    own = nodes.select("parcel", F.col("node").alias("c"), F.lit(1.0).alias("n"), F.col(features).cast("array<double>").alias("s"), F.lit(0.0).alias("h"))
    now = written(own.filter(F.col("c").isNotNull() & F.col("s").isNotNull() & F.forall("s", lambda x: x.isNotNull())))
    keys = now.select("c")
    links = edges.select(F.col("src").alias("c"), F.col("dst").alias("d")).filter("c <> d").distinct()
    links = written(links.join(keys, "c", "left_semi").join(keys.withColumnRenamed("c", "d"), "d", "left_semi").select("c", "d"))
    merges: list[DataFrame] = []
    while not links.isEmpty():
        a = now.select("parcel", "c", F.col("n").alias("n1"), F.col("s").alias("s1"), F.col("h").alias("h1"))
        b = now.select(F.col("c").alias("d"), F.col("n").alias("n2"), F.col("s").alias("s2"), F.col("h").alias("h2"))
        priced = links.join(a, "c").join(b, "d")
        # both ends see the same order: cost, then the pair
        order = F.struct(rise("n1", "s1", "n2", "s2").alias("cost"), F.least("c", "d").alias("x"), F.greatest("c", "d").alias("y"))
        nearest = priced.groupBy("c").agg(F.min(F.struct(order.alias("o"), "parcel", "h1", "h2")).alias("m"))
        pairs = nearest.select("c", "m.*").select("c", "parcel", "o.*", "h1", "h2")
        again = pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("k"), F.first("parcel").alias("parcel"), F.max(F.greatest("cost", "h1", "h2")).alias("height"))
        merged = written(again.filter("k = 2").select("parcel", F.col("x").alias("a"), F.col("y").alias("b"), "height"))
        merges.append(merged)
        gone = merged.select(F.col("b").alias("c"), F.col("a").alias("to"))
        moved = now.join(gone, "c", "left").select("parcel", F.coalesce("to", "c").alias("c"), "n", "s", "h")
        # two rows a merged cluster
        sums = moved.groupBy("parcel", "c").agg(F.sum("n").alias("n"), F.collect_list("s").alias("ss"))
        total = F.aggregate(F.slice("ss", 2, 1), F.get("ss", F.lit(0)), lambda t, s: F.zip_with(t, s, lambda x, y: x + y))
        heights = merged.select(F.col("a").alias("c"), F.col("height").alias("_h"))
        old = now.select("c", F.col("h").alias("_old"))
        now = written(sums.join(heights, "c", "left").join(old, "c").select("parcel", "c", "n", total.alias("s"), F.coalesce("_h", "_old").alias("h")))
        ends = links.join(gone, "c", "left").select(F.coalesce("to", "c").alias("c"), "d")
        ends = ends.join(gone.select(F.col("c").alias("d"), "to"), "d", "left").select("c", F.coalesce("to", "d").alias("d"))
        links = written(ends.filter("c <> d").distinct())
    out = own.select("parcel", F.col("c").alias("a"), F.col("c").alias("b"), F.col("h").alias("height")).limit(0)
    for m in merges:
        out = out.unionByName(m)
    return out


def ward_spatial(nodes: DataFrame, edges: DataFrame, n_clusters: int | DataFrame, features: str = "features") -> DataFrame:
    """(parcel, node, label): each parcel's nodes in ``n_clusters`` connected clusters, labels from 1 by their least node.

    ``n_clusters``: a number, or a table (parcel, n_clusters). A parcel in more components than ``n_clusters`` has a cluster for each of them; one of fewer nodes has each alone.
    """
    return ward_cut(nodes, ward_merges(nodes, edges, features), n_clusters)


def ward_cut(nodes: DataFrame, merges: DataFrame, n_clusters: int | DataFrame) -> DataFrame:
    """(parcel, node, label) after each parcel's lowest merges."""
    sizes = nodes.groupBy("parcel").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("k", F.lit(n_clusters)) if isinstance(n_clusters, int) else sizes.join(n_clusters.select("parcel", F.col("n_clusters").alias("k")), "parcel")
    ranked = written(global_row_number(merges, ["parcel", "height", "a", "b"], "at"))
    first = ranked.groupBy("parcel").agg(F.min("at").alias("first"))
    made = ranked.join(first, "parcel").join(sizes, "parcel").filter(F.col("at") - F.col("first") < F.col("n") - F.col("k"))
    found = connected_components(made.select(F.col("a").alias("src"), F.col("b").alias("dst")), nodes.select("node"))
    named = written(nodes.select("parcel", "node").join(found, "node"))
    numbered = written(global_row_number(named.select("parcel", "component").distinct(), ["parcel", "component"], "at"))
    start = numbered.groupBy("parcel").agg(F.min("at").alias("first"))
    labels = numbered.join(start, "parcel").select("component", (F.col("at") - F.col("first") + 1).cast("int").alias("label"))
    return named.join(labels, "component").select("parcel", "node", "label")
