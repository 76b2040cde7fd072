"""Nested maps as tables of branches: a row is a leaf, a column a layer.

A tree's layers are columns ``levels`` and its leaf the column ``leaf``, so swapping or rearranging layers is a matter of
column order, and stacking trees is a grouping by branch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def swap_layers(branches: DataFrame, levels: Sequence[str], a: str, b: str) -> DataFrame:
    """Branches with the layers ``a`` and ``b`` in each other's place."""
    other = {a: b, b: a}
    return tree_rearrange(branches, levels, [other.get(x, x) for x in levels])


def tree_rearrange(branches: DataFrame, levels: Sequence[str], new: Sequence[str]) -> DataFrame:
    """Branches with their layers in the order ``new``."""
    if sorted(levels) != sorted(new):
        raise ValueError("the new order must have the same layers")
    return branches.select(*new, *[c for c in branches.columns if c not in levels])


def tree(branches: DataFrame, levels: Sequence[str], leaf: str, keep: int = 1) -> DataFrame:
    """One row for each value of the first ``keep`` layers, with the layers below as nested maps in ``tree``.

    Nesting stops there, so that a whole table never becomes one value. Leaves of one branch must be single.
    """
    if not 1 <= keep < len(levels):
        raise ValueError("one layer at least stays a column, and one is nested")
    out = branches.groupBy(*levels[:-1]).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(levels[-1], leaf)))).alias("tree"))
    for depth in range(len(levels) - 2, keep - 1, -1):
        out = out.groupBy(*levels[:depth]).agg(F.map_from_entries(F.collect_list(F.struct(levels[depth], "tree"))).alias("tree"))
    return out


def stack_trees(trees: Sequence[DataFrame], levels: Sequence[str], leaf: str) -> DataFrame:
    """(levels, leaf): each branch with the list of its leaves over the trees, which must have the same branches."""
    parts = None
    for i, t in enumerate(trees):
        one = t.select(*levels, F.struct(F.lit(i).alias("i"), F.col(leaf).alias("v")).alias("_e"))
        parts = one if parts is None else parts.unionByName(one)
    # as many entries a branch as trees
    return parts.groupBy(*levels).agg(F.transform(F.sort_array(F.collect_list("_e")), lambda e: e["v"]).alias(leaf))


def unstack_trees(stacked: DataFrame, levels: Sequence[str], leaf: str) -> DataFrame:
    """Inverse of ``stack_trees``: one row for each branch and tree (number ``tree``)."""
    return stacked.select(*levels, F.posexplode(leaf).alias("tree", leaf))
