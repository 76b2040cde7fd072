"""File series, nested maps, names and small text functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def file_series(files: DataFrame, name: str = "name", others: bool = False) -> DataFrame:
    """(prefix, ext, number) of names that end in a number, a dot and an extension, such as ``nii`` or ``nii.gz``.

    Names without such a number belong to no series: they are left out or, with ``others``, kept with a null number, split
    at their last dot.
    """
    text = F.col(name)
    # fixed values: an extension consists of letters, dots and ~
    tail = F.regexp_extract(text, r"[a-zA-Z~.]*\z", 0)
    stem = F.left(text, F.length(text) - F.length(tail))
    digits = F.regexp_extract(stem, r"[0-9]*\z", 0)
    prefix = F.left(stem, F.length(stem) - F.length(digits))
    numbered = (digits != "") & tail.startswith(".")
    found = files.filter(numbered).select(prefix.alias("prefix"), F.substring(tail, 2, 1 << 20).alias("ext"), digits.cast("long").alias("number"))
    if not others:
        return found
    ext = F.regexp_extract(text, r"(?s)[^/.][^/]*?([.][^./]*)\z", 1)
    rest = files.filter(~numbered).select(F.left(text, F.length(text) - F.length(ext)).alias("prefix"), F.substring(ext, 2, 1 << 20).alias("ext"), F.lit(None).cast("long").alias("number"))
    return found.unionByName(rest)


def condensed(numbers: DataFrame, by: list[str], number: str = "number") -> DataFrame:
    """(by, first, last, n): runs of consecutive numbers."""
    order = Window.partitionBy(*by).orderBy(number)
    island = F.col(number) - F.row_number().over(order)
    return numbers.select(*by, number).distinct().withColumn("_i", island).groupBy(*by, "_i").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count(F.lit(1)).alias("n")).drop("_i")


def missing(numbers: DataFrame, by: list[str], number: str = "number") -> DataFrame:
    """(by, n_missing): how many numbers between the first and the last are not there."""
    return numbers.select(*by, number).distinct().groupBy(*by).agg((F.max(number) - F.min(number) + 1 - F.count(F.lit(1))).alias("n_missing"))


def duplicates(values: DataFrame, position: str, value: str) -> DataFrame:
    """(value, positions): where repeated values stand, an array a value; ``duplicate_rows`` where a value may be frequent."""
    more = values.groupBy(value).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(value)
    return values.join(more, value, "left_semi").groupBy(value).agg(F.sort_array(F.collect_list(position)).alias("positions"))


def duplicate_rows(values: DataFrame, position: str, value: str) -> DataFrame:
    """(value, position, n): the rows whose value occurs n > 1 times, one row each, so a frequent value is in no array."""
    more = values.groupBy(value).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return values.select(value, position).join(more, value).select(value, position, "n")


def cartesian(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All combinations of small argument tables."""
    for other in others:
        first = first.crossJoin(other)
    return first


def get_leaf(tree: Column, *path: str) -> Column:
    for key in path:
        tree = F.try_element_at(tree, F.lit(key))
    return tree


def set_leaf(tree: Column, key: str, leaf: Column) -> Column:
    return F.map_concat(F.map_filter(tree, lambda k, _: k != key), F.create_map(F.lit(key), leaf))


def apply_to_leaves(tree: Column, how) -> Column:
    return F.transform_values(tree, lambda _, v: how(v))


def branches(tree: DataFrame, column: str, levels: list[str], leaf: str = "leaf") -> DataFrame:
    """One row for each path of nested maps."""
    out = tree.select(F.col(column).alias("_t"))
    for i, name in enumerate(levels):
        out = out.select(*levels[:i], F.explode("_t").alias(name, "_t"))
    return out.withColumnRenamed("_t", leaf)


def add_suffix(name: Column, suffix: str) -> Column:
    """Before the extension; ``.gz`` is part of it."""
    whole = r"^(.*?)((?:\.[^./]+)(?:\.gz)?|)$"
    return F.concat(F.regexp_extract(name, whole, 1), F.lit(suffix), F.regexp_extract(name, whole, 2))


def add_prefix(name: Column, prefix: str) -> Column:
    return F.concat(F.regexp_extract(name, r"^(.*/)?", 0), F.lit(prefix), F.regexp_replace(name, r"^.*/", ""))


def has_ext(name: Column, ext: str) -> Column:
    return name.endswith(f".{ext}") | name.endswith(f".{ext}.gz")


def replace_ext(name: Column, ext: str) -> Column:
    return F.concat(F.regexp_replace(name, r"\.[^./]*(\.gz)?$", ""), F.lit(f".{ext}"))


def format_duration(seconds: Column) -> Column:
    """``1H2min3.000sec``; leading units that are 0 are left out."""
    hours, minutes = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60)
    head = F.concat(F.when(hours > 0, F.format_string("%dH", hours)).otherwise(""), F.when((hours > 0) | (minutes > 0), F.format_string("%dmin", minutes)).otherwise(""))
    return F.concat(head, F.format_string("%.3fsec", seconds % 60))


def pairs_in_grid(a: Column, b: Column) -> Column:
    """a + b + 2 (a - 1)(b - 1) - 2: pairs of neighbours in a grid of a x b cells."""
    return a + b + 2 * (a - 1) * (b - 1) - 2


def contrast_vector(expression: str, conditions: list[str]) -> list[float]:
    """Coefficients of a linear expression of condition names: ``2*a - b``, ``a+b``. Unknown names raise."""
    import re

    out = dict.fromkeys(conditions, 0.0)
    names = "|".join(re.escape(c) for c in sorted(conditions, key=len, reverse=True))
    term = re.compile(rf"\s*([+-]?)\s*(?:(\d+(?:\.\d*)?)\s*\*?\s*)?({names})\s*")
    at = 0
    while at < len(expression.rstrip()):
        m = term.match(expression, at)
        if not m or (at and not m[1]):
            raise ValueError(f"no term at {at} of {expression!r}")
        out[m[3]] += (-1 if m[1] == "-" else 1) * float(m[2] or 1)
        at = m.end()
    return [out[c] for c in conditions]


def contrast_name(vector: list[float], conditions: list[str]) -> str:
    """``+a -b``; coefficients of size 1 are not written."""
    parts = [f"{'+' if c > 0 else '-'}{'' if abs(c) == 1 else f'{abs(c):g}*'}{n}" for c, n in zip(vector, conditions, strict=True) if c]
    return " ".join(parts)


def weighted_sum(weights: list[float], columns: list[str]) -> Column:
    return sum((F.lit(w) * F.col(c) for w, c in zip(weights, columns, strict=True) if w), F.lit(0.0))
