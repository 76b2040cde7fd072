"""Labelled arrays as long tables: one column for each axis, one value column.

A cell is a row. Axis order and value label are kept beside the table; domains are the axes' distinct values unless
given. Operations are lazy: slices are filters, reductions are grouped aggregates, arithmetic between arrays is an inner
join on the axes, moving between a masked space and a flat axis is a join on coordinates.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridsignal.operators.ranking import global_row_number, number_within

#: Axes that lead in the canonical orientation, in this order; all others follow alphabetically.
CANONICAL = ["sagittal", "coronal", "axial", "time", "iteration", "condition"]


class Cuboid:
    """``df`` with the key columns ``axes`` and the value column ``value``."""

    def __init__(self, df: DataFrame, axes: Sequence[str], value: str = "value", domains: dict[str, list] | None = None):
        missing = [c for c in (*axes, value) if c not in df.columns]
        if missing:
            raise ValueError(f"no such columns: {missing}")
        if len(set(axes)) != len(axes) or value in axes:
            raise ValueError("axes and value must have different names")
        for axis, domain in (domains or {}).items():
            if axis not in axes:
                raise ValueError(f"domain of an unknown axis: {axis}")
            if len(set(domain)) != len(domain):
                raise ValueError(f"domain of {axis} has repeated values")
        self.df, self.axes, self.value, self.domains = df.select(*axes, value), list(axes), value, dict(domains or {})

    @classmethod
    def from_table(cls, df: DataFrame, axes: Sequence[str], value: str | Column, how: Callable[[Column], Column] = F.sum, label: str = "value") -> Cuboid:
        """One cell for each combination of ``axes``; rows that share a cell are put together by ``how``."""
        column = F.col(value) if isinstance(value, str) else value
        return cls(df.groupBy(*axes).agg(how(column).alias(label)), axes, label)

    def _like(self, df: DataFrame, axes: Sequence[str] | None = None, value: str | None = None) -> Cuboid:
        axes = self.axes if axes is None else list(axes)
        return Cuboid(df, axes, value or self.value, {a: d for a, d in self.domains.items() if a in axes})

    def like(self, df: DataFrame) -> Cuboid:
        """Another table with this array's axes, label and domains."""
        return self._like(df)

    def copy(self) -> Cuboid:
        """A new object on the same table; tables never change."""
        return self._like(self.df)

    # axes and domains

    def has_axis(self, axis: str) -> bool:
        return axis in self.axes

    def has_axes(self, axes: Sequence[str]) -> bool:
        return set(axes) <= set(self.axes)

    def get_ndims(self) -> int:
        return len(self.axes)

    def get_axis_id(self, axis: str | int) -> int | None:
        if isinstance(axis, int):
            return axis if 0 <= axis < len(self.axes) else None
        return self.axes.index(axis) if axis in self.axes else None

    def get_axis_name(self, axis: str | int) -> str | None:
        at = self.get_axis_id(axis)
        return None if at is None else self.axes[at]

    def get_new_axis_name(self) -> str:
        return next(f"dim{i}" for i in range(len(self.axes) + 1) if f"dim{i}" not in self.axes)

    def domain(self, axis: str) -> DataFrame:
        """The axis's values, sorted, as a table of one column."""
        if axis in self.domains:
            return self.df.sparkSession.createDataFrame([(v,) for v in self.domains[axis]], self.df.select(axis).schema)
        return self.df.select(axis).distinct().orderBy(axis)

    def get_domain(self, axis: str) -> list:
        """The axis's values on the driver; for axes of bounded length."""
        return self.domains.get(axis) or [r[0] for r in self.domain(axis).collect()]

    def get_domain_idx(self, axis: str, value: object) -> int:
        return self.get_domain(axis).index(value)

    def get_dshape(self) -> dict[str, int]:
        row = self.df.agg(*[F.count_distinct(a).alias(a) for a in self.axes]).first() if self.axes else {}
        return {a: len(self.domains[a]) if a in self.domains else row[a] for a in self.axes}

    def n_cells(self) -> int:
        return self.df.count()

    def summary(self, precision: int = 4) -> DataFrame:
        """One row ``summary``: mean(deviation)[least...most] of all cells."""
        v = F.col(self.value)
        parts = [F.round(F.avg(v), precision), F.round(F.stddev_pop(v), precision), F.min(v), F.max(v)]
        return self.df.agg(F.format_string("%1$.{0}f(%2$.{0}f)[%3$.{0}f...%4$.{0}f]".format(precision), *[x.cast("double") for x in parts]).alias("summary"))

    def descrip(self) -> str:
        """Label, shape and the ends of each axis."""
        ends = self.df.agg(*[f(a).alias(f"{n}_{a}") for a in self.axes for n, f in (("lo", F.min), ("hi", F.max))]).first()
        return f"{self.value} {self.descrip_shape()}\n" + "\n".join(f"  {a}: {ends[f'lo_{a}']}...{ends[f'hi_{a}']}" for a in self.axes)

    def get_orientation(self) -> list[str]:
        return list(self.axes)

    def descrip_shape(self) -> str:
        return "(" + ",".join(f"{a}:{n}" for a, n in self.get_dshape().items()) + ")"

    def set_axis_domain(self, axis: str, mapping: DataFrame) -> Cuboid:
        """Replace an axis's values by a table (old, new); values that it lacks are lost, as in an inner join."""
        new = self.df.join(mapping.select(F.col(mapping.columns[0]).alias(axis), F.col(mapping.columns[1]).alias("_new")), axis)
        return Cuboid(new.drop(axis).withColumnRenamed("_new", axis), self.axes, self.value, {a: d for a, d in self.domains.items() if a != axis})

    # orientation: a matter of column order

    def reorient(self, axes: Sequence[str]) -> Cuboid:
        if sorted(axes) != sorted(self.axes):
            raise ValueError("the new orientation must have the same axes")
        return self._like(self.df, axes)

    def swapaxes(self, a: str, b: str) -> Cuboid:
        other = {a: b, b: a}
        return self.reorient([other.get(x, x) for x in self.axes])

    def roll(self, axis: str) -> Cuboid:
        return self.reorient([a for a in self.axes if a != axis] + [axis])

    def set_MRI_orientation(self) -> Cuboid:
        lead = [a for a in CANONICAL if a in self.axes]
        return self.reorient(lead + sorted(a for a in self.axes if a not in lead))

    def squeeze(self, axes: Sequence[str] | None = None) -> Cuboid:
        """Drop axes of length one (of ``axes``, or all)."""
        shape = self.get_dshape()
        gone = [a for a in (axes or self.axes) if shape[a] == 1]
        if axes and not gone:
            raise ValueError("none of the axes has length one")
        return self._like(self.df.drop(*gone), [a for a in self.axes if a not in gone])

    def squeeze_all_but(self, axes: Sequence[str]) -> Cuboid:
        rest = [a for a in self.axes if a not in axes]
        return self.squeeze(rest) if any(n == 1 for a, n in self.get_dshape().items() if a in rest) else self

    def repeat(self, n: int, new_axis: str, domain: Sequence | None = None) -> Cuboid:
        values = F.array(*[F.lit(v) for v in domain]) if domain is not None else F.sequence(F.lit(0), F.lit(n - 1))
        return self._like(self.df.withColumn(new_axis, F.explode(values)), [*self.axes, new_axis])

    def astype(self, kind: str) -> Cuboid:
        return self._like(self.df.withColumn(self.value, F.col(self.value).cast(kind)))

    # slices

    def sub_cuboid(self, **at: object) -> Cuboid:
        """Cells at the given axis values; these axes go."""
        for axis in at:
            if axis not in self.axes:
                raise ValueError(f"unknown axis: {axis}")
        df = self.df
        for axis, value in at.items():
            df = df.filter(F.col(axis) == F.lit(value))
        return self._like(df, [a for a in self.axes if a not in at])

    def sub_cuboid_from_slices(self, **at: int | slice) -> Cuboid:
        """Cells at the given positions of the axes' sorted values; an axis goes if its position is a number."""
        df, axes = self.df, list(self.axes)
        for axis, where in at.items():
            place = F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy(axis)) - 1
            # ranks are taken over the axis's distinct values, not over cells
            ranked = self.df.select(axis).distinct().withColumn("_at", place)
            if isinstance(where, slice):
                ok = (F.col("_at") >= (where.start or 0)) & ((F.col("_at") - (where.start or 0)) % (where.step or 1) == 0)
                ranked = ranked.filter(ok & (F.col("_at") < where.stop) if where.stop is not None else ok)
                df = df.join(ranked.drop("_at"), axis, "left_semi")
            else:
                df = df.join(ranked.filter(F.col("_at") == where).drop("_at"), axis, "left_semi")
                axes.remove(axis)
        return self._like(df, axes)

    def split(self, axis: str) -> dict[object, Cuboid]:
        return {v: self.sub_cuboid(**{axis: v}) for v in self.get_domain(axis)}

    # reductions; all deviations are of the population

    def reduce(self, how: Callable[[Column], Column], axis: str | Sequence[str] | None = None) -> Cuboid:
        gone = self.axes if axis is None else [axis] if isinstance(axis, str) else list(axis)
        rest = [a for a in self.axes if a not in gone]
        return self._like(self.df.groupBy(*rest).agg(how(F.col(self.value)).alias(self.value)), rest)

    def min(self, axis=None) -> Cuboid:
        return self.reduce(F.min, axis)

    def max(self, axis=None) -> Cuboid:
        return self.reduce(F.max, axis)

    def ptp(self, axis=None) -> Cuboid:
        return self.reduce(lambda v: F.max(v) - F.min(v), axis)

    def mean(self, axis=None) -> Cuboid:
        return self.reduce(F.avg, axis)

    def std(self, axis=None) -> Cuboid:
        return self.reduce(F.stddev_pop, axis)

    def var(self, axis=None) -> Cuboid:
        return self.reduce(F.var_pop, axis)

    def sum(self, axis=None) -> Cuboid:
        return self.reduce(F.sum, axis)

    # arithmetic

    def combine(self, other: Cuboid | float, how: Callable[[Column, Column], Column]) -> Cuboid:
        """Cell by cell with a number, or with an array of the same axes: cells that both have."""
        if not isinstance(other, Cuboid):
            return self._like(self.df.withColumn(self.value, how(F.col(self.value), F.lit(other))))
        if sorted(other.axes) != sorted(self.axes):
            raise ValueError("both arrays must have the same axes")
        right = other.df.withColumnRenamed(other.value, "_other")
        return self._like(self.df.join(right, self.axes).withColumn(self.value, how(F.col(self.value), F.col("_other"))))

    def add(self, other) -> Cuboid:
        return self.combine(other, lambda a, b: a + b)

    def substract(self, other) -> Cuboid:
        return self.combine(other, lambda a, b: a - b)

    def multiply(self, other) -> Cuboid:
        return self.combine(other, lambda a, b: a * b)

    def divide(self, other) -> Cuboid:
        """True division; a zero divisor gives null."""
        return self.combine(other, lambda a, b: a / F.nullif(b, F.lit(0)))

    def floor_divide(self, other) -> Cuboid:
        return self.combine(other, lambda a, b: F.floor(a / F.nullif(b, F.lit(0))))

    def __add__(self, other) -> Cuboid:
        return self.add(other)

    def __sub__(self, other) -> Cuboid:
        return self.substract(other)

    def __mul__(self, other) -> Cuboid:
        return self.multiply(other)

    def __truediv__(self, other) -> Cuboid:
        return self.divide(other)

    def __radd__(self, other) -> Cuboid:
        return self.add(other)

    def __rmul__(self, other) -> Cuboid:
        return self.multiply(other)

    def __rsub__(self, other) -> Cuboid:
        return self.combine(other, lambda a, b: b - a)

    def __rtruediv__(self, other) -> Cuboid:
        return self.combine(other, lambda a, b: b / F.nullif(a, F.lit(0)))

    def __pow__(self, exponent: float) -> Cuboid:
        return self.combine(exponent, F.pow)

    def rescale_values(self, v_min: float = 0.0, v_max: float = 1.0, axis: str | None = None) -> Cuboid:
        """Min-max scaling over all cells, or along an axis; where all are equal, ``v_min``."""
        rest = [] if axis is None else [a for a in self.axes if a != axis]
        ends = self.df.groupBy(*rest).agg(F.min(self.value).alias("_lo"), F.max(self.value).alias("_hi"))
        # without an axis the ends are one row
        df = self.df.join(ends, rest) if rest else self.df.crossJoin(F.broadcast(ends))
        scaled = F.coalesce((F.col(self.value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0)), F.lit(0.0))
        return self._like(df.withColumn(self.value, scaled * (v_max - v_min) + v_min))

    def equals(self, other: Cuboid, tolerance: float = 0.0) -> bool:
        """Same axes in order, same label, the same cells, values within ``tolerance``."""
        if self.axes != other.axes or self.value != other.value:
            return False
        both = self.df.join(other.df.withColumnRenamed(other.value, "_other"), self.axes, "full")
        return both.filter(F.coalesce(F.abs(F.col(self.value) - F.col("_other")) > tolerance, F.lit(True))).isEmpty()

    # masks and maps: joins on coordinates

    def grid(self) -> DataFrame:
        """All combinations of the axes' values."""
        out = self.domain(self.axes[0])
        for axis in self.axes[1:]:
            out = out.crossJoin(self.domain(axis))
        return out

    def fill_grid(self, fill: float = 0.0) -> Cuboid:
        df = self.grid().join(self.df, self.axes, "left")
        return self._like(df.withColumn(self.value, F.coalesce(self.value, F.lit(fill))))

    def flatten(self, mask: Cuboid, new_axis: str = "position") -> Cuboid:
        """Gather the cells where ``mask`` is not 0 on one axis, numbered from 0 in the order of the mask's axes."""
        inside = global_row_number(mask.df.filter(F.col(mask.value) != 0).select(*mask.axes), mask.axes, new_axis)
        rest = [a for a in self.axes if a not in mask.axes]
        return Cuboid(self.df.join(inside, mask.axes), [*rest, new_axis], self.value)

    def expand(self, mask: Cuboid, axis: str, fill: float = 0.0) -> Cuboid:
        """Inverse of ``flatten``: scatter ``axis`` over the mask's cells, ``fill`` elsewhere."""
        inside = global_row_number(mask.df.filter(F.col(mask.value) != 0).select(*mask.axes), mask.axes, axis)
        rest = [a for a in self.axes if a != axis]
        cells = mask.df.select(*mask.axes).join(inside, mask.axes, "left")
        if rest:
            cells = cells.crossJoin(self.df.select(*rest).distinct())
        out = cells.join(self.df, [*rest, axis], "left").withColumn(self.value, F.coalesce(self.value, F.lit(fill)))
        return Cuboid(out, [*rest, *mask.axes], self.value)

    def map_onto(self, mapping: Cuboid, fill: float = 0.0) -> Cuboid:
        """Replace the axis named as the mapping's label by the mapping's axes; cells mapped nowhere get ``fill``."""
        axis = mapping.value
        if axis not in self.axes:
            raise ValueError(f"no axis has the mapping's label {axis}")
        rest = [a for a in self.axes if a != axis]
        cells = mapping.df.crossJoin(self.df.select(*rest).distinct()) if rest else mapping.df
        out = cells.join(self.df, [*rest, axis], "left").withColumn(self.value, F.coalesce(self.value, F.lit(fill)))
        return Cuboid(out, [*rest, *mapping.axes], self.value)

    def explode(self, mask: Cuboid, parcel: str = "parcel", new_axis: str = "position") -> DataFrame:
        """Cells by the mask's value, 0 included: parcel, position in the parcel (from 0), other axes, value."""
        labelled = number_within(mask.df.select(*mask.axes, mask.value), [mask.value], mask.axes, new_axis)
        rest = [a for a in self.axes if a not in mask.axes]
        return self.df.join(labelled, mask.axes).select(F.col(mask.value).alias(parcel), new_axis, *rest, self.value)

    def fill(self, other: Cuboid) -> Cuboid:
        """Values of an array with fewer axes, repeated over the missing ones."""
        if not set(other.axes) <= set(self.axes):
            raise ValueError("the other array's axes must be among this one's")
        right = other.df.withColumnRenamed(other.value, "_other")
        return self._like(self.df.join(right, other.axes).withColumn(self.value, F.col("_other")))

    def to_html_table(self, rows: str | Sequence[str], columns: str | Sequence[str], limit: int = 1000, inner: Sequence[str] = (), separator: str = " | ") -> str:
        """The array as an HTML table, for reports: at most ``limit`` rows and columns, or an error.

        A column of headers for each axis of ``rows``, a line of them for each of ``columns``; a cell has the values of the
        ``inner`` axes in their order.
        """
        rows, columns, heads, grid = self._grid(rows, columns, limit, inner, separator)
        lines = []
        for k, axis in enumerate(columns):
            first = rows if k == len(columns) - 1 else [""] * len(rows)
            corner = "".join(f"<th>{r}\\{axis}</th>" if r == rows[-1] else f"<th>{r}</th>" for r in first)
            lines.append(f"<tr>{corner}" + "".join(f"<th>{h[k]}</th>" for h in heads) + "</tr>")
        for names, cells in grid:
            lines.append("<tr>" + "".join(f"<th>{n}</th>" for n in names) + "".join(f"<td>{'' if v is None else v}</td>" for v in cells) + "</tr>")
        return f"<table>{''.join(lines)}</table>"

    def to_latex(self, rows: str | Sequence[str], columns: str | Sequence[str], limit: int = 1000, inner: Sequence[str] = (), separator: str = " | ") -> str:
        rows, columns, heads, grid = self._grid(rows, columns, limit, inner, separator)
        lines = [" & ".join([*[""] * len(rows), *(str(h[k]) for h in heads)]) for k in range(len(columns))]
        lines += [" & ".join([*map(str, names), *("" if v is None else str(v) for v in cells)]) for names, cells in grid]
        return "\\begin{tabular}{" + "l" * len(rows) + "r" * len(heads) + "}\n" + " \\\\\n".join(lines) + " \\\\\n\\end{tabular}"

    def _grid(self, rows: str | Sequence[str], columns: str | Sequence[str], limit: int, inner: Sequence[str], separator: str) -> tuple[list[str], list[str], list[tuple], list[tuple]]:
        rows, columns = ([x] if isinstance(x, str) else list(x) for x in (rows, columns))
        if sorted(self.axes) != sorted([*rows, *columns, *inner]):
            raise ValueError("the table's axes must be the array's")
        heads = [tuple(r) for r in self.df.select(*columns).distinct().orderBy(*columns).limit(limit + 1).collect()]
        if len(heads) > limit:
            raise ValueError(f"more than {limit} columns")
        # headers in columns' places: one literal a header
        place = F.array_position(F.array(*[F.struct(*[F.lit(v).cast(self.df.schema[c].dataType).alias(c) for v, c in zip(h, columns, strict=True)]) for h in heads]), F.struct(*columns)).cast("int") if heads else F.lit(1)
        cells = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*inner, F.col(self.value).cast("string").alias("_v")))), lambda s: s["_v"]), separator) if inner else F.first(self.value)
        wide = self.df.withColumn("_c", place).groupBy(*rows).pivot("_c", list(range(1, len(heads) + 1))).agg(cells)
        found = wide.orderBy(*rows).limit(limit + 1).collect() if heads else []
        if len(found) > limit:
            raise ValueError(f"more than {limit} rows")
        return rows, columns, heads, [(tuple(r)[: len(rows)], tuple(r)[len(rows) :]) for r in found]

    # sinks

    def extra_info(self) -> dict:
        """The axes with their types and numbers of values, and the label: what describes the array beside its cells."""
        sizes = self.get_dshape()
        return {"axes": [{"name": a, "type": self.df.schema[a].dataType.simpleString(), "size": sizes[a]} for a in self.axes], "value": self.value, "type": self.df.schema[self.value].dataType.simpleString()}

    def save(self, folder: str, name: str, by: Sequence[str] = (), voxel: tuple[float, float, float] = (1.0, 1.0, 1.0), packed: bool = False, formatted: bool = False) -> None:
        """``name.nii`` below ``folder``, or a file for each combination of the axes ``by``; axes become whole numbers from 0 in
        the order of their values. Cells that the array lacks are 0. ``voxel`` is the size of a cell along the first three axes."""
        from gridsignal.sources.volumes import split_items, write_volumes

        rest = [a for a in self.axes if a not in by]
        cells = self.df.select(*self.axes, self.value)
        for axis in rest:
            places = global_row_number(self.domain(axis), [axis], f"_p_{axis}")
            cells = cells.join(places, axis)
        write_volumes(cells.withColumn("_item", split_items(cells, name, list(by), formatted)), folder, "_item", [f"_p_{a}" for a in rest], self.value, voxel, packed)

    @classmethod
    def load(cls, spark: SparkSession, path: str, value: str = "intensity") -> Cuboid:
        """The array of a volume's file: axes x, y, z and, in a series, t."""
        from gridsignal.sources.volumes import load_volumes

        cells = load_volumes(spark, path).withColumnRenamed("value", value).drop("path")
        series = cells.filter("t > 0").isEmpty()
        return cls(cells.drop("t"), ["x", "y", "z"], value) if series else cls(cells, ["x", "y", "z", "t"], value)

    # nesting

    def unstack(self, inner: Sequence[str]) -> DataFrame:
        """One row for each combination of the other axes, with the sorted list of (inner axes, value)."""
        outer = [a for a in self.axes if a not in inner]
        return self.df.groupBy(*outer).agg(F.sort_array(F.collect_list(F.struct(*inner, self.value))).alias("cells"))

    def to_tree(self, levels: Sequence[str], leaf: str) -> DataFrame:
        """One row whose ``tree`` is nested maps by ``levels``; leaves map ``leaf``'s values to values."""
        out = self.df.groupBy(*levels).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(leaf, self.value)))).alias("tree"))
        for depth in range(len(levels) - 1, -1, -1):
            out = out.groupBy(*levels[:depth]).agg(F.map_from_entries(F.collect_list(F.struct(levels[depth], "tree"))).alias("tree"))
        return out


def merge(parcels: DataFrame, mask: Cuboid, value: str, parcel: str = "parcel", position: str = "position", fill: float = 0.0) -> Cuboid:
    """Inverse of ``explode``: parcels' cells at their places in the mask, ``fill`` where a parcel has none."""
    labelled = number_within(mask.df.select(*mask.axes, mask.value), [mask.value], mask.axes, position).withColumnRenamed(mask.value, parcel)
    rest = [c for c in parcels.columns if c not in (parcel, position, value)]
    out = labelled.join(parcels, [parcel, position], "left").withColumn(value, F.coalesce(value, F.lit(fill)))
    return Cuboid(out, [*mask.axes, *rest], value)


def stack_cuboids(cuboids: Sequence[Cuboid], axis: str, domain: Sequence | None = None, first: bool = True) -> Cuboid:
    """Put arrays of the same axes side by side on a new axis."""
    lead = cuboids[0]
    if any(c.axes != lead.axes for c in cuboids):
        raise ValueError("arrays to stack must have the same axes")
    values = list(domain) if domain is not None else list(range(len(cuboids)))
    out = None
    for v, c in zip(values, cuboids, strict=True):
        part = c.df.select(*c.axes, F.col(c.value).alias(lead.value)).withColumn(axis, F.lit(v))
        out = part if out is None else out.unionByName(part)
    return Cuboid(out, [axis, *lead.axes] if first else [*lead.axes, axis], lead.value)


def tree_to_cuboid(tree: DataFrame, levels: Sequence[str], leaf: str, value: str = "value") -> Cuboid:
    """From a row with nested maps to cells."""
    out = tree
    for name in levels:
        out = out.select(*[c for c in out.columns if c != "tree"], F.explode("tree").alias(name, "tree"))
    out = out.select(*levels, F.explode("tree").alias(leaf, value))
    return Cuboid(out, [*levels, leaf], value)
