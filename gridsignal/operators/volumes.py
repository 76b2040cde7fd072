"""Cells of volumes: cropping, sub-sampling, resizing, masks and unusable signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def crop(df: DataFrame, axes: list[str], value: str, extension: int = 0) -> DataFrame:
    """Cells inside the bounding box of the non-zero ones (widened by ``extension``), counted from the box's corner."""
    ends = df.filter(F.col(value) != 0).agg(*[f(a).alias(f"_{n}_{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max))])
    out = df.crossJoin(F.broadcast(ends))  # one row
    for a in axes:
        out = out.filter(F.col(a).between(F.col(f"_lo_{a}") - extension, F.col(f"_hi_{a}") + extension))
    return out.select(*[(F.col(a) - F.col(f"_lo_{a}") + extension).alias(a) for a in axes], *[c for c in df.columns if c not in axes])


def sub_sample(df: DataFrame, axes: list[str], value: str, factor: int, mean: bool = True) -> DataFrame:
    """Coarser cells: the mean of ``factor`` cells along each axis, or every ``factor``-th cell."""
    if not mean:
        for a in axes:
            df = df.filter(F.col(a) % factor == 0)
        return df.select(*[(F.col(a) / factor).cast("long").alias(a) for a in axes], value)
    return df.groupBy(*[F.floor(F.col(a) / factor).alias(a) for a in axes]).agg(F.avg(value).alias(value))


def _maps_to(own, n: int, m: int):
    return lambda i: (F.floor(i * F.lit(n) / m) == own) & (i < m)


def rebin(df: DataFrame, axes: list[str], value: str, old: dict[str, int], new: dict[str, int]) -> DataFrame:
    """Resize by nearest index: new cell i takes the old cell floor(i x old / new). Each old cell makes its new ones."""
    out = df
    for a in axes:
        n, m, own = old[a], new[a], F.col(a)
        near = F.sequence(F.floor(own * F.lit(m) / n).cast("long"), F.floor((own + 1) * F.lit(m) / n).cast("long"))
        ids = F.filter(near, _maps_to(own, n, m))
        out = out.withColumn(a, F.explode(ids))
    return out.select(*axes, value)


def flip_in_parcels(df: DataFrame, value: str, parcel: str, parcels: list) -> DataFrame:
    """Negated values inside the listed parcels."""
    return df.withColumn(value, F.when(F.col(parcel).isin(parcels), -F.col(value)).otherwise(F.col(value)))


def remove_parcels(df: DataFrame, parcel: str, parcels: list) -> DataFrame:
    """The listed parcels become background."""
    return df.withColumn(parcel, F.when(F.col(parcel).isin(parcels), F.lit(0)).otherwise(F.col(parcel)))


def usable_signals(df: DataFrame, signal: str = "y") -> DataFrame:
    """Signals that vary and hold no NaN."""
    y = F.col(signal)
    first = F.get(y, F.lit(0))
    return df.filter(F.size(y) > 0).filter(F.exists(y, lambda x: x != first) & ~F.exists(y, lambda x: x.isNull() | F.isnan(x)))


def signal_summary(df: DataFrame, by: list[str], signal: str = "y") -> DataFrame:
    """(by, t, mean): average signal of each group, and population deviation over its voxels."""
    return df.select(*by, F.posexplode(signal).alias("t", "v")).groupBy(*by, "t").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def joined_sessions(df: DataFrame, by: list[str], session: str = "session", signal: str = "y") -> DataFrame:
    """Sessions' signals of a voxel, one after the other."""
    parts = F.sort_array(F.collect_list(F.struct(session, signal)))
    return df.groupBy(*by).agg(F.flatten(F.transform(parts, lambda p: p[signal])).alias(signal))
