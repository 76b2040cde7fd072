"""A study: signals of voxels in parcels, of one or several subjects, with the design that they were measured under.

``cells`` has a row for each voxel: subject, parcel, voxel, x, y, z, y (array of double, all sessions one after the other).
``bucketed`` lays the table out by parcel once, so that fits, averages and splits by parcel, of one subject or of all, start
from the files as they are, without a shuffle. A parcel's voxels are one bucket's: parcels are to be of bounded size
(``splitting`` cuts larger ones).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridsignal.functions import signal
from gridsignal.functions.expressions import contrast_vector
from gridsignal.operators import graph, models, parcellation
from gridsignal.operators.ranking import global_row_number
from gridsignal.paradigm import Paradigm
from gridsignal.session import written
from gridsignal.sources.images import read_surfaces
from gridsignal.sources.volumes import load_volumes, write_volumes

COLUMNS = ["subject", "parcel", "voxel", "x", "y", "z", "y_"]
AXES = ["x", "y", "z"]
#: Events of a design that come to the driver.
MOST_EVENTS = 1_000_000


def mask_from_bold(bold: DataFrame, low: float = 0.4, high: float = 0.9) -> DataFrame:
    """(x, y, z, value): 1 in the largest connected part of the bright cells, 0 elsewhere.

    A cell's brightness is its mean over time; the threshold lies in the widest gap between neighbouring values whose ranks are
    between the shares ``low`` and ``high``.
    """
    means = bold.groupBy(*AXES).agg(F.avg("value").alias("value"))
    ranked = written(global_row_number(means, ["value", *AXES], "rank"))
    n = ranked.count()
    first, last = int(low * n), min(int(high * n), n - 2)
    span = ranked.filter(F.col("rank").between(first, last + 1)).select("rank", "value")
    gaps = span.join(span.select((F.col("rank") - 1).alias("rank"), F.col("value").alias("next")), "rank").filter(F.col("rank") <= last)
    best = gaps.agg(F.max_by((F.col("value") + F.col("next")) / 2, F.struct(F.col("next") - F.col("value"), -F.col("rank"))).alias("t")).first()
    if best is None or best["t"] is None:
        return means.select(*AXES, F.lit(0).alias("value"))
    bright = ranked.filter(F.col("value") >= best["t"]).select(F.col("rank").alias("node"), *AXES)
    kept = graph.largest_component(graph.lattice_edges(bright, AXES, "node", graph.KERNELS["3D-6n"]), bright)
    return ranked.join(kept.select(F.col("node").alias("rank"), F.lit(1).alias("in_")), "rank", "left").select(*AXES, F.coalesce("in_", F.lit(0)).alias("value"))


@dataclass(frozen=True)
class Study:
    """``mask``: x, y, z, parcel of all cells of the space; ``scans``: the sessions' lengths; ``tr``: seconds a scan; ``edges``: the
    neighbours (src, dst) on a surface, whose voxels are its nodes."""

    cells: DataFrame
    tr: float
    scans: tuple[int, ...]
    paradigm: Paradigm | None = None
    mask: DataFrame | None = None
    background: int = 0
    edges: DataFrame | None = None

    @classmethod
    def from_volumes(cls, spark: SparkSession, mask: str | None, paradigm: str, bold: Sequence[str], tr: float, subject: str = "0", background: int = 0, conditions: Sequence[str] | None = None, delimiter: str | None = None) -> Study:
        """From a mask's, a design's and the sessions' files; ``conditions`` keeps those of the design alone.

        Without a mask one is made from the first session. Cells of the mask that a session lacks raise; voxels whose
        signal is constant 0 or holds NaN are left out.
        """
        sessions = [load_volumes(spark, path, remove_nans=False).select(*AXES, "t", "value", F.lit(i).alias("session")) for i, path in enumerate(bold)]
        space = load_volumes(spark, mask).select(*AXES, "value") if mask else mask_from_bold(sessions[0].withColumn("value", F.nanvl("value", F.lit(0.0))))
        space = written(space.select(*AXES, F.col("value").cast("int").alias("parcel")))
        design = Paradigm.from_csv(spark, paradigm, delimiter)
        if conditions is not None:
            design = Paradigm(design.events.filter(F.col("condition").isin(list(conditions))), design.durations)
        rows = sessions[0]
        for s in sessions[1:]:
            rows = rows.unionByName(s)
        lengths = {r["session"]: r["n"] for r in rows.groupBy("session").agg((F.max("t") + 1).alias("n")).collect()}
        scans = tuple(lengths.get(i, 0) for i in range(len(sessions)))
        inside = space.filter(F.col("parcel") != background)
        values = F.sort_array(F.collect_list(F.struct("session", "t", "value")))
        signals = rows.join(inside, AXES).groupBy("parcel", *AXES).agg(F.transform(values, lambda v: v["value"]).alias("y_"))
        numbered = global_row_number(inside, AXES, "voxel")
        full = written(numbered.join(signals, ["parcel", *AXES], "left"))
        short = full.filter(F.coalesce(F.size("y_"), F.lit(0)) != sum(scans)).select(*AXES).first()
        if short:
            raise ValueError(f"the sessions don't cover the mask's cell {tuple(short)}")
        usable = F.exists("y_", lambda v: v != 0) & ~F.exists("y_", lambda v: v.isNull() | F.isnan(v))
        cells = full.filter(usable).select(F.lit(subject).alias("subject"), "parcel", "voxel", *AXES, "y_")
        return cls(cells, tr, scans, design, space, background)

    @classmethod
    def from_surfaces(cls, spark: SparkSession, mesh: str, paradigm: str, bold: Sequence[str], tr: float, mask: str | None = None, subject: str = "0", background: int = 0, delimiter: str | None = None) -> Study:
        """From a mesh, a design and the sessions' textures (an array a scan); without a texture of labels all nodes are parcel 1.

        Nodes that a session lacks raise; nodes whose signal is constant 0 or holds NaN are left out.
        """
        surface = written(read_surfaces(spark, mesh))
        coords = surface.filter("intent = 'NIFTI_INTENT_POINTSET'").groupBy(F.col("i").cast("long").alias("voxel")).pivot("j", [0, 1, 2]).agg(F.first("value"))
        coords = coords.select("voxel", *[F.col(str(k)).alias(a) for k, a in enumerate(AXES)])
        corners = surface.filter("intent = 'NIFTI_INTENT_TRIANGLE'").groupBy("i").pivot("j", [0, 1, 2]).agg(F.first("value"))
        edges = written(graph.mesh_edges(corners.select(*[F.col(str(k)).cast("long").alias(c) for k, c in enumerate("abc")])))
        labels = read_surfaces(spark, mask).filter("array = 0").select(F.col("i").cast("long").alias("voxel"), F.col("value").cast("int").alias("parcel")) if mask else coords.select("voxel", F.lit(1).alias("parcel"))
        rows = None
        for k, path in enumerate(bold):
            own = read_surfaces(spark, path).select(F.lit(k).alias("session"), F.col("array").alias("t"), F.col("i").cast("long").alias("voxel"), "value")
            rows = own if rows is None else rows.unionByName(own)
        lengths = {r["session"]: r["n"] for r in rows.groupBy("session").agg((F.max("t") + 1).alias("n")).collect()}
        scans = tuple(lengths.get(i, 0) for i in range(len(bold)))
        values = F.sort_array(F.collect_list(F.struct("session", "t", "value")))
        signals = rows.groupBy("voxel").agg(F.transform(values, lambda v: v["value"]).alias("y_"))
        full = written(labels.filter(F.col("parcel") != background).join(coords, "voxel").join(signals, "voxel", "left"))
        short = full.filter(F.coalesce(F.size("y_"), F.lit(0)) != sum(scans)).select("voxel").first()
        if short:
            raise ValueError(f"the sessions don't cover the surface's node {short['voxel']}")
        usable = F.exists("y_", lambda v: v != 0) & ~F.exists("y_", lambda v: v.isNull() | F.isnan(v))
        cells = full.filter(usable).select(F.lit(subject).alias("subject"), "parcel", "voxel", *AXES, "y_")
        return cls(cells, tr, scans, Paradigm.from_csv(spark, paradigm, delimiter), coords.join(labels, "voxel").select(*AXES, "parcel"), background, edges)

    @classmethod
    def from_signals(cls, signals: DataFrame, tr: float, n_scans: int, paradigm: Paradigm | None = None, subject: str = "0") -> Study:
        """From rows (parcel, voxel, y) without a place."""
        none = [F.lit(None).cast("int").alias(a) for a in AXES]
        return cls(signals.select(F.lit(subject).alias("subject"), "parcel", "voxel", *none, F.col("y").cast("array<double>").alias("y_")), tr, (n_scans,), paradigm)

    # layout

    def bucketed(self, name: str, buckets: int = 64) -> Study:
        """The same study on a table of the warehouse, laid out by parcel and sorted inside."""
        spark = self.cells.sparkSession
        self.cells.repartition(buckets, "parcel").write.bucketBy(buckets, "parcel").sortBy("parcel", "voxel").mode("overwrite").saveAsTable(name)
        return replace(self, cells=spark.table(name))

    def merge_subjects(self, *others: Study) -> Study:
        """All subjects' voxels; sessions must be of equal lengths, as a fit of a parcel takes them together."""
        cells = self.cells
        for o in others:
            if o.scans != self.scans or o.tr != self.tr:
                raise ValueError("subjects differ in their sessions' lengths")
            cells = cells.unionByName(o.cells)
        return replace(self, cells=cells)

    def merge_sessions(self, *others: Study) -> Study:
        """The signals of the same voxels one after the other; a voxel that one lacks is left out."""
        keys = ["subject", "parcel", "voxel", *AXES]
        cells = self.cells
        for o in others:
            right = o.cells.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("y_").alias("_more"))
            together = cells.join(right, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
            cells = together.select(*keys, F.concat("y_", "_more").alias("y_"))
        return replace(self, cells=cells, scans=tuple(n for s in (self, *others) for n in s.scans))

    # parcels

    def keep_only_parcels(self, parcels: Sequence[int]) -> Study:
        return replace(self, cells=parcellation.keep_parcels(self.cells, parcels))

    def discard_parcels(self, parcels: Sequence[int]) -> Study:
        return replace(self, cells=parcellation.discard_parcels(self.cells, parcels))

    def discard_small_parcels(self, min_size: int) -> Study:
        return replace(self, cells=parcellation.discard_small(self.cells, min_size).select(self.cells.columns))

    def parcel_mask(self) -> DataFrame:
        """(x, y, z, parcel) of the whole space, background where no voxel is left."""
        if self.mask is None:
            raise ValueError("the study has no space")
        left = self.cells.select(*AXES, F.col("parcel").alias("_own")).distinct()
        return self.mask.join(left, AXES, "left").select(*AXES, F.coalesce("_own", F.lit(self.background)).alias("parcel"))

    def parcel_edges(self) -> DataFrame:
        """(parcel, src, dst): neighbouring voxels of each parcel."""
        places = self.cells.select("voxel", "parcel", *AXES).distinct()
        edges = self.edges if self.edges is not None else graph.lattice_edges(places, AXES, "voxel", graph.KERNELS["3D-6n"])
        return graph.parcel_edges(edges, places, "voxel")

    def edge_lengths(self) -> DataFrame:
        """(parcel, src, dst, length): ``parcel_edges`` with the distance of both voxels' places."""
        places = self.cells.select("voxel", *AXES).distinct()
        ends = [places.select(F.col("voxel").alias(end), *[F.col(a).alias(f"_{end}_{a}") for a in AXES]) for end in ("src", "dst")]
        met = self.parcel_edges().join(ends[0], "src").join(ends[1], "dst")
        far = graph.distance(*[[F.col(f"_{end}_{a}") for a in AXES] for end in ("src", "dst")])
        return met.select("parcel", "src", "dst", far.alias("length"))

    def sizes(self) -> DataFrame:
        """(subject, parcel, n_voxels)"""
        return self.cells.groupBy("subject", "parcel").agg(F.count(F.lit(1)).alias("n_voxels"))

    def summary(self) -> DataFrame:
        """One row: subjects, parcels, voxels, scans, and the least and the largest parcel's voxels."""
        s = self.sizes()
        return s.agg(F.count_distinct("subject").alias("n_subjects"), F.count_distinct("parcel").alias("n_parcels"), F.sum("n_voxels").alias("n_voxels"), F.lit(sum(self.scans)).alias("n_scans"), F.min("n_voxels").alias("least"), F.max("n_voxels").alias("largest"))

    def averaged(self) -> Study:
        """One voxel a parcel and subject, numbered as its parcel: the mean signal. Values are added up before they are shuffled."""
        means = self.cells.select("subject", "parcel", F.posexplode("y_").alias("t", "v")).groupBy("subject", "parcel", "t").agg(F.avg("v").alias("v"))
        series = F.transform(F.sort_array(F.collect_list(F.struct("t", "v"))), lambda s: s["v"])
        rows = means.groupBy("subject", "parcel").agg(series.alias("y_"))
        none = [F.lit(None).cast("int").alias(a) for a in AXES]
        return replace(self, cells=rows.select("subject", "parcel", F.col("parcel").cast("long").alias("voxel"), *none, "y_"))

    # fits

    def fit(self, estimate: Callable[..., dict], pass_error: bool = True) -> DataFrame:
        """``models.fit_parcels`` over each parcel; a parcel of several subjects is one fit. On a bucketed study no row moves."""
        return models.fit_parcels(self.cells.select("parcel", "voxel", F.col("y_").alias("y")), estimate, pass_error=pass_error)

    def design(self, duration: float = 25.0, cutoff: float = 128.0, drift: np.ndarray | None = None, oversampling: int = 16) -> tuple[np.ndarray, list[str]]:
        """The design matrix of all sessions and its columns' names: conditions convolved with the canonical response, drifts
        and a constant of each session. A design's events are its experimenter's, so they come to the driver, counted."""
        if self.paradigm is None:
            raise ValueError("the study has no design")
        found = self.paradigm.events.select("session", "condition", "onset", "duration").limit(MOST_EVENTS + 1).collect()
        if len(found) > MOST_EVENTS:
            raise ValueError(f"a design of more than {MOST_EVENTS} events")
        conditions = sorted({r["condition"] for r in found})
        numbers = sorted({r["session"] for r in found})
        dt = self.tr / oversampling
        response = signal.canonical_response(duration, dt)
        blocks, names = [], list(conditions)
        for i, n in enumerate(self.scans):
            grids = {c: np.zeros(n * oversampling) for c in conditions}
            for r in found:
                if i < len(numbers) and r["session"] == numbers[i]:
                    start = int(round(r["onset"] / dt))
                    grids[r["condition"]][start : max(start + 1, int(round((r["onset"] + r["duration"]) / dt)))] = 1.0
            slow = signal.cosine_basis(n, cutoff, self.tr) if drift is None else drift
            matrix, _ = models.design_matrix(grids, response, slow, oversampling)
            blocks.append((matrix[:, : len(conditions)], matrix[:, len(conditions) :]))
            names += [f"drift{k}_{i}" for k in range(blocks[-1][1].shape[1])]
        wide = np.zeros((sum(self.scans), len(names)))
        row, column = 0, len(conditions)
        for events, slow in blocks:
            wide[row : row + len(events), : len(conditions)] = events
            wide[row : row + len(events), column : column + slow.shape[1]] = slow
            row, column = row + len(events), column + slow.shape[1]
        return wide, names

    def glm(self, contrasts: dict[str, str] | None = None, residuals: str = "spherical", **design: float) -> DataFrame:
        """The cells with beta, s2 and each contrast's effect, variance and t; ``residuals``: ``spherical`` or ``ar1``.

        Contrasts are linear expressions of the design's columns.
        """
        if residuals not in ("spherical", "ar1"):
            raise ValueError(f"residuals are spherical or ar1, not {residuals!r}")
        matrix, names = self.design(**design)
        vectors = {k: np.array(contrast_vector(text, names)) for k, text in (contrasts or {}).items()}
        fit = models.glm if residuals == "spherical" else models.glm_ar1
        return fit(self.cells, matrix, vectors, "y_")

    # sinks

    def save(self, folder: str) -> None:
        """``paradigm`` (text), ``mask.nii`` and each subject's ``bold_<subject>.nii`` below a folder."""
        if self.paradigm is not None:
            self.paradigm.save_csv(f"{folder}/paradigm")
        write_volumes(self.parcel_mask().withColumn("_item", F.lit("mask")), folder, "_item", AXES, "parcel")
        self.save_values(folder, "bold_", self.cells.select("subject", *AXES, F.posexplode("y_").alias("t", "value")), "value", ["t"])

    def save_values(self, folder: str, prefix: str, values: DataFrame, value: str, more: Sequence[str] = ()) -> None:
        """A volume a subject of values by x, y, z and further axes."""
        write_volumes(values.withColumn("_item", F.concat(F.lit(prefix), F.col("subject"))), folder, "_item", [*AXES, *more], value)


def glm_from_files(spark: SparkSession, bold: str, tr: float, paradigm: str, mask: str | None, output: str | None = None, contrasts: dict[str, str] | None = None, residuals: str = "spherical", **design: float) -> DataFrame:
    """The fit of one subject's one session; with ``output`` each column's level and each contrast's effect and t become volumes."""
    study = Study.from_volumes(spark, mask, paradigm, [bold], tr)
    fitted = written(study.glm(contrasts, residuals, **design))
    if output:
        _, names = study.design(**design)
        volumes = [("beta_" + n, F.col("beta")[i]) for i, n in enumerate(names)] + [(f"{p}_{k}", F.col(f"{p}_{k}")) for k in (contrasts or {}) for p in ("effect", "t")]
        rows = fitted.select(*AXES, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in volumes])).alias("e"))
        write_volumes(rows.select(*AXES, "e.name", "e.value"), output, "name", AXES)
    return fitted


def joined_outputs(results: DataFrame, study: Study, name: str) -> DataFrame:
    """(subject, condition, at, x, y, z, value) of an output of ``fit`` by voxel, put on the voxels' places; cells without a
    result are left out, as parcels that failed have none."""
    rows = results.filter((F.col("name") == name) & (F.col("report") == "ok") & F.col("voxel").isNotNull())
    return rows.join(study.cells.select("subject", "parcel", "voxel", *AXES), ["parcel", "voxel"]).select("subject", "condition", "at", *AXES, "value")


def stacked_outputs(results: DataFrame, name: str) -> DataFrame:
    """(parcel, condition, at, value) of an output that each parcel has once, such as a response."""
    return results.filter((F.col("name") == name) & (F.col("report") == "ok") & F.col("voxel").isNull()).select("parcel", "condition", "at", "value")


def fitted_signals(study: Study, results: DataFrame, onsets: np.ndarray, conditions: Sequence[str], level: str = "nrl", response: str = "hrf") -> DataFrame:
    """(parcel, voxel, fit): each voxel's levels times the onsets convolved with its parcel's response, as an array."""
    order = Window.partitionBy("parcel").orderBy("at")
    shape = stacked_outputs(results, response).withColumn("lag", F.row_number().over(order) - 1).select("parcel", "lag", F.col("value").alias("h"))
    # one row a condition, scan and lag that has an onset: the design's
    hits = [(str(conditions[m]), int(t), int(d), float(onsets[m, t, d])) for m, t, d in zip(*np.nonzero(onsets), strict=True)]
    design = study.cells.sparkSession.createDataFrame(hits, "condition string, t int, lag int, x double")
    columns = design.join(shape, "lag").groupBy("parcel", "condition", "t").agg(F.sum(F.col("x") * F.col("h")).alias("s"))
    levels = results.filter((F.col("name") == level) & (F.col("report") == "ok")).select("parcel", "voxel", "condition", F.col("value").alias("a"))
    sums = levels.join(columns, ["parcel", "condition"]).groupBy("parcel", "voxel", "t").agg(F.sum(F.col("a") * F.col("s")).alias("v"))
    series = sums.groupBy("parcel", "voxel").agg(F.map_from_entries(F.collect_list(F.struct("t", "v"))).alias("m"))
    n = onsets.shape[1]
    return series.select("parcel", "voxel", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda t: F.coalesce(F.try_element_at("m", t), F.lit(0.0))).alias("fit"))
