"""Convex hulls of cells in the plane and in space.

A partition's points leave the corners of their own hull, and hulls are merged as a tree: the corners of several hulls are
the points of the next one. Corners are few (those of a body on a grid of side L grow with a power of L below its surface),
so their last merge is small; it is counted before it comes to the driver. A cell is inside if it lies on the inner side of
all faces, which is one column expression. Points on a line, in a plane or at one place have a hull of that dimension.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points that are reduced at once, and corners that may come to the driver.
CHUNK, MOST_CORNERS = 1 << 16, 200_000


def plane_corners(points: np.ndarray) -> np.ndarray:
    """Places of the corners of different points in the plane, counter-clockwise, by two chains of left turns."""
    order = np.lexsort((points[:, 1], points[:, 0]))
    if len(order) < 3:
        return order

    def chain(places: np.ndarray) -> list[int]:
        out: list[int] = []
        for k in places.tolist():
            while len(out) > 1:
                a, b = points[out[-1]] - points[out[-2]], points[k] - points[out[-1]]
                if a[0] * b[1] - a[1] * b[0] > 1e-9 * max(np.abs(a).max() * np.abs(b).max(), 1e-300):
                    break
                out.pop()
            out.append(k)
        return out

    return np.array(chain(order)[:-1] + chain(order[::-1])[:-1])


def space_faces(points: np.ndarray) -> np.ndarray:
    """Triangles (places of points) of the hull of points in space that aren't in one plane, seen from outside.

    Points are added one by one: the faces that see a new point go, and their rim is joined with it.
    """
    scale = np.abs(points - points.mean(0)).max()
    first = [int(points[:, 0].argmin())]
    for _ in range(3):
        rest = points - points[first[0]]
        if len(first) > 1:
            q, _ = np.linalg.qr((points[first[1:]] - points[first[0]]).T)
            rest = rest - rest @ q @ q.T
        first.append(int((rest**2).sum(1).argmax()))
    centre = points[first].mean(0)

    def turned(f: tuple[int, int, int]) -> tuple[int, int, int]:
        a, b, c = points[list(f)]
        return f if np.cross(b - a, c - a) @ (a - centre) > 0 else (f[0], f[2], f[1])

    faces = np.array([turned(tuple(first[:i] + first[i + 1 :])) for i in range(4)])
    normals = np.cross(points[faces[:, 1]] - points[faces[:, 0]], points[faces[:, 2]] - points[faces[:, 0]])
    for k in np.argsort(-((points - centre) ** 2).sum(1), kind="stable").tolist():
        if k in first:
            continue
        size = np.sqrt((normals**2).sum(1))
        sees = ((points[k] - points[faces[:, 0]]) * normals).sum(1) > 1e-9 * scale * size
        if not sees.any():
            continue
        edges = np.concatenate([faces[sees][:, [0, 1]], faces[sees][:, [1, 2]], faces[sees][:, [2, 0]]])
        inner = {tuple(e) for e in edges[:, ::-1].tolist()}
        rim = [e for e in edges.tolist() if tuple(e) not in inner]
        new = np.array([(a, b, k) for a, b in rim])
        faces = np.concatenate([faces[~sees], new])
        normals = np.concatenate([normals[~sees], np.cross(points[new[:, 1]] - points[new[:, 0]], points[new[:, 2]] - points[new[:, 0]])])
    return faces


def spanned(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The points' mean, an orthonormal basis of the directions that they span, and one of the others (rows)."""
    middle = points.mean(0)
    _, s, v = np.linalg.svd(points - middle, full_matrices=True)
    rank = int((s > 1e-9 * max(1.0, np.abs(points).max())).sum())
    return middle, v[:rank], v[rank:]


def corners(points: np.ndarray) -> np.ndarray:
    """The corners of the points' hull, one row each (a superset of them where faces touch several in one plane)."""
    points = np.unique(points, axis=0)
    if len(points) <= points.shape[1]:
        return points
    middle, basis, _ = spanned(points)
    flat = (points - middle) @ basis.T
    if len(basis) == 0:
        return points[:1]
    if len(basis) == 1:
        return points[[flat[:, 0].argmin(), flat[:, 0].argmax()]]
    return points[plane_corners(flat) if len(basis) == 2 else np.unique(space_faces(flat))]


def faces(points: np.ndarray) -> list[tuple[np.ndarray, float]]:
    """Half spaces (normal, offset): x is inside the hull if normal @ x <= offset for all of them."""
    points = np.unique(points, axis=0)
    middle, basis, others = spanned(points)
    out = [(s * w, float((s * w) @ middle)) for w in others for s in (1, -1)]
    flat = (points - middle) @ basis.T
    if len(basis) == 1:
        normals, at = np.array([[1.0], [-1.0]]), flat[[flat[:, 0].argmax(), flat[:, 0].argmin()]]
    elif len(basis) == 2:
        ring = flat[plane_corners(flat)]
        side = np.roll(ring, -1, 0) - ring
        normals, at = np.column_stack([side[:, 1], -side[:, 0]]), ring
    elif len(basis) == 3:
        f = space_faces(flat)
        normals, at = np.cross(flat[f[:, 1]] - flat[f[:, 0]], flat[f[:, 2]] - flat[f[:, 0]]), flat[f[:, 0]]
    else:
        return out
    normals = normals / np.linalg.norm(normals, axis=1, keepdims=True)
    _, one_each = np.unique(np.round(np.column_stack([normals, (normals * at).sum(1)]), 9), axis=0, return_index=True)
    return out + [(n @ basis, float(n @ a + (n @ basis) @ middle)) for n, a in zip(normals[one_each], at[one_each], strict=True)]


def hull_corners(cells: DataFrame, axes: list[str]) -> np.ndarray:
    """The corners of all cells' hull; cells with a null coordinate take no part."""
    kind = ", ".join(f"{a} double" for a in axes)

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if batch.num_rows:
                held.append(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
            if sum(map(len, held)) >= CHUNK:
                held = [corners(np.concatenate(held))]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in corners(np.concatenate(held)).T], axes)

    now = cells.select(*[F.col(a).cast("double").alias(a) for a in axes]).dropna().mapInArrow(reduced, kind)
    parts = cells.sparkSession.sparkContext.defaultParallelism
    while parts > 1:
        parts = max(1, parts // 8)
        now = now.repartition(parts).mapInArrow(reduced, kind)
    found = now.limit(MOST_CORNERS + 1).collect()
    if len(found) > MOST_CORNERS:
        raise ValueError(f"the hull has more than {MOST_CORNERS} corners")
    return np.array([tuple(r) for r in found], float).reshape(len(found), len(axes))


def inside_hull(cells: DataFrame, of: DataFrame, axes: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Those of ``cells`` that lie in the convex hull of the cells ``of``; none if there are none."""
    points = hull_corners(of, axes)
    if not len(points):
        return cells.limit(0)
    # one half space a face; a task's constant
    half = [(normal, offset + tolerance) for normal, offset in faces(points)]
    table = F.array(*[F.array(*[F.lit(float(x)) for x in (*normal, offset)]) for normal, offset in half]) if half else F.array().cast("array<array<double>>")
    place = F.array(*[F.col(a).cast("double") for a in axes])
    within = lambda h: F.aggregate(F.zip_with(F.slice(h, 1, len(axes)), place, lambda n, x: n * x), F.lit(0.0), lambda t, v: t + v) <= F.element_at(h, len(axes) + 1)
    return cells.filter(F.forall(table, within))
