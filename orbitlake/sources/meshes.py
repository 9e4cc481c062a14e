"""Building meshes: OBJ files, boxes, and the line of sight past them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rays import sight_lines

_CORNERS = [f"{c}{i}" for i in range(3) for c in "xyz"]
_SCHEMA = ", ".join(f"{c} double" for c in _CORNERS)


def obj_triangles(spark: SparkSession, path: str) -> DataFrame:
    """(file, x0..z2): faces of OBJ files, polygons cut into fans; each file in one task."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for f, text in zip(b["file"], b["value"]):
                parts = [x.split() for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]
                v = np.array([[float(y) for y in p[1:4]] for p in parts if p[0] == "v"]).reshape(-1, 3)
                faces = [[int(y.split("/")[0]) - 1 for y in p[1:]] for p in parts if p[0] == "f"]
                tri = [(x[0], x[i], x[i + 1]) for x in faces for i in range(1, len(x) - 1)]
                out = pd.DataFrame(v[np.array(tri, int).reshape(-1, 3)].reshape(-1, 9), columns=_CORNERS)
                out.insert(0, "file", f)
                yield out

    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value").mapInPandas(rows, f"file string, {_SCHEMA}")


def box(spark: SparkSession, centre: tuple[float, float, float], width: float, depth: float, height: float) -> DataFrame:
    """The twelve triangles of a box: two for each pair of a fixed axis and its side."""
    half = np.array([width, depth, height]) / 2
    rows = []
    for axis in range(3):
        a, b = [i for i in range(3) if i != axis]
        for side in (-1, 1):
            corner = lambda s, t: np.array(centre) + [side * half[axis] if i == axis else s * half[i] if i == a else t * half[i] for i in range(3)]  # noqa: B023, E731
            ring = [corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1)]
            rows += [tuple(float(x) for x in np.concatenate(t)) for t in ((ring[0], ring[1], ring[2]), (ring[0], ring[2], ring[3]))]
    return spark.createDataFrame(rows, _SCHEMA)


def hits(origin: np.ndarray, target: np.ndarray, mesh: np.ndarray) -> np.ndarray:
    """Whether each segment meets any of the triangles (n, 3, 3), by barycentric coordinates."""
    out = np.zeros(len(origin), bool)
    e1, e2 = mesh[:, 1] - mesh[:, 0], mesh[:, 2] - mesh[:, 0]
    step = max(1, 1_000_000 // max(len(mesh), 1))
    for s in range(0, len(origin), step):
        o, d = origin[s : s + step], target[s : s + step] - origin[s : s + step]
        length = np.linalg.norm(d, axis=1)
        d = d / np.maximum(length, 1e-300)[:, None]
        h = np.cross(d[:, None], e2[None])
        a = (e1[None] * h).sum(-1)
        with np.errstate(divide="ignore", invalid="ignore"):
            f = np.where(np.abs(a) < 1e-12, np.nan, 1 / a)
            r = o[:, None] - mesh[None, :, 0]
            u = f * (r * h).sum(-1)
            q = np.cross(r, e1[None])
            v = f * (d[:, None] * q).sum(-1)
            t = f * (e2[None] * q).sum(-1)
            out[s : s + step] = ((u >= 0) & (u <= 1) & (v >= 0) & (u + v <= 1) & (t > 1e-12) & (t < length[:, None])).any(axis=1)
    return out


def line_of_sight(rays: DataFrame, mesh: DataFrame) -> DataFrame:
    """Rays (rx, ry, rz to sx, sy, sz) with `los`: no triangle of the mesh (x0..z2) is in between; meshes of any size."""
    return sight_lines(rays, mesh)
