"""Rays against an indexed mesh: triangles in Morton-coded tiles, a tree of boxes in each tile, rays joined with the tiles they cross."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut

CORNERS = [f"{c}{i}" for i in range(3) for c in "xyz"]
ENDS = ["rx", "ry", "rz", "sx", "sy", "sz"]
#: Rays and triangles that meet in one group at most; hot tiles are dealt out as several groups.
GROUP_RAYS, GROUP_TRIANGLES = 100_000, 20_000
#: Metres that boxes are widened by, so that rounding loses no touch.
PAD = 1e-6
_LEAF = 8
_TILE_AXIS = 1 << 20
_SPREAD = [(32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)]


def morton(x, y, z):
    """Interleaved bits of three whole numbers under 2**21: columns or arrays."""

    def spread(v):
        for shift, mask in _SPREAD:
            v = (v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))) if isinstance(v, Column) else ((v | (v << shift)) & mask)
        return v

    a, b, c = spread(x), spread(y), spread(z)
    return a.bitwiseOR(F.shiftleft(b, 1)).bitwiseOR(F.shiftleft(c, 2)) if isinstance(a, Column) else a | (b << 1) | (c << 2)


def meets(origin: np.ndarray, target: np.ndarray, tri: np.ndarray) -> np.ndarray:
    """Whether segments (n, 3) meet triangles (n, k, 3, 3), pair by pair, by barycentric coordinates: (n, k)."""
    d = target - origin
    length = np.linalg.norm(d, axis=1)
    d = d / np.maximum(length, 1e-300)[:, None]
    e1, e2 = tri[:, :, 1] - tri[:, :, 0], tri[:, :, 2] - tri[:, :, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        h = np.cross(d[:, None], e2)
        a = (e1 * h).sum(-1)
        f = np.where(np.abs(a) < 1e-12, np.nan, 1 / a)
        r = origin[:, None] - tri[:, :, 0]
        u = f * (r * h).sum(-1)
        q = np.cross(r, e1)
        v = f * (d[:, None] * q).sum(-1)
        t = f * (e2 * q).sum(-1)
        return (u >= 0) & (u <= 1) & (v >= 0) & (u + v <= 1) & (t > 1e-12) & (t < length[:, None])


class BoxTree:
    """Triangles (n, 3, 3) along a Morton curve, eight a leaf, and boxes of leaves, of pairs of leaves, and so on."""

    def __init__(self, tri: np.ndarray):
        middle = tri.mean(axis=1)
        low = middle.min(axis=0)
        cell = np.maximum(middle.max(axis=0) - low, 1e-9) / 1023
        at = np.floor((middle - low) / cell).astype(np.int64)
        order = np.argsort(morton(at[:, 0], at[:, 1], at[:, 2]), kind="stable")
        leaves = 1 << max(0, math.ceil(math.log2(-(-len(tri) // _LEAF))))
        self.tri = np.full((leaves * _LEAF, 3, 3), np.nan)
        self.tri[: len(tri)] = tri[order]
        corners = self.tri.reshape(leaves, _LEAF * 3, 3)
        lo, hi = np.fmin.reduce(corners, axis=1) - PAD, np.fmax.reduce(corners, axis=1) + PAD
        self.levels = [(lo, hi)]
        while len(lo) > 1:
            lo, hi = np.fmin(lo[::2], lo[1::2]), np.fmax(hi[::2], hi[1::2])
            self.levels.append((lo, hi))

    def hit(self, origin: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Whether each segment meets any triangle: rays and nodes go down level by level, pairs apart from each other fall out."""
        out = np.zeros(len(origin), bool)
        for s in range(0, len(origin), 2048):
            o, d = origin[s : s + 2048], target[s : s + 2048] - origin[s : s + 2048]
            ray, node = np.arange(len(o)), np.zeros(len(o), np.int64)
            for lo, hi in reversed(self.levels):
                if len(self.levels) > 1 and len(lo) > 1:
                    ray, node = np.repeat(ray, 2), np.repeat(node * 2, 2)
                    node[1::2] += 1
                keep = boxes_met(o[ray], d[ray], lo[node], hi[node])
                ray, node = ray[keep], node[keep]
            leaves = self.tri.reshape(-1, _LEAF, 3, 3)
            for p in range(0, len(ray), 65_536):
                r, n = ray[p : p + 65_536], node[p : p + 65_536]
                found = meets(o[r], o[r] + d[r], leaves[n]).any(axis=1)
                out[s + r[found]] = True
        return out


def boxes_met(o: np.ndarray, d: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Whether segments from o by d meet boxes, row by row; empty (NaN) boxes are never met."""
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = (lo - o) / d, (hi - o) / d
    near, far = np.fmin(a, b), np.fmax(a, b)
    still = d == 0
    inside = (o >= lo) & (o <= hi)
    near, far = np.where(still, np.where(inside, -np.inf, np.inf), near), np.where(still, np.where(inside, np.inf, -np.inf), far)
    near, far = near.max(axis=1), far.min(axis=1)
    return (near <= far) & (far >= 0) & (near <= 1) & ~np.isnan(lo[:, 0])


def tiles_crossed(ends: np.ndarray, low: np.ndarray, high: np.ndarray, edge: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, Morton code) of the tiles that segments (n, 6) cross within a box, its low corner the origin of the tiles.

    A segment is cut where it enters the box, at each plane between tiles, and where it leaves; the middle of each part
    tells its tile.
    """
    o, d = ends[:, :3], ends[:, 3:] - ends[:, :3]
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = (low - o) / d, (high - o) / d
    still = d == 0
    inside = (o >= low) & (o <= high)
    near = np.where(still, np.where(inside, -np.inf, np.inf), np.fmin(a, b)).max(axis=1)
    far = np.where(still, np.where(inside, np.inf, -np.inf), np.fmax(a, b)).min(axis=1)
    first, last = np.maximum(near, 0.0), np.minimum(far, 1.0)
    live = np.flatnonzero(first <= last)
    o, d, first, last = o[live], d[live], first[live], last[live]
    start, stop = (o + d * first[:, None] - low) / edge, (o + d * last[:, None] - low) / edge
    rows, cuts = [np.arange(len(live))] * 2, [first, last]
    for axis in range(3):
        s, e = start[:, axis], stop[:, axis]
        n = np.where(d[:, axis] == 0, 0, np.floor(np.maximum(s, e)) - np.ceil(np.minimum(s, e)) + 1).astype(np.int64).clip(0)
        r = np.repeat(np.arange(len(live)), n)
        plane = np.ceil(np.minimum(s, e))[r] + np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)
        rows.append(r)
        cuts.append(((plane * edge + low[axis] - o[r, axis]) / d[r, axis]).clip(first[r], last[r]))
    row, t = np.concatenate(rows), np.concatenate(cuts)
    order = np.lexsort((t, row))
    row, t = row[order], t[order]
    same = row[1:] == row[:-1]
    row, middle = row[:-1][same], ((t[1:] + t[:-1]) / 2)[same]
    most = np.floor((high - low) / edge)
    cell = np.floor((o[row] + d[row] * middle[:, None] - low) / edge).clip(0, most).astype(np.int64)
    code = morton(cell[:, 0], cell[:, 1], cell[:, 2])
    pairs = np.unique(np.stack([row, code], 1), axis=0) if len(row) else np.empty((0, 2), np.int64)
    return live[pairs[:, 0]], pairs[:, 1]


def _tiled(mesh: DataFrame, low: np.ndarray, edge: float) -> DataFrame:
    """Triangles with level and code, once for each tile that their box touches: eight at most, as a level's tiles are no smaller."""
    box = mesh.select(*CORNERS, *[F.least(*[F.col(f"{c}{i}") for i in range(3)]).alias(f"lo_{c}") for c in "xyz"], *[F.greatest(*[F.col(f"{c}{i}") for i in range(3)]).alias(f"hi_{c}") for c in "xyz"])
    extent = F.greatest(*[F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in "xyz"]) + 2 * PAD
    out = box.withColumn("level", F.greatest(F.lit(0), F.ceil(F.log2(extent / edge))).cast("int"))
    size = F.pow(F.lit(2.0), F.col("level")) * edge
    for c, l in zip("xyz", low):
        place = lambda v, l=l: F.greatest(F.floor((v - float(l)) / size).cast("long"), F.lit(0))
        out = out.withColumn(f"i{c}", F.explode(F.sequence(place(F.col(f"lo_{c}") - PAD), place(F.col(f"hi_{c}") + PAD))))
    return out.withColumn("code", morton(F.col("ix"), F.col("iy"), F.col("iz"))).drop("ix", "iy", "iz")


def _meets_box() -> Column:
    """The segment of a row meets the box lo to hi of the row."""
    near, far = [], []
    for c in "xyz":
        o, d, lo, hi = F.col(f"r{c}"), F.col(f"s{c}") - F.col(f"r{c}"), F.col(f"lo_{c}") - PAD, F.col(f"hi_{c}") + PAD
        inside = (o >= lo) & (o <= hi)
        a, b = F.when(d != 0, (lo - o) / d), F.when(d != 0, (hi - o) / d)
        near.append(F.when(d != 0, F.least(a, b)).when(inside, -math.inf).otherwise(math.inf))
        far.append(F.when(d != 0, F.greatest(a, b)).when(inside, math.inf).otherwise(-math.inf))
    n, f = F.greatest(*near), F.least(*far)
    return (n <= f) & (f >= 0) & (n <= 1)


def blocked_rays(rays: DataFrame, mesh: DataFrame, edge: float = 64.0, group_rays: int = GROUP_RAYS, group_triangles: int = GROUP_TRIANGLES) -> DataFrame:
    """The distinct segments (rx, ry, rz to sx, sy, sz) that a triangle (x0..z2) of the mesh lies across.

    Triangles go to tiles of the lowest level whose edge is no smaller than they are, so to eight at most. A segment is
    clipped to the mesh's box, joined with the tiles it crosses at each level that holds triangles, and left out of those
    whose triangles' box it misses. Tile, part of its triangles and part of its segments then meet in groups of bounded
    size, however many cross a hot tile. Neither side is collected or broadcast whole.
    """
    ends = rays.select(*[F.col(c).cast("double").alias(c) for c in ENDS])
    ends = ends.where(" and ".join(f"{c} is not null and not isnan({c})" for c in ENDS)).distinct()
    solid = mesh.select(*[F.col(c).cast("double").alias(c) for c in CORNERS]).where(" and ".join(f"{c} is not null and not isnan({c})" for c in CORNERS))
    none = ends.limit(0)
    span = solid.agg(*[F.min(F.least(*[F.col(f"{c}{i}") for i in range(3)])).alias(f"lo_{c}") for c in "xyz"], *[F.max(F.greatest(*[F.col(f"{c}{i}") for i in range(3)])).alias(f"hi_{c}") for c in "xyz"]).first()
    if span["lo_x"] is None:
        return none
    low, high = np.array([span[f"lo_{c}"] for c in "xyz"]) - 2 * PAD, np.array([span[f"hi_{c}"] for c in "xyz"]) + 2 * PAD
    edge = max(float(edge), float((high - low).max()) / _TILE_AXIS)
    tiled = _tiled(solid, low, edge)
    tiles = cut(tiled.groupBy("level", "code").agg(F.count("*").alias("held"), *[F.min(f"lo_{c}").alias(f"lo_{c}") for c in "xyz"], *[F.max(f"hi_{c}").alias(f"hi_{c}") for c in "xyz"]))
    levels = sorted(r["level"] for r in tiles.select("level").distinct().collect())  # some twenty at most

    def crossing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b[ENDS].to_numpy(float)
            for level in levels:
                for s in range(0, len(x), 4096):
                    row, code = tiles_crossed(x[s : s + 4096], low, high, edge * 2.0**level)
                    out = pd.DataFrame(x[s + row], columns=ENDS)
                    out["level"], out["code"] = np.int32(level), code
                    yield out

    places = ", ".join(f"{c} double" for c in ENDS)
    met = ends.mapInPandas(crossing, f"{places}, level int, code long").join(tiles, ["level", "code"]).where(_meets_box()).select("level", "code", *ENDS)
    met = cut(met)
    parts = met.groupBy("level", "code").agg(F.ceil(F.count("*") / group_rays).cast("int").alias("ray_parts"))
    parts = parts.join(tiles.select("level", "code", F.ceil(F.col("held") / group_triangles).cast("int").alias("tri_parts")), ["level", "code"])
    key = ["level", "code", "tri_part", "ray_part"]
    left = met.join(parts, ["level", "code"]).withColumn("ray_part", F.pmod(F.xxhash64(*ENDS), F.col("ray_parts")).cast("int"))
    left = left.withColumn("tri_part", F.explode(F.sequence(F.lit(0), F.col("tri_parts") - 1))).select(*key, *ENDS)
    right = tiled.join(parts, ["level", "code"]).withColumn("tri_part", F.pmod(F.xxhash64(*CORNERS), F.col("tri_parts")).cast("int"))
    right = right.withColumn("ray_part", F.explode(F.sequence(F.lit(0), F.col("ray_parts") - 1))).select(*key, *CORNERS)

    def tested(r: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(r) or not len(t):
            return r[ENDS].iloc[:0]
        x = r[ENDS].to_numpy(float)
        return r[ENDS][BoxTree(t[CORNERS].to_numpy(float).reshape(-1, 3, 3)).hit(x[:, :3], x[:, 3:])]

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(tested, places).distinct()


def sight_lines(rays: DataFrame, mesh: DataFrame, edge: float = 64.0) -> DataFrame:
    """All columns of the rays, and los: no triangle of the mesh lies between the ends.

    Segments of no length see each other; those with a null or NaN end have a null los. Triangles with such a corner are
    left out. Repeated rays are traced once and keep their rows. An empty mesh blocks none. A column los is replaced.
    """
    base = rays.drop("los")
    ends = [F.col(c).cast("double") for c in ENDS]
    whole = ~F.greatest(*[F.coalesce(F.isnan(c) | c.isNull(), F.lit(True)).cast("int") for c in ends]).cast("boolean")
    found = blocked_rays(rays, mesh, edge).select(*[F.col(c).alias(f"__{c}") for c in ENDS], F.lit(True).alias("__blocked"))
    on = [F.col(c).cast("double") == F.col(f"__{c}") for c in ENDS]
    out = base.join(found, on, "left")
    return out.select(*base.columns, F.when(whole, F.col("__blocked").isNull()).alias("los"))


def weight_by_sight(residuals: DataFrame, mesh: DataFrame, keys: list[str], sigma: float, blocked_sigma: float, blocked_bias: float, blocked_chance: float = 1.0, clear_chance: float = 0.0, edge: float = 64.0) -> DataFrame:
    """Log weight of each key from pseudorange residuals whose satellites are traced through the mesh.

    Rows hold x, y, z and sx, sy, sz (the ends), r (observed less predicted) and w. A clear satellite has its Gaussian
    term of sigma, a blocked one that of blocked_sigma about blocked_bias, which is taken only from a positive residual;
    either is mixed with the other by the chance that it is blocked all the same.
    """
    traced = sight_lines(residuals.select(*residuals.columns, *[F.col(c).alias(f"r{c}") for c in "xyz"]), mesh, edge)
    late = F.when(F.col("r") > 0, F.col("r") - blocked_bias).otherwise(F.col("r"))
    clear = -0.5 * F.col("w") * F.col("r") * F.col("r") / sigma**2
    shaded = -0.5 * F.col("w") * late * late / blocked_sigma**2

    def mixed(p: float) -> Column:
        if p <= 0:
            return clear
        if p >= 1:
            return shaded
        a, b = clear + math.log1p(-p), shaded + math.log(p)
        return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))

    return traced.groupBy(*keys).agg(F.sum(F.when(F.col("los"), mixed(clear_chance)).otherwise(mixed(blocked_chance))).alias("log_weight"))
