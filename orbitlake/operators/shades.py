"""Sight of particle clouds past a mesh: bundles of rays from near particles to satellites in near directions meet triangles as matrix products."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .particles import _PAIRS, _PLACE, _SKY, _numbers
from .rays import CORNERS, meets

#: Particles of a leaf, leaves and satellites of a bundle; particles and satellites of a group; triangles that a group takes at once.
NEAR, LEAVES, CONE, GROUP_PARTICLES, GROUP_SATELLITES, TRIANGLES = 32, 8, 32, 8192, 4096, 20_000
#: Widest cone of satellites, as a share of a radian.
OPEN = 0.1
#: Metres of a tile of triangles.
EDGE = 64.0


def _leaves(p: np.ndarray, most: int, wide: float = math.inf) -> tuple[np.ndarray, np.ndarray]:
    """An order of points (n, 3) and the starts of its leaves: halves along the widest axis until they have `most` points, no wider than told."""
    out, todo = [], [np.arange(len(p))]
    while todo:
        rows = todo.pop()
        span = np.ptp(p[rows], axis=0)
        if len(rows) <= most and span.max() <= wide:
            out.append(rows)
            continue
        half = -(-len(rows) // (2 * most)) * most if len(rows) > most else len(rows) // 2
        rows = rows[np.argpartition(p[rows, int(np.argmax(span))], half)]
        todo += [rows[half:], rows[:half]]
    return np.concatenate(out), np.append(0, np.cumsum([len(r) for r in out]))


def _near_cone(v: np.ndarray, far: np.ndarray, axis: np.ndarray, angle: float) -> np.ndarray:
    """Whether balls at v (.., 3) of radius far touch the cone of rays from 0 within an angle of the axis."""
    along = v @ axis
    square = (v * v).sum(-1)
    side = np.sqrt(np.maximum(square - along * along, 0.0))
    c, s = math.cos(angle), math.sin(angle)
    if angle > 1.5:
        return np.ones(v.shape[:-1], bool)
    off = side * c - along * s
    return (square <= far * far) | (off <= far) & ((along * c + side * s >= 0) | (off <= 0))


def _cone(to: np.ndarray) -> tuple[np.ndarray, float]:
    """Axis and half angle of a cone around directions (n, 3); a direction of no length takes all."""
    length = np.linalg.norm(to, axis=1)
    ways = to / np.maximum(length, 1e-300)[:, None]
    axis = ways.mean(axis=0)
    size = float(np.linalg.norm(axis))
    if size < 0.1 or (length < 1e-9).any():
        return np.array([0.0, 0.0, 1.0]), math.pi
    axis /= size
    return axis, float(np.arccos(np.clip(ways @ axis, -1, 1)).max()) + 1e-7


def _sides(tri: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of triangles, what the planes of any satellite come from: matrices of the edges (k, 3, 4, 4), own planes (k, 4), lengths and corners.

    A plane through a satellite s and an edge e from a has the normal e x s - e x a and the offset s (e x a), so its four
    numbers are a matrix times (s, 1).
    """
    e = np.roll(tri, -1, axis=1) - tri
    m = np.cross(e, tri)
    rows = np.zeros((len(tri), 3, 4, 4))
    for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1)):
        rows[:, :, i, k], rows[:, :, i, j], rows[:, :, i, 3] = e[:, :, j], -e[:, :, k], -m[:, :, i]
        rows[:, :, 3, i] = m[:, :, i]
    flat = np.cross(e[:, 0], tri[:, 2] - tri[:, 0])
    flat /= np.maximum(np.linalg.norm(flat, axis=1), 1e-300)[:, None]
    return rows, np.concatenate([flat, -(flat * tri[:, 0]).sum(-1)[:, None]], 1), np.linalg.norm(e, axis=2), tri


def _planes(sides: tuple, at: np.ndarray, sats: np.ndarray) -> np.ndarray:
    """Half spaces (triangles, satellites, 4, 4) in single precision whose common part is what a triangle hides from a satellite.

    Rows are unit normals and offsets: three planes through the satellite and an edge, and the triangle's own. All zero
    where rounding could tell another side: a satellite near the triangle's plane, or an edge that points at it.
    """
    rows, own, edges, tri = (x[at] for x in sides)
    k, m = len(at), len(sats)
    ones = np.column_stack([sats, np.ones(m)])
    height = own @ ones.T
    far = np.sqrt(np.maximum((sats * sats).sum(1) - 2 * (tri[:, 0] @ sats.T) + (tri[:, 0] ** 2).sum(1)[:, None], 0.0))
    sure, turn = np.abs(height) > 1e-6 * far + 1e-3, np.sign(height)
    out = np.empty((k, m, 4, 4), np.float32)
    out[:, :, 3] = -turn[:, :, None] * own[:, None]
    # a satellite's distance from the edge's start is that from the first corner within the triangle's size
    far += edges.max(axis=1)[:, None]
    for i in range(3):
        n = (rows[:, i].reshape(-1, 4) @ ones.T).reshape(k, 4, m)
        size = np.sqrt(n[:, 0] * n[:, 0] + n[:, 1] * n[:, 1] + n[:, 2] * n[:, 2])
        sure &= size > 1e-6 * edges[:, i, None] * far
        # the third corner lies on the side that the satellite's height tells
        n *= (-turn / np.maximum(size, 1e-300))[:, None]
        out[:, :, i] = np.swapaxes(n, 1, 2)
    out[~sure] = 0.0
    return out


def _least(g: np.ndarray) -> np.ndarray:
    """The least of four along the second axis of (n, 4, ..)."""
    out = np.minimum(g[:, 0], g[:, 1])
    for i in (2, 3):
        np.minimum(out, g[:, i], out=out)
    return out


def shade(blocked: np.ndarray, place: np.ndarray, sats: np.ndarray, tri: np.ndarray, near: int = NEAR, cone: int = CONE) -> None:
    """Set blocked (n, m) where a triangle (k, 3, 3) lies across the segment from a place (n, 3) to a satellite (m, 3).

    Bundles hold near places and satellites in near directions. A bundle takes the triangles whose ball touches its rays,
    and of these, for each satellite, those whose shadow touches the places' ball. Signed distances to half spaces in single
    precision tell most of the rest; `meets` decides what is nearer than rounding, so the result is that of `meets` on all pairs.
    """
    middle = (place.min(axis=0) + place.max(axis=0)) / 2
    p, s, t = place - middle, sats - middle, tri - middle
    order, starts = _leaves(p, near)
    p = p[order]
    lo, hi = np.minimum.reduceat(p, starts[:-1]), np.maximum.reduceat(p, starts[:-1])
    centre = (lo + hi) / 2
    every = np.arange(0, len(starts) - 1, LEAVES)
    low, high = np.minimum.reduceat(lo, every), np.maximum.reduceat(hi, every)
    spots, wide = (low + high) / 2, np.linalg.norm(high - low, axis=1) / 2 + 1e-3
    radius = np.linalg.norm(hi - lo, axis=1) / 2 + 1e-3
    whole = float(np.linalg.norm(p, axis=1).max()) + 1e-3
    ball = t.mean(axis=1)
    size = np.linalg.norm(t - ball[:, None], axis=2).max(axis=1) + 1e-3
    far = np.linalg.norm(s, axis=1)
    by_way, cones = _leaves(s / np.maximum(far, 1e-300)[:, None], cone, OPEN)
    ones = np.concatenate([p, np.ones((len(p), 1))], 1).astype(np.float32)
    stretch, sides = float(np.abs(p).max()) * 2, _sides(t)
    for c in range(len(cones) - 1):
        mine = by_way[cones[c] : cones[c + 1]]
        # the ray of another place stays as near to that of the middle as the places are: balls are widened by that
        at = np.flatnonzero(_near_cone(ball, size + whole, *_cone(s[mine])))
        if not len(at):
            continue
        planes = _planes(sides, at, s[mine])
        slack = 1e-6 * (float(np.abs(planes[..., 3]).max()) + stretch) + 1e-6
        for first in range(0, len(starts) - 1, LEAVES):
            # triangles of some leaves together, then of each leaf, then for each leaf and satellite
            those, spot = slice(first, first + LEAVES), spots[first // LEAVES]
            axis, angle = _cone(s[mine] - spot)
            on = np.flatnonzero(_near_cone(ball[at] - spot, size[at] + wide[first // LEAVES], axis, angle))
            if not len(on):
                continue
            # ways from a leaf's centre are turned from those of the bundle's by what both are apart, seen from the satellite
            apart = np.linalg.norm(centre[those] - spot, axis=1).max() / max(float(np.linalg.norm(s[mine] - spot, axis=1).min()) - wide[first // LEAVES], 1e-300)
            angle = angle + math.asin(apart) if apart < 0.5 else math.pi
            near_leaf = _near_cone(ball[at[on]] - centre[those, None], size[at[on]] + radius[those, None], axis, angle)
            for b in range(len(near_leaf)):
                some = on[near_leaf[b]]
                if not len(some):
                    continue
                x = slice(starts[first + b], starts[first + b + 1])
                rows, ends = order[x], planes.take(some, axis=0).reshape(-1, 4, 4)
                least = _least((ends.reshape(-1, 4) @ np.append(centre[first + b], 1.0).astype(np.float32)).reshape(-1, 4)).reshape(len(some), -1)
                reach = np.float32(radius[first + b] + slack)
                to, v = s[mine] - centre[first + b], ball[at[some]] - centre[first + b]
                to /= np.maximum(np.linalg.norm(to, axis=1), 1e-300)[:, None]
                along = v @ to.T
                inside = ((v * v).sum(axis=1) - (size[at[some]] + radius[first + b]) ** 2)[:, None]
                close = (least >= -reach) & (along * along >= inside) & ((along > 0) | (inside <= 0))
                covered = least.max(axis=0) > reach
                if covered.any():
                    blocked[rows[:, None], mine[covered][None]] = True
                    close[:, covered] = False
                pairs = np.flatnonzero(close.T)
                if not len(pairs):
                    continue
                m, k = np.divmod(pairs, len(some))
                depth = _least((ends.take(k * len(mine) + m, axis=0).reshape(-1, 4) @ ones[x].T).reshape(len(m), 4, -1))
                new = np.append(True, m[1:] != m[:-1])
                heads = np.flatnonzero(new)
                most = np.maximum.reduceat(depth, heads, axis=0)
                hit = most > slack
                unsure = np.abs(most) <= slack
                if unsure.any():
                    which = np.cumsum(new) - 1
                    open_ = np.flatnonzero(unsure.any(axis=1)[which])
                    pair, y = np.nonzero((np.abs(depth[open_]) <= slack) & unsure[which[open_]])
                    pair = open_[pair]
                    found = meets(place[rows[y]], sats[mine[m[pair]]], tri[at[some[k[pair]]]][:, None])[:, 0]
                    hit[which[pair[found]], y[found]] = True
                blocked[rows[:, None], mine[m[heads]][None]] |= hit.T


def _reached(groups: DataFrame, sky: DataFrame, solid: DataFrame, edge: float) -> DataFrame:
    """(__g, triangle) of the triangles whose tile lies in the box of a group's rays within the mesh's own box."""
    box = [*[F.min(F.least(*[F.col(f"{c}{i}") for i in range(3)])).alias(f"lo_{c}") for c in "xyz"], *[F.max(F.greatest(*[F.col(f"{c}{i}") for i in range(3)])).alias(f"hi_{c}") for c in "xyz"]]
    tiled = solid.withColumns({f"__t{c}": F.floor(F.col(f"{c}0") / edge).cast("long") for c in "xyz"})
    places = [f"__t{c}" for c in "xyz"]
    tiles = tiled.groupBy(*places).agg(*box)
    span = solid.agg(*box).select(*[F.col(f"{e}_{c}").alias(f"all_{e}_{c}") for e in ("lo", "hi") for c in "xyz"])
    r = groups.where("wide is not null").join(sky, "__g").crossJoin(F.broadcast(span))
    near, far = [F.lit(0.0)], [F.lit(1.0)]
    for c in "xyz":
        o, d = F.col(f"mid_{c}"), F.col(f"s{c}") - F.col(f"mid_{c}")
        lo, hi = F.col(f"all_lo_{c}") - F.col("wide"), F.col(f"all_hi_{c}") + F.col("wide")
        a, b, inside = (lo - o) / d, (hi - o) / d, (o >= lo) & (o <= hi)
        near.append(F.when(d != 0, F.least(a, b)).when(inside, -math.inf).otherwise(math.inf))
        far.append(F.when(d != 0, F.greatest(a, b)).when(inside, math.inf).otherwise(-math.inf))
    r = r.withColumns({"near": F.greatest(*near), "far": F.least(*far)}).where("near <= far")
    ends = lambda c: [F.col(f"mid_{c}") + (F.col(f"s{c}") - F.col(f"mid_{c}")) * F.col(t) for t in ("near", "far")]
    reach = r.groupBy("__g").agg(*[F.min(F.least(*ends(c)) - F.col("wide") - 1e-3).alias(f"from_{c}") for c in "xyz"], *[F.max(F.greatest(*ends(c)) + F.col("wide") + 1e-3).alias(f"to_{c}") for c in "xyz"])
    met = reach.join(tiles, [(F.col(f"lo_{c}") <= F.col(f"to_{c}")) & (F.col(f"hi_{c}") >= F.col(f"from_{c}")) for c in "xyz"]).select("__g", *places)
    return met.join(tiled, places).select("__g", *CORNERS)


def cloud_sight_weights(particles: DataFrame, observations: DataFrame, mesh: DataFrame, epoch: list[str], keys: list[str], sigma: float, blocked_sigma: float, blocked_bias: float, blocked_chance: float = 1.0, clear_chance: float = 0.0, edge: float = EDGE) -> DataFrame:
    """rays.weight_by_sight of residuals(particles, observations, epoch), for epochs of any size.

    Particles of an epoch are dealt by cells of space, satellites by a hash, and each two parts are a group. A group's
    particles, satellites and the distinct triangles of the tiles that its rays may reach come sorted to one task, which
    traces them in bundles, some triangles at once. Rays are no rows; no side, and no mesh, is held or sent whole.
    """
    double = lambda names: [F.col(c).cast("double").alias(c) for c in names]
    names = [f"__e{i}" for i in range(len(epoch))]
    on = [F.col(c).alias(n) for c, n in zip(epoch, names)]
    own = particles.select(*on, *[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], *double(_PLACE))
    sky = observations.select(*on, *double([*_SKY, "w"]))
    solid = mesh.select(*double(CORNERS)).where(" and ".join(f"abs({c}) < double('infinity')" for c in CORNERS)).distinct()

    fine = lambda c: F.when(F.abs(c) < math.inf, F.col(c))
    spread = own.groupBy(*names).agg(*[F.min(fine(c)).alias(f"__lo_{c}") for c in "xyz"], F.greatest(*[F.max(fine(c)) - F.min(fine(c)) for c in "xyz"]).alias("__span"), F.ceil(F.sqrt(F.count("*") / GROUP_PARTICLES)).alias("__cells"))
    cell = lambda c: F.coalesce(F.floor((fine(c) - F.col(f"__lo_{c}")) * F.col("__cells") / (F.col("__span") + 1e-9)).cast("long"), F.lit(-1))
    cells = [f"__c{c}" for c in "xyz"]
    own = own.join(spread, names).withColumns({f"__c{c}": cell(c) for c in "xyz"}).drop("__span", "__cells", *[f"__lo_{c}" for c in "xyz"])
    counts = own.groupBy(*names, *cells).agg(F.ceil(F.count("*") / GROUP_PARTICLES).alias("__n"))
    own = own.join(counts, [*names, *cells]).withColumn("__p", F.pmod(F.xxhash64(*[f"__k{i}" for i in range(len(keys))], *_PLACE), F.col("__n")))
    part = [*names, *cells, "__p"]
    sizes = sky.groupBy(*names).agg(F.ceil(F.count("*") / GROUP_SATELLITES).alias("__n"))
    sky = sky.join(sizes, names).withColumn("__o", F.pmod(F.xxhash64(*_SKY, "w"), F.col("__n"))).drop("__n")
    boxes = own.groupBy(*part).agg(*[F.min(fine(c)).alias(f"a{c}") for c in "xyz"], *[F.max(fine(c)).alias(f"b{c}") for c in "xyz"])
    boxes = boxes.select(*part, *[((F.col(f"a{c}") + F.col(f"b{c}")) / 2).alias(f"mid_{c}") for c in "xyz"], (F.sqrt(sum(((F.col(f"b{c}") - F.col(f"a{c}")) * (F.col(f"b{c}") - F.col(f"a{c}")) for c in "xyz"), F.lit(0.0))) / 2).alias("wide"))
    # a written table, so that all sides see the same numbers of groups
    groups = cut(boxes.join(sky.select(*names, "__o").distinct(), names).withColumn("__g", F.monotonically_increasing_id()))

    seen = sky.join(groups.select(*names, "__o", "__g"), [*names, "__o"])
    values = [f"v{i}" for i in range(9)]
    wanted = {f"__k{i}": own.schema[f"__k{i}"].dataType for i in range(len(keys))}
    row = lambda df, kind, cols, ks: df.select("__g", F.lit(kind).alias("kind"), *[F.col(c).alias(v) if c else F.lit(None).cast("double").alias(v) for c, v in zip([*cols, *[None] * 9], values)], *[F.col(k) if ks else F.lit(None).cast(d).alias(k) for k, d in wanted.items()])
    rows = row(own.join(groups.select(*part, "__g"), part), 0, _PLACE, True).unionByName(row(seen, 1, [*_SKY, "w"], False)).unionByName(row(_reached(groups, seen.select("__g", "sx", "sy", "sz").where("abs(sx) < double('infinity') and abs(sy) < double('infinity') and abs(sz) < double('infinity')"), solid, edge), 2, CORNERS, False))
    odds = [(-math.inf if p >= 1 else math.log1p(-p) if p > 0 else 0.0, -math.inf if p <= 0 else math.log(p) if p < 1 else 0.0) for p in (clear_chance, blocked_chance)]
    named = [*[f"__k{i}" for i in range(len(keys))]]

    def closed(held: list[list[pa.Table]], bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        left, right = pa.concat_tables(held[0]), pa.concat_tables(held[1])
        place, placed = _numbers(left, values[:4])
        at, there = _numbers(right, values[:4])
        (w,), weighed = _numbers(right, values[4:5])
        shaded_sky, nan_sky = np.isfinite(at[:3]).all(axis=0) & there, np.isnan(at[:3]).any(axis=0)
        solid_place, nan_place = np.isfinite(place[:3]).all(axis=0), np.isnan(place[:3]).any(axis=0)
        n, out = left.num_rows, np.zeros(left.num_rows)
        fit = there & weighed
        line = np.cumsum(solid_place) - 1
        step = max(1, _PAIRS // max(1, int(fit.sum())))
        sky, w = at[:, fit], w[fit]
        for i in range(0, n if fit.any() else 0, step):
            x, y, z, clock = place[:, i : i + step, None]
            d = (x - sky[0]) ** 2 + (y - sky[1]) ** 2 + (z - sky[2]) ** 2
            r = sky[3] - (np.sqrt(d) + clock)
            hidden = np.zeros((len(r), len(fit)), bool)
            if bits is not None:
                mine = np.flatnonzero(solid_place[i : i + step])
                hidden[mine[:, None], np.flatnonzero(shaded_sky)[None]] = bits[line[i + mine]]
            hidden = (hidden | nan_place[i : i + step, None] | nan_sky)[:, fit]
            late = np.where(r > 0, r - blocked_bias, r)
            with np.errstate(all="ignore"):
                a = -0.5 * w * r * r / sigma**2 + np.where(hidden, odds[1][0], odds[0][0])
                b = -0.5 * w * late * late / blocked_sigma**2 + np.where(hidden, odds[1][1], odds[0][1])
                out[i : i + step] = (np.maximum(a, b) + np.log1p(np.exp(-np.abs(a - b)))).sum(axis=1)
        yield pa.RecordBatch.from_arrays([*[left.column(k).combine_chunks() for k in named], pa.array(out, mask=~(placed & fit.any()))], names=[*named, "term"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, tri, bits, ends = None, [[], []], [], None, None

        def traced() -> None:
            nonlocal bits, ends
            if not tri:
                return
            if ends is None:
                (p, _), (s, there) = _numbers(pa.concat_tables(held[0]), values[:3]), _numbers(pa.concat_tables(held[1]), values[:4])
                ends = p[:, np.isfinite(p).all(axis=0)].T, s[:3, np.isfinite(s[:3]).all(axis=0) & there].T
                bits = np.zeros((len(ends[0]), len(ends[1])), bool)
            if bits.size:
                shade(bits, *ends, np.concatenate(tri).reshape(-1, 3, 3))
            tri.clear()

        for batch in batches:
            g, kind = batch["__g"].to_numpy(), batch["kind"].to_numpy()
            heads = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (kind[1:] != kind[:-1]))) if len(g) else []
            for i, j in zip(heads, [*heads[1:], len(g)]):
                if g[i] != group:
                    if group is not None:
                        traced()
                        yield from closed(held, bits)
                    group, held, bits, ends = g[i], [[], []], None, None
                piece = batch.slice(i, j - i)
                if kind[i] < 2:
                    held[kind[i]].append(pa.Table.from_batches([piece]))
                else:
                    tri.append(np.column_stack([piece[v].to_numpy() for v in values]))
                    if sum(len(x) for x in tri) >= TRIANGLES:
                        traced()
        if group is not None:
            traced()
            yield from closed(held, bits)

    types = ", ".join([*[f"`{k}` {d.simpleString()}" for k, d in wanted.items()], "term double"])
    tasks = 4 * int(particles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = rows.repartition(tasks, "__g").sortWithinPartitions("__g", "kind").mapInArrow(run, types)
    return sums.groupBy(*named).agg(F.sum("term").alias("log_weight")).select(*[F.col(k).alias(c) for k, c in zip(named, keys)], "log_weight")
