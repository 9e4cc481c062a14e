"""Per-epoch estimators: normal equations by aggregation, Gauss-Newton by grouped maps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geodesy import LIGHT, OMEGA, A


def line_fit(df: DataFrame, by: list[str], x: Column, y: Column) -> DataFrame:
    """Least-squares line of each group from five sums, combined where the rows are read."""
    s = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"))
    det = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when(det != 0, (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / det)
    return s.select(*by, "n", slope.alias("slope"), ((F.col("sy") - slope * F.col("sx")) / F.col("n")).alias("intercept"))


def normal_sums(h: list[Column], y: Column, w: Column) -> list[Column]:
    """Aggregates a00, a01, ... (upper triangle of H'WH) and b0, b1, ... (H'Wy) of design columns h."""
    n = len(h)
    return [F.sum(w * h[i] * h[j]).alias(f"a{i}{j}") for i in range(n) for j in range(i, n)] + [F.sum(w * h[i] * y).alias(f"b{i}") for i in range(n)]


def solve_sums(sums: DataFrame, n: int, names: list[str], least: float = 1e-12) -> DataFrame:
    """The rows with the solution of their normal equations under `names`; null where the matrix is as good as singular.

    Only the sums of an epoch reach the small solves, a batch of epochs at a time.
    """
    upper = [(i, j) for i in range(n) for j in range(i, n)]

    @F.pandas_udf(", ".join(f"{c} double" for c in names))
    def solve(p: pd.DataFrame) -> pd.DataFrame:
        m = np.empty((len(p), n, n))
        for i, j in upper:
            m[:, i, j] = m[:, j, i] = p[f"a{i}{j}"]
        v = np.stack([p[f"b{i}"].to_numpy(float) for i in range(n)], axis=1)
        scale = np.sqrt(np.abs(np.diagonal(m, axis1=1, axis2=2)))
        unit = m / np.maximum(scale[:, :, None] * scale[:, None, :], 1e-300)
        fine = np.isfinite(unit).all(axis=(1, 2)) & np.isfinite(v).all(axis=1)
        fine[fine] &= np.abs(np.linalg.det(unit[fine])) > least
        out = np.full((len(p), n), np.nan)
        out[fine] = np.linalg.solve(m[fine], v[fine][:, :, None])[:, :, 0]
        return pd.DataFrame(out, columns=names)

    used = [*[f"a{i}{j}" for i, j in upper], *[f"b{i}" for i in range(n)]]
    return sums.withColumn("__x", solve(F.struct(*used))).select(*sums.columns, "__x.*")


def doppler_velocity(meas: DataFrame, by: list[str], receiver: list[Column], wavelength: float, least: int = 4) -> DataFrame:
    """(by, n, vx, vy, vz, drift) from columns sx..sz, svx..svz, doppler (hertz) and w: the model is linear, so one solve."""
    d = [F.col(f"s{a}") - r for a, r in zip("xyz", receiver)]
    length = F.sqrt(sum((x * x for x in d), F.lit(0.0)))
    los = [x / length for x in d]
    y = F.col("doppler") * wavelength - sum((F.col(f"sv{a}") * l for a, l in zip("xyz", los)), F.lit(0.0))
    sums = meas.groupBy(*by).agg(F.count("*").alias("n"), *normal_sums([*[-l for l in los], F.lit(1.0)], y, F.col("w"))).where(F.col("n") >= least)
    return solve_sums(sums, 4, ["vx", "vy", "vz", "drift"]).select(*by, "n", "vx", "vy", "vz", "drift")


def carrier_velocity(meas: DataFrame, track: list[str], epoch: str, at: str, receiver: list[Column], wavelength: float, least: int = 5, most_jump: float = 20000.0, most_rms: float = 10.0, most_speed: float = 50.0) -> DataFrame:
    """(track, epoch, n, vx, vy, vz, rms) from carrier differences of the satellites that two epochs in a row share.

    Columns satellite, snr, phase (cycles), sx..sz, svx..svz, clock_drift (s/s) and w. Of several rows of a satellite the
    strongest counts, none if the two best are within 0.05 dB. Epochs with few satellites, a large RMS or an impossible
    speed give no row. Two aggregations by (track, epoch): the sums, and the residuals of the solution.
    """
    key = [*track, "satellite"]
    rank = Window.partitionBy(*key, epoch).orderBy(F.desc("snr"))
    one = meas.withColumns({"__k": F.row_number().over(rank), "__gap": F.col("snr") - F.lead("snr").over(rank)})
    one = one.where("__k = 1").where(F.col("__gap").isNull() | (F.col("__gap") > 0.05))
    w = Window.partitionBy(*key).orderBy(epoch)
    cols = [at, "phase", "clock_drift", "w", *[f"s{a}" for a in "xyz"], *[f"sv{a}" for a in "xyz"]]
    both = one.withColumns({f"p_{c}": F.lag(c).over(w) for c in [epoch, *cols]}).where(F.col(f"p_{epoch}") == F.col(epoch) - 1)
    both = both.where((F.abs("phase") > 1e-12) & (F.abs("p_phase") > 1e-12) & (F.abs(F.col("phase") - F.col("p_phase")) <= most_jump))
    dt = F.col(at) - F.col(f"p_{at}")
    d = [(F.col(f"s{a}") + F.col(f"p_s{a}")) * 0.5 - r for a, r in zip("xyz", receiver)]
    length = F.sqrt(sum((x * x for x in d), F.lit(0.0)))
    moved = sum((x / length * 0.5 * (F.col(f"sv{a}") + F.col(f"p_sv{a}")) for a, x in zip("xyz", d)), F.lit(0.0)) * dt
    y = (F.col("phase") - F.col("p_phase")) * wavelength - moved + 0.5 * (F.col("clock_drift") + F.col("p_clock_drift")) * LIGHT * dt
    wt = F.when((F.col("w") > 0) & (F.col("p_w") > 0), F.sqrt(F.col("w") * F.col("p_w"))).otherwise(F.lit(1.0))
    rows = both.select(*track, epoch, dt.alias("dt"), *[(x / length).alias(f"h{i}") for i, x in enumerate(d)], y.alias("y"), wt.alias("wt")).where("dt > 0")
    h = [F.col("h0"), F.col("h1"), F.col("h2"), F.lit(1.0)]
    sums = rows.groupBy(*track, epoch).agg(F.count("*").alias("n"), F.first("dt").alias("step"), *normal_sums(h, F.col("y"), F.col("wt"))).where(F.col("n") >= least)
    fit = solve_sums(sums, 4, ["x0", "x1", "x2", "x3"]).where("x0 is not null").select(*track, epoch, "n", "step", "x0", "x1", "x2", "x3")
    off = F.col("y") - sum((h[i] * F.col(f"x{i}") for i in range(4)), F.lit(0.0))
    rms = rows.join(fit, [*track, epoch]).groupBy(*track, epoch, "n", "step", "x0", "x1", "x2").agg(F.sqrt(F.avg(off * off)).alias("rms")).where(F.col("rms") <= most_rms)
    out = rms.select(*track, epoch, "n", *[(F.col(f"x{i}") / F.col("step")).alias(f"v{a}") for i, a in enumerate("xyz")], "rms")
    return out.where(F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy") + F.col("vz") * F.col("vz")) <= most_speed)


def chi_square_limit(dof: Column, p_fa: float) -> Column:
    """Upper quantile of chi square by the cube-root approximation, the normal quantile by a rational one."""
    t = (-2.0 * np.log(p_fa if p_fa <= 0.5 else 1 - p_fa)) ** 0.5
    z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1.0 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t**3)
    z = float(z if p_fa <= 0.5 else -z)
    a = 1.0 - 2.0 / (9.0 * dof) + z * F.sqrt(2.0 / (9.0 * dof))
    return F.when(dof > 0, F.greatest(dof * a * a * a, F.lit(0.0))).otherwise(F.lit(0.0))


def integrity(rows: DataFrame, by: list[str], residual: str, weight: str, p_fa: float = 1e-3) -> DataFrame:
    """(by, n, statistic, threshold, ok): the weighted sum of squared residuals of an epoch against its chi-square limit."""
    s = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col(weight) * F.col(residual) * F.col(residual)).alias("sse"))
    spare = F.col("n") - 4
    s = s.withColumns({"statistic": F.when(spare > 0, F.col("sse")).otherwise(0.0), "threshold": chi_square_limit(spare, p_fa)})
    return s.select(*by, "n", "statistic", "threshold", F.when(spare > 0, F.col("statistic") <= F.col("threshold")).otherwise(F.col("n") >= 4).alias("ok"))


def weighted_clock(rows: DataFrame, by: list[str], residual: str, weight: str) -> DataFrame:
    """Clock of each group at a fixed position: the weighted mean of residuals with a positive weight."""
    fine = rows.where((F.col(weight) > 0) & F.col(residual).isNotNull() & ~F.isnan(residual))
    return fine.groupBy(*by).agg((F.sum(F.col(weight) * F.col(residual)) / F.sum(weight)).alias("clock"), F.count("*").alias("n"))


def _normal_sums(epoch: np.ndarray, n: int, *columns: np.ndarray) -> np.ndarray:
    return np.stack([np.bincount(epoch, c, n) for c in columns], axis=1)


def solve_epochs(epoch: np.ndarray, sat: np.ndarray, rho: np.ndarray, w: np.ndarray, sagnac: bool, rounds: int, tol: float, system: np.ndarray | None = None, robust: str | None = None, threshold: float = 15.0, least: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Newton for all epochs at once: (x, y, z, clocks) and the rounds that each took.

    Starts below the mean satellite at the earth's radius; the small systems come from sums over each epoch's rows.
    With `system` (0, 1, ...) each system has a clock of its own; one that an epoch lacks stays 0. With `robust`, the plain
    solution comes first, then weights shrink with the residuals (cauchy, huber), and an epoch with fewer than `least` rows of a
    weight over 0.1 has no result.
    """
    first = solve_epochs(epoch, sat, rho, w, sagnac, rounds, tol, system)[0] if robust else None  # weights need a start
    n, clocks = int(epoch.max()) + 1, 1 if system is None else int(system.max()) + 1
    system = np.zeros(len(epoch), np.int64) if system is None else system
    size = 3 + clocks
    count = np.bincount(epoch, minlength=n)
    centre = _normal_sums(epoch, n, *sat.T) / count[:, None]
    x = np.hstack([centre / np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1.0) * A, np.zeros((n, clocks))]) if first is None else first
    took, live, prior = np.zeros(n, np.int64), count >= 4, w
    for k in range(1, rounds + 1):
        if not live.any():
            break
        at, s = x[epoch], sat
        if sagnac:
            turn = OMEGA * np.linalg.norm(sat - at[:, :3], axis=1) / LIGHT
            s = np.column_stack([np.cos(turn) * sat[:, 0] + np.sin(turn) * sat[:, 1], np.cos(turn) * sat[:, 1] - np.sin(turn) * sat[:, 0], sat[:, 2]])
        d = s - at[:, :3]
        r = np.linalg.norm(d, axis=1)
        h = np.column_stack([-d / r[:, None], *[(system == s).astype(float) for s in range(clocks)]])
        res = rho - r - at[np.arange(len(r)), 3 + system]
        if robust:
            u = np.abs(res) / threshold
            w = prior * (1.0 / (1.0 + u * u) if robust == "cauchy" else np.minimum(1.0, 1.0 / np.maximum(u, 1e-12)))
            lost = live & (np.bincount(epoch, w > 0.1, n) < least)
            x[lost], live = np.nan, live & ~lost
        m = _normal_sums(epoch, n, *[w * h[:, i] * h[:, j] for i in range(size) for j in range(size)]).reshape(n, size, size)
        v = _normal_sums(epoch, n, *[w * h[:, i] * res for i in range(size)])
        step = np.zeros((n, size))
        step[live] = np.einsum("eij,ej->ei", np.linalg.pinv(m[live]), v[live])
        x += step
        took[live] = k
        live &= np.linalg.norm(step[:, :3], axis=1) >= tol
    return x, took


def wls_positions(meas: DataFrame, by: list[str], sagnac: bool = True, rounds: int = 10, tol: float = 1e-4, systems: int = 1, robust: str | None = None, threshold: float = 15.0) -> DataFrame:
    """Weighted least-squares position and clock of each epoch from columns sx, sy, sz, pr, w.

    Rows are shuffled by epoch and sorted; a task solves the epochs of a batch together. Rows without a positive weight
    or a range count for nothing; epochs with fewer than four satellites have null results. With systems > 1 a column
    `system` (0, 1, ...) gives each row's; isb1, ... are their clocks less the first one's. robust: see solve_epochs().
    """
    keys = [meas.schema[c] for c in by]
    extra = [f"isb{i}" for i in range(1, systems)]
    names = [k.name for k in keys] + ["n", "x", "y", "z", "clock", *extra, "rounds"]
    schema = ", ".join(f"{k.name} {k.dataType.simpleString()}" for k in keys) + ", n int, x double, y double, z double, clock double, " + "".join(f"{c} double, " for c in extra) + "rounds int"

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        epoch = g.groupby(by, dropna=False, sort=False).ngroup().to_numpy()
        fine = ((g["w"] > 0) & g["pr"].notna()).to_numpy()
        first = g[by].iloc[np.unique(epoch, return_index=True)[1]].reset_index(drop=True)
        part = g[fine]
        n = np.bincount(epoch[fine], minlength=len(first))
        out = np.full((len(first), 3 + systems), np.nan)
        took = np.zeros(len(first), np.int64)
        if len(part):
            own = part["system"].to_numpy() if systems > 1 else None
            x, k = solve_epochs(epoch[fine], part[["sx", "sy", "sz"]].to_numpy(float), part["pr"].to_numpy(float), part["w"].to_numpy(float), sagnac, rounds, tol, own, robust, threshold)
            enough = n[: len(x)] >= 4
            out[: len(x), : x.shape[1]][enough], took[: len(x)][enough] = x[enough], k[enough]
            out[:, 4:] -= out[:, 3:4]
        for i, c in enumerate(["n", "x", "y", "z", "clock", *extra, "rounds"]):
            first[c] = n if c == "n" else took if c == "rounds" else out[:, i - 1]
        return first[names]

    def run(batches):
        held = None
        for g in batches:
            g = g if held is None else pd.concat([held, g], ignore_index=True)
            last = g[by].iloc[-1]
            same = np.logical_and.reduce([(g[c] == last[c]) | (g[c].isna() & pd.isna(last[c])) for c in by])
            held = g[same]
            if not same.all():
                yield solve(g[~same])
        if held is not None and len(held):
            yield solve(held)

    return meas.select(*by, "sx", "sy", "sz", "pr", "w", *(["system"] if systems > 1 else [])).repartition(F.xxhash64(*by)).sortWithinPartitions(*by).mapInPandas(run, schema)


def dilution(meas: DataFrame, by: list[str], azimuth: str, elevation: str) -> DataFrame:
    """GDOP, PDOP, HDOP, VDOP of each epoch; 999 with fewer than four satellites or no inverse.

    The ten sums of the normal matrix are aggregated by Spark; only they reach the 4x4 inverse.
    """
    h = [F.cos(elevation) * F.sin(azimuth), F.cos(elevation) * F.cos(azimuth), F.sin(elevation), F.lit(1.0)]
    sums = meas.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(h[i] * h[j]).alias(f"s{i}{j}") for i in range(4) for j in range(i, 4)])

    @F.pandas_udf("struct<gdop: double, pdop: double, hdop: double, vdop: double>")
    def inverse(s: pd.DataFrame) -> pd.DataFrame:
        m = np.empty((len(s), 4, 4))
        for i in range(4):
            for j in range(i, 4):
                m[:, i, j] = m[:, j, i] = s[f"s{i}{j}"]
        fine = (s["n"].to_numpy() >= 4) & (np.abs(np.linalg.det(m)) > 1e-12)
        q = np.full((len(s), 4), np.nan)
        if fine.any():
            q[fine] = np.diagonal(np.linalg.inv(m[fine]), axis1=1, axis2=2)
        dop = lambda k: np.where(fine, np.sqrt(np.maximum(q[:, k].sum(axis=1), 0)), 999.0)
        return pd.DataFrame({"gdop": dop([0, 1, 2, 3]), "pdop": dop([0, 1, 2]), "hdop": dop([0, 1]), "vdop": dop([2])})

    return sums.withColumn("d", inverse(F.struct(*[c for c in sums.columns if c not in by]))).select(*by, "n", "d.*")
