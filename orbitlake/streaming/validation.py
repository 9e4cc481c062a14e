"""Validation and hold of carrier solutions: scores from an epoch's counts, and the state machine over a run's epochs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .machines import Machine, decayed, elapsed

# Names of the result columns.
RESULTS = [
    "validation_quality_score", "validation_quality_ewma_30s", "validation_quality_ewma_120s",
    "validation_block_score", "validation_block_count_score", "validation_raw_block_score", "validation_doppler_block_score",
    "validation_block_ewma_30s", "validation_block_ewma_120s",
    "validation_hard_block", "validation_severe_block", "validation_block_spike", "validation_reject_block", "validation_gap_reset",
    "validation_pass", "validation_soft_pass", "validation_pass_ewma_30s",
    "validation_recent_pass_s", "validation_recent_block_s", "validation_severe_recent_s", "validation_reject_recent_s", "validation_block_cooldown_s",
    "validation_pass_count", "validation_block_count",
    "validation_continuity_support", "validation_long_continuity_support", "validation_los_support", "validation_clean_phase_support",
    "hold_state", "hold_age_s", "hold_since_reset_s", "hold_reset_count", "hold_ready", "hold_strict_ready",
    "hold_carry_score", "hold_validation_confidence", "hold_state_x_quality_ewma_120s", "hold_state_x_low_block_factor",
    "clean_streak_s", "strict_clean_streak_s",
]
SUMMARISED = [
    "validation_quality_score", "validation_block_score", "validation_pass", "validation_hard_block", "validation_severe_block", "validation_reject_block",
    "validation_recent_pass_s", "validation_recent_block_s", "validation_reject_recent_s", "hold_state", "hold_ready", "hold_strict_ready", "hold_carry_score",
]
INPUTS = ["quality", "block", "count_block", "raw_block", "doppler_block", "hard", "severe", "continuity", "long_continuity", "los_support", "clean_phase"]

_STATE = ["t", "quality_30", "quality_120", "block_30", "block_120", "pass_30", "recent_pass", "recent_block", "recent_severe", "recent_reject", "cooldown", "hold", "age", "since_reset", "resets", "passes", "blocks", "clean", "strict"]
_NEVER = 9999.0


def scores(epochs: DataFrame) -> DataFrame:
    """All columns and the machine's inputs, from counts of an epoch; counts that are absent or null have their default.

    Names of the counts are fixed values of the epoch table. Everything is columns of the row: no shuffle.
    """

    def of(name: str, other: float = 0.0) -> Column:
        if name not in epochs.columns:
            return F.lit(other)
        return F.coalesce(F.col(name).try_cast("double"), F.lit(other))

    finite = lambda v: ~F.isnan(v) & (F.abs(v) < float("inf"))
    over = lambda v: F.when(finite(v) & (v > 0), v).otherwise(0.0)

    def most(*values: Column) -> Column:
        return F.coalesce(F.greatest(*[F.when(finite(v), v) for v in values], F.lit(None).cast("double")), F.lit(0.0))

    sim = lambda name: of(f"sim_{name}")
    phase = lambda name: of(f"rinex_phase_{name}")
    continuity = most(phase("streak_ge30p0s_count"), of("rinex_gf_streak_ge30p0s_count"), sim("adop_cont_ge30p0s_count"), sim("adop_all_count"))
    long_continuity = most(phase("streak_ge60p0s_count"), of("rinex_gf_streak_ge60p0s_count"), sim("adop_cont_ge60p0s_count"))
    sight = [sim(f"los_{system}cont_ge{s}p0s_count") for s in (30, 60) for system in ("", "system_g_")]
    los_support = most(*sight, sim("adop_los_count"))
    adop = [F.when(finite(v), v) for v in (of(f"sim_adop_{k}_log10_adop", 3.0) for k in ("cont_ge30p0s", "cont_ge60p0s", "los", "all"))]
    elevation = most(sim("adop_cont_ge30p0s_mean_el_deg"), sim("adop_los_mean_el_deg"))
    lock = F.coalesce(F.least(*adop), F.lit(float("nan")))
    quarter, half, whole = phase("jump_ge0p25cy_count"), phase("jump_ge0p5cy_count"), phase("jump_ge1p0cy_count")
    slip, long_slip = of("rinex_gf_slip_ge0p2m_count"), of("rinex_gf_slip_ge0p5m_count")
    lli = phase("lli_count")
    raw = {k: phase(f"raw_delta_cycles_{k}") for k in ("p50", "p90", "max")}
    doppler = {k: phase(f"doppler_min_residual_cycles_{k}") for k in ("p50", "p90", "max")}
    clean = F.greatest(F.lit(0.0), phase("present_count") - 1.5 * half - slip - 0.5 * lli)
    count_block = 0.6 * quarter + 1.5 * half + 2.0 * whole + 1.2 * slip + 1.8 * long_slip + 0.5 * phase("break_count") + 0.5 * phase("lost_count") + 0.35 * lli
    raw_block = over((raw["p50"] - 250.0) / 250.0) + over((raw["p90"] - 500.0) / 500.0) + over((raw["max"] - 1000.0) / 1000.0)
    doppler_block = over((doppler["p50"] - 0.15) / 0.15) + over((doppler["p90"] - 0.5) / 0.5) + over((doppler["max"] - 1.0) / 1.0)
    jumped = (whole >= 1) | (raw["p50"] >= 600) | (raw["p90"] >= 1000) | (raw["max"] >= 5000) | (doppler["p90"] >= 0.7) | (doppler["max"] >= 1.5)
    told = {
        "quality": continuity + 0.45 * long_continuity + 0.30 * los_support + 0.12 * clean + 0.02 * elevation + over(-lock),
        "block": count_block + raw_block + doppler_block,
        "count_block": count_block, "raw_block": raw_block, "doppler_block": doppler_block,
        "hard": (jumped | (half >= 1) | (long_slip >= 1)).cast("double"), "severe": (jumped | (half >= 3)).cast("double"),
        "continuity": continuity, "long_continuity": long_continuity, "los_support": los_support, "clean_phase": clean,
    }
    return epochs.select(*[c for c in epochs.columns if c not in told], *[v.cast("double").alias(k) for k, v in told.items()])


def validation(max_gap: float = 2.0, hard_cooldown: float = 10.0, severe_cooldown: float = 60.0, severe_memory: float = 120.0, forget_after: float = float("inf")) -> Machine:
    """The machine over scores(): cooldowns after blocks, passes, a hold that grows with passes and decays, clean streaks.

    A pause of over max_gap seconds counts as a severe block. Times are seconds; equal times pass no time.
    """

    def step(s: np.ndarray, t: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        was = dict(zip(_STATE, s.T))
        new = np.isnan(was["t"])
        dt, gap = elapsed(was["t"], t), ~new & (t - was["t"] > max_gap)
        now = {k: np.where(new, _NEVER if k == "since_reset" else 0.0, was[k]) for k in _STATE[6:]}
        v = dict(zip(INPUTS, np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0).T))
        for k, tau in (("quality", 30), ("quality", 120), ("block", 30), ("block", 120)):
            now[f"{k}_{tau}"] = decayed(was[f"{k}_{tau}"], v[k], dt, tau)
        severe, hard, spike = (v["severe"] > 0) | gap, (v["hard"] > 0) | gap, v["block"] >= 10
        reject, firm = severe | spike, hard | (v["block"] >= 2)
        ebb = lambda k: np.maximum(now[k] - dt, 0.0)
        now["cooldown"], now["recent_severe"], now["recent_reject"] = (
            np.where(reject, np.maximum(now["cooldown"], severe_cooldown), np.where(firm, np.maximum(now["cooldown"], hard_cooldown), ebb("cooldown"))),
            np.where(reject, np.maximum(now["recent_severe"], severe_memory), np.where(firm, now["recent_severe"], ebb("recent_severe"))),
            np.where(reject, np.maximum(now["recent_reject"], severe_memory), np.where(firm, np.maximum(now["recent_reject"], hard_cooldown), ebb("recent_reject"))),
        )
        calm = now["cooldown"] <= 0
        passed = ~hard & calm & (v["quality"] >= 5) & (now["quality_30"] >= 4.5) & (v["continuity"] >= 3) & (v["block"] <= 1.25) & (now["block_30"] <= 0.9)
        soft = ~hard & (now["cooldown"] <= 2) & (v["quality"] >= 4) & (v["continuity"] >= 2) & (v["block"] <= 1.75) & (now["block_30"] <= 1.25)
        now["pass_30"] = decayed(was["pass_30"], passed.astype(float), dt, 30)
        now["passes"] = now["passes"] + passed
        now["recent_pass"] = np.maximum(now["recent_pass"] + dt * np.where(passed, 1.0, np.where(soft, 0.25, -1.5)), 0.0)
        stopped = firm | ~calm
        now["blocks"] = now["blocks"] + stopped
        now["recent_block"] = np.maximum(now["recent_block"] + np.where(stopped, dt, -dt), 0.0)
        broken, held = hard | ~calm, now["hold"] > 0
        grow = np.where(passed, dt / 20, np.where(soft & held, dt / 80, -np.where(v["block"] <= 1.5, dt / 60, dt / 25)))
        now["hold"] = np.where(broken, 0.0, np.clip(now["hold"] + grow, 0.0, 1.0))
        now["age"] = np.where(broken, 0.0, np.maximum(now["age"] + dt * np.where(passed, 1.0, np.where(soft & held, 0.5, -0.5)), 0.0))
        now["since_reset"] = np.where(broken, 0.0, np.minimum(now["since_reset"] + dt, _NEVER))
        now["resets"] = now["resets"] + hard
        dirty = hard | reject
        now["clean"] = np.where(dirty, 0.0, now["clean"] + dt)
        now["strict"] = np.where(passed, now["strict"] + dt, np.where(dirty | ~soft, 0.0, now["strict"]))
        now["t"] = t
        low = np.exp(-np.minimum(now["block_120"], 8.0) / 2.5)
        ready = lambda hold, recent, block: ((now["hold"] >= hold) & (now["recent_pass"] >= recent) & calm & (now["block_30"] <= block)).astype(float)
        out = [
            v["quality"], now["quality_30"], now["quality_120"], v["block"], v["count_block"], v["raw_block"], v["doppler_block"], now["block_30"], now["block_120"],
            hard, severe, spike, reject, gap, passed, soft, now["pass_30"], now["recent_pass"], now["recent_block"], now["recent_severe"], now["recent_reject"], now["cooldown"],
            now["passes"], now["blocks"], v["continuity"], v["long_continuity"], v["los_support"], v["clean_phase"],
            now["hold"], now["age"], now["since_reset"], now["resets"], ready(0.35, 5, 1.25), ready(0.65, 12, 0.75),
            now["hold"] * np.maximum(now["quality_120"], 0.0) * low, np.clip(now["pass_30"], 0.0, 1.0), now["hold"] * now["quality_120"], now["hold"] * low,
            now["clean"], now["strict"],
        ]
        return np.stack([now[k] for k in _STATE], 1), np.stack([np.asarray(o, float) for o in out], 1)

    return Machine(step, len(_STATE), INPUTS, RESULTS, forget_after)


def summary(rows: DataFrame) -> DataFrame:
    """Epochs of each track, and mean and largest value of the summarised columns."""
    return rows.groupBy("track").agg(F.count("*").alias("epochs"), *[f(c).alias(f"{c}_{n}") for c in SUMMARISED for n, f in (("mean", F.avg), ("max", F.max))])
