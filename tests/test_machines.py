import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from orbitlake.operators import aggregates
from orbitlake.streaming import kalman, machines, navigation_filter, validation


def plain_mean(rows, tau):
    out, was, mean = [], None, math.nan
    for t, v in sorted(rows):
        dt = 0.0 if was is None else t - was
        if math.isnan(mean):
            mean = v
        elif dt > 0:
            k = 1 - math.exp(-dt / tau)
            mean = mean * (1 - k) + k * v
        out.append((t, v, mean))
        was = t
    return out


def near(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == q or (p != p and q != q) or p == pytest.approx(q, rel=1e-9, abs=1e-9) for p, q in zip(x, y)), (x, y)


def test_irregular_mean(spark):
    r = random.Random(1)
    rows = [(k, r.choice([0.0, 1.5, r.uniform(0, 500)]), r.uniform(-5, 5)) for k in "abc" for _ in range(200)]
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0), ("a", None, 1.0), ("a", float("nan"), 1.0)], "track string, t double, v double").repartition(5)
    got = sorted(tuple(x) for x in machines.replay(df, machines.ewma("v", 30.0), ["track"]).collect())
    near(got, sorted((k, *x) for k in "abc" for x in plain_mean([(t, v) for n, t, v in rows if n == k], 30.0)))
    assert machines.replay(df.limit(0), machines.ewma("v", 30.0), ["track"]).count() == 0


def plain_machine(rows, max_gap=2.0, hard_s=10.0, severe_s=60.0, memory_s=120.0):
    """One run's rows (t, inputs by name), by the rules one after the other."""
    prev, means, out = None, {}, []
    s = dict(rp=0.0, rb=0.0, sev=0.0, rej=0.0, cool=0.0, hold=0.0, age=0.0, since=9999.0, resets=0, passes=0, blocks=0, clean=0.0, strict=0.0)

    def mean(name, v, dt, tau):
        if name not in means:
            means[name] = v
        elif dt > 0:
            k = 1 - math.exp(-dt / tau)
            means[name] += k * (v - means[name])
        return means[name]

    for t, v in rows:
        dt = 0.0 if prev is None else max(0.0, t - prev)
        gap = prev is not None and dt > max_gap
        q30, q120 = mean("q30", v["quality"], dt, 30), mean("q120", v["quality"], dt, 120)
        b30, b120 = mean("b30", v["block"], dt, 30), mean("b120", v["block"], dt, 120)
        severe, hard, spike = bool(v["severe"]) or gap, bool(v["hard"]) or gap, v["block"] >= 10
        if severe or spike:
            s["cool"], s["sev"], s["rej"] = max(s["cool"], severe_s), max(s["sev"], memory_s), max(s["rej"], memory_s)
        elif hard or v["block"] >= 2:
            s["cool"], s["rej"] = max(s["cool"], hard_s), max(s["rej"], hard_s)
        else:
            for k in ("cool", "sev", "rej"):
                s[k] = max(0.0, s[k] - dt)
        ok = not hard and s["cool"] <= 0 and v["quality"] >= 5 and q30 >= 4.5 and v["continuity"] >= 3 and v["block"] <= 1.25 and b30 <= 0.9
        soft = not hard and s["cool"] <= 2 and v["quality"] >= 4 and v["continuity"] >= 2 and v["block"] <= 1.75 and b30 <= 1.25
        p30 = mean("p30", float(ok), dt, 30)
        s["passes"] += ok
        s["rp"] = s["rp"] + dt if ok else max(0.0, s["rp"] + (0.25 if soft else -1.5) * dt)
        if hard or v["block"] >= 2 or s["cool"] > 0:
            s["blocks"] += 1
            s["rb"] += dt
        else:
            s["rb"] = max(0.0, s["rb"] - dt)
        if hard or s["cool"] > 0:
            s["hold"] = s["age"] = s["since"] = 0.0
            s["resets"] += hard
        else:
            s["since"] = min(9999.0, s["since"] + dt)
            if ok:
                s["hold"], s["age"] = min(1.0, s["hold"] + dt / 20), s["age"] + dt
            elif soft and s["hold"] > 0:
                s["hold"], s["age"] = min(1.0, s["hold"] + dt / 80), s["age"] + 0.5 * dt
            else:
                s["hold"], s["age"] = max(0.0, s["hold"] - (dt / 60 if v["block"] <= 1.5 else dt / 25)), max(0.0, s["age"] - 0.5 * dt)
        dirty = hard or spike or gap or severe
        s["clean"] = 0.0 if dirty else s["clean"] + dt
        s["strict"] = s["strict"] + dt if ok else 0.0 if dirty or not soft else s["strict"]
        low = math.exp(-min(b120, 8.0) / 2.5)
        out.append({
            "validation_pass": ok, "validation_soft_pass": soft, "validation_hard_block": hard, "validation_severe_block": severe, "validation_gap_reset": gap, "validation_quality_ewma_30s": q30,
            "validation_block_ewma_120s": b120, "validation_pass_ewma_30s": p30, "validation_recent_pass_s": s["rp"], "validation_recent_block_s": s["rb"], "validation_severe_recent_s": s["sev"],
            "validation_reject_recent_s": s["rej"], "validation_block_cooldown_s": s["cool"], "validation_pass_count": s["passes"], "validation_block_count": s["blocks"], "hold_state": s["hold"],
            "hold_age_s": s["age"], "hold_since_reset_s": s["since"], "hold_reset_count": s["resets"], "clean_streak_s": s["clean"], "strict_clean_streak_s": s["strict"],
            "hold_ready": s["hold"] >= 0.35 and s["rp"] >= 5 and s["cool"] <= 0 and b30 <= 1.25, "hold_strict_ready": s["hold"] >= 0.65 and s["rp"] >= 12 and s["cool"] <= 0 and b30 <= 0.75,
            "hold_carry_score": s["hold"] * max(0.0, q120) * low, "hold_state_x_low_block_factor": s["hold"] * low,
        })
        prev = t
    return out


def runs(seed, names, n):
    """Rows (track, t, inputs) of runs with good stretches, blocks and pauses."""
    r, rows = random.Random(seed), []
    for name in names:
        t, mood = 1000.0, 0
        for _ in range(n):
            t += r.choice([0.2, 1.0, 1.0, 1.5] + [3.5] * (r.random() < 0.02))
            mood = r.choice([0, 1, 2]) if r.random() < 0.03 else mood
            block = [0.0, r.uniform(0.5, 2.5), r.uniform(0, 14)][mood]
            v = {k: 0.0 for k in validation.INPUTS} | {"quality": r.uniform(4, 9), "block": block, "continuity": r.choice([1.0, 2.0, 4.0, 6.0, 6.0, 6.0]), "hard": float(mood == 2 and r.random() < 0.2), "severe": float(mood == 2 and r.random() < 0.05)}
            rows.append((name, round(t, 1), v))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(k, t, *[v[c] for c in validation.INPUTS]) for k, t, v in rows], "track string, t double, " + ", ".join(f"{c} double" for c in validation.INPUTS))


def test_replay_follows_the_rules(spark):
    rows = runs(3, ["a", "b", "c"], 500)
    out = machines.replay(frame(spark, rows).repartition(4), validation.validation(), ["track"]).toPandas().sort_values(["track", "t"])
    seen = set()
    for k in "abc":
        want, got = plain_machine([(t, v) for n, t, v in rows if n == k]), out[out.track == k]
        for c in want[0]:
            near([(float(x),) for x in got[c]], [(float(w[c]),) for w in want])
            seen |= {c} if any(w[c] for w in want) else set()
    assert seen == set(want[0])
    told = validation.summary(machines.replay(frame(spark, rows), validation.validation(), ["track"])).toPandas()
    assert told["epochs"].sum() == 1500 and told["hold_state_max"].max() <= 1


def test_scores_from_counts(spark):
    row = {"rinex_phase_present_count": "12", "rinex_phase_streak_ge30p0s_count": "7", "rinex_gf_streak_ge60p0s_count": "4", "sim_los_system_g_cont_ge60p0s_count": "6", "sim_adop_los_mean_el_deg": "40", "sim_adop_all_log10_adop": "-0.5",
           "rinex_phase_jump_ge0p5cy_count": "2", "rinex_gf_slip_ge0p2m_count": "1", "rinex_phase_lli_count": "1", "rinex_phase_raw_delta_cycles_p50": "500", "rinex_phase_doppler_min_residual_cycles_max": "1.2", "sim_adop_cont_ge30p0s_count": "bad"}
    df = spark.createDataFrame([tuple(row.values()), (None,) * len(row)], ", ".join(f"{c} string" for c in row))
    one, none = [x.asDict() for x in validation.scores(df).collect()]
    want = {"continuity": 7, "long_continuity": 4, "los_support": 6, "clean_phase": 12 - 3 - 1 - 0.5, "count_block": 3 + 1.2 + 0.35, "raw_block": 1, "doppler_block": 0.2, "hard": 1, "severe": 0}
    want |= {"block": 3 + 1.2 + 0.35 + 1 + 0.2, "quality": 7 + 1.8 + 1.8 + 0.12 * 7.5 + 0.8 + 0.5}
    assert {k: one[k] for k in want} == pytest.approx(want)
    assert {k: none[k] for k in validation.INPUTS} == pytest.approx(dict.fromkeys(validation.INPUTS, 0.0))
    empty = spark.createDataFrame([(1,)], "a int")
    assert validation.scores(empty).first()["quality"] == 0


def as_stream_files(spark, folder, parts):
    for i, rows in enumerate(parts):
        df = frame(spark, rows).withColumn("at", F.timestamp_micros(F.round(F.col("t") * 1_000_000).cast("long"))).drop("t")
        df.coalesce(1).write.mode("append").parquet(f"{folder}/p{i:03d}")


def run_over(spark, folder, checkpoint, out, machine):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "track string, " + ", ".join(f"{c} double" for c in validation.INPUTS) + ", at timestamp"
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    q = machines.run_stream(df, machine, ["track"], "at", "10 seconds").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(150)
    assert q.exception() is None


def test_stream_over_restarts_equals_replay(spark, tmp_path):
    rows = sorted(runs(5, ["a", "b"], 90), key=lambda x: x[1])
    r = random.Random(2)
    # rows come up to some seconds late, within the watermark's delay
    late = sorted(rows, key=lambda x: x[1] + r.uniform(0, 8))
    parts = [late[i : i + 60] for i in range(0, len(late), 60)]
    machine = validation.validation(forget_after=3.0)
    close = [("z", 9999.0, rows[0][2])]
    as_stream_files(spark, f"{tmp_path}/in", parts[:2])
    run_over(spark, f"{tmp_path}/in", f"{tmp_path}/check", f"{tmp_path}/out", machine)
    as_stream_files(spark, f"{tmp_path}/in", [[], [], *parts[2:], close])
    run_over(spark, f"{tmp_path}/in", f"{tmp_path}/check", f"{tmp_path}/out", machine)
    got = spark.read.parquet(f"{tmp_path}/out").toPandas().sort_values(["track", "t"]).reset_index(drop=True)
    want = machines.replay(frame(spark, rows), machine, ["track"]).toPandas().sort_values(["track", "t"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got[want.columns], want, check_exact=False, rtol=1e-12)


def test_null_tracks_are_left_out_of_both_filters(spark):
    df = spark.createDataFrame([(None, 0.0, 1.0), (None, 1.0, 1.0), (7, 0.0, 1.0)], "track long, t double, z double")
    assert [r.track for r in kalman.filter_batch(df).collect()] == [7]
    df = spark.createDataFrame([(None, 0.0, 1e7, 1e7, 1e7, 1.7e7, 1.0), (7, 0.0, 1e7, 1e7, 1e7, 1.7e7, 1.0)], "track long, t double, sx double, sy double, sz double, pr double, w double")
    assert [r.track for r in navigation_filter.filter_batch(df, (0.0, 0.0, 0.0, 0.0)).collect()] == [7]


def test_silent_channels_have_no_strength(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0)] * 3, "c int, i double, q double")
    assert aggregates.carrier_to_noise(df, ["c"], "i", "q", 0.001).first()["cn0"] == 0.0
