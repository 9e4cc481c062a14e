"""Spectra and code searches over the values of each event type, as recordings of one sample an event."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chip_clocks, spectra, windows
from .queries import _EV, _events, _query, _r

SIZE, HOP, CHUNK = 64, 32, 1000

_FRAMES = f"""{_EV}, x AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY us, event_id) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n, coalesce(value, 0) AS v FROM ev),
f AS (SELECT event_type, unnest(range(greatest(0, (r - {SIZE - 1} + {HOP - 1}) // {HOP}), r // {HOP} + 1)) AS frame, r, n, v FROM x),
g AS (SELECT event_type, frame, r - frame * {HOP} AS i, v * 0.5 * (1 - cos(2 * pi() * (r - frame * {HOP}) / {SIZE - 1})) AS v FROM f WHERE frame * {HOP} + {SIZE} <= n),
p AS (SELECT event_type, frame, bin, 10 * log10(sum(v * cos(2 * pi() * i * bin / {SIZE})) ^ 2 + sum(v * sin(2 * pi() * i * bin / {SIZE})) ^ 2 + 1e-20) AS power FROM g, range({SIZE // 2 + 1}) b(bin) GROUP BY ALL)"""


def _recordings(spark, sf_dir):
    rows = windows.ranked(_events(spark, sf_dir).select("event_type", "us", "event_id", F.coalesce("value", F.lit(0.0)).alias("value")), ["event_type"], ["us", "event_id"])
    chunk = F.floor(F.col("rank") / CHUNK).cast("long")
    held = rows.groupBy("event_type", chunk.alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("x"))
    return held.select("event_type", (F.col("chunk") * CHUNK).alias("start"), F.transform("x", lambda v: v.value).alias("samples"))


@_query(f"WITH {_FRAMES} SELECT event_type, frame::BIGINT AS frame, bin::INT AS bin, round(power, 4) AS power FROM p")
def spectrogram(spark, sf_dir):
    """Power of each bin of overlapping frames."""
    s = spectra.spectrogram(_recordings(spark, sf_dir), ["event_type"], SIZE, HOP)
    return s.select("event_type", "frame", F.posexplode("power").alias("bin", "power")).withColumn("power", _r("power", 4))


@_query(f"""WITH {_FRAMES}, m AS (SELECT event_type, bin, avg(power) AS mean FROM p GROUP BY ALL),
n AS (SELECT a.event_type, a.bin, list_sort(list(b.mean)) AS near FROM m a JOIN m b ON a.event_type = b.event_type AND abs(a.bin - b.bin) BETWEEN 3 AND 16 GROUP BY ALL)
SELECT m.event_type, m.bin::INT AS bin, round(mean, 4) AS mean, round(near[len(near) // 2 + 1], 4) AS floor FROM m JOIN n ON m.event_type = n.event_type AND m.bin = n.bin""")
def noise_floors(spark, sf_dir):
    """Mean power of each bin and the floor that its neighbours give."""
    f = spectra.noise_floors(spectra.spectrogram(_recordings(spark, sf_dir), ["event_type"], SIZE, HOP), ["event_type"])
    return f.select("event_type", "bin", _r("mean", 4).alias("mean"), _r("floor", 4).alias("floor"))


@_query(None)
def interference_bands(spark, sf_dir):
    """Bands of each recording that stand out by 3 dB."""
    s = spectra.spectrogram(_recordings(spark, sf_dir), ["event_type"], SIZE, HOP)
    return spectra.interference(s, ["event_type"], SIZE, 1000.0, 3.0)


@_query(None)
def code_search(spark, sf_dir):
    """The code of four satellites in each thousand samples."""
    signals = _recordings(spark, sf_dir).withColumn("centred", F.expr("aggregate(samples, 0d, (a, v) -> a + v) / size(samples)"))
    signals = signals.select("event_type", "start", F.expr("transform(samples, v -> v - centred)").alias("samples"))
    out = spectra.acquire(signals, ["event_type", "start"], 1.0e6, [1, 7, 19, 32], doppler_range=1000.0)
    return out.select("event_type", "start", "prn", "acquired", _r("code_phase").alias("code_phase"), "doppler_hz", _r("snr").alias("snr"))


_RAW = """o AS (SELECT event_id, user_id % 50 AS phone, us // 1000 AS utc, us * 1000 AS tn, -1388000000000000000 - event_id % 3 AS fb, (event_id % 7) * 0.1::DOUBLE AS bn, [1, 3, 5, 6][event_id // 4 % 4 + 1] AS sys, event_id % 4 + 1 AS sv, event_id % 2 AS band, us * 1000 + 1388000000000000000 + 3 - 70000000 - event_id % 1000 * 1000 AS gps FROM ev),
r AS (SELECT *, CASE sys WHEN 5 THEN (gps - 14000000000) % 604800000000000 WHEN 3 THEN (gps + 10782000000000) % 86400000000000 ELSE gps % 604800000000000 END AS svt FROM o)"""


@_query(f"""WITH {_EV}, {_RAW},
e AS (SELECT phone, utc, min({{'a': sys, 'b': sv, 'c': band, 'tn': tn, 'fb': fb, 'bn': bn}}) AS m FROM r GROUP BY ALL),
j AS (SELECT phone, utc, m.tn AS tn, m.bn AS bn, CASE WHEN coalesce(abs(m.tn - lag(m.tn) OVER w), 2000000000) > 1000000000 THEN m.fb END AS fresh FROM e WINDOW w AS (PARTITION BY phone ORDER BY utc)),
k AS (SELECT phone, utc, bn, tn - last_value(fresh IGNORE NULLS) OVER (PARTITION BY phone ORDER BY utc) AS el FROM j),
t AS (SELECT r.*, (el - floor(el::DOUBLE / 604800000000000.0)::BIGINT * 604800000000000)::DOUBLE / 1e9 - k.bn / 1e9 AS rx, svt::DOUBLE / 1e9 AS told FROM r JOIN k USING (phone, utc)),
g AS (SELECT *, floor(rx / 86400.0) AS day, told + floor(rx / 86400.0) * 86400.0 - 10800.0 + 18.0 AS mos FROM t),
x AS (SELECT *, CASE sys WHEN 5 THEN told + 14.0 WHEN 3 THEN mos + (day - floor(mos / 86400.0)) * 86400.0 ELSE told END AS tx FROM g),
d AS (SELECT *, coalesce(round_even((rx - lag(rx) OVER w) / 604800.0, 0), 0) AS jr, coalesce(round_even((tx - lag(tx) OVER w) / 604800.0, 0), 0) AS jt FROM x WINDOW w AS (PARTITION BY phone, sys, sv, band ORDER BY utc, band, svt)),
u AS (SELECT *, rx - 604800.0 * sum(jr) OVER w AS ur, tx - 604800.0 * sum(jt) OVER w AS ut FROM d WINDOW w AS (PARTITION BY phone, sys, sv, band ORDER BY utc, band, svt))
SELECT event_id, round(rx, 6) AS tow_rx_s, round(tx, 6) AS tow_tx_s, round((ur - ut) * 299792458.0, 2) AS range_m FROM u""")
def raw_ranges(spark, sf_dir):
    """Ranges of a raw log whose counters are made from the events' times."""
    ev = _events(spark, sf_dir)
    gps = F.col("us") * 1000 + F.lit(1388000000000000000 + 3 - 70000000) - F.col("event_id") % 1000 * 1000
    kind = F.element_at(F.array(*[F.lit(k) for k in (1, 3, 5, 6)]), (F.expr("event_id div 4 % 4") + 1).cast("int"))
    log = ev.select(
        "event_id", (F.col("user_id") % 50).alias("phone"), F.expr("us div 1000").alias("utcTimeMillis"), (F.col("us") * 1000).alias("TimeNanos"),
        (F.lit(-1388000000000000000) - F.col("event_id") % 3).alias("FullBiasNanos"), ((F.col("event_id") % 7) * 0.1).alias("BiasNanos"),
        F.lit(None).cast("double").alias("TimeOffsetNanos"), kind.alias("ConstellationType"), (F.col("event_id") % 4 + 1).alias("Svid"),
        (F.col("event_id") % 2).alias("CarrierFrequencyHz"), (F.col("event_id") % 2).alias("band"), gps.alias("gps"))
    told = F.when(F.col("ConstellationType") == 5, (F.col("gps") - 14000000000) % 604800000000000).when(F.col("ConstellationType") == 3, (F.col("gps") + 10782000000000) % 86400000000000).otherwise(F.col("gps") % 604800000000000)
    out = chip_clocks.raw_ranges(log.withColumn("ReceivedSvTimeNanos", told).drop("gps"), ["phone"], "band")
    return out.select("event_id", _r("tow_rx_s").alias("tow_rx_s"), _r("tow_tx_s").alias("tow_tx_s"), _r("PseudorangeMeters", 2).alias("range_m"))
