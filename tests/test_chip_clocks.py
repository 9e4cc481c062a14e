"""Ranges from chip clocks: systems with their own weeks and days, roll-overs, a jump of the counter, rows without times."""

from orbitlake.operators.chip_clocks import LIGHT, raw_ranges

WEEK = 604_800_000_000_000
BIAS = -1_388_016_000_000_000_000
DELAY = 70_000_000
COLUMNS = "phone string, utcTimeMillis long, ConstellationType int, Svid int, CarrierFrequencyHz double, band string, TimeNanos long, FullBiasNanos long, BiasNanos double, TimeOffsetNanos double, ReceivedSvTimeNanos long"


def _told(kind, gps):
    if kind == 5:
        return (gps - 14_000_000_000) % WEEK
    if kind == 3:
        return (gps + 3 * 3600 * 10**9 - 18 * 10**9) % (86400 * 10**9)
    return gps % WEEK


def _row(phone, utc, kind, counter, bias=BIAS, gps=None, told=True, offset=None):
    gps = counter - bias if gps is None else gps
    return (phone, utc, kind, 7, 1.5e9, "L1", counter, bias, 0.0, offset, _told(kind, gps - DELAY) if told else None)


def test_ranges_of_all_systems_over_a_week_s_end(spark):
    rows, edge = [], BIAS % WEEK  # the counter at a week's end
    for kind in (1, 3, 5, 6):
        # seconds around the end of the week; the satellite's week ends while the signal travels
        rows += [_row(None if kind == 1 else "a", u, kind, edge + WEEK + int((u - 3) * 1e9) + 30_000_000) for u in range(6)]
    out = raw_ranges(spark.createDataFrame(rows, COLUMNS), ["phone"], "band").collect()
    assert len(out) == len(rows)
    assert all(abs(r.PseudorangeMeters - DELAY / 1e9 * LIGHT) < 0.2 for r in out if r.ConstellationType != 3)
    # a day has no signal that unwraps it: GLONASS is put on the receiver's day, so at a day's start it may be one day off
    assert sum(abs(r.PseudorangeMeters - DELAY / 1e9 * LIGHT) < 0.2 for r in out if r.ConstellationType == 3) >= 5


def test_the_bias_holds_until_the_counter_jumps(spark):
    at = 10**14
    rows = [_row("a", 0, 1, at), _row("a", 1, 1, at + 10**9, BIAS - 100, gps=at + 10**9 - BIAS), _row("a", 2, 1, 5 * 10**9, BIAS - 200, gps=5 * 10**9 - BIAS + 200)]
    got = {r.utcTimeMillis: r.PseudorangeMeters for r in raw_ranges(spark.createDataFrame(rows, COLUMNS), ["phone"], "band").collect()}
    assert all(abs(v - DELAY / 1e9 * LIGHT) < 0.2 for v in got.values())


def test_rows_without_times_and_offsets(spark):
    at = 10**14
    rows = [_row("a", 0, 1, at), _row("a", 1, 1, at + 10**9, told=False), _row("a", 2, 1, at + 2 * 10**9, offset=100.0)]
    got = {r.utcTimeMillis: r.PseudorangeMeters for r in raw_ranges(spark.createDataFrame(rows, COLUMNS), ["phone"], "band").collect()}
    assert got[1] is None and abs(got[0] - got[2] - 100e-9 * LIGHT) < 0.2
    assert raw_ranges(spark.createDataFrame([], COLUMNS), ["phone"], "band").count() == 0
