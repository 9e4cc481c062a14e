"""Broadcast orbits and clocks, ranges and range rates as column expressions; metres, seconds, radians."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geodesy import LIGHT, OMEGA

# fixed values: constants of the GPS interface specification
MU = 3.986005e14
WEEK = 604800.0
RELATIVITY = -4.442807633e-10
NEWTON_STEPS = 10


def week_wrap(dt: Column) -> Column:
    """Time differences to within half a week."""
    return F.when(dt > WEEK / 2, dt - WEEK).when(dt < -WEEK / 2, dt + WEEK).otherwise(dt)


def eccentric_anomaly(mean: Column, e: Column) -> Column:
    """Kepler's equation by Newton steps from the mean anomaly."""
    return F.aggregate(F.array_repeat(F.lit(0), NEWTON_STEPS), mean.cast("double"), lambda x, _: x - (x - e * F.sin(x) - mean) / (1.0 - e * F.cos(x)))


def satellite_state(eph: dict[str, Column], t: Column) -> dict[str, Column]:
    """x, y, z and clock of a satellite at time of week t.

    eph has sqrt_a, delta_n, m0, e, toe, toc, omega, omega0, omega_dot, i0, idot, cuc, cus, crc, crs, cic, cis, af0,
    af1, af2, tgd. Columns are expressions over each other; name the anomaly once in a projection for large tables.
    """
    a = eph["sqrt_a"] * eph["sqrt_a"]
    tk = week_wrap(t - eph["toe"])
    mean = eph["m0"] + (F.sqrt(MU / (a * a * a)) + eph["delta_n"]) * tk
    x = eccentric_anomaly(mean, eph["e"])
    return state_from_anomaly(eph, t, x)


def state_from_anomaly(eph: dict[str, Column], t: Column, x: Column) -> dict[str, Column]:
    """The same, with the eccentric anomaly at hand."""
    a, e = eph["sqrt_a"] * eph["sqrt_a"], eph["e"]
    tk = week_wrap(t - eph["toe"])
    phi = F.atan2(F.sqrt(1.0 - e * e) * F.sin(x), F.cos(x) - e) + eph["omega"]
    s2, c2 = F.sin(2.0 * phi), F.cos(2.0 * phi)
    u = phi + eph["cuc"] * c2 + eph["cus"] * s2
    r = a * (1.0 - e * F.cos(x)) + eph["crc"] * c2 + eph["crs"] * s2
    i = eph["i0"] + eph["idot"] * tk + eph["cic"] * c2 + eph["cis"] * s2
    node = eph["omega0"] + (eph["omega_dot"] - OMEGA) * tk - OMEGA * eph["toe"]
    xp, yp = r * F.cos(u), r * F.sin(u)
    clock = clock_polynomial(eph, t) + RELATIVITY * e * eph["sqrt_a"] * F.sin(x) - eph["tgd"]
    return {"x": xp * F.cos(node) - yp * F.cos(i) * F.sin(node), "y": xp * F.sin(node) + yp * F.cos(i) * F.cos(node), "z": yp * F.sin(i), "clock": clock}


def clock_polynomial(eph: dict[str, Column], t: Column) -> Column:
    """Broadcast clock offset without relativity."""
    dt = week_wrap(t - eph["toc"])
    return eph["af0"] + eph["af1"] * dt + eph["af2"] * dt * dt


def group_delay(system: Column, code: Column, sources: Column, tgd: Column, bgd_a: Column, bgd_b: Column) -> Column:
    """Group delay by system and observation code: Galileo's first band has one by the data sources of its message."""
    b = F.when(bgd_b != 0.0, bgd_b).otherwise(bgd_a)
    first = F.when(sources.bitwiseAND(F.lit(0x200)) != 0, bgd_b).when(sources.bitwiseAND(F.lit(0x100)) != 0, bgd_a).otherwise(b)
    return F.when((system == "E") & (code.substr(2, 1) == "1"), first).otherwise(tgd)


def sagnac_term(sx: Column, sy: Column, rx: Column, ry: Column) -> Column:
    """First-order range correction for the earth's rotation."""
    return OMEGA * (sx * ry - sy * rx) / LIGHT


def range_rate(s: list[Column], r: list[Column], sv: list[Column], rv: list[Column]) -> Column:
    """Rate of the range with the first-order rotation term, of satellite s with velocity sv and receiver r with rv."""
    d = [a - b for a, b in zip(s, r)]
    length = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    along = sum((di * (a - b) for di, a, b in zip(d, sv, rv)), F.lit(0.0)) / length
    turn = OMEGA * (sv[0] * r[1] + s[0] * rv[1] - sv[1] * r[0] - s[1] * rv[0]) / LIGHT
    return F.when(length > 0, along).otherwise(F.lit(0.0)) - turn


def split_label(label: Column) -> tuple[Column, Column]:
    """System letter and number of a satellite label such as G01; a label without a letter is GPS."""
    text = F.trim(label)
    has = text.rlike("^[A-Za-z]")
    return F.when(has, F.upper(text.substr(1, 1))).otherwise(F.lit("G")), F.when(has, F.substring(text, 2, 9)).otherwise(text).try_cast("int")


# fixed values: carrier frequencies by band, in hertz
BANDS = {"L1": [1575.42e6, 1561.098e6], "L5": [1176.45e6]}


def carrier_band(hertz: Column, constellation: Column) -> Column:
    """The band whose frequency is nearest, the first one for all GLONASS channels (3); null without a frequency."""
    near = F.array_min(F.array(*[F.struct(F.abs(hertz - f).alias("d"), F.lit(b).alias("b")) for b, fs in BANDS.items() for f in fs]))
    return F.when(hertz.isNotNull() & ~F.isnan(hertz), F.when(constellation == 3, F.lit("L1")).otherwise(near["b"]))


def signal_band(signal: Column) -> Column:
    """The band of a signal name: L5, E5 and B2 are L5, others L1."""
    return F.when(F.upper(F.coalesce(signal, F.lit(""))).rlike("L5|E5|B2"), F.lit("L5")).otherwise(F.lit("L1"))


def system_rank(constellation: Column) -> Column:
    """Order of the systems in a list of slots: GPS, Galileo, QZSS, the rest."""
    return F.when(constellation == 1, 0).when(constellation == 6, 1).when(constellation == 4, 2).otherwise(99)


def chips_of_lag(lag: Column, rate: float, chips: float = 1.023e6, length: int = 1023) -> Column:
    """Code phase in chips of a lag in samples."""
    return F.pmod(lag * (chips / rate), F.lit(float(length)))


def pseudorange_of_phase(chip: Column, near: Column, chips: float = 1.023e6, length: int = 1023) -> Column:
    """Pseudorange of a code phase, with the whole code periods that come nearest to a known range."""
    period = length / chips * LIGHT
    own = chip / chips * LIGHT
    return own + F.rint((near - own) / period) * period


# fixed values: constants of the GLONASS interface specification, and the step of its integration in seconds
GLONASS_MU = 3.9860044e14
GLONASS_RADIUS = 6378136.0
GLONASS_J2 = 1.0826257e-3
GLONASS_OMEGA = 7.292115e-5
GLONASS_STEP = 60.0


def _bound(value: Column, then) -> Column:
    """then(value), in which the value is made once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _glonass_rates(s: Column, acc: list[Column]) -> Column:
    """Derivatives of a state (array of position and velocity) in the turning frame: earth's pull with its flattening, and sun and moon's."""
    x, y, z, vx, vy, vz = (F.get(s, F.lit(i)) for i in range(6))
    r2 = x * x + y * y + z * z
    terms = lambda q: F.struct((-GLONASS_MU / (q * F.sqrt(q))).alias("pull"), (1.5 * GLONASS_J2 * GLONASS_MU * GLONASS_RADIUS**2 / (q * q * F.sqrt(q))).alias("flat"), (5.0 * z * z / q).alias("tilt"))
    turn = GLONASS_OMEGA * GLONASS_OMEGA

    def rates(f: Column) -> Column:
        around = f["pull"] - f["flat"] * (1.0 - f["tilt"])
        along = f["pull"] - f["flat"] * (3.0 - f["tilt"])
        return F.array(vx, vy, vz, (around + turn) * x + 2.0 * GLONASS_OMEGA * vy + acc[0], (around + turn) * y - 2.0 * GLONASS_OMEGA * vx + acc[1], along * z + acc[2])

    return _bound(r2, lambda q: _bound(terms(q), rates))


def _glonass_advance(s: Column, h: Column, acc: list[Column]) -> Column:
    """One Runge-Kutta step of h seconds."""
    on = lambda k, share: F.zip_with(s, k, lambda a, b: a + b * (h * share))
    rates = lambda v: _glonass_rates(v, acc)

    def second(k1: Column) -> Column:
        return _bound(_bound(on(k1, 0.5), rates), lambda k2: third(k1, k2))

    def third(k1: Column, k2: Column) -> Column:
        return _bound(_bound(on(k2, 0.5), rates), lambda k3: fourth(k1, k2, k3))

    def fourth(k1: Column, k2: Column, k3: Column) -> Column:
        mean = lambda k4: F.transform(s, lambda a, i: a + (F.get(k1, i) + 2.0 * F.get(k2, i) + 2.0 * F.get(k3, i) + F.get(k4, i)) * (h / 6.0))
        return _bound(_bound(on(k3, 1.0), rates), mean)

    return _bound(rates(s), second)


def glonass_orbit(state: list[Column], acc: list[Column], since: Column) -> Column:
    """Array of position and velocity `since` seconds (any sign, within half a week) after a record's state of six values.

    acc is the record's acceleration of sun and moon. Steps of 60 seconds and one for the rest are folded over the row, so a
    time at most half an hour from its record takes 30; metres and seconds in the earth's turning frame. Null where
    any input is null.
    """
    t = week_wrap(since.cast("double"))
    many = F.floor(F.abs(t) / GLONASS_STEP).cast("int")
    rest = t - F.signum(t) * many * GLONASS_STEP
    steps = F.concat(F.array_repeat(F.signum(t) * GLONASS_STEP, many), F.when(F.abs(rest) > 1e-9, F.array(rest)).otherwise(F.array().cast("array<double>")))
    start = F.array(*[c.cast("double") for c in state])
    return F.when(sum((c * 0 for c in [*state, *acc]), F.lit(0.0)).isNotNull(), F.aggregate(steps, start, lambda s, h: _glonass_advance(s, h, acc)))


def glonass_clock(tau: Column, gamma: Column, since: Column) -> Column:
    """Correction of a satellite's clock `since` seconds after its record."""
    return -tau + gamma * week_wrap(since)


def glonass_valid(state: list[Column]) -> Column:
    """Whether a record's position is at the height of an orbit."""
    r = F.sqrt(sum((c * c for c in state[:3]), F.lit(0.0)))
    return F.coalesce(r.between(1.5e7, 5.0e7), F.lit(False))
