"""Delays of the atmosphere as column expressions, in metres; angles in radians."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geodesy import LIGHT

DEGREE = math.pi / 180


def troposphere(lat: Column, alt: Column, el: Column) -> Column:
    """Saastamoinen delay at half humidity in the standard atmosphere; elevations under two degrees count as two."""
    pressure = 1013.25 * F.pow(1.0 - 2.2557e-5 * alt, F.lit(5.2568))
    celsius = 15.0 - 6.5e-3 * alt
    vapour = 0.5 * 6.108 * F.exp(17.15 * celsius / (celsius + 234.7))
    zenith = 0.002277 * (pressure + (1255.0 / (celsius + 273.15) + 0.05) * vapour) / (1.0 - 0.00266 * F.cos(2.0 * lat) - 0.00028 * (alt / 1000.0))
    low = F.greatest(el, F.lit(2 * DEGREE))
    return zenith / F.sin(F.sqrt(low * low + 6.25 * DEGREE * DEGREE))


def corrected(pr: Column, el: Column, tropo: Column, iono: Column, mask: float = 0.087) -> tuple[Column, Column]:
    """Range less the delays and a weight by elevation; under the mask the range as it is, with a weight of 0.01."""
    high = F.greatest(F.sin(el), F.lit(0.1))
    return F.when(el < mask, pr).otherwise(pr - (tropo + iono)), F.when(el < mask, F.lit(0.01)).otherwise(high * high)


def _polynomial(factors: list[float], x: Column) -> Column:
    value = F.lit(0.0)
    for c in reversed(factors):
        value = value * x + c
    return value


def ionosphere(alpha: list[float], beta: list[float], lat: Column, lon: Column, az: Column, el: Column, tow: Column) -> Column:
    """Broadcast single-frequency delay from the four alpha and beta parameters, at seconds of the week `tow`."""
    up = el / math.pi
    reach = 0.0137 / (up + 0.11) - 0.022
    pierce_lat = F.least(F.greatest(lat / math.pi + reach * F.cos(az), F.lit(-0.416)), F.lit(0.416))
    pierce_lon = lon / math.pi + reach * F.sin(az) / F.cos(pierce_lat * math.pi)
    magnetic = pierce_lat + 0.064 * F.cos((pierce_lon - 1.617) * math.pi)
    local = F.pmod(43200.0 * pierce_lon + tow, F.lit(86400.0))
    phase = 2 * math.pi * (local - 50400.0) / F.greatest(_polynomial(beta, magnetic), F.lit(72000.0))
    amplitude = F.greatest(_polynomial(alpha, magnetic), F.lit(0.0))
    square = phase * phase
    day = F.when(F.abs(phase) < 1.57, amplitude * (1.0 - square / 2 + square * square / 24)).otherwise(0.0)
    slant = 1.0 + 16.0 * F.pow(0.53 - up, F.lit(3))
    return LIGHT * slant * (5e-9 + day)
