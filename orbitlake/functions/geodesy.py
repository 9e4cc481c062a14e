"""WGS84 geodesy as column expressions; angles in radians, lengths in metres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: WGS84 and the broadcast-navigation constants
A = 6378137.0
FLATTENING = 1.0 / 298.257223563
E2 = FLATTENING * (2.0 - FLATTENING)
B = A * (1.0 - FLATTENING)
EP2 = (A * A - B * B) / (B * B)
LIGHT = 299792458.0
OMEGA = 7.2921151467e-5


def lla_to_ecef(lat: Column, lon: Column, alt: Column) -> tuple[Column, Column, Column]:
    n = F.lit(A) / F.sqrt(1 - F.lit(E2) * F.sin(lat) * F.sin(lat))
    return (n + alt) * F.cos(lat) * F.cos(lon), (n + alt) * F.cos(lat) * F.sin(lon), (n * (1 - E2) + alt) * F.sin(lat)


def ecef_to_lla(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Closed form with one auxiliary angle; near the poles the height comes from z."""
    p = F.sqrt(x * x + y * y)
    t = F.atan2(z * A, p * B)
    lat = F.atan2(z + EP2 * B * F.pow(F.sin(t), F.lit(3)), p - E2 * A * F.pow(F.cos(t), F.lit(3)))
    n = F.lit(A) / F.sqrt(1 - F.lit(E2) * F.sin(lat) * F.sin(lat))
    alt = F.when(F.abs(F.cos(lat)) > 1e-10, p / F.cos(lat) - n).otherwise(F.abs(z) - B)
    return lat, F.atan2(y, x), alt


def ecef_to_enu(dx: Column, dy: Column, dz: Column, lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    east = -F.sin(lon) * dx + F.cos(lon) * dy
    north = -F.sin(lat) * F.cos(lon) * dx - F.sin(lat) * F.sin(lon) * dy + F.cos(lat) * dz
    up = F.cos(lat) * F.cos(lon) * dx + F.cos(lat) * F.sin(lon) * dy + F.sin(lat) * dz
    return east, north, up


def enu_to_ecef(east: Column, north: Column, up: Column, lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    x = -F.sin(lon) * east - F.sin(lat) * F.cos(lon) * north + F.cos(lat) * F.cos(lon) * up
    y = F.cos(lon) * east - F.sin(lat) * F.sin(lon) * north + F.cos(lat) * F.sin(lon) * up
    return x, y, F.cos(lat) * north + F.sin(lat) * up


def azimuth_elevation(east: Column, north: Column, up: Column) -> tuple[Column, Column]:
    azimuth = F.atan2(east, north)
    return F.when(azimuth < 0, azimuth + 2 * 3.141592653589793).otherwise(azimuth), F.atan2(up, F.sqrt(east * east + north * north))


def haversine(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column, radius: float = 6371000.0) -> Column:
    h = F.pow(F.sin((lat_b - lat_a) / 2), F.lit(2)) + F.cos(lat_a) * F.cos(lat_b) * F.pow(F.sin((lon_b - lon_a) / 2), F.lit(2))
    return 2 * radius * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def sagnac_range(rx: Column, ry: Column, rz: Column, sx: Column, sy: Column, sz: Column) -> Column:
    """Range after turning the satellite by the earth's rotation during the flight of the signal."""
    turn = OMEGA * F.sqrt((sx - rx) * (sx - rx) + (sy - ry) * (sy - ry) + (sz - rz) * (sz - rz)) / LIGHT
    x, y = F.cos(turn) * sx + F.sin(turn) * sy, -F.sin(turn) * sx + F.cos(turn) * sy
    return F.sqrt((x - rx) * (x - rx) + (y - ry) * (y - ry) + (sz - rz) * (sz - rz))


def tangent_offsets(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """East and north metres from an origin, by the radii of curvature there."""
    w = F.sqrt(1 - F.lit(E2) * F.sin(lat0) * F.sin(lat0))
    return (lon - lon0) * (A / w) * F.cos(lat0), (lat - lat0) * A * (1 - E2) / (w * w * w)


def tangent_position(east: Column, north: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Latitude and longitude of metres from an origin."""
    w = F.sqrt(1 - F.lit(E2) * F.sin(lat0) * F.sin(lat0))
    return lat0 + north * (w * w * w) / (A * (1 - E2)), lon0 + east * w / (A * F.cos(lat0))


def wrap_cycles(x: Column) -> Column:
    """Distance to the nearest whole cycle; halves go to the even one."""
    return x - F.rint(x)
