"""Projections and plane geometry as Column expressions; no Python runs on the executors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The GRS80 ellipsoid and the conic projection EPSG:2154.
A, E = 6378137.0, 0.0818191910428158
CONE_N, CONE_C, CONE_X, CONE_Y, CONE_LON = 0.725607765053267, 11754255.426096, 700000.0, 12655612.049876, 3.0
#: Central meridian and false northing of the UTM zones in use.
UTM_ZONES = {2975: (57.0, 10_000_000.0), 5490: (-63.0, 0.0), 2972: (-51.0, 0.0), 4471: (45.0, 10_000_000.0)}
UTM_K0, UTM_E0, INVERSE_FLATTENING = 0.9996, 500_000.0, 298.257222101
ROUNDS = 6  # of the inverse latitude, unrolled; the error falls below 1e-12 rad


def isometric_latitude(phi: Column) -> Column:
    es = E * F.sin(phi)
    return F.log(F.tan(F.lit(math.pi / 4) + phi / 2) * F.pow((1 - es) / (1 + es), F.lit(E / 2)))


def latitude_of(iso: Column) -> Column:
    """The inverse, by fixed-point steps."""
    phi = 2 * F.atan(F.exp(iso)) - math.pi / 2
    for _ in range(ROUNDS):
        es = E * F.sin(phi)
        phi = 2 * F.atan(F.pow((1 + es) / (1 - es), F.lit(E / 2)) * F.exp(iso)) - math.pi / 2
    return phi


def conic_forward(lon: Column, lat: Column) -> tuple[Column, Column]:
    r = CONE_C * F.exp(-CONE_N * isometric_latitude(F.radians(lat)))
    turn = CONE_N * F.radians(lon - CONE_LON)
    return CONE_X + r * F.sin(turn), CONE_Y - r * F.cos(turn)


def conic_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    dx, dy = x - CONE_X, F.lit(CONE_Y) - y
    iso = -F.log(F.hypot(dx, dy) / CONE_C) / CONE_N
    return CONE_LON + F.degrees(F.atan2(dx, dy) / CONE_N), F.degrees(latitude_of(iso))


def conic_scale(lat: Column) -> Column:
    phi = F.radians(lat)
    r = CONE_C * F.exp(-CONE_N * isometric_latitude(phi))
    return CONE_N * r * F.sqrt(1 - F.pow(E * F.sin(phi), F.lit(2))) / (A * F.cos(phi))


def _series(order: int = 4) -> tuple[float, list[float], list[float]]:
    """Rectifying radius and the coefficients of the transverse Mercator series (Krüger)."""
    n = 1 / (2 * INVERSE_FLATTENING - 1)
    radius = UTM_K0 * A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]
    inverse = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    ]
    return radius, forward, inverse


def utm_forward(epsg: int, lon: Column, lat: Column) -> tuple[Column, Column]:
    lon0, north = UTM_ZONES[epsg]
    radius, alpha, _ = _series()
    phi, lam = F.radians(lat), F.radians(lon - lon0)
    t = F.sinh(F.atanh(F.sin(phi)) - E * F.atanh(E * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    dxi = sum((a * F.sin(2 * k * xi) * F.cosh(2 * k * eta) for k, a in enumerate(alpha, 1)), F.lit(0.0))
    deta = sum((a * F.cos(2 * k * xi) * F.sinh(2 * k * eta) for k, a in enumerate(alpha, 1)), F.lit(0.0))
    return UTM_E0 + radius * (eta + deta), north + radius * (xi + dxi)


def utm_inverse(epsg: int, x: Column, y: Column) -> tuple[Column, Column]:
    lon0, north = UTM_ZONES[epsg]
    radius, _, beta = _series()
    xi, eta = (y - north) / radius, (x - UTM_E0) / radius
    dxi = sum((b * F.sin(2 * k * xi) * F.cosh(2 * k * eta) for k, b in enumerate(beta, 1)), F.lit(0.0))
    deta = sum((b * F.cos(2 * k * xi) * F.sinh(2 * k * eta) for k, b in enumerate(beta, 1)), F.lit(0.0))
    xi, eta = xi - dxi, eta - deta
    iso = F.atanh(F.sin(xi) / F.cosh(eta))
    return lon0 + F.degrees(F.atan2(F.sinh(eta), F.cos(xi))), F.degrees(latitude_of(iso))


def local_frame(x: Column, y: Column, x0: Column, y0: Column, scale: Column) -> tuple[Column, Column]:
    """Metres about a start, true to scale there."""
    return (x - x0) / scale, (y - y0) / scale


def pack_node(x: Column, y: Column) -> Column:
    """One long for a node: x in the high half, y (not negative, below 2**32) in the low."""
    return F.shiftleft(x.cast("bigint"), 32).bitwiseOR(y.cast("bigint"))


def unpack_node(key: Column) -> tuple[Column, Column]:
    return F.shiftright(key, 32), key.bitwiseAND(F.lit(0xFFFFFFFF))


def bearing(lat0: Column, lon0: Column, lat1: Column, lon1: Column) -> Column:
    east = (lon1 - lon0) * F.cos(F.radians(lat0))
    return (F.degrees(F.atan2(east, lat1 - lat0)) + 360) % 360


def angle_at(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.atan2(by - ay, bx - ax)


def bilinear(q00: Column, q10: Column, q01: Column, q11: Column, fx: Column, fy: Column) -> Column:
    """Between four pixel centres; fractions are held within [0, 1]."""
    fx, fy = F.least(F.greatest(fx, F.lit(0.0)), F.lit(1.0)), F.least(F.greatest(fy, F.lit(0.0)), F.lit(1.0))
    return (q00 * (1 - fx) + q10 * fx) * (1 - fy) + (q01 * (1 - fx) + q11 * fx) * fy


def slippy_tile(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    n = float(1 << zoom)
    phi = F.radians(lat)
    x = F.floor((lon + 180) / 360 * n)
    y = F.floor((1 - F.log(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2 * n)
    return x, y


def terrarium(red: Column, green: Column, blue: Column) -> Column:
    return red * 256 + green + blue / 256.0 - 32768
