"""Coordinate frames on WGS84 as Column expressions: geodetic, earth-centred (4978), UTM and the Albers grids of California.

Order is always east (longitude) before north (latitude). NAD83 is taken as WGS84.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from orthoquilt.functions.linalg import let, named, vec

# Fixed values of the WGS84 ellipsoid and of UTM.
A = 6378137.0
FLATTENING = 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)
K0, FALSE_EAST, FALSE_NORTH = 0.9996, 500_000.0, 10_000_000.0
ECEF = 4978
#: Albers equal area: parallels, origin latitude, central meridian, false north (degrees, metres).
ALBERS = {3310: (34.0, 40.5, 0.0, -120.0, -4_000_000.0), 3311: (34.0, 40.5, 0.0, -120.0, -4_000_000.0)}


def utm_code(lat: Column, lon: Column, west: bool = True) -> Column:
    """EPSG code of the UTM zone; positive longitudes are negated if `west`. Halves go to even."""
    lon = F.when(lon > 0, -lon).otherwise(lon) if west else lon
    return (32700 - F.bround((45 + lat) / 90).cast("long") * 100 + F.bround((183 + lon) / 6).cast("long")).cast("long")


def to_ecef(lon: Column, lat: Column, height: Column) -> Column:
    phi, lam = F.radians(lat), F.radians(lon)
    n = A / F.sqrt(1 - E2 * F.sin(phi) * F.sin(phi))
    return vec((n + height) * F.cos(phi) * F.cos(lam), (n + height) * F.cos(phi) * F.sin(lam), (n * (1 - E2) + height) * F.sin(phi))


def from_ecef(p: Column) -> Column:
    """(x longitude, y latitude, z height) by Bowring's closed form, with one further step."""
    b = A * (1 - FLATTENING)
    ep2 = E2 / (1 - E2)

    def located(g: Column) -> Column:
        latitude = lambda t: F.atan2(g["z"] + ep2 * b * F.pow(F.sin(t), F.lit(3)), g["r"] - E2 * A * F.pow(F.cos(t), F.lit(3)))
        reduced = lambda t: F.atan2((1 - FLATTENING) * F.sin(t), F.cos(t))
        phi = let(let(F.atan2(g["z"] * A, g["r"] * b), latitude), lambda t: let(reduced(t), latitude))

        def done(f: Column) -> Column:
            n = A / F.sqrt(1 - E2 * F.sin(f) * F.sin(f))
            height = F.when(F.abs(F.cos(f)) > 1e-3, g["r"] / F.cos(f) - n).otherwise(F.abs(g["z"]) / F.abs(F.sin(f)) - n * (1 - E2))
            return vec(F.degrees(F.atan2(g["y"], g["x"])), F.degrees(f), height)

        return let(phi, done)

    return let(named(x=p["x"], y=p["y"], z=p["z"], r=F.sqrt(p["x"] * p["x"] + p["y"] * p["y"])), located)


def _series() -> tuple[float, list[float], list[float]]:
    """Rectifying radius and the Krueger coefficients, forward and inverse, to the fourth order of the third flattening."""
    n = FLATTENING / (2 - FLATTENING)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]
    back = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    ]
    return radius, forward, back


def to_utm(lon: Column, lat: Column, epsg: int | Column) -> Column:
    """(x east, y north) as a struct, in the UTM zone of an EPSG code 326zz or 327zz."""
    code = F.lit(epsg) if isinstance(epsg, int) else epsg
    south = code >= 32700
    zone = F.pmod(code, F.lit(100))
    centre = zone * 6 - 183
    radius, forward, _ = _series()
    e = math.sqrt(E2)
    e_ = F.lit(e)

    def conformal(g: Column) -> Column:
        tau = F.tan(g["phi"])
        sigma = F.sinh(e_ * F.atanh(e_ * F.sin(g["phi"])))
        return let(tau * F.sqrt(1 + sigma * sigma) - sigma * F.sqrt(1 + tau * tau), lambda c: named(
            xi=F.atan2(c, F.cos(g["lam"])), eta=F.asinh(F.sin(g["lam"]) / F.sqrt(c * c + F.cos(g["lam"]) * F.cos(g["lam"])))))

    def grid(g: Column) -> Column:
        north, east = g["xi"], g["eta"]
        for k, a in enumerate(forward, 1):
            north = north + a * F.sin(2 * k * g["xi"]) * F.cosh(2 * k * g["eta"])
            east = east + a * F.cos(2 * k * g["xi"]) * F.sinh(2 * k * g["eta"])
        return named(x=K0 * radius * east + FALSE_EAST, y=K0 * radius * north + F.when(south, FALSE_NORTH).otherwise(0.0))

    return let(let(named(phi=F.radians(lat), lam=F.radians(lon - centre)), conformal), grid)


def from_utm(x: Column, y: Column, epsg: int | Column) -> Column:
    """(x longitude, y latitude) as a struct."""
    code = F.lit(epsg) if isinstance(epsg, int) else epsg
    radius, _, back = _series()
    e = math.sqrt(E2)
    grid = named(xi=(y - F.when(code >= 32700, FALSE_NORTH).otherwise(0.0)) / (K0 * radius), eta=(x - FALSE_EAST) / (K0 * radius))

    def sphere(g: Column) -> Column:
        a, b = g["xi"], g["eta"]
        for k, c in enumerate(back, 1):
            a = a - c * F.sin(2 * k * g["xi"]) * F.cosh(2 * k * g["eta"])
            b = b - c * F.cos(2 * k * g["xi"]) * F.sinh(2 * k * g["eta"])
        return named(a=a, b=b)

    def geodetic(g: Column) -> Column:
        # latitude from the conformal one by fixed-point steps on the isometric latitude
        isometric = F.asinh(F.tan(F.asin(F.sin(g["a"]) / F.cosh(g["b"]))))
        e_ = F.lit(e)
        phi = let(isometric, lambda q: F.aggregate(
            F.sequence(F.lit(1), F.lit(6)), F.atan(F.sinh(q)), lambda f, _: F.atan(F.sinh(q + e_ * F.atanh(e_ * F.sin(f))))))
        return named(x=F.degrees(F.atan2(F.sinh(g["b"]), F.cos(g["a"]))) + F.pmod(code, F.lit(100)) * 6 - 183, y=F.degrees(phi))

    return let(let(grid, sphere), geodetic)


def to_albers(lon: Column, lat: Column, epsg: int) -> Column:
    p1, p2, p0, l0, north = ALBERS[epsg]
    e = math.sqrt(E2)

    def q(s):
        log = F.log if isinstance(s, Column) else math.log
        return (1 - E2) * (s / (1 - E2 * s * s) - log((1 - e * s) / (1 + e * s)) / (2 * e))

    m = lambda d: math.cos(math.radians(d)) / math.sqrt(1 - E2 * math.sin(math.radians(d)) ** 2)
    q1, q2, q0 = (q(math.sin(math.radians(d))) for d in (p1, p2, p0))
    n = (m(p1) ** 2 - m(p2) ** 2) / (q2 - q1)
    c = m(p1) ** 2 + n * q1
    rho = A / n * F.sqrt(c - n * q(F.sin(F.radians(lat))))
    rho0 = A / n * math.sqrt(c - n * q0)
    theta = n * F.radians(lon - l0)
    return F.struct((rho * F.sin(theta)).alias("x"), (rho0 - rho * F.cos(theta) + north).alias("y"))


def convert(p: Column, source: int, target: int) -> Column:
    """A point (x, y, z) from one EPSG code to another; longitude and latitude are x and y of 4326 and 4979."""
    if source == target:
        return p
    geodetic = lambda c: c in (4326, 4979)
    utm = lambda c: 32601 <= c <= 32660 or 32701 <= c <= 32760
    if not (geodetic(source) or utm(source) or source == ECEF):
        raise ValueError(f"cannot read coordinates of EPSG:{source}")
    if not (geodetic(target) or utm(target) or target == ECEF or target in ALBERS):
        raise ValueError(f"cannot make coordinates of EPSG:{target}")

    def onward(g: Column) -> Column:
        if geodetic(target):
            return vec(g["x"], g["y"], g["z"])
        if target == ECEF:
            return to_ecef(g["x"], g["y"], g["z"])
        to = to_utm(g["x"], g["y"], target) if utm(target) else to_albers(g["x"], g["y"], target)
        return let(to, lambda q: vec(q["x"], q["y"], g["z"]))

    if geodetic(source):
        return onward(p)
    if source == ECEF:
        return let(from_ecef(p), onward)
    return let(from_utm(p["x"], p["y"], source), lambda g: let(vec(g["x"], g["y"], p["z"]), onward))


def dms_to_degrees(d: Column, m: Column, s: Column) -> Column:
    return d + m / 60 + s / 3600
