"""Vectors as structs of x, y, z, and 4x4 transforms as arrays of 16 doubles in row order, in Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once: a plain Column would be copied into every place it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def named(**parts: Column) -> Column:
    return F.struct(*(c.alias(n) for n, c in parts.items()))


def vec(x, y, z) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(lit(x).cast("double").alias("x"), lit(y).cast("double").alias("y"), lit(z).cast("double").alias("z"))


def add(a: Column, b: Column) -> Column:
    return vec(a["x"] + b["x"], a["y"] + b["y"], a["z"] + b["z"])


def sub(a: Column, b: Column) -> Column:
    return vec(a["x"] - b["x"], a["y"] - b["y"], a["z"] - b["z"])


def scaled(a: Column, k) -> Column:
    return vec(a["x"] * k, a["y"] * k, a["z"] * k)


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return vec(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Null for a vector of length zero."""
    return scaled(a, F.try_divide(F.lit(1.0), norm(a)))


def angle_between(a: Column, b: Column) -> Column:
    """Radians; the cosine is clipped to [-1, 1]."""
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(unit(a), unit(b)))))


def onto_line(a: Column, b: Column) -> Column:
    """The part of a along b."""
    return scaled(b, F.try_divide(dot(a, b), dot(b, b)))


def onto_plane(a: Column, normal: Column) -> Column:
    return sub(a, onto_line(a, normal))


def entry(m: Column, i: int, j: int) -> Column:
    return F.get(m, F.lit(4 * i + j))


def product(a: Column, b: Column) -> Column:
    """The 4x4 product a b."""
    cell = lambda g, i, j: sum(
        (entry(g["a"], i, k) * entry(g["b"], k, j) for k in range(1, 4)), entry(g["a"], i, 0) * entry(g["b"], 0, j)
    )
    return let(named(a=a, b=b), lambda g: F.array(*(cell(g, i, j) for i in range(4) for j in range(4))))


def apply(m: Column, p: Column) -> Column:
    """The point m p, divided by its fourth coordinate."""
    row = lambda i: entry(m, i, 0) * p["x"] + entry(m, i, 1) * p["y"] + entry(m, i, 2) * p["z"] + entry(m, i, 3)
    return vec(row(0) / row(3), row(1) / row(3), row(2) / row(3))


def turn(m: Column, v: Column) -> Column:
    """The direction v under the upper 3x3 part of m."""
    row = lambda i: entry(m, i, 0) * v["x"] + entry(m, i, 1) * v["y"] + entry(m, i, 2) * v["z"]
    return vec(row(0), row(1), row(2))


def det3(m: Column) -> Column:
    e = lambda i, j: entry(m, i, j)
    return (
        e(0, 0) * (e(1, 1) * e(2, 2) - e(1, 2) * e(2, 1))
        - e(0, 1) * (e(1, 0) * e(2, 2) - e(1, 2) * e(2, 0))
        + e(0, 2) * (e(1, 0) * e(2, 1) - e(1, 1) * e(2, 0))
    )


def scale_of(m: Column) -> Column:
    """Cube root of the determinant of the upper 3x3 part; 1 for a null transform."""
    return F.coalesce(F.cbrt(det3(m)), F.lit(1.0))


def inverse(m: Column) -> Column:
    """The inverse of an affine 4x4 transform (last row 0 0 0 1); null if it is singular."""
    def cells(g: Column) -> Column:
        e = lambda i, j: entry(g["m"], i, j)
        minor = lambda i, j: (
            e((j + 1) % 3, (i + 1) % 3) * e((j + 2) % 3, (i + 2) % 3) - e((j + 1) % 3, (i + 2) % 3) * e((j + 2) % 3, (i + 1) % 3)
        )
        part = [[minor(i, j) / g["d"] for j in range(3)] for i in range(3)]
        shift = [-(part[i][0] * e(0, 3) + part[i][1] * e(1, 3) + part[i][2] * e(2, 3)) for i in range(3)]
        rows = F.array(*(c for i in range(3) for c in (*part[i], shift[i])), *map(F.lit, (0.0, 0.0, 0.0, 1.0)))
        return F.when(g["d"] != 0, rows)

    return let(let(m, lambda k: named(m=k, d=det3(k))), cells)


def from_parts(rotation: Column, translation: Column, scale: Column, tolerance: float = 1e-8) -> Column:
    """[s R t; 0 1] of nine rotation entries, three of translation and a scale; an error unless det R is 1."""
    r, t = (lambda i: F.get(rotation, F.lit(i))), (lambda i: F.get(translation, F.lit(i)))
    cells = [c for i in range(3) for c in (r(3 * i) * scale, r(3 * i + 1) * scale, r(3 * i + 2) * scale, t(i))]
    plain = F.array(*(c for i in range(3) for c in (r(3 * i), r(3 * i + 1), r(3 * i + 2), F.lit(0.0))), *map(F.lit, (0.0, 0.0, 0.0, 1.0)))
    ok = F.abs(det3(plain) - 1) <= tolerance
    return F.when(ok, F.array(*cells, *map(F.lit, (0.0, 0.0, 0.0, 1.0)))).otherwise(
        F.raise_error(F.lit("the rotation's determinant is not 1")).cast("array<double>")
    )


def from_quaternion(w: Column, x: Column, y: Column, z: Column, tx: Column, ty: Column, tz: Column) -> Column:
    """The rigid transform of a unit quaternion (w first) and a translation."""
    rows = (
        (1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), tx),
        (2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), ty),
        (2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y), tz),
    )
    return F.array(*(c for r in rows for c in r), *map(F.lit, (0.0, 0.0, 0.0, 1.0)))


def roll_pitch_yaw(roll: Column, pitch: Column, yaw: Column) -> Column:
    """P^T Rz(yaw) Ry(pitch) Rx(roll) P in degrees, with P from camera axes (right, down, forward) to (forward, right, down)-like ones."""
    c, s = (lambda a: F.cos(F.radians(a))), (lambda a: F.sin(F.radians(a)))
    cr, sr, cp, sp, cy, sy = c(roll), s(roll), c(pitch), s(pitch), c(yaw), s(yaw)
    m = [
        [cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr],
        [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr],
        [-sp, cp * sr, cp * cr],
    ]
    # P sends camera axes (x, y, z) to (z, x, -y)
    p = [(2, 1), (0, 1), (1, -1)]
    back = {axis: (row, sign) for row, (axis, sign) in enumerate(p)}
    cells = []
    for i in range(3):
        for j in range(3):
            (a, sa), (b, sb) = back[i], back[j]
            cells.append(m[a][b] * float(sa * sb))
        cells.append(F.lit(0.0))
    return F.array(*cells, *map(F.lit, (0.0, 0.0, 0.0, 1.0)))
