"""Lens distortion as Column expressions: the frame-camera polynomial, its inverse, and the key of a parameter set."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients that the model knows; k1 must be there.
NAMES = ("b1", "b2", "k1", "k2", "k3", "k4", "p1", "p2")


def key(params: Column, scale: float = 1.0) -> Column:
    """Sorted `name:value` pairs with eight decimals, joined by bars, with the image scale last."""
    pairs = F.array_sort(F.map_entries(params))
    return F.array_join(
        F.concat(F.transform(pairs, lambda e: F.format_string("%s:%.8f", e["key"], e["value"])), F.array(F.format_string("s:%.8f", F.lit(float(scale))))), "|"
    )


def checked(params: Column) -> Column:
    """The parameters, or an error if k1 is missing or a name is unknown."""
    known = F.forall(F.map_keys(params), lambda k: k.isin(*NAMES))
    return F.when(known & F.map_contains_key(params, "k1"), params).otherwise(
        F.raise_error(F.lit("distortion needs k1 and has unknown coefficients or lacks it")).cast("map<string,double>")
    )


def warped(x: Column, y: Column, params: Column, f: Column, cx: Column, cy: Column, width: Column, height: Column) -> Column:
    """Ideal pixel (x, y) -> the pixel (x, y) where the lens images it."""
    k = lambda n: F.coalesce(F.try_element_at(params, F.lit(n)), F.lit(0.0))
    u, v = (x - width / 2) / f, (y - height / 2) / f
    r2 = u * u + v * v
    radial = 1 + r2 * (k("k1") + r2 * (k("k2") + r2 * (k("k3") + r2 * k("k4"))))
    du = u * radial + k("p1") * (r2 + 2 * u * u) + 2 * k("p2") * u * v
    dv = v * radial + k("p2") * (r2 + 2 * v * v) + 2 * k("p1") * u * v
    return F.struct(
        (width / 2 + cx + du * f + du * k("b1") + dv * k("b2")).alias("x"), (height / 2 + cy + dv * f).alias("y")
    )


def ideal(x: Column, y: Column, params: Column, f: Column, cx: Column, cy: Column, width: Column, height: Column, steps: int = 6) -> Column:
    """The inverse of `warped` by fixed-point steps, for the mild distortions of survey lenses."""
    at = F.struct((x - cx).alias("x"), (y - cy).alias("y"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        at,
        lambda p, _: F.struct(
            (p["x"] + x - warped(p["x"], p["y"], params, f, cx, cy, width, height)["x"]).alias("x"),
            (p["y"] + y - warped(p["x"], p["y"], params, f, cx, cy, width, height)["y"]).alias("y"),
        ),
    )
