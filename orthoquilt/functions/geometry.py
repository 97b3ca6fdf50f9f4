"""Geometry as Column expressions. A polygon is an array of rings, a ring an array of points (x, y), closed or not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orthoquilt.functions.linalg import add, cross, dot, let, named, norm, scaled, sub, unit


#: Square of the sine of the angle up to which segments count as parallel: below it the crossing of their lines is noise of their coordinates.
PARALLEL = 1e-18


def area_3d(a: Column, b: Column, c: Column) -> Column:
    return norm(cross(sub(b, a), sub(c, a))) / 2


def area_2d(a: Column, b: Column, c: Column) -> Column:
    """Area of the triangle seen from above."""
    return F.abs(cross(sub(b, a), sub(c, a))["z"]) / 2


def _edges(ring: Column) -> Column:
    """(a, b) of each edge, with the closing one."""
    return F.zip_with(ring, F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def signed_area(ring: Column) -> Column:
    return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]) / 2)


def polygon_area(rings: Column) -> Column:
    """The outer ring's area less those of the holes."""
    return F.aggregate(F.slice(rings, 2, 1 << 30), F.abs(signed_area(F.get(rings, F.lit(0)))), lambda s, r: s - F.abs(signed_area(r)))


def centroid(ring: Column) -> Column:
    """Of a simple ring; null if it has no area."""
    total = F.aggregate(
        _edges(ring),
        F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")),
        lambda s, e: F.struct(
            (s["a"] + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]).alias("a"),
            (s["x"] + (e["a"]["x"] + e["b"]["x"]) * (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])).alias("x"),
            (s["y"] + (e["a"]["y"] + e["b"]["y"]) * (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])).alias("y"),
        ),
    )
    return F.struct(F.try_divide(total["x"], 3 * total["a"]).alias("x"), F.try_divide(total["y"], 3 * total["a"]).alias("y"))


def _on_edge(x: Column, y: Column, e: Column) -> Column:
    a, b = e["a"], e["b"]
    return (
        ((b["x"] - a["x"]) * (y - a["y"]) == (b["y"] - a["y"]) * (x - a["x"]))
        & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"]))
        & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))
    )


def inside(x: Column, y: Column, rings: Column) -> Column:
    """Strictly inside: even-odd over all rings, borders excluded."""
    edges = F.flatten(F.transform(rings, _edges))
    crosses = lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (
        x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]
    )
    odd = F.aggregate(edges, F.lit(False), lambda s, e: s != crosses(e))
    return odd & ~F.exists(edges, lambda e: _on_edge(x, y, e))


def covers_triangle(rings: Column, a: Column, b: Column, c: Column) -> Column:
    """Whether a polygon that holds the triangle's centre holds all of it: each corner inside or on the border, no edge of
    the polygon crossing a side, and none of its vertices or edges' middles strictly within."""
    turn = lambda p, q, r: (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])

    def test(g: Column) -> Column:
        edges, corner = g["edges"], [g[k] for k in "abc"]
        held = [inside(p["x"], p["y"], g["rings"]) | F.exists(edges, lambda e: _on_edge(p["x"], p["y"], e)) for p in corner]  # noqa: B023
        sides = list(zip(corner, corner[1:] + corner[:1]))
        crosses = lambda e, p, q: (
            (F.signum(turn(e["a"], e["b"], p)) * F.signum(turn(e["a"], e["b"], q)) < 0) & (F.signum(turn(p, q, e["a"])) * F.signum(turn(p, q, e["b"])) < 0)
        )

        def within_it(p: Column) -> Column:
            s = [F.signum(turn(u, v, p)) for u, v in sides]
            return (s[0] != 0) & (s[0] == s[1]) & (s[1] == s[2])

        middle = lambda e: F.struct(((e["a"]["x"] + e["b"]["x"]) / 2).alias("x"), ((e["a"]["y"] + e["b"]["y"]) / 2).alias("y"))
        bad = lambda e: crosses(e, *sides[0]) | crosses(e, *sides[1]) | crosses(e, *sides[2]) | within_it(e["a"]) | within_it(middle(e))
        return held[0] & held[1] & held[2] & ~F.exists(edges, bad)

    return let(named(rings=rings, edges=F.flatten(F.transform(rings, _edges)), a=a, b=b, c=c), test)


def edge_distance(x: Column, y: Column, rings: Column) -> Column:
    """Distance from a point to the nearest edge."""

    def far(e: Column) -> Column:
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        t = F.coalesce(F.try_divide((x - e["a"]["x"]) * dx + (y - e["a"]["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
        return F.hypot(x - e["a"]["x"] - t * dx, y - e["a"]["y"] - t * dy)

    return F.array_min(F.transform(F.flatten(F.transform(rings, _edges)), far))


def within(x: Column, y: Column, rings: Column, buffer: float = 0.0) -> Column:
    """Inside the polygon, or within `buffer` of it (no buffered polygon is built)."""
    return inside(x, y, rings) if not buffer else inside(x, y, rings) | (edge_distance(x, y, rings) < buffer)


def box(x0, y0, x1, y1) -> Column:
    """A rectangle as a polygon."""
    lit = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("double")
    p = lambda a, b: F.struct(lit(a).alias("x"), lit(b).alias("y"))
    return F.array(F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1)))


def closest_points(a0: Column, a1: Column, b0: Column, b1: Column, clamp: bool = True) -> Column:
    """(pa, pb, dist) of the closest approach of two segments, or of their lines without `clamp`. Null for a segment without length.

    Of parallel segments that overlap only the distance is meaningful; the points are at the nearest of a0, a1, b0 and b1, the first of those on a tie.
    """
    limit = lambda x, top: F.least(top, F.greatest(F.lit(0.0), x))

    def crossing(g: Column) -> Column:
        a0, b0, u, v, la, lb = (g[n] for n in ("a0", "b0", "u", "v", "la", "lb"))
        at = lambda h: named(s0=dot(cross(h["t"], v), h["c"]) / h["den"], s1=dot(cross(h["t"], u), h["c"]) / h["den"])
        if not clamp:
            return let(at(g), lambda s: named(pa=add(a0, scaled(u, s["s0"])), pb=add(b0, scaled(v, s["s1"]))))

        def clamped(s: Column) -> Column:
            # a parameter out of range moves the other point to the foot of the clamped one
            first = let(add(a0, scaled(u, limit(s["s0"], la))), lambda pa: named(
                pa=pa, pb=add(b0, scaled(v, F.when(s["s0"].between(0.0, la), limit(s["s1"], lb)).otherwise(limit(dot(sub(pa, b0), v), lb))))))
            again = lambda r: named(
                pa=F.when(s["s1"].between(0.0, lb), r["pa"]).otherwise(add(a0, scaled(u, limit(dot(sub(r["pb"], a0), u), la)))), pb=r["pb"]
            )
            return let(first, again)

        return let(at(g), clamped)

    def parallel(g: Column) -> Column:
        a0, b0, u = g["a0"], g["b0"], g["u"]
        if not clamp:
            return named(pa=add(a0, scaled(u, dot(u, sub(b0, a0)))), pb=b0)

        def ends(d: Column) -> Column:
            share = lambda x: limit(x, F.lit(1.0))
            one, aa, bb, ab, at, bt = F.lit(1.0), d["aa"], d["bb"], d["ab"], d["at"], d["bt"]
            places = ((one * 0, share(-bt / bb)), (one, share((ab - bt) / bb)), (share(at / aa), one * 0), (share((at + ab) / aa), one))
            found = [let(named(pa=add(a0, scaled(g["a"], s)), pb=add(b0, scaled(g["b"], t))), lambda p: named(
                dist=norm(sub(p["pa"], p["pb"])), k=F.lit(k), pa=p["pa"], pb=p["pb"])) for k, (s, t) in enumerate(places)]  # fmt: skip # noqa: B023
            return let(F.array_min(F.array(*found)), lambda m: named(pa=m["pa"], pb=m["pb"]))

        return let(named(aa=dot(g["a"], g["a"]), bb=dot(g["b"], g["b"]), ab=dot(g["a"], g["b"]), at=dot(g["a"], g["t"]), bt=dot(g["b"], g["t"])), ends)

    ends = let(named(a=sub(a1, a0), b=sub(b1, b0)), lambda d: named(
        a0=a0, b0=b0, a=d["a"], b=d["b"], u=unit(d["a"]), v=unit(d["b"]), la=norm(d["a"]), lb=norm(d["b"]), t=sub(b0, a0)))
    crossed = let(ends, lambda g: g.withField("c", cross(g["u"], g["v"])))
    ready = let(crossed, lambda g: g.withField("den", dot(g["c"], g["c"])))
    points = let(ready, lambda g: F.when(g["den"] > PARALLEL, crossing(g)).when(g["den"] <= PARALLEL, parallel(g)))
    return let(points, lambda p: F.when(p.isNotNull(), named(pa=p["pa"], pb=p["pb"], dist=norm(sub(p["pa"], p["pb"])))))


def ray_hits_triangle(origin: Column, direction: Column, a: Column, b: Column, c: Column) -> Column:
    """Distance along the direction at which a ray meets a triangle, either face; null if it does not."""
    edges = let(named(e1=sub(b, a), e2=sub(c, a), s=sub(origin, a)), lambda g: g.withField("h", cross(direction, g["e2"])))
    more = let(edges, lambda g: g.withField("det", dot(g["e1"], g["h"])).withField("q", cross(g["s"], g["e1"])))

    def hit(g: Column) -> Column:
        u, v = F.try_divide(dot(g["s"], g["h"]), g["det"]), F.try_divide(dot(direction, g["q"]), g["det"])
        t = F.try_divide(dot(g["e2"], g["q"]), g["det"])
        return F.when((F.abs(g["det"]) > 1e-12) & (u >= 0) & (v >= 0) & (u + v <= 1) & (t >= 0), t)

    return let(more, hit)
