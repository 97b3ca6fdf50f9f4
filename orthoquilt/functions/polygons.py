"""Boolean operations on polygons (lists of rings, a ring an array of points) in numpy, for Arrow-batched operators.

Vertices and crossings cut the plane into vertical slabs in which no two edges cross. At the middle of a slab the edges are sorted once,
and even-odd counts of each polygon tell which stretches between them are kept; a stretch is a trapezoid over the slab. So areas are exact for
any polygons with holes, also of rings that cross themselves, and the result's outline is what trapezoids do not share.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Ring = np.ndarray
Polygon = list[Ring]
Trapezoid = tuple[float, float, float, float, float, float]  # x0, x1, lower y at both, upper y at both
#: What is nearer than this, against the size of the coordinates, is taken for the same place.
CLOSE = 1e-9


def edges_of(polygon: Polygon) -> np.ndarray:
    """x0, y0, x1, y1 of all edges, left to right; vertical ones bound nothing in a slab."""
    found = [np.hstack([r, np.roll(r, -1, axis=0)]) for r in polygon if len(r) > 2]
    if not found:
        return np.zeros((0, 4))
    e = np.concatenate(found)
    e = e[e[:, 0] != e[:, 2]]
    return np.where(e[:, :1] > e[:, 2:3], e[:, [2, 3, 0, 1]], e)


def crossings(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x of the points where edges of a and of b cross."""
    if not len(a) or not len(b):
        return np.zeros(0)
    p, q = a[:, None, :2], b[None, :, :2]
    u, v = a[:, None, 2:] - p, b[None, :, 2:] - q
    det = u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]
    w = q - p
    with np.errstate(divide="ignore", invalid="ignore"):
        s = (w[..., 0] * v[..., 1] - w[..., 1] * v[..., 0]) / det
        t = (w[..., 0] * u[..., 1] - w[..., 1] * u[..., 0]) / det
    hit = (det != 0) & (s >= 0) & (s <= 1) & (t >= 0) & (t <= 1)
    return (p[..., 0] + s * u[..., 0])[hit]


def trapezoids(polygons: list[Polygon], keep: Callable[[list[bool]], bool]) -> list[Trapezoid]:
    """The parts of the plane for which `keep` accepts which polygons hold them."""
    own = [edges_of(p) for p in polygons]
    every = np.concatenate(own) if own else np.zeros((0, 4))
    if not len(every):
        return []
    of = np.repeat(np.arange(len(own)), [len(e) for e in own])
    crossed = np.concatenate([np.zeros(0)] + [crossings(own[i], own[j]) for i in range(len(own)) for j in range(i + 1)])
    xs = np.unique(np.concatenate([every[:, 0], every[:, 2], crossed]))
    # crossings are not exact: those beside another cut are that cut
    ends = np.unique(np.concatenate([every[:, 0], every[:, 2]]))
    near = np.diff(xs, prepend=-np.inf) <= CLOSE * max(1.0, float(np.abs(xs).max()))
    xs = np.union1d(xs[~near], ends)
    slope = (every[:, 3] - every[:, 1]) / (every[:, 2] - every[:, 0])
    out = []
    for x0, x1 in zip(xs[:-1].tolist(), xs[1:].tolist()):
        middle = (x0 + x1) / 2
        live = np.flatnonzero((every[:, 0] < middle) & (every[:, 2] > middle))
        at = lambda x: every[live, 1] + slope[live] * (x - every[live, 0])  # noqa: B023, E731
        order = np.argsort(at(middle), kind="stable")
        low, high, who = at(x0)[order].tolist(), at(x1)[order].tolist(), of[live][order].tolist()
        held, begin = [False] * len(own), None
        inside = keep(held)
        for k, p in enumerate(who):
            held[p] = not held[p]
            now = keep(held)
            if now and not inside:
                begin = k
            elif inside and not now and begin is not None:
                out.append((x0, x1, low[begin], high[begin], low[k], high[k]))
            inside = now
    return [t for t in out if t[4] - t[2] + t[5] - t[3] > 0]


def trapezoid_area(parts: list[Trapezoid]) -> float:
    return float(sum((t[1] - t[0]) * (t[4] - t[2] + t[5] - t[3]) / 2 for t in parts))


def both(held: list[bool]) -> bool:
    return all(held)


def either(held: list[bool]) -> bool:
    return any(held)


def first_only(held: list[bool]) -> bool:
    return held[0] and not any(held[1:])


def signed_area(ring: Ring) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2


def holds(ring: Ring, p: np.ndarray) -> bool:
    a, b = ring, np.roll(ring, -1, axis=0)
    spans = (a[:, 1] > p[1]) != (b[:, 1] > p[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        x = (b[:, 0] - a[:, 0]) * (p[1] - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
    return bool((spans & (p[0] < x)).sum() % 2)


def straightened(ring: list[tuple[float, float]]) -> Ring:
    """Without points between two others on a line."""
    p = np.array(ring)
    while len(p) > 2:
        u, v = p - np.roll(p, 1, axis=0), np.roll(p, -1, axis=0) - p
        turn = np.abs(u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0])
        flat = turn <= 1e-9 * np.maximum(np.hypot(*u.T) * np.hypot(*v.T), 1e-12)
        if not flat.any():
            break
        if flat[0]:  # drop one at a time where neighbours may change
            p = p[1:]
        else:
            keep = ~flat | np.roll(flat, 1)
            p = p[keep]
    return p


def outline(parts: list[Trapezoid]) -> list[Polygon]:
    """The polygons that trapezoids make up: outer rings against the clock, each with its holes."""
    heights: dict[float, list[float]] = {}
    for x0, x1, a0, a1, b0, b1 in parts:
        heights.setdefault(x0, []).extend((a0, b0))
        heights.setdefault(x1, []).extend((a1, b1))
    close = CLOSE * max([1.0, *(abs(v) for t in parts for v in t)]) * 10
    snapped: dict[tuple[float, float], float] = {}
    for x, ys in heights.items():
        last = -np.inf
        for y in sorted(set(ys)):
            last = y if y - last > close else last
            snapped[x, y] = last
    key = lambda x, y: (x, snapped[x, y])
    leaving: dict[tuple[float, float], list[tuple[float, float]]] = {}
    sides: dict[float, list[tuple[float, int]]] = {}
    for x0, x1, a0, a1, b0, b1 in parts:
        for p, q in (((x0, a0), (x1, a1)), ((x1, b1), (x0, b0))):
            leaving.setdefault(key(*p), []).append(key(*q))
        for x, low, high, way in ((x1, a1, b1, 1), (x0, a0, b0, -1)):
            sides.setdefault(x, []).extend(((snapped[x, low], way), (snapped[x, high], -way)))
    for x, ends in sides.items():  # what only one side of a slab's border has
        level, before = 0, None
        for y in sorted({y for y, _ in ends}):
            if level and before is not None:
                p, q = (x, before), (x, y)
                p, q = (p, q) if level > 0 else (q, p)
                leaving.setdefault(p, []).append(q)
            level += sum(way for v, way in ends if v == y)
            before = y
    rings: list[Ring] = []
    for start in sorted(leaving):
        while leaving[start]:
            path, seen = [start], {start: 0}
            while leaving.get(path[-1]):
                there = leaving[path[-1]].pop()
                if there in seen:
                    k = seen[there]
                    rings.append(straightened(path[k:]))
                    for p in path[k + 1 :]:
                        del seen[p]
                    path = path[: k + 1]
                else:
                    seen[there] = len(path)
                    path.append(there)
    rings = [r for r in rings if len(r) > 2 and abs(signed_area(r)) > close * close]
    outer = sorted((r for r in rings if signed_area(r) > 0), key=signed_area)
    found: list[Polygon] = [[r] for r in outer]
    for hole in (r for r in rings if signed_area(r) < 0):
        # a point just inside the hole's border lies in the ring around it
        middle = (hole[0] + hole[1]) / 2
        around = next((p for p in found if signed_area(p[0]) > -signed_area(hole) and holds(p[0], middle)), None)
        if around is not None:
            around.append(hole)
    return found


def combined(polygons: list[Polygon], keep: Callable[[list[bool]], bool]) -> list[Polygon]:
    return outline(trapezoids(polygons, keep))


def is_convex(ring: Ring) -> bool:
    u = np.roll(ring, -1, axis=0) - ring
    v = np.roll(u, -1, axis=0)
    turn = u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]
    if not (turn >= 0).all() and not (turn <= 0).all():
        return False
    # a star turns one way, too, but more than once around
    angle = np.arctan2(turn, (u * v).sum(1))
    return bool(abs(abs(angle.sum()) - 2 * np.pi) < 1e-6)
