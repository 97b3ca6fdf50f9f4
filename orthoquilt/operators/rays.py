"""Viewing rays: ray(ray_id, camera_id, start, end, direction), their meetings, and the points they agree on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthoquilt.functions import geometry, linalg
from orthoquilt.functions.linalg import let, vec


#: Rays of a key in a block whose pairs a task forms.
PAIR_BLOCK = 2000


def clip_to_surfaces(rays: DataFrame, surface: DataFrame, size: float, limit: float | None = None) -> DataFrame:
    """Rays cut to run from surface 0 to surface 1 of surface(surface_id, face_id, a, b, c); rays that miss one are dropped, as are
    those longer than the limit. Rays and triangles meet in the (x, y) cells that their boxes share."""
    cell = lambda c: F.floor(c / size).cast("long")
    span = lambda df, parts, k: df.withColumn(
        f"c{k}", F.explode(F.sequence(cell(F.least(*(F.col(f"{p}.{k}") for p in parts))), cell(F.greatest(*(F.col(f"{p}.{k}") for p in parts)))))
    )
    r = span(span(rays.select("ray_id", "camera_id", "start", "end", "direction"), ("start", "end"), "x"), ("start", "end"), "y")
    t = span(span(surface.select("surface_id", "face_id", "a", "b", "c"), "abc", "x"), "abc", "y")
    hit = geometry.ray_hits_triangle(F.col("start"), F.col("direction"), F.col("a"), F.col("b"), F.col("c"))
    hits = r.join(t, ["cx", "cy"]).withColumn("t", hit).where("t is not null")
    first = hits.groupBy("ray_id", "camera_id", "surface_id").agg(F.min_by(linalg.add(F.col("start"), linalg.scaled(F.col("direction"), F.col("t"))), F.struct("t", "face_id")).alias("p"))
    both = first.groupBy("ray_id", "camera_id").agg(
        F.max(F.when(F.col("surface_id") == 0, F.col("p"))).alias("start"), F.max(F.when(F.col("surface_id") == 1, F.col("p"))).alias("end")
    )
    out = both.where("start is not null and end is not null").withColumn("direction", linalg.unit(linalg.sub(F.col("end"), F.col("start"))))
    return out if limit is None else out.where(linalg.norm(linalg.sub(F.col("end"), F.col("start"))) <= limit)


def clip_to_planes(rays: DataFrame, top: float, bottom: float, limit: float | None = None) -> DataFrame:
    """The same for two horizontal planes, in closed form."""
    at = lambda z: let(F.try_divide(F.lit(float(z)) - F.col("start.z"), F.col("direction.z")), lambda t: F.when(t >= 0, linalg.add(F.col("start"), linalg.scaled(F.col("direction"), t))))
    out = rays.select("ray_id", "camera_id", at(top).alias("s"), at(bottom).alias("e")).where("s is not null and e is not null")
    out = out.select("ray_id", "camera_id", F.col("s").alias("start"), F.col("e").alias("end"), linalg.unit(linalg.sub(F.col("e"), F.col("s"))).alias("direction"))
    return out if limit is None else out.where(linalg.norm(linalg.sub(F.col("end"), F.col("start"))) <= limit)


def cell_sides(rays: DataFrame, threshold: float, in_a_cell: float = 4.0) -> tuple[float, float, float]:
    """Sides of cells for `edges`, from one row of sums: as long as rays are on average along their main axis, and across it so wide
    that about `in_a_cell` rays share a cell if they are spread evenly, but at least twice the threshold."""
    spans = [F.avg(F.abs(F.col(f"end.{k}") - F.col(f"start.{k}"))) for k in "xyz"]
    bounds = [f(g(f"start.{k}", f"end.{k}")) for k in "xyz" for f, g in ((F.min, F.least), (F.max, F.greatest))]
    row = rays.agg(F.count("*"), *spans, *bounds).first()
    least = max(2 * threshold, 1e-9)
    if not row[0]:
        return least, least, least
    mean, width = row[1:4], [row[2 * k + 5] - row[2 * k + 4] for k in range(3)]
    main = max(range(3), key=lambda k: mean[k])
    across = [k for k in range(3) if k != main]
    layers = max(1.0, width[main] / max(mean[main], least))
    side = max(least, (in_a_cell * layers * max(width[across[0]], least) * max(width[across[1]], least) / row[0]) ** 0.5)
    return tuple(max(least, mean[k]) if k == main else side for k in range(3))


def closest(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """geometry.closest_points of many segments (n, 3), operation by operation, as arrays of pa, pb and dist; not numbers for a segment without length."""
    dot = lambda a, b: a[:, 0] * b[:, 0] + a[:, 1] * b[:, 1] + a[:, 2] * b[:, 2]
    cross = lambda a, b: np.stack([a[:, i] * b[:, j] - a[:, j] * b[:, i] for i, j in ((1, 2), (2, 0), (0, 1))], 1)
    along = lambda p, u, s: p + u * s[:, None]
    limit = lambda x, top: np.minimum(top, np.maximum(0.0, x))
    with np.errstate(all="ignore"):
        a, b, t = a1 - a0, b1 - b0, b0 - a0
        la, lb = np.sqrt(dot(a, a)), np.sqrt(dot(b, b))
        u, v = a * (1.0 / la)[:, None], b * (1.0 / lb)[:, None]
        c = cross(u, v)
        den = dot(c, c)
        s0, s1 = dot(cross(t, v), c) / den, dot(cross(t, u), c) / den
        p = along(a0, u, limit(s0, la))
        q = along(b0, v, np.where((s0 >= 0) & (s0 <= la), limit(s1, lb), limit(dot(p - b0, v), lb)))
        p = np.where(((s1 >= 0) & (s1 <= lb))[:, None], p, along(a0, u, limit(dot(q - a0, u), la)))
        k = np.flatnonzero(den <= geometry.PARALLEL)
        if len(k):
            aa, bb, ab, at, bt = (dot(x[k], y[k]) for x, y in ((a, a), (b, b), (a, b), (a, t), (b, t)))
            zero, one = np.zeros(len(k)), np.ones(len(k))
            least = np.full(len(k), np.inf)
            for s, w in ((zero, limit(-bt / bb, 1.0)), (one, limit((ab - bt) / bb, 1.0)), (limit(at / aa, 1.0), zero), (limit((at + ab) / aa, 1.0), one)):
                x, y = along(a0[k], a[k], s), along(b0[k], b[k], w)
                far = np.sqrt(dot(x - y, x - y))
                nearer = far < least
                least, p[k[nearer]], q[k[nearer]] = np.where(nearer, far, least), x[nearer], y[nearer]
        return p, q, np.sqrt(dot(p - q, p - q))


def points_in(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    """Columns of points as arrays (n, 3); missing ones are not numbers."""
    return [np.stack([batch[n].flatten()[k].to_numpy(zero_copy_only=False).astype(float) for k in range(3)], 1) for n in names]


def edges(
    rays: DataFrame, threshold: float, min_dist: float = 1e-6, transform: Callable[[Column], Column] = lambda d: d, cell: float | tuple[float, float, float] | None = None
) -> DataFrame:
    """src < dst, dist and weight = 1 / transform(dist) of rays of different cameras that come within the threshold.

    Each segment is cut into steps of at most the cells' sides (`cell_sides` unless given; one number makes cubes) and put into the cells of the boxes of its
    steps, widened by half the threshold: two segments within the threshold share a cell. Candidate pairs are made distinct, then measured exactly.
    """
    sides = cell_sides(rays, threshold) if cell is None else cell if isinstance(cell, tuple) else (float(cell),) * 3
    sides = tuple(max(float(s), 2 * threshold, 1e-9) for s in sides)
    span = lambda axis: F.abs(F.col(f"end.{axis}") - F.col(f"start.{axis}"))
    steps = F.greatest(F.lit(1), *(F.ceil(span(axis) / side).cast("int") for axis, side in zip("xyz", sides, strict=True)))
    cut = rays.select("ray_id", "camera_id", "start", "end", F.explode(F.array(steps)).alias("n")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    near = threshold / 2
    for axis, side in zip("xyz", sides, strict=True):
        p = lambda k: F.col(f"start.{axis}") + (F.col(f"end.{axis}") - F.col(f"start.{axis}")) * k / F.col("n")  # noqa: E731, B023
        a, b = p(F.col("k")), p(F.col("k") + 1)
        floor = lambda v: F.floor(v / side).cast("long")  # noqa: E731, B023
        cut = cut.withColumn(f"c{axis}", F.explode(F.sequence(floor(F.least(a, b) - near), floor(F.greatest(a, b) + near))))
    placed = cut.select("ray_id", "camera_id", "cx", "cy", "cz").distinct()
    other = placed.select(F.col("ray_id").alias("dst"), F.col("camera_id").alias("other"), "cx", "cy", "cz")
    pairs = placed.join(other, ["cx", "cy", "cz"]).where("ray_id < dst and camera_id <> other").select(F.col("ray_id").alias("src"), "dst").distinct()
    ends = lambda name: rays.select(F.col("ray_id").alias(name), F.col("start").alias(f"{name}_s"), F.col("end").alias(f"{name}_e"))
    met = pairs.join(ends("src"), "src").join(ends("dst"), "dst")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *_, far = closest(*points_in(batch, "src_s", "src_e", "dst_s", "dst_e"))
            near = pa.array(far <= threshold)
            yield pa.RecordBatch.from_arrays([batch["src"].filter(near), batch["dst"].filter(near), pa.array(far).filter(near)], names=["src", "dst", "dist"])

    met = met.select("src", "dst", "src_s", "src_e", "dst_s", "dst_e")
    kind = rays.select(F.col("ray_id").alias("src"), F.col("ray_id").alias("dst"), F.lit(0.0).alias("dist")).schema
    met = met.mapInArrow(measured, kind)
    dist = F.greatest(F.col("dist"), F.lit(float(min_dist)))
    return met.select("src", "dst", dist.alias("dist"), (1 / transform(dist)).alias("weight"))


def average_point(rays: DataFrame, key: str) -> DataFrame:
    """For each key the mean of the closest points of all pairs of its rays; keys with one ray give no row. The pairs of a key are what is
    asked for; they are dealt by blocks of its rays, so a large key is spread over many tasks."""
    own = rays.select(key, "ray_id", "start", "end")
    blocks = own.groupBy(key).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / PAIR_BLOCK)).cast("int").alias("blocks")).where(f"{key} is not null")
    block = F.pmod(F.xxhash64("ray_id"), F.col("blocks")).cast("int")
    dealt = own.join(blocks, key).withColumn("block", block)
    # a ray of block b meets those of block c in the cell (least, greatest) of both
    cell = lambda c: F.struct(F.least("block", c).alias("p"), F.greatest("block", c).alias("q"))
    cells = dealt.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), cell)))
    other = cells.select(key, "cell", F.col("block").alias("other"), F.col("ray_id").alias("dst"), F.col("start").alias("s"), F.col("end").alias("e"))
    met = cells.join(other, [key, "cell"]).where("ray_id < dst and (block <> other or cell.p = cell.q)")

    def middles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q, _ = closest(*points_in(batch, "start", "end", "s", "e"))
            whole = ~np.isnan(p).any(1)
            mid = (p[whole] + q[whole]) / 2
            yield pa.RecordBatch.from_arrays([batch[key].filter(pa.array(whole)), *(pa.array(mid[:, k]) for k in range(3))], names=[key, *"xyz"])

    zero = F.lit(0.0)
    kind = rays.select(key, *(zero.alias(k) for k in "xyz")).schema
    return met.select(key, "start", "end", "s", "e").mapInArrow(middles, kind).groupBy(key).agg(*(F.avg(k).alias(k) for k in "xyz"))


def least_squares_point(rays: DataFrame, key: str) -> DataFrame:
    """For each key the point with the least sum of squared distances to its rays' lines: nine sums, then a 3x3 solution;
    null if the lines are all parallel."""
    d, s = F.col("direction"), F.col("start")
    axes = "xyz"
    m = {f"m{a}{b}": F.sum((F.lit(1.0) if a == b else F.lit(0.0)) - d[a] * d[b]) for i, a in enumerate(axes) for b in axes[i:]}
    v = {f"v{a}": F.sum(s[a] - d[a] * linalg.dot(d, s)) for a in axes}
    sums = rays.groupBy(key).agg(*(c.alias(n) for n, c in (m | v).items()))
    at = lambda a, b: F.col(f"m{min(a, b)}{max(a, b)}")
    minor = lambda i, j: (
        at(axes[(i + 1) % 3], axes[(j + 1) % 3]) * at(axes[(i + 2) % 3], axes[(j + 2) % 3])
        - at(axes[(i + 1) % 3], axes[(j + 2) % 3]) * at(axes[(i + 2) % 3], axes[(j + 1) % 3])
    )
    det = sum((at("x", axes[j]) * minor(0, j) for j in range(1, 3)), at("x", "x") * minor(0, 0))
    out = sums.withColumn("det", det)
    solved = [F.when(F.abs(F.col("det")) > 1e-9, sum((minor(j, i) * F.col(f"v{axes[j]}") for j in range(1, 3)), minor(0, i) * F.col("vx")) / F.col("det")).alias(a) for i, a in enumerate(axes)]
    return out.select(key, *solved)


def covering_surfaces(vertices: DataFrame, n: int, buffer: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """surface_id (0 upper, 1 lower), i, j, x, y, z: highest and lowest vertex in each of n x n cells over the bounding box, whose borders
    belong to the cells on both sides; the buffers are added to the upper and the lower surface. Cells without vertices are left out."""
    if n < 2:
        raise ValueError("n must be at least 2")
    b = vertices.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if b[0] is None:
        return vertices.sparkSession.createDataFrame([], "surface_id int, i long, j long, x double, y double, z double")
    sx, sy = ((b[1] - b[0]) / n or 1.0), ((b[3] - b[2]) / n or 1.0)

    def cells(v: Column, low: float, step: float) -> Column:
        t = (v - low) / step
        k = F.least(F.floor(t).cast("long"), F.lit(n - 1))
        return F.when((t == F.floor(t)) & (k > 0) & (t < n), F.array(k - 1, k)).otherwise(F.array(k))

    dealt = vertices.select("z", F.explode(cells(F.col("x"), b[0], sx)).alias("i"), "y").select("z", "i", F.explode(cells(F.col("y"), b[2], sy)).alias("j"))
    held = dealt.groupBy("i", "j").agg(F.max("z").alias("top"), F.min("z").alias("low"))
    both = held.select("i", "j", F.explode(F.array(F.struct(F.lit(0).alias("s"), (F.col("top") + buffer[0]).alias("z")), F.struct(F.lit(1).alias("s"), (F.col("low") + buffer[1]).alias("z")))).alias("r"))
    middle = lambda k, low, step: (F.col(k) + 0.5) * step + low
    return both.select(F.col("r.s").alias("surface_id"), "i", "j", middle("i", b[0], sx).alias("x"), middle("j", b[2], sy).alias("y"), F.col("r.z").alias("z"))


def grid_triangles(surface: DataFrame) -> DataFrame:
    """Two triangles for each square of neighbouring cells that are all there: surface_id, face_id, a, b, c."""
    p = surface.select("surface_id", "i", "j", vec(F.col("x"), F.col("y"), F.col("z")).alias("p"))
    shift = lambda di, dj, name: p.select("surface_id", (F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.col("p").alias(name))
    key = ["surface_id", "i", "j"]
    square = p.join(shift(1, 0, "q"), key).join(shift(0, 1, "r"), key).join(shift(1, 1, "s"), key)
    both = F.array(F.struct(F.lit(0).alias("k"), F.col("p").alias("a"), F.col("q").alias("b"), F.col("r").alias("c")), F.struct(F.lit(1).alias("k"), F.col("q").alias("a"), F.col("s").alias("b"), F.col("r").alias("c")))
    return square.select("surface_id", "i", "j", F.explode(both).alias("t")).select("surface_id", F.xxhash64("i", "j", "t.k").alias("face_id"), "t.a", "t.b", "t.c")


def points_as_vec(df: DataFrame, name: str, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    return df.withColumn(name, vec(F.col(x), F.col(y), F.col(z)))
