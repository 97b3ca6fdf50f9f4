"""Areas that polygons share, outlines of face classes, and covers without overlap."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthoquilt.functions import geometry, polygons
from orthoquilt.operators.graph import components
from orthoquilt.operators.spatial import bounds, in_cells
from orthoquilt.relations import RINGS

ARROW_RINGS = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))


def clip(subject: np.ndarray, convex: np.ndarray) -> np.ndarray:
    """The part of a ring inside a convex ring, by cutting with one edge after the other."""
    x, y = convex[:, 0], convex[:, 1]
    if (x * np.roll(y, -1) - np.roll(x, -1) * y).sum() < 0:
        convex = convex[::-1]
    out = subject
    for a, b in zip(convex, np.roll(convex, -1, axis=0), strict=True):
        if len(out) == 0:
            break
        d = (b[0] - a[0]) * (out[:, 1] - a[1]) - (b[1] - a[1]) * (out[:, 0] - a[0])
        nxt, e = np.roll(out, -1, axis=0), np.roll(d, -1)
        points = []
        for p, q, s, t in zip(out, nxt, d, e, strict=True):
            if s >= 0:
                points.append(p)
            if s * t < 0:
                points.append(p + (q - p) * (s / (s - t)))
        out = np.array(points).reshape(-1, 2)
    return out


def ring_area(ring: np.ndarray) -> float:
    if len(ring) < 3:
        return 0.0
    x, y = ring[:, 0], ring[:, 1]
    return abs(float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())) / 2


def points_of(rings) -> polygons.Polygon:
    """A polygon of Arrow's Python values."""
    return [np.array([(p["x"], p["y"]) for p in ring], float).reshape(-1, 2) for ring in rings or []]


def rings_of(polygon: polygons.Polygon) -> list[list[dict[str, float]]]:
    return [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in polygon]


def common_area(a: polygons.Polygon, b: polygons.Polygon) -> float:
    """Of any two polygons: by cutting edge after edge if the second is convex and without holes, else by slabs."""
    if not a or not b:
        return 0.0
    if len(b) == 1 and len(b[0]) > 2 and polygons.is_convex(b[0]):
        parts = [ring_area(clip(r, b[0])) for r in a]
        return parts[0] - sum(parts[1:])
    return polygons.trapezoid_area(polygons.trapezoids([a, b], polygons.both))


def shared_area(pairs: DataFrame, subject: str, other: str) -> DataFrame:
    """pairs with shared_area: of two polygons, with or without holes, convex or not."""
    from pyspark.sql import types as T

    schema = T.StructType([*pairs.schema.fields, T.StructField("shared_area", T.DoubleType())])
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column(names.index(subject)).to_pylist(), batch.column(names.index(other)).to_pylist(), strict=True)
            found = [common_area(points_of(a), points_of(b)) for a, b in both]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*names, "shared_area"])

    return pairs.mapInArrow(run, schema)


HOW = {"intersection": polygons.both, "union": polygons.either, "difference": polygons.first_only}


def combined_pairs(pairs: DataFrame, a: str, b: str, how: str = "intersection") -> DataFrame:
    """pairs with part and geom: the polygons that make up the intersection, union or difference of two polygons (no row where there is none)."""
    keep, names = HOW[how], [c for c in pairs.columns if c not in (a, b)]
    from pyspark.sql import types as T

    geom = T._parse_datatype_string(RINGS)
    schema = T.StructType([*(f for f in pairs.schema.fields if f.name in names), T.StructField("part", T.IntegerType()), T.StructField("geom", geom)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts, geoms = [], [], []
            for k, (p, q) in enumerate(zip(batch.column(batch.schema.names.index(a)).to_pylist(), batch.column(batch.schema.names.index(b)).to_pylist(), strict=True)):
                for n, polygon in enumerate(polygons.combined([points_of(p), points_of(q)], keep)):
                    rows.append(k)
                    parts.append(n)
                    geoms.append(rings_of(polygon))
            kept = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(kept.column(batch.schema.names.index(n)) for n in names), pa.array(parts, pa.int32()), pa.array(geoms, ARROW_RINGS)], [*names, "part", "geom"]
            )

    return pairs.mapInArrow(run, schema)


def overlapping(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """Pairs of polygons (a_id, a_geom) and (b_id, b_geom) whose boxes share a cell, each at the first cell that both have."""

    def dealt(df: DataFrame, k: str) -> DataFrame:
        out = in_cells(df.select(f"{k}_id", F.col(f"{k}_geom").alias("geom")), size)
        low = lambda axis: F.floor(bounds(F.col("geom"), axis)[0] / size).cast("long")
        return out.select("cell_x", "cell_y", f"{k}_id", F.col("geom").alias(f"{k}_geom"), low("x").alias(f"{k}_x"), low("y").alias(f"{k}_y"))

    met = dealt(a, "a").join(dealt(b, "b"), ["cell_x", "cell_y"])
    return met.where("cell_x = greatest(a_x, b_x) and cell_y = greatest(a_y, b_y)").select("a_id", "a_geom", "b_id", "b_geom")


def in_tiles(shapes: DataFrame, size: float, make: Callable[[list[tuple], list[polygons.Polygon]], list[tuple]], columns: str) -> DataFrame:
    """Rows (of `columns`, without the geometry) and geom that `make` gives for each square tile, from the shapes' other columns
    (rows sorted) and their parts inside the tile. A task holds what meets one tile, so `size` bounds it; shapes over several tiles come in parts."""
    others = [c for c in shapes.columns if c != "geom"]
    names = [c.split()[0] for c in columns.split(", ")]

    def one(key: tuple, table: pa.Table) -> pa.Table:
        x, y = key[0].as_py() * size, key[1].as_py() * size
        tile = [np.array([(x, y), (x + size, y), (x + size, y + size), (x, y + size)])]
        rows = []
        for row in sorted(table.to_pylist(), key=lambda r: tuple((r[c] is None, r[c]) for c in others)):
            for part in polygons.combined([points_of(row["geom"]), tile], polygons.both):
                rows.append((tuple(row[c] for c in others), part))
        found = make([r for r, _ in rows], [p for _, p in rows]) if rows else []
        out = {n: pa.array([f[k] for f in found], types[n]) for k, n in enumerate(names)}
        return pa.table(out | {"geom": pa.array([rings_of(f[-1]) for f in found], ARROW_RINGS)})

    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    types = {f.name: to_arrow_type(f.dataType) for f in T._parse_datatype_string(columns).fields}
    return in_cells(shapes, size).groupBy("cell_x", "cell_y").applyInArrow(one, f"{columns}, geom {RINGS}")


def merged(parts: list[polygons.Polygon], batch: int = 16) -> list[polygons.Polygon]:
    """The union, by batches of neighbours (sorted by their least x) round after round."""
    parts = sorted(parts, key=lambda p: float(p[0][:, 0].min()))
    while len(parts) > 1:
        before = len(parts)
        parts = [q for k in range(0, before, batch) for q in polygons.combined(parts[k : k + batch], polygons.either)]
        if len(parts) >= before:
            # nothing met within the batches: one last round over all of it
            return polygons.combined(parts, polygons.either) if before > batch else parts
    return parts


def dissolved(shapes: DataFrame, key: str, size: float) -> DataFrame:
    """key, geom: the union of shapes (key long, geom) of each key, as polygons cut at the borders of tiles of that size."""

    def make(rows: list[tuple], parts: list[polygons.Polygon]) -> list[tuple]:
        of: dict[int | None, list[polygons.Polygon]] = {}
        for (k,), p in zip(rows, parts, strict=True):
            of.setdefault(k, []).append(p)
        return [(k, q) for k, own in of.items() for q in merged(own)]

    return in_tiles(shapes.select(F.col(key).cast("long").alias(key), "geom"), size, make, f"{key} long")


def apart(shapes: DataFrame, size: float) -> DataFrame:
    """polygon_id, geom: what of each polygon (polygon_id, geom) no smaller one covers (the lower id of two of equal area keeps it), cut at the borders of tiles."""

    def make(rows: list[tuple], parts: list[polygons.Polygon]) -> list[tuple]:
        # rows come by area and id
        of: dict[tuple, list[polygons.Polygon]] = {}
        for r, p in zip(rows, parts, strict=True):
            of.setdefault(r, []).append(p)
        taken: list[polygons.Polygon] = []
        found = []
        for (_, k), own in of.items():
            for p in own:
                low, high = p[0].min(0), p[0].max(0)
                near = [q for q in taken if (q[0].min(0) <= high).all() and (q[0].max(0) >= low).all()]
                found += [(k, q) for q in polygons.combined([p, *near], polygons.first_only)]
            taken += own
        return found

    sized = shapes.select(F.round(geometry.polygon_area(F.col("geom")), 9).alias("area"), F.col("polygon_id").cast("long").alias("polygon_id"), "geom")
    return in_tiles(sized, size, make, "polygon_id long")


def overlap_table(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """a_id, b_id, area of shared area of polygons a(a_id, a_geom) with polygons b(b_id, b_geom); none where they only touch."""
    return shared_area(overlapping(a, b, size), "a_geom", "b_geom").where("shared_area > 1e-12").select("a_id", "b_id", F.col("shared_area").alias("area"))


def face_shares(faces: DataFrame, shapes: DataFrame, size: float) -> DataFrame:
    """polygon_id, face_id, share: how much of a face (seen from above) lies in a polygon, exactly, also where it is cut."""
    ring = F.array(F.array(*(F.struct(F.col(f"{k}.x").alias("x"), F.col(f"{k}.y").alias("y")) for k in "abc")))
    tri = faces.select(F.col("face_id").alias("b_id"), ring.alias("b_geom"))
    met = overlap_table(shapes.select(F.col("polygon_id").alias("a_id"), F.col("geom").alias("a_geom")), tri, size)
    whole = tri.select("b_id", geometry.polygon_area(F.col("b_geom")).alias("whole")).where("whole > 0")
    return met.join(whole, "b_id").select(F.col("a_id").alias("polygon_id"), F.col("b_id").alias("face_id"), (F.col("area") / F.col("whole")).alias("share"))


def boundary_edges(faces: DataFrame, parts: int | None = None) -> DataFrame:
    """class_id, v, w (v < w) of faces (face_id, v0, v1, v2, class_id): edges that one face of the class has only. They outline the
    dissolved class. The edges are counted in `parts` tasks if that is given: few edges come twice, so a task holds nearly all of its own."""
    pair = lambda a, b: F.struct(F.least(a, b).alias("v"), F.greatest(a, b).alias("w"))
    each = faces.where("class_id is not null").select("class_id", F.explode(F.array(pair("v0", "v1"), pair("v1", "v2"), pair("v2", "v0"))).alias("e")).select("class_id", "e.v", "e.w")
    if parts is not None:
        each = each.repartition(parts, "class_id", "v", "w")
    return each.groupBy("class_id", "v", "w").agg(F.count("*").alias("n")).where("n = 1").select("class_id", "v", "w")


def walk(v: list[int], w: list[int]) -> list[list[int]]:
    """Closed walks that use each edge once, split where they come back to a vertex."""
    near: dict[int, list[int]] = {}
    for a, b in sorted(zip(v, w, strict=True)):
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    rings = []
    for start in sorted(near):
        while near[start]:
            path, seen = [start], {start: 0}
            while near[path[-1]]:
                here = path[-1]
                there = min(near[here])
                near[here].remove(there)
                near[there].remove(here)
                if there in seen:
                    k = seen[there]
                    rings.append(path[k:])
                    for p in path[k + 1 :]:
                        del seen[p]
                    path = path[: k + 1]
                else:
                    seen[there] = len(path)
                    path.append(there)
    return [r for r in rings if len(r) > 2]


def outlines(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """class_id, ring_id, ring (points): the boundary edges stitched to rings. Edges are grouped by class and connected piece, so a task
    holds one piece's outline."""
    piece = lambda v: F.struct("class_id", F.col(v).alias("v"))
    keyed = edges.select("class_id", "v", "w", F.xxhash64(piece("v")).alias("src"), F.xxhash64(piece("w")).alias("dst"))
    label = components(keyed).select(F.col("node").alias("src"), "component")
    grouped = keyed.join(label, "src").select("class_id", "component", "v", "w")

    def stitch(table: pa.Table) -> pa.Table:
        rings = walk(table["v"].to_pylist(), table["w"].to_pylist())
        k, c = table["class_id"][0].as_py(), table["component"][0].as_py()
        rows = [(k, c, n, at, v) for n, r in enumerate(rings) for at, v in enumerate(r)]
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.table({name: pa.array(col, pa.int64()) for name, col in zip(("class_id", "component", "ring", "at", "vertex_id"), columns, strict=True)})

    walked = grouped.groupBy("class_id", "component").applyInArrow(stitch, "class_id long, component long, ring long, at long, vertex_id long")
    placed = walked.join(vertices.select("vertex_id", "x", "y"), "vertex_id")
    rings = placed.groupBy("class_id", "component", "ring").agg(F.sort_array(F.collect_list(F.struct("at", "x", "y"))).alias("p"))
    return rings.select("class_id", F.xxhash64("class_id", "component", "ring").alias("ring_id"), F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("ring"))


def without_overlap(cells: DataFrame) -> DataFrame:
    """x, y and the polygon that keeps each cell of cells(x, y, polygon_id, area): the smallest, the lowest id on a tie."""
    return cells.groupBy("x", "y").agg(F.min(F.struct("area", "polygon_id"))["polygon_id"].alias("polygon_id"))


def covered_twice(cells: DataFrame) -> DataFrame:
    """Cells that at least two polygons cover: the union of pairwise intersections."""
    return cells.groupBy("x", "y").agg(F.count_distinct("polygon_id").alias("n")).where("n > 1")


