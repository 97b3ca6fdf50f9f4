"""Joins between places: points with polygons, faces with polygons, points with raster cells, points with points.

Polygons meet points by the grid cells that their bounding boxes touch (an equi join that spreads and that adaptive execution can
split), then by an exact test. A polygon of many cells and a cell of many points are both just many rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthoquilt.functions import geometry
from orthoquilt.relations import checkpointed


#: Targets of a cell that `nearest` begins with, if they are spread evenly.
IN_A_CELL = 0.5


def bounds(rings: Column, k: str) -> tuple[Column, Column]:
    values = F.transform(F.flatten(rings), lambda p: p[k])
    return F.array_min(values), F.array_max(values)


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("long")


def in_cells(polygons: DataFrame, size: float, geom: str = "geom", buffer: float = 0.0) -> DataFrame:
    """polygons with a row for each grid cell that the (buffered) bounding box touches."""
    (x0, x1), (y0, y1) = bounds(F.col(geom), "x"), bounds(F.col(geom), "y")
    out = polygons.withColumn("cell_x", F.explode(F.sequence(_cell(x0 - buffer, size), _cell(x1 + buffer, size))))
    return out.withColumn("cell_y", F.explode(F.sequence(_cell(y0 - buffer, size), _cell(y1 + buffer, size))))


def points_in_polygons(points: DataFrame, polygons: DataFrame, size: float, buffer: float = 0.0) -> DataFrame:
    """Every pair of a point (x, y) and a polygon (geom) that holds it strictly, with the columns of both."""
    dealt = points.withColumn("cell_x", _cell(F.col("x"), size)).withColumn("cell_y", _cell(F.col("y"), size))
    pairs = dealt.join(in_cells(polygons, size, buffer=buffer), ["cell_x", "cell_y"])
    return pairs.where(geometry.within(F.col("x"), F.col("y"), F.col("geom"), buffer)).drop("cell_x", "cell_y")


def values_from_polygons(points: DataFrame, polygons: DataFrame, key: str, value: str, order: str, size: float, missing: Column | None = None) -> DataFrame:
    """key and value of the last polygon (by `order`) that holds the point; `missing`, or null, where none does."""
    held = points_in_polygons(points.select(key, "x", "y"), polygons.select(order, value, "geom"), size)
    last = held.groupBy(key).agg(F.max(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))["v"].alias(value))
    out = points.select(key).join(last, key, "left")
    return out if missing is None else out.withColumn(value, F.coalesce(value, missing))


def faces_within(faces: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """Pairs of a face (a, b, c points) and a polygon that holds it wholly (its border included), convex or not, with or without holes."""
    mid = faces.withColumn("x", (F.col("a.x") + F.col("b.x") + F.col("c.x")) / 3).withColumn("y", (F.col("a.y") + F.col("b.y") + F.col("c.y")) / 3)
    return points_in_polygons(mid, polygons, size).where(geometry.covers_triangle(F.col("geom"), F.col("a"), F.col("b"), F.col("c")))


def region_crop(vertices: DataFrame, faces: DataFrame, region: DataFrame, size: float, buffer: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(faces, vertices) that stay: faces with a corner in the region, and all of their corners; ids as they were."""
    held = points_in_polygons(vertices.select("vertex_id", "x", "y"), region.select("geom"), size, buffer).select("vertex_id").distinct()
    long = faces.select("face_id", F.explode(F.array("v0", "v1", "v2")).alias("vertex_id"))
    kept = faces.join(long.join(held, "vertex_id", "left_semi").select("face_id").distinct(), "face_id", "left_semi")
    corners = kept.select(F.explode(F.array("v0", "v1", "v2")).alias("vertex_id")).distinct()
    return kept, vertices.join(corners, "vertex_id", "left_semi")


def polygon_labels(pairs: DataFrame, polygons: DataFrame, labels: DataFrame | None = None, unknown: str = "unknown") -> DataFrame:
    """polygon_id, pred_class (and its name) of the class that weighs most in pairs (polygon_id, class_id, weight): lowest class on a
    tie, null where no weight is."""
    summed = pairs.where("class_id is not null").groupBy("polygon_id", "class_id").agg(F.round(F.sum("weight"), 6).alias("w"))
    best = summed.groupBy("polygon_id").agg(F.max(F.struct("w", (-F.col("class_id")).alias("c"))).alias("b"))
    out = polygons.select("polygon_id").join(best, "polygon_id", "left").select("polygon_id", F.when(F.col("b.w") > 0, -F.col("b.c")).alias("pred_class"))
    if labels is None:
        return out
    named = labels.select(F.col("class_id").alias("pred_class"), "name")
    return out.join(named, "pred_class", "left").select("polygon_id", "pred_class", F.coalesce("name", F.lit(unknown)).alias("name"))


def face_weight(a: Column, b: Column, c: Column, weight: Column) -> Column:
    """Area seen from above x (true area by it) x weight: what a wholly contained face brings; null without area from above."""
    flat = geometry.area_2d(a, b, c)
    return flat * F.try_divide(geometry.area_3d(a, b, c), flat) * weight


def ground_weight(weight: Column, ground: Column) -> Column:
    return 1 - (1 - weight) * ground


def raster_values(points: DataFrame, cells: DataFrame, transform: tuple[float, ...], nodata: float | None = None, value: str = "value") -> DataFrame:
    """points with the value of the raster cell (row, col) they lie in; null outside and for nodata. transform: (a, b, c, d, e, f) with
    x = a col + b row + c and y = d col + e row + f."""
    a, b, c, d, e, f = transform
    det = a * e - b * d
    x, y = F.col("x") - c, F.col("y") - f
    dealt = points.withColumn("col", F.floor((e * x - b * y) / det).cast("long")).withColumn("row", F.floor((a * y - d * x) / det).cast("long"))
    v = F.col("value").cast("double")
    side = cells.select("row", "col", (v if nodata is None else F.when(v != nodata, v)).alias(value))
    return dealt.join(side, ["row", "col"], "left").drop("row", "col")


def height_above(points: DataFrame, cells: DataFrame, transform: tuple[float, ...], nodata: float | None = None) -> DataFrame:
    """points with height: z less the terrain below (null where that is unknown)."""
    return raster_values(points, cells, transform, nodata, "__ground").withColumn("height", F.col("z") - F.col("__ground")).drop("__ground")


def is_ground(height: Column, threshold: float) -> Column:
    """Strictly below the threshold; unknown heights are not ground."""
    return F.coalesce(height < threshold, F.lit(False))


def height_class(height: Column, cut: float) -> Column:
    """0 unknown, 1 up to the cut, 2 above."""
    return F.when(height.isNull(), 0).when(height <= cut, 1).otherwise(2)


def with_ground(values: DataFrame, heights: DataFrame, threshold: float, ground_class: int, only_existing: bool = False) -> DataFrame:
    """values (face_id, class_id) with the class of low faces replaced; `only_existing` leaves null classes alone."""
    low = is_ground(F.col("height"), threshold)
    if only_existing:
        low = low & F.col("class_id").isNotNull()
    joined = values.join(heights.select("face_id", "height"), "face_id", "left")
    return joined.select("face_id", F.when(low, F.lit(ground_class)).otherwise(F.col("class_id")).alias("class_id"))


def nearest(points: DataFrame, targets: DataFrame, radius: float, axes: tuple[str, ...] = ("x", "y", "z"), limit: float | None = None, apart: bool = False) -> DataFrame:
    """point_id, target_id and dist of each point's nearest target (lowest id on a tie), by default however far it is; `apart` leaves out the target
    of the point's own id. Targets are looked for in the neighbouring cells of a grid of side `radius`, which is exact up to that distance; points
    that found none there go on with a doubled radius, until all have one, or up to `limit`. The first side is less where targets are dense, so that a cell
    holds a few if they are spread evenly; of targets at the same place the two lowest ids are looked at, as no other can be the answer."""
    square = sum(((F.col(k) - F.col(f"t_{k}")) * (F.col(k) - F.col(f"t_{k}")) for k in axes), F.lit(0.0))
    cells = [f"__c{k}" for k in range(len(axes))]
    left = points.select("point_id", *axes).where(" and ".join(f"{k} is not null" for k in axes))
    side = targets.select("target_id", *(F.col(k).alias(f"t_{k}") for k in axes)).where(" and ".join(f"t_{k} is not null" for k in axes))
    place = side.groupBy(*(f"t_{k}" for k in axes))
    if apart:  # the lowest id may be the point's own
        lowest = place.agg(F.min("target_id").alias("__a"))
        met = side.join(lowest, [f"t_{k}" for k in axes])
        second = met.where("target_id > __a").groupBy(*(f"t_{k}" for k in axes)).agg(F.min("target_id").alias("target_id"))
        side = lowest.withColumnRenamed("__a", "target_id").unionByName(second)
    else:
        side = place.agg(F.min("target_id").alias("target_id"))
    side = checkpointed(side.select("target_id", *(f"t_{k}" for k in axes)))
    span = side.agg(*(f(f"t_{k}") for k in axes for f in (F.min, F.max))).unionAll(left.agg(*(f(k) for k in axes for f in (F.min, F.max)))).collect()  # two rows
    found = []
    if span[0][0] is not None and span[1][0] is not None:
        most = max(max(r[2 * k + 1] for r in span) - min(r[2 * k] for r in span) for k in range(len(axes))) * len(axes) ** 0.5
        most = max(most, radius) if limit is None else limit
        widths = [span[0][2 * k + 1] - span[0][2 * k] for k in range(len(axes))]
        radius = max(min(radius, (math.prod(w or radius for w in widths) * IN_A_CELL / side.count()) ** (1 / len(axes))), most * 1e-6)
        while True:
            reach = min(radius, most)
            a, b = left, side
            for k, c in zip(axes, cells, strict=True):
                a = a.withColumn(c, F.explode(F.sequence(_cell(F.col(k), reach) - 1, _cell(F.col(k), reach) + 1)))
                b = b.withColumn(c, _cell(F.col(f"t_{k}"), reach))
            met = a.join(b, cells).select("point_id", "target_id", F.round(F.sqrt(square), 9).alias("dist"))
            # distances are rounded: one that is just beyond the cells could tie with one within
            met = met.where(F.col("dist") <= (reach if reach >= most else reach - 1e-9))
            if apart:
                met = met.where("point_id <> target_id")
            best = met.groupBy("point_id").agg(F.min(F.struct("dist", "target_id")).alias("m")).select("point_id", "m.target_id", "m.dist")
            if reach >= most:
                found.append(best)
                break
            best = checkpointed(best)
            found.append(best)
            left = checkpointed(left.join(best, "point_id", "left_anti"))
            if not left.take(1):
                break
            radius *= 2
    return reduce(DataFrame.union, found) if found else points.select("point_id", F.lit(None).cast("long").alias("target_id"), F.lit(None).cast("double").alias("dist")).where("false")
