"""Views of panoramas, composites and colours, samples of images, and parts of a mesh near cameras."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthoquilt.functions import crs
from orthoquilt.operators.predictors import equirectangular_source
from orthoquilt.operators.spatial import points_in_polygons


def hex_to_rgb(colour: Column) -> Column:
    """"#rrggbb" as an array of three numbers from 0 to 1."""
    part = lambda k: F.conv(F.substring(F.ltrim(colour), 2 + 2 * k, 2), 16, 10).cast("double") / 255
    return F.array(*(part(k) for k in range(3)))


def coloured(pixels: DataFrame, palette: DataFrame) -> DataFrame:
    """pixels (class_id) with rgb of palette (class_id, rgb); unknown classes are black."""
    return pixels.join(palette, "class_id", "left").withColumn("rgb", F.coalesce("rgb", F.array(*[F.lit(0.0)] * 3)))


def composite(pixels: DataFrame, width: int, share: float = 0.5) -> DataFrame:
    """Three images side by side of pixels (camera_id, i, j, label_rgb, image_rgb): the label, the image, and a blend."""
    blend = F.zip_with("label_rgb", "image_rgb", lambda a, b: a * share + b * (1 - share))
    three = F.array(*(F.struct(F.lit(k).alias("k"), c.alias("rgb")) for k, c in enumerate((F.col("label_rgb"), F.col("image_rgb"), blend))))
    out = pixels.select("camera_id", "i", "j", F.explode(three).alias("v"))
    return out.select("camera_id", "i", (F.col("j") + F.col("v.k") * width).alias("j"), "v.rgb")


def sampled_images(images: DataFrame, n: int, stride: int = 1, seed: int = 0) -> DataFrame:
    """n images (camera_id) of every stride-th, in an order fixed by the seed."""
    return images.where(F.pmod("camera_id", F.lit(stride)) == 0).orderBy(F.xxhash64(F.lit(seed), "camera_id"), "camera_id").limit(n)


def panorama_views(
    panoramas: DataFrame, orientations: list[tuple[float, float, float]], size: tuple[int, int], fov: float, source: tuple[int, int], oversample: int = 1
) -> DataFrame:
    """camera_id, view, i, j, channel, value: perspective views (yaw, pitch, roll in degrees) of panoramas (camera_id, i, j, channel, value) by
    nearest samples; with oversampling each pixel is the mean of oversample x oversample of them. The aim of a view's pixels is
    the same for all panoramas, so it is a table of the view's size that panoramas are joined to."""
    spark = panoramas.sparkSession
    h, w = size[0] * oversample, size[1] * oversample
    view = spark.createDataFrame([(k, *map(float, o)) for k, o in enumerate(orientations)], "view int, yaw double, pitch double, roll double")
    grid = view.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(h - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(w - 1))))
    at = equirectangular_source(F.col("y"), F.col("x"), (h, w), fov, F.col("yaw"), F.col("pitch"), F.col("roll"), source)
    aimed = grid.select("view", "y", "x", F.explode(F.array(at)).alias("at"))
    aimed = aimed.select("view", F.floor(F.col("y") / oversample).cast("int").alias("to_i"), F.floor(F.col("x") / oversample).cast("int").alias("to_j"), F.round("at.i").cast("int").alias("i"), F.pmod(F.round("at.j").cast("int"), F.lit(source[1])).alias("j"))
    met = panoramas.join(aimed, ["i", "j"])
    return met.groupBy("camera_id", "view", F.col("to_i").alias("i"), F.col("to_j").alias("j"), "channel").agg(F.avg("value").alias("value"))


def mask_sum(samples: DataFrame) -> DataFrame:
    """How often each source pixel (i, j) is sampled over all views."""
    return samples.groupBy("i", "j").agg(F.count("*").alias("n"))


def mesh_chunks(faces: DataFrame, cameras: DataFrame, buffer: float) -> DataFrame:
    """chunk, face_id of faces (face_id, x, y) within the buffer of a camera (x, y) of the chunk, by grid cells of the buffer's side."""
    cell = lambda c: F.floor(F.col(c) / buffer).cast("long")
    near = cameras.select("chunk", F.col("x").alias("u"), F.col("y").alias("v"), F.explode(F.sequence(cell("x") - 1, cell("x") + 1)).alias("cx"), cell("y").alias("c"))
    near = near.select("chunk", "u", "v", "cx", F.explode(F.sequence(F.col("c") - 1, F.col("c") + 1)).alias("cy"))
    dealt = faces.select("face_id", "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    met = dealt.join(near, ["cx", "cy"]).where(F.hypot(F.col("x") - F.col("u"), F.col("y") - F.col("v")) <= buffer)
    return met.select("chunk", "face_id").distinct()


def intersecting(points: DataFrame, region: DataFrame, size: float) -> DataFrame:
    """points (point_id, x, y) that lie in any polygon of the region."""
    held = points_in_polygons(points.select("point_id", "x", "y"), region.select("geom"), size).select("point_id").distinct()
    return points.join(held, "point_id", "left_semi")


def metric_code(points: DataFrame, west: bool = True) -> int:
    """The UTM code for points (point_id, x longitude, y latitude), by the one of the lowest id."""
    return points.select("point_id", crs.utm_code(F.col("y"), F.col("x"), west).alias("code")).agg(F.min_by("code", "point_id")).first()[0]
