"""Predictions per image as pixel rows: pixel(image_filename, i, j, class_id). A segmentor is a function of one image."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthoquilt.functions import geometry
from orthoquilt.operators.cameras import stem

PIXELS = "image_filename string, i int, j int, class_id long"


def segmented(images: DataFrame, make: Callable[[], Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """Pixels of images (image_filename, height, width, channels, data: float array, row after row). `make` builds the segmentor once in
    each task; it maps (h, w, c) to (h, w) of whole numbers, negative for none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = make()
        for batch in batches:
            for row in batch.to_pylist():
                image = np.array(row["data"], float).reshape(row["height"], row["width"], row["channels"])
                classes = np.asarray(segment(image))
                i, j = np.nonzero(classes >= 0)
                name = pa.array([row["image_filename"]] * len(i), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [name, pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(classes[i, j].astype(np.int64))], ["image_filename", "i", "j", "class_id"]
                )

    return images.select("image_filename", "height", "width", "channels", "data").mapInArrow(run, PIXELS)


def brightness(pixels: DataFrame, threshold: float = 0.75**0.5) -> DataFrame:
    """class_id 1 where the norm of the channels (array `values`) is over the threshold, else 0."""
    norm = F.sqrt(F.aggregate("values", F.lit(0.0), lambda s, v: s + v * v))
    return pixels.withColumn("class_id", (norm > threshold).cast("long"))


def image_id(pixels: DataFrame, cameras: DataFrame) -> DataFrame:
    """class_id: the camera's position."""
    return pixels.join(cameras.select("image_filename", F.col("camera_id").alias("class_id")), "image_filename")


def looked_up(cameras: DataFrame, label_pixels: DataFrame) -> DataFrame:
    """Pixels (camera_id, i, j, class_id) of label files that have the camera's relative path without its suffix."""
    key = cameras.select("camera_id", stem(F.col("image_filename")).alias("stem"))
    return label_pixels.withColumn("stem", stem(F.col("label_file"))).join(key, "stem").select("camera_id", "i", "j", "class_id")


def resized(pixels: DataFrame, height: int, width: int, to_height: int, to_width: int) -> DataFrame:
    """Nearest sampling of pixels to another size."""
    rows = lambda n, m: F.sequence(F.ceil(F.col("k") * m / n).cast("int"), F.ceil((F.col("k") + 1) * m / n).cast("int") - 1)
    out = pixels
    for axis, n, m in (("i", height, to_height), ("j", width, to_width)):
        spread = out.withColumn("k", F.col(axis))
        out = spread.where(F.ceil(F.col("k") * m / n) < F.ceil((F.col("k") + 1) * m / n)).withColumn(axis, F.explode(rows(n, m))).drop("k")
    return out


def box_centres(detections: DataFrame) -> DataFrame:
    return detections.withColumn("i", (F.col("imin") + F.col("imax")) / 2).withColumn("j", (F.col("jmin") + F.col("jmax")) / 2)


def region_centres(regions: DataFrame) -> DataFrame:
    """i, j of regions: the outer ring's centroid as (y, x)."""
    c = geometry.centroid(F.get(F.col("geom"), F.lit(0)))
    return regions.select("*", F.explode(F.array(c)).alias("__c")).withColumn("i", F.col("__c.y")).withColumn("j", F.col("__c.x")).drop("__c")


def box_of_text(text: Column) -> Column:
    """The corners of "[j, i, w, h]": sides are added first, then all are cut to whole numbers towards zero."""
    parts = F.transform(F.split(F.regexp_replace(text, r"[\[\]\s]", ""), ","), lambda s: s.cast("double"))
    at = lambda k: F.get(parts, F.lit(k))
    whole = lambda v: v.cast("long").cast("double")
    return F.struct(
        whole(at(1)).alias("imin"), whole(at(0)).alias("jmin"), whole(at(1) + at(3)).alias("imax"), whole(at(0) + at(2)).alias("jmax")
    )


def equirectangular_source(i: Column, j: Column, size: tuple[int, int], fov: float, yaw: Column, pitch: Column, roll: Column, source: tuple[int, int]) -> Column:
    """(i, j) in an equirectangular image (height, width) of pixel (i, j) of a perspective view: clipped rows, wrapped columns."""
    from orthoquilt.functions.linalg import let, roll_pitch_yaw, turn, unit, vec

    h, w = size
    f = w / 2 / float(np.tan(np.radians(fov / 2)))
    ray = unit(vec((j + 0.5 - w / 2) / f, (i + 0.5 - h / 2) / f, 1))

    def place(d: Column) -> Column:
        lon, lat = F.atan2(d["x"], d["z"]), F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), -d["y"])))
        row = (0.5 - lat / np.pi) * source[0] - 0.5
        col = F.pmod((lon / (2 * np.pi) + 0.5) * source[1] - 0.5, F.lit(float(source[1])))
        return F.struct(F.least(F.lit(source[0] - 1.0), F.greatest(F.lit(0.0), row)).alias("i"), col.alias("j"))

    return let(let(ray, lambda r: turn(roll_pitch_yaw(roll, pitch, yaw), r)), place)
