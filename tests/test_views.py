from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from orthoquilt.functions import geometry
from orthoquilt.operators import views


def test_colours(spark):
    px = spark.createDataFrame([(0, 0, 1, 7), (0, 0, 0, 9)], "camera_id long, i int, j int, class_id long")
    palette = spark.range(1).select(F.lit(7).alias("class_id"), views.hex_to_rgb(F.lit("#ff8000")).alias("rgb"))
    out = views.coloured(px, palette).withColumnRenamed("rgb", "label_rgb").withColumn("image_rgb", F.array(*[F.lit(1.0)] * 3))
    by = {r["j"]: r["rgb"] for r in views.composite(out, 2).collect()}
    assert len(by) == 6 and by[1] == pytest.approx([1, 128 / 255, 0]) and by[3] == [1, 1, 1] and by[5][2] == 0.5 and by[0] == [0, 0, 0]


def test_panorama_views(spark):
    """A panorama whose value is its own bearing: a view's centre has the bearing asked for."""
    pano = spark.range(90).select(F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(179))).alias("j"))
    pano = pano.select(F.lit(3).alias("camera_id"), "i", "j", F.lit(0).alias("channel"), (F.col("j") + 0.5).alias("value"))
    got = views.panorama_views(pano, [(0, 0, 0), (90, 0, 0), (-90, 0, 0)], (11, 15), 60.0, (90, 180), 3)
    assert got.count() == 3 * 11 * 15
    centre = {r["view"]: r["value"] for r in got.where("i = 5 and j = 7").collect()}
    assert centre == pytest.approx({0: 90, 1: 135, 2: 45}, abs=0.6)
    assert views.mask_sum(got).agg(F.sum("n")).first()[0] == 3 * 11 * 15


def test_chunks_and_regions(spark):
    faces = spark.createDataFrame([(k, float(k), 0.0) for k in range(30)], "face_id long, x double, y double")
    cams = spark.createDataFrame([(0, 2.0, 0.0), (0, 4.0, 0.0), (1, 25.0, 1.0)], "chunk long, x double, y double")
    got = {(r["chunk"], r["face_id"]) for r in views.mesh_chunks(faces, cams, 3.0).collect()}
    assert got == {(0, k) for k in range(8)} | {(1, k) for k in range(23, 28)}
    region = spark.range(1).select(geometry.box(3.5, -1.0, 6.5, 1.0).alias("geom"))
    points = faces.withColumnRenamed("face_id", "point_id")
    assert {r["point_id"] for r in views.intersecting(points, region, 2.0).collect()} == {4, 5, 6}
    assert views.metric_code(spark.createDataFrame([(5, -120.4, 38.5), (9, 10.0, -10.0)], "point_id long, x double, y double")) == 32610
    a, b = (sorted(r["camera_id"] for r in views.sampled_images(faces.withColumnRenamed("face_id", "camera_id"), 4, 2, s).collect()) for s in (1, 1))
    assert a == b and len(a) == 4 and all(k % 2 == 0 for k in a)
