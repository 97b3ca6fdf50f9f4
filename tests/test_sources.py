from __future__ import annotations

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import CAMERA, DOWN, flat_mesh

from orthoquilt.functions import geometry
from orthoquilt.operators import votes
from orthoquilt.plans import workflows
from orthoquilt.sources import cameras, meshes, vectors
from orthoquilt.streaming import votes as stream

XML = """<document><chunk><sensors>
<sensor id="0" label="s"><resolution width="400" height="300"/><calibration class="adjusted"><resolution width="400" height="300"/><f>350.5</f><cx>1.5</cx><cy>-2</cy><k1>0.1</k1><b1>0.01</b1></calibration></sensor>
<sensor id="1" label="t"><resolution width="10" height="10"/></sensor></sensors>
<components><component id="0"><transform><rotation>1 0 0 0 1 0 0 0 1</rotation><translation>1 2 3</translation><scale>2</scale></transform></component></components>
<cameras><group id="0"><camera id="7" sensor_id="0" component_id="0" label="a/x"><transform>1 0 0 5 0 1 0 6 0 0 1 7 0 0 0 1</transform></camera></group>
<camera id="8" sensor_id="0" component_id="0" label="y"/>
<camera id="9" sensor_id="0" component_id="1" label="z"><transform>1 0 0 0 0 1 0 0 0 0 1 0 0 0 0 1</transform></camera>
<camera id="10" sensor_id="1" component_id="0" label="w"><transform>1 0 0 0 0 1 0 0 0 0 1 0 0 0 0 1</transform></camera></cameras></chunk></document>"""


def test_project_file(spark, tmp_path):
    (p := tmp_path / "c.xml").write_text(XML)
    (row,) = cameras.project_cameras(spark, str(p), active="0", folder="img", suffix=".JPG").collect()
    assert row["camera_id"] == 7 and row["image_filename"] == "img/a/x.JPG" and row["cam_to_world"][3::4][:3] == [5, 6, 7]
    assert row["f"] == 350.5 and row["distortion"] == {"k1": 0.1, "b1": 0.01} and row["image_width"] == 400
    assert cameras.project_cameras(spark, str(p), active="0", defaults={"f": 9.0}).count() == 2
    assert cameras.components(spark, str(p)).first()["local_to_ecef"][:4] == [2, 0, 0, 1]
    (m := tmp_path / "m.xml").write_text("<ModelMetadata><SRS>EPSG:32610</SRS><SRSOrigin>1,2.5,-3</SRSOrigin></ModelMetadata>")
    assert cameras.mesh_metadata(spark, str(m)) == ("EPSG:32610", (1.0, 2.5, -3.0))


def test_colmap(spark, tmp_path):
    (a := tmp_path / "cameras.txt").write_text("# list\n1 SIMPLE_RADIAL 400 300 350.5 201 148 0.02\n")
    (b := tmp_path / "images.txt").write_text("# head\n3 1 0 0 0 -5 -6 -7 1 a.jpg\n1.5 2.5 -1 3 4 9\n4 1 0 0 0 0 0 0 1 b 2.jpg\n\n5 1 0 0 0 0 0 1 1 c.jpg\n")
    rows = {r["camera_id"]: r for r in cameras.colmap_cameras(spark, str(a), str(b), "im").collect()}
    assert set(rows) == {3, 5} and rows[3]["cam_to_world"][3::4][:3] == pytest.approx([5, 6, 7])
    assert (rows[3]["cx"], rows[3]["cy"], rows[3]["image_filename"]) == (1, -2, "im/a.jpg")
    (c := tmp_path / "points.txt").write_text("# x\n1 0.5 1.5 2.5 10 20 30 0.1\n")
    assert tuple(cameras.colmap_points(spark, str(c)).first()) == (1, 0.5, 1.5, 2.5, 10, 20, 30)


def test_exif(spark):
    gps = struct.pack("<H", 2) + struct.pack("<HHII", 2, 5, 3, 100) + struct.pack("<HHII", 4, 5, 3, 124)
    data = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHII", 0x8825, 4, 1, 40)
    data = data.ljust(40, b"\0") + gps
    data = data.ljust(100, b"\0") + struct.pack("<6I", 38, 1, 30, 1, 36, 1) + struct.pack("<6I", 120, 1, 6, 1, 0, 1)
    jpeg = b"\xff\xd8\xff\xe1..Exif\0\0" + data
    files = spark.createDataFrame([("a", bytearray(jpeg)), ("b", bytearray(b"nothing")), ("c", bytearray(b"II*\0"))], "path string, content binary")
    got = {r["path"]: (r["lon"], r["lat"]) for r in cameras.exif_positions(files).collect()}
    assert got["a"] == pytest.approx((120.1, 38.51)) and got["b"] == got["c"] == (None, None)


def test_ply(spark, tmp_path):
    v, f, _ = flat_mesh(spark, 4)
    path = str(tmp_path / "m.ply")
    meshes.write_ply(v, f, path)
    v2, f2 = meshes.read_ply(spark, path, (1.0, 0.0, 0.0))
    assert f2.count() == f.count() and v2.agg(F.sum("x")).first()[0] == pytest.approx(v.agg(F.sum("x")).first()[0] + 16)
    assert meshes.mesh_hash(*meshes.read_ply(spark, path)) == meshes.mesh_hash(v.repartition(3), f)
    spark.dataSource.register(meshes.PlySource)
    assert spark.read.format("ply").option("part", "face").load(path).count() == 18
    head = "ply\nformat binary_little_endian 1.0\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    body = b"".join(struct.pack("<fffB", i, i, 0, 9) for i in range(4)) + struct.pack("<B4i", 4, 0, 1, 2, 3)
    assert list(meshes.parse_ply(head.encode() + body, "face")) == [(0, 0, 1, 2), (1, 0, 2, 3)]
    coarse_v, coarse_f = meshes.decimated(v, f, 2.1)
    assert 0 < coarse_v.count() < 16 and coarse_f.count() < 18


def test_vectors(spark, tmp_path):
    square = [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]
    features = [
        {"type": "Feature", "properties": {"name": "a"}, "geometry": {"type": "Polygon", "coordinates": square}},
        {"type": "Feature", "properties": {"name": "b"}, "geometry": {"type": "MultiPolygon", "coordinates": [square, square]}},
        {"type": "Feature", "properties": {"name": "c"}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
    ]
    (p := tmp_path / "x.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    rows = vectors.read_geojson(spark, str(p), "name: string").collect()
    assert [(r["name"], len(r["geom"][0])) for r in rows] == [("a", 5), ("b", 5), ("b", 5), ("c", 1)]
    df = vectors.read_geojson(spark, str(p), "name: string").where("name = 'a'")
    assert df.select(geometry.polygon_area(F.col("geom")).alias("a")).first()["a"] == 4
    vectors.write_geojson(df, str(tmp_path / "out"), ["name"])
    text = spark.read.text(str(tmp_path / "out")).first()[0]
    assert json.loads(text)["properties"] == {"name": "a"}
    (m := tmp_path / "l.json").write_text('{"1": "x", "0": "y"}')
    labels = vectors.read_label_map(spark, str(m))
    assert json.loads(vectors.label_map_json(labels).first()[0]) == {"0": "y", "1": "x"} and vectors.label_map_json(labels.where("false")).count() == 0
    (c := tmp_path / "d.csv").write_text('image_path,label,bbox\na.png,t,"[1, 2, 3, 4]"\nb.png,u,"[0, 0, 1, 1]"\n')
    found = vectors.read_detections(spark, str(c), box="bbox").collect()
    assert [(r["image_path"], r["imin"], r["jmax"]) for r in found] == [("a.png", 2, 4), ("b.png", 0, 1)]
    np.save(tmp_path / "a.npy", np.array([[1.0, np.nan], [3.0, 4.0]]))
    px = vectors.array_pixels(spark.read.format("binaryFile").load(str(tmp_path / "a.npy")))
    assert {(r["i"], r["j"]): r["value"] for r in px.collect()} == {(0, 0): 1, (0, 1): None, (1, 0): 3, (1, 1): 4}
    v = spark.createDataFrame([(-1.0,), (300.0,), (7.9,), (None,), (float("nan"),)], "v double")
    assert [r[0] for r in v.select(vectors.render_value(F.col("v"))).collect()] == [0, 0, 7, 0, 0]


def scene(spark):
    v, f, corner = flat_mesh(spark, 21)
    cams = spark.createDataFrame([(k, f"{k}.png", DOWN(k * 0.3, 0, 2), 100.0, 0.0, 0.0, 200, 200) for k in range(3)], CAMERA)
    polygons = spark.range(2).select(F.col("id").alias("polygon_id"), (F.col("id") + 1).alias("class_id"), F.when(F.col("id") == 0, geometry.box(-2.0, -2.0, 0.0, 2.0)).otherwise(geometry.box(0.0, -2.0, 2.0, 2.0)).alias("geom"))
    return v, f, corner, cams, polygons


def test_there_and_back(spark):
    """Labels of a map rendered to views and aggregated again give the map."""
    v, f, corner, cams, polygons = scene(spark)
    pixels = workflows.render_labels(cams, corner, polygons, 0.5, 3.0, 1.0)
    assert pixels.groupBy("camera_id").count().count() == 3
    found = workflows.aggregate_images(cams, corner, pixels, 0.5, 3.0, 1.0)
    rows = found.join(corner, "face_id").collect()
    assert len(rows) > 700
    for r in rows:
        x = (r["a"]["x"] + r["b"]["x"] + r["c"]["x"]) / 3
        assert r["pred_class"] == (1 if x < 0 else 2) and r["n_votes"] == r["n_views"]
    for clip in (False, True):
        assert {r["polygon_id"]: r["pred_class"] for r in workflows.label_polygons(corner, found, polygons, 1.0, clip).collect()} == {0: 1, 1: 2}
    rings = workflows.export_labels(f, v, found)
    assert {r["class_id"] for r in rings.collect()} == {1, 2}
    cover = workflows.covering_images(pixels.select("camera_id", F.col("class_id").alias("face_id")))
    assert cover.count() == 1
    every = workflows.aggregate_images(cams, corner, pixels, 0.5, 3.0, 1.0, every=2)
    assert every.agg(F.max("n_views")).first()[0] == 2
    heights = corner.select("face_id", F.lit(0.5).alias("height"))
    low = workflows.render_labels(cams, corner, polygons, 0.2, 3.0, 1.0, heights, 1.0, 9)
    assert {r["class_id"] for r in low.select("class_id").distinct().collect()} == {9}


def test_detections_to_places(spark):
    _, _, corner, cams, _ = scene(spark)
    spots = [(0.2, 0.4), (-0.5, -0.6), (0.9, 0.1)]
    found = [(f"{k}.png", 10 * k + n, 100 - 50 * y, 100 + 50 * (x - 0.3 * k)) for k in range(3) for n, (x, y) in enumerate(spots)]
    df = spark.createDataFrame(found, "image_filename string, instance_id long, i double, j double")
    member, places = workflows.multiview_detections(cams, df, 4.0, 0.01)
    rows = places.collect()
    assert len(rows) == 3 and all(r["size"] == 3 for r in rows)
    assert {(round(r["x"], 3), round(r["y"], 3), abs(round(r["z"], 3))) for r in rows} == {(x, y, 0.0) for x, y in spots}
    assert member.count() == 9
    boxes = spark.createDataFrame([("0.png", 5, "tree", 80.0, 80.0, 120.0, 120.0)], "image_path string, instance_id long, label string, imin double, jmin double, imax double, jmax double")
    v, f, *_ = scene(spark)
    seen, rings = workflows.project_detections(cams, corner, v, f, boxes, 0.5, 3.0, 1.0)
    assert seen.count() > 0 and {r["label"] for r in rings.collect()} == {"tree"}
    moved = workflows.in_frame_of(spark.createDataFrame([(1, -120.4, 38.5, 10.0)], "vertex_id long, x double, y double, z double"), 4326, 4978)
    assert moved.first()["x"] < 0


def test_streamed_votes(spark, tmp_path):
    rows = [(c, face, (c + face) % 2) for c in range(6) for face in range(4)]
    schema = "camera_id long, face_id long, class_id long"
    for k in range(3):
        spark.createDataFrame(rows[8 * k : 8 * k + 8], schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    views = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = stream.start(views, "votes_so_far", str(tmp_path / "check"))
    run.processAllAvailable()
    run.stop()
    want = votes.votes(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, spark.table("votes_so_far").collect())) == sorted(map(tuple, want.collect()))
    assert stream.consensus(spark.table("votes_so_far")).count() == 4
