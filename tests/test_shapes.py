"""Polygons of any form, distortion maps, textures and raster files."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orthoquilt.functions import distortion, geometry, polygons
from orthoquilt.operators import cameras as cam
from orthoquilt.operators import correspondence, graph, overlay, raster, spatial, textures, warps
from orthoquilt.plans import workflows
from orthoquilt.relations import RINGS
from orthoquilt.sources import rasters, vectors

L = [(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)]
SQUARE = [(0, 0), (4, 0), (4, 4), (0, 4)]


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def inside(polygon, pts):
    odd = np.zeros(len(pts), int)
    for r in polygon:
        for (ax, ay), (bx, by) in zip(r, np.roll(r, -1, axis=0)):
            with np.errstate(all="ignore"):
                odd += ((ay > pts[:, 1]) != (by > pts[:, 1])) & (pts[:, 0] < (bx - ax) * (pts[:, 1] - ay) / (by - ay) + ax)
    return odd % 2 == 1


def test_polygons_equal_points_in_them():
    rng = np.random.default_rng(0)
    pts = rng.uniform(-2, 3, (4000, 2))

    def star(n, centre, radius):
        a = np.sort(rng.uniform(0, 2 * np.pi, n))
        return np.c_[np.cos(a), np.sin(a)] * rng.uniform(0.3, 1, n)[:, None] * radius + centre

    for _ in range(20):
        a, b, c = [star(9, (0, 0), 1.5)], [star(7, (0.5, 0.3), 1.5)], [star(5, (0.2, 0.9), 1), star(3, (0.2, 0.9), 0.2)]
        held = [inside(p, pts) for p in (a, b, c)]
        for keep, want in ((polygons.both, held[0] & held[1] & held[2]), (polygons.either, held[0] | held[1] | held[2]), (polygons.first_only, held[0] & ~held[1] & ~held[2])):
            parts = polygons.trapezoids([a, b, c], keep)
            found = polygons.outline(parts)
            assert sum(polygons.signed_area(r) for p in found for r in p) == pytest.approx(polygons.trapezoid_area(parts), abs=1e-6)
            got = np.any([inside(p, pts) for p in found], axis=0) if found else np.zeros(len(pts), bool)
            assert (got != want).sum() <= 1


def test_overlaps_of_angled_polygons(spark):
    hole = [(1, 1), (3, 1), (3, 3), (1, 3)]
    a = spark.createDataFrame([(1, [ring(SQUARE)]), (2, [ring(SQUARE), ring(hole)])], f"a_id long, a_geom {RINGS}")
    b = spark.createDataFrame([(1, [ring(L)]), (2, [ring([(x + 1, y + 1) for x, y in SQUARE])]), (3, [ring(hole)])], f"b_id long, b_geom {RINGS}")
    got = {(r["a_id"], r["b_id"]): r["area"] for r in overlay.overlap_table(a, b, 1.5).collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {(1, 1): 7.0, (1, 2): 9.0, (1, 3): 4.0, (2, 1): 7.0, (2, 2): 5.0}
    pairs = overlay.overlapping(a, b, 1.5)
    assert pairs.count() == 6
    area = lambda how: {(r["a_id"], r["b_id"]): round(r["s"], 9) for r in overlay.combined_pairs(pairs, "a_geom", "b_geom", how).groupBy("a_id", "b_id").agg(F.sum(geometry.polygon_area(F.col("geom"))).alias("s")).collect()}
    assert area("union") == {(1, 1): 16.0, (1, 2): 23.0, (1, 3): 16.0, (2, 1): 12.0, (2, 2): 23.0, (2, 3): 16.0}
    assert area("difference")[1, 1] == 9.0 and area("difference")[2, 3] == 12.0
    faces = spark.createDataFrame(
        [(1, (0.2, 0.2), (3.0, 0.2), (0.2, 3.0)), (2, (0.2, 0.2), (0.9, 0.2), (0.2, 0.9)), (3, (0.0, 0.0), (1.0, 0.0), (0.0, 1.0)), (4, (2.0, 2.0), (3.0, 2.0), (2.0, 3.0))],
        "face_id long, a struct<x: double, y: double>, b struct<x: double, y: double>, c struct<x: double, y: double>",
    )
    shape = spark.createDataFrame([(7, [ring(L)])], f"polygon_id long, geom {RINGS}")
    assert {r["face_id"] for r in spatial.faces_within(faces, shape, 2.0).collect()} == {2, 3}
    holed = spark.createDataFrame([(7, [ring([(-5, -5), (9, -5), (9, 9), (-5, 9)]), ring([(0.3, 0.3), (0.4, 0.3), (0.4, 0.4)])])], f"polygon_id long, geom {RINGS}")
    assert {r["face_id"] for r in spatial.faces_within(faces, holed, 20.0).collect()} == {4}


def test_unions_and_parts_apart(spark):
    shapes = [(1, ring(SQUARE)), (2, ring(L)), (3, ring([(x + 2, y + 2) for x, y in SQUARE])), (4, ring([(20, 20), (21, 20), (21, 21)]))]
    df = spark.createDataFrame([(k, k % 2, [r]) for k, r in shapes], f"polygon_id long, class_id long, geom {RINGS}")
    for size in (3.0, 100.0):
        area = {r["class_id"]: round(r["s"], 6) for r in overlay.dissolved(df, "class_id", size).groupBy("class_id").agg(F.sum(geometry.polygon_area(F.col("geom"))).alias("s")).collect()}
        assert area == {1: 28.0, 0: 7.5}
        own = {r["polygon_id"]: round(r["s"], 6) for r in overlay.apart(df.select("polygon_id", "geom"), size).groupBy("polygon_id").agg(F.sum(geometry.polygon_area(F.col("geom"))).alias("s")).collect()}
        assert own == {1: 9.0, 2: 7.0, 3: 12.0, 4: 0.5}
    whole = overlay.dissolved(df.where("class_id = 1").select("class_id", "geom"), "class_id", 100.0).collect()
    assert len(whole) == 1 and len(whole[0]["geom"]) == 1 and len(whole[0]["geom"][0]) == 8


def test_nearest_however_far(spark):
    rng = np.random.default_rng(1)
    p, t = rng.normal(size=(60, 3)) * [1, 5, 50], rng.normal(size=(40, 3)) * [1, 5, 50]
    frame = lambda a, k: spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(a)], f"{k} long, x double, y double, z double")
    got = {r["point_id"]: r["target_id"] for r in spatial.nearest(frame(p, "point_id"), frame(t, "target_id"), 0.5).collect()}
    assert got == {i: int(np.linalg.norm(t - v, axis=1).argmin()) for i, v in enumerate(p)}
    assert spatial.nearest(frame(p, "point_id"), frame(t, "target_id").where("false"), 0.5).count() == 0
    own = {r["point_id"]: r["target_id"] for r in spatial.nearest(frame(p, "point_id"), frame(p, "target_id"), 0.5, apart=True).collect()}
    far = np.linalg.norm(p[:, None] - p[None], axis=2) + np.diag([np.inf] * 60)
    assert own == dict(enumerate(far.argmin(1).tolist()))


def test_covers_by_rounds_equal_the_greedy_rule(spark):
    rng = np.random.default_rng(2)
    pairs = {(int(i), int(f)) for i, f in zip(rng.integers(0, 30, 900), rng.integers(0, 200, 900))}
    df = spark.createDataFrame(sorted(pairs), "image_id long, face_id long")
    want, left = [], {i: {f for j, f in pairs if j == i} for i in range(30)}
    while any(left.values()):
        best = max(left, key=lambda i: (len(left[i]), -i))
        want.append((best, len(want), len(left[best])))
        seen = left.pop(best)
        left = {i: f - seen for i, f in left.items()}
    for most in (10, 200, 10**6):
        assert [tuple(r) for r in graph.greedy_cover(df, 1, most).orderBy("rank").collect()] == want


def test_a_face_through_the_camera_is_cut(spark):
    cams = spark.createDataFrame([(0, "a", list(map(float, (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1))), 10.0, 0.0, 0.0, 20, 20)], "camera_id long, image_filename string, cam_to_world array<double>, f double, cx double, cy double, image_width int, image_height int")
    point = lambda v: dict(zip("xyz", map(float, v)))
    kind = "struct<x: double, y: double, z: double>"
    faces = spark.createDataFrame([(1, point((-50, 1, -5)), point((50, 1, -5)), point((0, 1, 40))), (2, point((-90, -90, 500)), point((90, -90, 500)), point((0, 90, 500)))], f"face_id long, a {kind}, b {kind}, c {kind}")
    for reach, want in ((None, {1, 2}), (100.0, {1})):
        obs = correspondence.visible_faces(cams, faces, 1.0, reach, 50.0).collect()
        assert {r["face_id"] for r in obs} == want
        # below the horizon the plane y = 1 is at depth 10 / (i - 9.5)
        assert all(r["i"] >= 10 for r in obs if r["face_id"] == 1)
        assert sum(r["face_id"] == 1 for r in obs) > 150


LENS = "camera_id long, distortion map<string,double>, f double, cx double, cy double, image_width int, image_height int"


def test_distortion_maps(spark):
    cams = spark.createDataFrame([(k, {"k1": -0.05, "p1": 0.001}, 60.0, 1.0, -3.0, 40, 30) for k in range(3)], LENS)
    warp = warps.distortion_map(cams)
    assert warp.count() == 40 * 30 and warp.select("model_key").distinct().count() == 1
    rows = {(r["i"], r["j"]): (r["to_i"], r["to_j"]) for r in warp.collect()}
    u, v = (33 - 20) / 60, (4 - 15) / 60
    r2 = u * u + v * v
    du, dv = u * (1 - 0.05 * r2) + 0.001 * (r2 + 2 * u * u), v * (1 - 0.05 * r2) + 2 * 0.001 * u * v
    assert rows[4, 33] == pytest.approx((15 - 3 + 60 * dv, 20 + 1 + 60 * du))
    back = {(r["i"], r["j"]): (r["to_i"], r["to_j"]) for r in warps.inverse_map(warp, fill=None).collect()}
    size = [F.lit(float(v)) for v in (60, 1, -3, 40, 30)]
    exact = spark.range(40).select(F.col("id").alias("j"), distortion.ideal(F.col("id").cast("double"), F.lit(12.0), F.create_map(F.lit("k1"), F.lit(-0.05), F.lit("p1"), F.lit(0.001)), *size, steps=20).alias("p")).collect()
    near = [(back[12, r["j"]], (r["p"]["y"], r["p"]["x"])) for r in exact if (12, r["j"]) in back]
    assert len(near) > 30 and all(abs(a - c) < 0.01 and abs(b - d) < 0.01 for (a, b), (c, d) in near)
    coarse = warps.inverse_map(warp, 5)
    assert coarse.count() == 1200 and coarse.where("to_i = -1").count() > 0
    key = warp.first()["model_key"]
    assert warps.warp_lookup(spark.createDataFrame([(key, 4, 33, 1), (key, 99, 0, 2)], "model_key string, i int, j int, k int"), warp).collect()[0]["to_j"] == pytest.approx(rows[4, 33][1])
    image = spark.createDataFrame([(9, key, i, j, 2.0 * i + 3.0 * j) for i in range(30) for j in range(40)], "image_id long, model_key string, i int, j int, value double")
    smooth = {(r["i"], r["j"]): r["value"] for r in warps.warped_image(image, warp, 1, -7.0).collect()}
    sharp = {(r["i"], r["j"]): r["value"] for r in warps.warped_image(image, warp, 0, -7.0).collect()}
    i, j = rows[4, 33]
    assert len(smooth) == len(sharp) == 1200 and smooth[4, 33] == pytest.approx(2 * i + 3 * j) and sharp[4, 33] == 2 * round(i) + 3 * round(j)
    out = [k for k, (a, b) in rows.items() if a < -1 or b > 40]
    assert out and all(abs(smooth[k] + 7) < 1e-9 and sharp[k] == -7.0 for k in out)
    half = warps.distortion_map(cams, 0.5)
    assert half.count() == 300 and half.first()["model_key"] != key
    warps.register_model("shifted", lambda x, y, *_: F.struct((x + 1).alias("x"), y.alias("y")))
    assert {r["to_j"] - r["j"] for r in warps.distortion_map(cams, model="shifted").collect()} == {1.0}


def test_textures(spark, tmp_path):
    vertices = spark.createDataFrame([(0, 0.5, 0.5), (1, 2.5, 0.5), (2, 0.5, 2.5), (3, 2.5, 2.5)], "vertex_id long, x double, y double")
    corners = [{"x": x, "y": y} for _, x, y in ((0, 0.5, 0.5), (1, 2.5, 0.5), (2, 0.5, 2.5), (3, 2.5, 2.5))]
    point = "struct<x: double, y: double>"
    faces = spark.createDataFrame([(0, 0, 1, 2, corners[0], corners[1], corners[2]), (1, 1, 3, 2, corners[1], corners[3], corners[2])], f"face_id long, v0 long, v1 long, v2 long, a {point}, b {point}, c {point}")
    table = spark.createDataFrame([(0, 5.0), (1, 5.0), (2, 7.0), (3, 7.0)], "id long, value double")
    of, texture, _ = textures.load_texture(spark, table, faces, vertices)
    assert of == "vertex" and texture.columns == ["vertex_id", "value"]
    own = textures.get_texture(None, texture, faces, "face")
    assert {r["face_id"]: r["value"] for r in own.collect()} == {0: [5.0], 1: [7.0]}
    assert {r["face_id"]: round(r["value"][0], 3) for r in textures.get_texture(None, texture, faces, "face", discrete=False).collect()} == {0: 5.667, 1: 6.333}
    assert {r["vertex_id"]: r["value"] for r in textures.get_texture(own, None, faces, "vertex").collect()} == {0: [5.0], 1: [6.0], 2: [6.0], 3: [7.0]}
    assert textures.get_texture(None, None, faces) is None and textures.get_texture(own, None, faces).count() == 2
    for bad in (lambda: textures.get_texture(own, texture, faces), lambda: textures.get_texture(None, texture, faces, "face", convert=False), lambda: textures.belongs_to(3, 2, 4), lambda: textures.belongs_to(2, 2, 2),
                lambda: textures.standardised(spark.createDataFrame([(1, "x")], "id long, value string"), "id")):
        with pytest.raises(ValueError):
            bad()
    np.save(tmp_path / "t.npy", np.array([[1.0, 1.0, 1.0], [2.0, 2.0, 2.0]]))
    of, texture, _ = textures.load_texture(spark, f"file://{tmp_path}/t.npy", faces, vertices)
    assert of == "face" and {r["face_id"]: r["value"] for r in texture.collect()} == {0: [1.0], 1: [2.0]}
    (tmp_path / "p.geojson").write_text('{"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"kind": "oak"}, "geometry": {"type": "Polygon", "coordinates": [[[0,0],[1.4,0],[1.4,1.4],[0,1.4],[0,0]]]}}]}')
    of, texture, labels = textures.load_texture(spark, f"file://{tmp_path}/p.geojson", faces, vertices, column="kind", background=0)
    assert of == "face" and {r["face_id"]: r["value"] for r in texture.collect()} == {0: [1.0], 1: [None]} and [tuple(r) for r in labels.collect()] == [(1, "oak")]
    (tmp_path / "r.tif").write_bytes(rasters.geotiff_bytes(np.arange(9, dtype=np.float32).reshape(3, 3, 1), [1, 0, 0, 0, -1, 3], 32610, 8))
    of, texture, _ = textures.load_texture(spark, f"file://{tmp_path}/r.tif", faces, vertices)
    assert of == "vertex" and {r["vertex_id"]: r["value"] for r in texture.collect()} == {0: [6.0], 1: [None], 2: [0.0], 3: [2.0]}
    v, f = textures.merged_meshes((vertices, faces), (vertices, faces))
    assert v.count() == 8 and {r["v0"] for r in f.collect()} == {0, 1, 4, 5} and f.agg(F.max("face_id")).first()[0] == 3
    cams = spark.createDataFrame([(2, list(map(float, (1, 0, 0, 5, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1))), 10.0, 20, 10)], "camera_id long, cam_to_world array<double>, f double, image_width int, image_height int")
    v, f = textures.frusta(cams, 2.0)
    assert sorted((r["vertex_id"], r["x"], r["y"], r["z"]) for r in v.collect())[:3] == [(10, 5.0, 0.0, 0.0), (11, 3.0, -1.0, 2.0), (12, 7.0, -1.0, 2.0)] and f.count() == 6


def test_rasters_in_and_out(spark, tmp_path):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 4, (20, 30, 1)).astype(np.uint8)
    (tmp_path / "ortho.tif").write_bytes(rasters.geotiff_bytes(a, [0.5, 0, 100, 0, -0.5, 50], 32610, 255))
    source = f"file://{tmp_path}/ortho.tif"
    info = rasters.raster_info(spark, source).first()
    assert (info["height"], info["width"], info["bands"], info["epsg"], info["nodata"], info["transform"]) == (20, 30, 1, 32610, 255.0, [0.5, 0.0, 100.0, 0.0, -0.5, 50.0])
    cells = {(r["row"], r["col"]): r["value"] for r in rasters.read_geotiff(spark, source).collect()}
    assert cells == {(i, j): float(a[i, j, 0]) for i in range(20) for j in range(30)}
    names = {r["name"] for r in workflows.chip_raster(spark, source, f"file://{tmp_path}/chips", 8, 6).collect()}
    assert names == {p.name for p in (tmp_path / "chips").iterdir()} and "ortho:24:18:8:8.tif" in names
    one = (tmp_path / "chips" / "ortho:24:12:8:8.tif").read_bytes()
    assert rasters.info_of(one)[3] == [0.5, 0.0, 112.0, 0.0, -0.5, 44.0]
    ((_, _, _, block),) = rasters.blocks_of(one)
    assert (block[:, :6, 0] == a[12:20, 24:30, 0]).all() and (block[:, 6:] == 0).all()
    found = {(r["row"], r["col"]): r["class_id"] for r in workflows.assemble_predictions(spark, f"file://{tmp_path}/chips").collect()}
    inner = [(i, j) for i in range(2, 18) for j in range(2, 28)]
    assert all(found[k] == a[k] for k in inner if found[k] != 255) and sum(found[k] != 255 for k in inner) > 300
    shape = spark.createDataFrame([(1, 3, [ring([(100, 48), (102, 48), (102, 50), (100, 50)])])], f"polygon_id long, class_id long, geom {RINGS}")
    named = workflows.chip_raster(spark, source, f"file://{tmp_path}/labels", 8, 8, shape)
    assert [r["name"] for r in named.collect()] == ["ortho:0:0:8:8.tif"]
    ((_, _, _, block),) = rasters.blocks_of((tmp_path / "labels" / "ortho:0:0:8:8.tif").read_bytes())
    assert (block[:4, :4] == 3).all() and block.sum() == 48
    roi = spark.createDataFrame([([ring([(113, 40), (115, 40), (115, 41), (113, 41)])],)], f"geom {RINGS}")
    assert workflows.chip_raster(spark, source, f"file://{tmp_path}/some", 8, 8, roi=roi).count() == 1


def test_resampling_padding_transparency(spark):
    a = np.arange(48, dtype=float).reshape(6, 8)
    cells = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(6) for j in range(8)], "row long, col long, value double")
    got = {(r["row"], r["col"]): r["value"] for r in raster.resampled(cells, 6, 8, 2.0).collect()}

    def tent(n, m):
        w = np.maximum(0, 1 - np.abs((np.arange(n) + 0.5)[None] - (np.arange(m) + 0.5)[:, None] * n / m) / (n / m))
        return w / w.sum(1, keepdims=True)

    want = tent(6, 3) @ a @ tent(8, 4).T
    assert set(got) == {(i, j) for i in range(3) for j in range(4)} and all(math.isclose(v, want[k]) for k, v in got.items())
    tiles = raster.tile_cells(cells, 4, 4)
    assert raster.padded(tiles, 4).count() == 4 * 16
    alpha = cells.select("row", "col", (F.col("col") < 4).cast("int").alias("alpha"))
    clear = raster.without_transparent(tiles, alpha)
    assert {r["col_off"] for r in clear.collect()} == {0}


def test_detections_of_several_files(spark, tmp_path):
    (tmp_path / "b.csv").write_text("image_path,label,box\n" + "".join(f'x{i}.png,l,"[{i}.5, 1.6, 2, 1.6]"\n' for i in range(500)))
    (tmp_path / "a.csv").write_text('image_path,label,box\ny0.png,l,"[-1.5, 0, 1, 2]"\ny1.png,l,"[0, 0, 1, 2]"\n')
    rows = sorted(vectors.read_detections(spark, f"file://{tmp_path}", box="box").collect())
    assert [r["instance_id"] for r in rows] == list(range(502)) and [r["image_path"] for r in rows[:4]] == ["y0.png", "y1.png", "x0.png", "x1.png"]
    assert (rows[0]["jmin"], rows[0]["jmax"]) == (-1.0, 0.0) and (rows[5]["imin"], rows[5]["imax"], rows[5]["jmin"], rows[5]["jmax"]) == (1.0, 3.0, 3.0, 5.0)


def test_stages_go_on_where_they_stopped(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert workflows.staged(spark, f"file://{tmp_path}", "numbers", make).count() == 3
    assert made == [1]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(b"abc")
    workflows.saved_images(spark.createDataFrame([(f"{tmp_path}/in/a.png",)], "image_filename string"), f"file://{tmp_path}/out")
    assert [p.read_bytes() for p in (tmp_path / "out").rglob("a.png")] == [b"abc"]


def test_cameras_on_the_globe(spark):
    pose = lambda x, y, z: [1.0, 0.0, 0.0, float(x), 0.0, -1.0, 0.0, float(y), 0.0, 0.0, -1.0, float(z), 0.0, 0.0, 0.0, 1.0]
    cams = spark.createDataFrame([(1, "a", pose(0, 0, 100), 5.0, None), (2, "b", pose(30, 0, 100), None, None)], "camera_id long, image_filename string, cam_to_world array<double>, lon double, lat double")
    exif = spark.createDataFrame([("a", 7.0, 44.0), ("b", 8.0, 45.0)], "path string, lon double, lat double")
    assert {tuple(r) for r in cam.lon_lat(cams, exif).collect()} == {(1, 5.0, 44.0), (2, -8.0, 45.0)}
    # a local frame at longitude 0, latitude 0: x east, y north, z up
    a = 6378137.0
    local = F.array(*map(F.lit, (0.0, 0.0, 1.0, a, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)))
    got = {r["camera_id"]: r for r in cam.locations(cams, local, 4979).collect()}
    assert abs(got[1]["x"]) < 1e-9 and abs(got[1]["y"]) < 1e-9 and abs(got[1]["z"] - 100) < 1e-3 and abs(got[2]["x"] - math.degrees(30 / (a + 100))) < 1e-9
    for r in cam.local_view_angles(cams, local).collect():
        assert abs(r["across"]) < 1e-3 and abs(r["along"]) < 1e-3
    assert cam.required(cams, exif.withColumnRenamed("path", "image_filename"), "image_filename").count() == 2
    with pytest.raises(ValueError, match="b"):
        cam.required(cams, exif.where("path = 'a'").withColumnRenamed("path", "image_filename"), "image_filename")


def test_confusion_of_layers(spark):
    layer = lambda rows: spark.createDataFrame([(k, n, [ring(r)]) for k, n, r in rows], f"polygon_id long, label string, geom {RINGS}")
    truth = layer([(1, "a", SQUARE), (2, "b", [(x + 10, y) for x, y in SQUARE])])
    found = {(r["true_label"], r["pred_label"]): round(r["amount"], 9) for r in workflows.confusion_of_layers(truth, layer([(1, "a", L), (2, "b", [(9, 0), (12, 0), (12, 4), (9, 4)])]), 3.0).collect()}
    assert found == {("a", "a"): 7.0, ("b", "b"): 8.0, ("a", "unlabelled"): 9.0, ("b", "unlabelled"): 8.0}
    cells = spark.createDataFrame([(i, j, "a" if j < 2 else "b") for i in range(4) for j in range(14)], "row long, col long, label string")
    found = {(r["true_label"], r["pred_label"]): (r["amount"], r["frac"]) for r in workflows.confusion_of_layers(truth, cells, 3.0, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0), True).collect()}
    assert found == {("a", "a"): (8, 0.5), ("a", "b"): (8, 0.5), ("b", "b"): (16, 1.0)}


def test_edges_come_down_to_forests():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 900, 700), rng.integers(0, 900, 700)

    def groups(a, b):
        own = {}
        for x, y in zip(a.tolist(), b.tolist()):
            p, q = own.setdefault(x, {x}), own.setdefault(y, {y})
            if p is not q:
                p |= q
                own.update(dict.fromkeys(q, p))
        return {frozenset(g) for g in own.values()}

    for most in (50, 10**6):
        graph.FOREST_EDGES, was = most, graph.FOREST_EDGES
        try:
            out = pa.Table.from_batches(graph.forests(iter(pa.table({"src": a, "dst": b}).to_batches(max_chunksize=30)))).to_pydict()
        finally:
            graph.FOREST_EDGES = was
        assert groups(np.array(out["src"]), np.array(out["dst"])) == groups(a, b)
        assert most == 50 or len(out["src"]) == len({*a.tolist(), *b.tolist()})
    assert list(graph.forests(iter([]))) == []


def test_components_of_images_and_faces_are_covered_apart(spark, monkeypatch):
    rng = np.random.default_rng(6)
    pairs = {(int(i) + 10 * k, int(f) + 100 * k) for k in range(3) for i, f in zip(rng.integers(0, 10, 150 + 60 * k), rng.integers(0, 60, 150 + 60 * k))}
    df = spark.createDataFrame(sorted(pairs), "image_id long, face_id long")
    want = [tuple(r) for r in graph.greedy_cover(df, 1, 10**6).orderBy("rank").collect()]
    rounds, by_rounds = [], graph.cover_by_rounds
    monkeypatch.setattr(graph, "cover_by_rounds", lambda left, n: rounds.append(left.count()) or by_rounds(left, n))
    sizes = [len({p for p in pairs if p[0] // 10 == k}) for k in range(3)]
    for most in (max(sizes), max(sizes) - 1):
        assert [tuple(r) for r in graph.greedy_cover(df, 1, most).orderBy("rank").collect()] == want
    assert rounds[0] == 0 and 0 < rounds[1] <= max(sizes)


def test_nearest_looks_at_two_targets_of_a_place(spark):
    rows = [(k, float(k % 7), 0.0, 0.0) for k in range(140)]
    frame = lambda k: spark.createDataFrame(rows, f"{k} long, x double, y double, z double")
    for apart in (False, True):
        got = {r["point_id"]: (r["target_id"], r["dist"]) for r in spatial.nearest(frame("point_id"), frame("target_id"), 50.0, apart=apart).collect()}
        assert got == {k: (k % 7 + 7 * (apart and k < 7), 0.0) for k in range(140)}
