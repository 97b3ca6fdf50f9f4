from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orthoquilt.functions import geometry
from orthoquilt.functions.linalg import sub, unit, vec
from orthoquilt.operators import cameras as cam
from orthoquilt.operators import correspondence, graph, metrics, overlay, predictors, raster, rays, spatial, votes

DOWN = lambda x, y, z: [1.0, 0.0, 0.0, float(x), 0.0, -1.0, 0.0, float(y), 0.0, 0.0, -1.0, float(z), 0.0, 0.0, 0.0, 1.0]
CAMERA = "camera_id long, image_filename string, cam_to_world array<double>, f double, cx double, cy double, image_width int, image_height int"


def segments(spark, rows):
    """rows: (ray_id, camera_id, start, end)"""
    flat = [(i, c, *map(float, s), *map(float, e)) for i, c, s, e in rows]
    df = spark.createDataFrame(flat, "ray_id long, camera_id long, ax double, ay double, az double, bx double, by double, bz double")
    v = lambda k: vec(*(F.col(k + c) for c in "xyz"))
    return df.select("ray_id", "camera_id", v("a").alias("start"), v("b").alias("end")).withColumn("direction", unit(sub(F.col("end"), F.col("start"))))


def test_votes_follow_the_rules(spark):
    counted = spark.createDataFrame([(1, 0, 2.0), (1, 1, 2.0), (2, 0, 0.0), (3, 0, float("nan")), (3, 1, 4.0), (4, 2, 1.0)], "face_id long, class_id long, n double")
    got = {r["face_id"]: r["pred_class"] for r in votes.argmax_class(counted).collect()}
    assert got == {1: 0, 2: None, 3: None, 4: 2}
    face = spark.createDataFrame([(0, 0, 1, 2), (1, 1, 2, 3)], "face_id long, v0 long, v1 long, v2 long")
    vertex = spark.createDataFrame([(0, 5, 1.0), (1, 5, 2.0), (2, 7, 3.0), (3, 7, 7.0)], "vertex_id long, class_id long, value double")
    assert {r["face_id"]: r["class_id"] for r in votes.vertex_to_face(face, vertex).collect()} == {0: 5, 1: 7}
    assert {r["face_id"]: r["value"] for r in votes.vertex_to_face(face, vertex, False).collect()} == {0: 2.0, 1: 4.0}
    labels = votes.label_ids(spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "t string"), "t")
    assert sorted(map(tuple, labels.collect())) == [(1, "a"), (2, "b")]
    assert sorted(map(tuple, votes.add_label(labels, "GROUND").collect())) == [(1, "a"), (2, "b"), (3, "GROUND")]
    assert votes.add_label(labels, "a").count() == 2
    with pytest.raises(ValueError):
        votes.remap(labels, "name", labels.union(labels))
    assert votes.is_discrete(vertex, "value") and not votes.is_discrete(vertex.selectExpr("value + 0.5 as v"), "v")


def test_metrics_of_an_empty_class(spark):
    cf = spark.createDataFrame([("a", "a", 3), ("a", "b", 1), ("c", "a", 2)], "true_label string, pred_label string, amount long")
    rows = {r["label"]: r for r in metrics.per_class(cf).collect()}
    assert rows["a"]["recall"] == 0.75 and rows["a"]["precision"] == 0.6 and rows["b"]["recall"] is None and rows["c"]["precision"] == 0
    assert metrics.accuracy(cf).first()[0] == 0.5
    assert metrics.class_means(metrics.per_class(cf)).first()["mean_recall"] == 0.375
    assert metrics.confusion(spark.createDataFrame([("a", "z"), ("a", "a"), (None, "a")], "t string, p string"), "t", "p", "gt").count() == 1


def test_cast_rays_of_the_five_cameras(spark):
    cams = spark.createDataFrame([(k, f"{k}.png", DOWN(0, 0, 10), 1000.0, -400.0 + 400, -400.0 + 400, 800, 800) for k in range(5)], CAMERA)
    points = [(f"{c}.png", 4 * c + n, i, j) for c in range(5) for n, (i, j) in enumerate(((0.0, 0.0), (100.0, 100.0), (300.0, 300.0), (400.0, 400.0)))]
    found = spark.createDataFrame(points, "image_filename string, instance_id long, i double, j double")
    for length in (100.0, 200.0):
        got = cam.detection_rays(cams, found, length).collect()
        assert len(got) == 20
        for r in got:
            s, e = r["start"], r["end"]
            assert (s["x"], s["y"], s["z"]) == (0, 0, 10)
            assert math.dist(s, e) == pytest.approx(length)
            if r["ray_id"] % 4 == 3:
                assert tuple(e) == pytest.approx((0, 0, 10 - length))
    assert cam.detection_rays(cams, found, 100.0, 15.0).count() == 10
    assert cam.detection_rays(cams, found.where("false"), 100.0).count() == 0


def test_paths(spark):
    df = spark.createDataFrame([("a/b/c.tif",), ("a/b/d/e.tif",)], "image_filename string")
    assert cam.common_root(df) == "a/b" and cam.common_root(df.where("false")) == ""
    assert {r[0] for r in df.select(cam.with_suffix(cam.rebased(F.col("image_filename"), "a", "z"), ".png")).collect()} == {"z/b/c.png", "z/b/d/e.png"}
    with pytest.raises(Exception, match="is not in"):
        df.select(cam.rebased(F.col("image_filename"), "q", "z")).collect()
    ids = cam.dense_ids(spark.range(1000).select((F.col("id") * 37 % 1000).alias("k")), "at", "k").collect()
    assert all(r["k"] == r["at"] for r in ids)


def surfaces(spark):
    square = lambda s, z: [(s, 2 * s, (0, 0, z), (1, 0, z), (0, 1, z)), (s, 2 * s + 1, (1, 0, z), (1, 1, z), (0, 1, z))]
    rows = [(s, f, *map(float, (*a, *b, *c))) for s, f, a, b, c in square(0, 1) + square(1, 0)]
    names = ", ".join(f"{p}{k} double" for p in "abc" for k in "xyz")
    df = spark.createDataFrame(rows, f"surface_id int, face_id long, {names}")
    return df.select("surface_id", "face_id", *(vec(*(F.col(p + k) for k in "xyz")).alias(p) for p in "abc"))


def test_clip_to_surfaces(spark):
    ray = segments(spark, [(0, 9, (0.5, 0.5, 2), (0.5, 0.5, -2)), (1, 8, (0.1, 0.3, -1), (0.1, 0.3, 3)), (2, 7, (5, 5, 2), (5, 5, -2)), (3, 7, (0.2, 0.2, 2), (0.2, 0.2, 3))])
    got = {r["ray_id"]: r for r in rays.clip_to_surfaces(ray, surfaces(spark), 1.0).collect()}
    assert set(got) == {0, 1}
    for r in got.values():
        assert r["start"]["z"] == 1 and r["end"]["z"] == 0 and tuple(r["direction"]) == (0, 0, -1)
    assert rays.clip_to_surfaces(ray, surfaces(spark), 1.0, 0.5).count() == 0
    assert rays.clip_to_surfaces(ray.where("false"), surfaces(spark), 1.0).count() == 0


def test_average_and_least_squares_points(spark):
    groups = {0: [((-1, 0, 0), (1, 0, 0)), ((0, -1, 0), (0, 1, 0)), ((0, 0, -1), (0, 0, 1))], 1: [((0, 0, 0), (5, 0, 0)), ((0, 1, 0), (5, 1, 0))], 2: [((0, 0, 0), (1, 0, 0))]}
    flat = [(g * 10 + n, n, s, e) for g, own in groups.items() for n, (s, e) in enumerate(own)]
    df = segments(spark, flat).withColumn("g", F.floor(F.col("ray_id") / 10))
    got = {r["g"]: (r["x"], r["y"], r["z"]) for r in rays.average_point(df, "g").collect()}
    assert set(got) == {0, 1} and got[0] == pytest.approx((0, 0, 0)) and got[1][1:] == pytest.approx((0.5, 0))
    lsq = {r["g"]: (r["x"], r["y"], r["z"]) for r in rays.least_squares_point(df, "g").collect()}
    assert lsq[0] == pytest.approx((0, 0, 0)) and lsq[1] == (None, None, None)


def test_edges_against_all_pairs(spark):
    r = random.Random(4)
    flat = [(i, i % 7, [r.uniform(0, 30) for _ in range(3)], [r.uniform(0, 30) for _ in range(3)]) for i in range(80)]
    df = segments(spark, flat)
    own = df.select(F.col("ray_id").alias("src"), F.col("camera_id").alias("c"), F.col("start").alias("s"), F.col("end").alias("e"))
    other = df.select(F.col("ray_id").alias("dst"), F.col("camera_id").alias("d"), F.col("start").alias("t"), F.col("end").alias("u"))
    every = own.join(other, F.expr("src < dst and c <> d")).withColumn("dist", geometry.closest_points(F.col("s"), F.col("e"), F.col("t"), F.col("u"))["dist"])
    want = {(r["src"], r["dst"]): round(r["dist"], 9) for r in every.where("dist <= 1.5").select("src", "dst", "dist").collect()}
    for cell in (None, 0.5, 11.0):
        got = {(r["src"], r["dst"]): round(r["dist"], 9) for r in rays.edges(df, 1.5, 0.0, cell=cell).collect()}
        assert got == want and want
    squared = {(r["src"], r["dst"]): r["weight"] for r in rays.edges(df, 1.5, 0.2, lambda d: d * d).collect()}
    assert all(squared[k] == pytest.approx(1 / max(d, 0.2) ** 2) for k, d in want.items())


def test_communities(spark):
    edge = spark.createDataFrame([(0, 1, 1.0), (0, 2, 1.0), (3, 4, 1.0), (3, 5, 1.0), (6, 7, 1.0)], "src long, dst long, weight double")
    got = {r["node"]: r["community"] for r in graph.communities(edge).collect()}
    assert [got[k] for k in range(8)] == [0, 0, 0, 1, 1, 1, 2, 2]
    assert graph.communities(edge.where("false")).count() == 0
    # two cliques with a bridge fall apart though they are connected
    cliques = [(a + o, b + o, 1.0) for o in (0, 10) for a, b in itertools.combinations(range(5), 2)] + [(4, 10, 0.1)]
    two = {r["node"]: r["community"] for r in graph.communities(spark.createDataFrame(cliques, "src long, dst long, weight double")).collect()}
    assert len({two[k] for k in range(5)}) == 1 and len({two[k] for k in range(10, 15)}) == 1 and two[0] != two[10]
    path = spark.createDataFrame([(i, i + 1) for i in range(60)], "src long, dst long")
    assert {r["component"] for r in graph.components(path).collect()} == {0}


def test_communities_of_a_component_over_the_task_limit(spark):
    """Cliques in a ring, over the limit for one task: joins alone find the same cliques."""
    edge = [(10 * c + a, 10 * c + b, 1.0) for c in range(12) for a, b in itertools.combinations(range(8), 2)]
    edge += [(10 * c, 10 * ((c + 1) % 12) + 1, 0.1) for c in range(12)]
    df = spark.createDataFrame(edge, "src long, dst long, weight double")
    for limit in (100, 1):
        got = {r["node"]: r["community"] for r in graph.communities(df, task_edges=limit).collect()}
        assert len(got) == 96
        assert all(len({got[10 * c + a] for a in range(8)}) == 1 for c in range(12))
        assert len(set(got.values())) > 3


def test_graph_queries_take_all_links(spark, sf):
    from orthoquilt.queries import QUERIES

    pairs = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_partkey").distinct().collect()
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in ((r[0], r[1] + 1_000_000) for r in pairs):
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {x: find(x) for x in root}
    assert {r["node"]: r["component"] for r in QUERIES["connected_rays"](spark, sf).collect()} == want
    assert {r["node"] for r in QUERIES["communities"](spark, sf).collect()} == set(want)


def test_greedy_cover(spark):
    sees = [(1, f) for f in range(6)] + [(2, f) for f in range(4, 9)] + [(3, f) for f in (0, 8, 9)] + [(4, 99)]
    df = spark.createDataFrame(sees, "image_id long, face_id long")
    got = [tuple(r) for r in graph.greedy_cover(df).orderBy("rank").collect()]
    assert got == [(1, 0, 6), (2, 1, 3), (3, 2, 1), (4, 3, 1)]
    assert {r["image_id"] for r in graph.greedy_cover(df, 2).collect()} == {1, 2}
    assert graph.greedy_cover(df.where("false")).count() == 0


def flat_mesh(spark, n=41, side=4.0):
    step = side / (n - 1)
    vertices = [(i * n + j, j * step - side / 2, i * step - side / 2, 0.0) for i in range(n) for j in range(n)]
    faces, at = [], 0
    for i in range(n - 1):
        for j in range(n - 1):
            a = i * n + j
            faces += [(at, a, a + 1, a + n), (at + 1, a + 1, a + n + 1, a + n)]
            at += 2
    v = spark.createDataFrame(vertices, "vertex_id long, x double, y double, z double")
    f = spark.createDataFrame(faces, "face_id long, v0 long, v1 long, v2 long")
    corner = f
    for name, k in zip(("v0", "v1", "v2"), "abc"):
        corner = corner.join(v.select(F.col("vertex_id").alias(name), vec(F.col("x"), F.col("y"), F.col("z")).alias(k)), name)
    return v, f, corner


def test_flat_mesh_under_a_nadir_camera(spark):
    """Every pixel sees the face that its centre's ray meets."""
    _, _, corner = flat_mesh(spark)
    cams = spark.createDataFrame([(0, "a.png", DOWN(0, 0, 2), 100.0, 0.0, 0.0, 200, 200)], CAMERA).withColumn("distortion", F.expr("map('k1', -0.05D)"))
    obs = correspondence.visible_faces(cams, corner, 0.5, 3.0, 0.5)
    got = {(r["i"], r["j"]): r["face_id"] for r in obs.collect()}
    assert len(got) == 100 * 100
    step = 4.0 / 40
    for (i, j), face in got.items():
        x, y = (j + 0.5 - 50) / 50 * 2, -(i + 0.5 - 50) / 50 * 2
        u, v = (x + 2) / step, (y + 2) / step
        a, b = int(u), int(v)
        if min(abs(u - round(u)), abs(v - round(v)), abs(u - a + v - b - 1)) > 1e-6:
            assert face == 2 * (b * 40 + a) + int(u - a + v - b > 1)
    lens = correspondence.through_lens(obs, cams, 0.5).collect()
    seen = {(r["i"], r["j"]) for r in lens}
    assert not {(0, 0), (0, 99), (99, 0), (99, 99)} & seen and (50, 50) in seen
    # a second layer above hides the first
    top = corner.select((F.col("face_id") + 10_000).alias("face_id"), *(vec(F.col(f"{k}.x") / 10, F.col(f"{k}.y") / 10, F.lit(1.0)).alias(k) for k in "abc"))
    both = correspondence.visible_faces(cams, corner.unionByName(top, allowMissingColumns=True), 0.5, 3.0, 0.5)
    hidden = both.where("face_id >= 10000").count()
    assert hidden == 20 * 20 and both.count() == 10_000


def test_last_pixel_wins(spark):
    obs = spark.createDataFrame([(0, 0, 0, 5), (0, 0, 1, 5), (0, 1, 0, 6)], "camera_id long, i int, j int, face_id long")
    pixels = spark.createDataFrame([(0, 0, 0, 1), (0, 0, 1, 2), (0, 1, 0, 3), (0, 9, 9, 4)], "camera_id long, i int, j int, class_id long")
    assert sorted(map(tuple, correspondence.projected(obs, pixels).collect())) == [(0, 5, 2), (0, 6, 3)]


def ring(*pts):
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in pts))


def test_region_masks(spark):
    """A square of ten units covers 11 x 11 pixels, its border included."""
    df = spark.range(1).select(F.lit("a.png").alias("image_path"), F.lit("PEAR").alias("label"), F.array(ring((10, 20), (20, 20), (20, 30), (10, 30))).alias("geom"))
    mask = raster.polygon_mask(df)
    assert mask.count() == 121
    centre = predictors.region_centres(df).first()
    assert (centre["i"], centre["j"]) == (25, 15)
    boxes = spark.createDataFrame([(0, "a", "x", 0.0, 0.0, 4.0, 4.0), (1, "a", "y", 2.0, 2.0, 6.0, 6.0)], "instance_id long, image_path string, label string, imin double, jmin double, imax double, jmax double")
    counts = {r["label"]: r["count"] for r in raster.rectangle_mask(boxes).groupBy("label").count().collect()}
    assert counts == {"x": 12, "y": 16}
    b = spark.range(1).select(predictors.box_of_text(F.lit("[3.7, 2, 10, 5]")).alias("b")).first()["b"]
    assert tuple(b) == (2, 3, 7, 13)


def test_overlays(spark):
    concave = ring((0, 0), (4, 0), (4, 4), (2, 1), (0, 4))
    a = spark.range(1).select(F.lit(1).alias("a_id"), F.array(concave).alias("a_geom"))
    b = spark.range(1).select(F.lit(2).alias("b_id"), geometry.box(-1.0, -1.0, 9.0, 9.0).alias("b_geom"))
    whole = spark.range(1).select(geometry.polygon_area(F.array(concave)).alias("w")).first()["w"]
    assert overlay.overlap_table(a, b, 3.0).first()["area"] == pytest.approx(whole)
    half = b.withColumn("b_geom", geometry.box(-1.0, -1.0, 2.0, 9.0))
    assert overlay.overlap_table(a, half, 3.0).first()["area"] == pytest.approx(whole / 2)
    assert overlay.overlap_table(a, b.withColumn("b_geom", geometry.box(4.0, 0.0, 9.0, 9.0)), 3.0).count() == 0
    v, f, corner = flat_mesh(spark, 9)
    inner = corner.withColumn("class_id", F.when((F.col("a.x").between(-1, 0.5)) & (F.col("a.y").between(-1, 0.5)), 1).otherwise(0))
    rings = overlay.outlines(overlay.boundary_edges(inner), v).withColumn("area", F.abs(geometry.signed_area(F.col("ring"))))
    total = {r["class_id"]: r["s"] for r in rings.groupBy("class_id").agg(F.max("area").alias("s")).collect()}
    held = inner.groupBy("class_id").agg(F.sum(geometry.area_2d(F.col("a"), F.col("b"), F.col("c"))).alias("s"))
    assert total[0] == pytest.approx(16) and total[1] == pytest.approx({r["class_id"]: r["s"] for r in held.collect()}[1])
    share = overlay.face_shares(corner, spark.range(1).select(F.lit(3).alias("polygon_id"), geometry.box(-0.3, -0.7, 1.1, 0.9).alias("geom")), 1.0)
    area = share.join(corner, "face_id").agg(F.sum(F.col("share") * geometry.area_2d(F.col("a"), F.col("b"), F.col("c")))).first()[0]
    assert area == pytest.approx(1.4 * 1.6)
    assert overlay.walk([0, 1, 2, 2, 3, 4], [1, 2, 0, 3, 4, 2]) == [[0, 1, 2], [2, 3, 4]]


def test_nearest_and_surfaces(spark):
    rng = np.random.default_rng(2)
    p, t = rng.uniform(0, 3, (60, 3)), rng.uniform(0, 3, (80, 3))
    df = lambda a, name: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(a)], f"{name} long, x double, y double, z double")
    got = {r["point_id"]: r["target_id"] for r in spatial.nearest(df(p, "point_id"), df(t, "target_id"), 0.8, limit=0.8).collect()}
    d = np.sqrt(((p[:, None] - t[None]) ** 2).sum(-1))
    assert got == {i: int(d[i].argmin()) for i in range(60) if d[i].min() <= 0.8}
    grid = spark.createDataFrame([(i, (i % 10) / 9, i // 10 / 9, float(rng.normal())) for i in range(100)], "vertex_id long, x double, y double, z double")
    s = rays.covering_surfaces(grid, 3, (0.5, -0.5))
    assert s.count() == 18 and rays.grid_triangles(s).count() == 2 * 2 * 4
    z = grid.agg(F.max("z"), F.min("z")).first()
    e = s.groupBy("surface_id").agg(F.max("z").alias("hi"), F.min("z").alias("lo")).orderBy("surface_id").collect()
    assert e[0]["hi"] == pytest.approx(z[0] + 0.5) and e[1]["lo"] == pytest.approx(z[1] - 0.5)
    assert rays.covering_surfaces(grid.where("false"), 3).count() == 0
    with pytest.raises(ValueError):
        rays.covering_surfaces(grid, 1)


def test_equirectangular_centre(spark):
    rows = [(float(y), float(p), float(r)) for y in (0, 45, 180, 270) for p in (0, 45, 90, -90) for r in (0, 30, 45, 180)]
    df = spark.createDataFrame(rows, "yaw double, pitch double, roll double")
    at = predictors.equirectangular_source(F.lit(50.0), F.lit(75.0), (101, 151), 60.0, F.col("yaw"), F.col("pitch"), F.col("roll"), (180, 360))
    for r in df.select("yaw", "pitch", F.explode(F.array(at)).alias("at")).collect():
        lat = 90 - (r["at"]["i"] + 0.5) if 0 < r["at"]["i"] < 179 else math.copysign(90, r["at"]["i"] < 1 or -1)
        lon = (r["at"]["j"] + 0.5 - 180) % 360
        lat = math.copysign(90, 1 if r["at"]["i"] < 1 else -1) if abs(r["pitch"]) == 90 else lat
        assert abs(lat) == pytest.approx(abs(r["pitch"]), abs=0.6)
        if abs(r["pitch"]) < 90:
            assert min(abs(lon - r["yaw"]), 360 - abs(lon - r["yaw"])) < 0.01


def test_segmentor_runs_once_a_task(spark):
    images = spark.createDataFrame([("a", 2, 2, 1, [0.0, 0.9, 1.0, 0.2])], "image_filename string, height int, width int, channels int, data array<double>")
    got = predictors.segmented(images, lambda: lambda im: np.where(im[:, :, 0] > 0.5, 3, -1)).collect()
    assert sorted(map(tuple, got)) == [("a", 0, 1, 3), ("a", 1, 0, 3)]
    small = spark.createDataFrame([("a", i, j, i * 2 + j) for i in range(2) for j in range(2)], "image_filename string, i int, j int, class_id long")
    big = {(r["i"], r["j"]): r["class_id"] for r in predictors.resized(small, 2, 2, 4, 4).collect()}
    assert len(big) == 16 and big[0, 0] == big[1, 1] == 0 and big[3, 3] == 3
