from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orthoquilt.operators import correspondence

POINT = "struct<x: double, y: double, z: double>"
POSE = "camera_id long, cam_to_world array<double>, f double, cx double, cy double, image_width int, image_height int"


def turned(rng) -> np.ndarray:
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    return q * np.sign(np.linalg.det(q))


def cast(pose, faces, f, cx, cy, w, h):
    """The face that each pixel centre's ray meets first, -1 for none, by brute force."""
    j, i = np.meshgrid(np.arange(w) + 0.5, np.arange(h) + 0.5)
    ray = np.stack([(j - w / 2 - cx) / f, (i - h / 2 - cy) / f, np.ones_like(i)], -1).reshape(-1, 3) @ pose[:3, :3].T
    best, found = np.full(len(ray), np.inf), np.full(len(ray), -1)
    for k, (a, b, c) in enumerate(faces):
        m = np.stack([b - a, c - a], 1)
        for n, d in enumerate(ray):
            try:
                u, v, t = np.linalg.solve(np.column_stack([m, -d]), pose[:3, 3] - a)
            except np.linalg.LinAlgError:
                continue
            if u >= 0 and v >= 0 and u + v <= 1 and correspondence.NEAR < t < best[n]:
                best[n], found[n] = t, k
    return found.reshape(h, w)


@pytest.mark.parametrize("principal_point", [False, True])
def test_turned_cameras_among_faces(spark, principal_point):
    rng = np.random.default_rng(5)
    faces = rng.uniform(-6, 6, (40, 1, 3)) + rng.normal(size=(40, 3, 3)) * 1.5
    poses = []
    for _ in range(4):
        pose = np.eye(4)
        pose[:3, :3], pose[:3, 3] = turned(rng), rng.uniform(-4, 4, 3)
        poses.append(pose)
    f, cx, cy, w, h = 14.0, 3.0, -2.0, 24, 18
    cams = spark.createDataFrame([(k, p.ravel().tolist(), f, cx, cy, w, h) for k, p in enumerate(poses)], POSE)
    point = lambda v: dict(zip("xyz", map(float, v), strict=True))
    mesh = spark.createDataFrame([(k, *map(point, t)) for k, t in enumerate(faces)], f"face_id long, a {POINT}, b {POINT}, c {POINT}")
    got = np.full((4, h, w), -1)
    for r in correspondence.visible_faces(cams, mesh, 1.0, None, 3.0, principal_point).collect():
        assert got[r["camera_id"], r["i"], r["j"]] == -1
        got[r["camera_id"], r["i"], r["j"]] = r["face_id"]
    shift = (cx, cy) if principal_point else (0.0, 0.0)
    want = np.stack([cast(p, faces, f, *shift, w, h) for p in poses])
    assert (want >= 0).mean() > 0.3 and (got != want).sum() <= 2  # rays through an edge may fall on either side


def test_what_a_camera_meets_does_not_grow_with_the_scene():
    down = np.diag([1.0, -1.0, -1.0, 1.0])
    down[:3, 3] = (5, 5, 60)
    lens = np.array([[1000.0, 800, 600, 0, 0]])
    for length in (400.0, 40_000.0):
        x0, x1, y0, y1 = correspondence.footprints(down.reshape(1, 16), lens, length, [-500.0, 500.0, -length, length, 1.0, 50.0])[0]
        assert (x0, x1, y0, y1) == pytest.approx((5 - 0.4 * 59, 5 + 0.4 * 59, 5 - 0.3 * 59, 5 + 0.3 * 59), abs=0.2)
    aside = np.eye(4)[[1, 2, 0, 3]].T.copy()  # looks along x, sees as far as there are faces
    x0, x1, *_ = correspondence.footprints(aside.reshape(1, 16), lens, 1000.0, [-500.0, 500.0, -90.0, 90.0, -1.0, 50.0])[0]
    assert x0 == pytest.approx(0, abs=0.01) and x1 == 500


def test_a_long_face_is_drawn_in_parts(monkeypatch):
    monkeypatch.setattr(correspondence, "DRAWN", 7)
    monkeypatch.setattr(correspondence, "FACES", 3)
    eye = np.eye(4).ravel().tolist() + [10.0, 20, 20, 0, 0, -100, 100, -100, 100]
    rows = [(1, 0, 4, eye)] + [(1, 1, 9 - k, [-20, -20, 10 + k % 5, 20, -20, 10 + k % 5, 0, 40, 10 + k % 5]) for k in range(10)] + [(2, 0, None, eye)]
    kind = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("id", pa.int64()), ("numbers", pa.list_(pa.float64()))])
    batches = pa.table([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind).to_batches(max_chunksize=4)
    got = pa.Table.from_batches(correspondence.drawn(iter(batches), None)).to_pylist()
    assert len(got) > 300 and {(r["camera_id"], r["face_id"], r["depth"]) for r in got} == {(4, 4, 10.0)}
    assert len({(r["i"], r["j"]) for r in got}) == len(got)


def test_cameras_and_faces_that_are_there_twice(spark):
    at = lambda z: list(map(float, (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, z, 0, 0, 0, 1)))
    cams = spark.createDataFrame([(0, at(0.0), 10.0, 0.0, 0.0, 10, 10), (0, at(5.0), 10.0, 0.0, 0.0, 10, 10), (1, None, 10.0, 0.0, 0.0, 10, 10)], POSE)
    point = lambda x, y, z: dict(x=x, y=y, z=z)
    tri = lambda k, z: (k, point(-20.0, -20.0, z), point(20.0, -20.0, z), point(0.0, 40.0, z))
    mesh = spark.createDataFrame([tri(1, 9.0), tri(2, 8.0), tri(2, 8.0), (3, None, None, None)], f"face_id long, a {POINT}, b {POINT}, c {POINT}")
    got = correspondence.visible_faces(cams, mesh, 1.0, None, 4.0).collect()
    assert len(got) == 100 and {r["face_id"] for r in got} == {2}
    assert correspondence.visible_faces(cams, mesh.where("false"), 1.0, None, 4.0).count() == 0
    assert correspondence.visible_faces(cams.where("false"), mesh, 1.0, None, 4.0).count() == 0


def test_pixels_made_by_an_explode_are_not_broadcast(spark):
    pixels = spark.range(3).select(F.col("id").alias("camera_id"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("class_id", F.lit(1))
    obs = pixels.select("camera_id", "i", "j", F.lit(5).alias("face_id"))
    lens = spark.createDataFrame([(0, {"k1": 0.0}, 10.0, 0.0, 0.0, 20, 20)], "camera_id long, distortion map<string,double>, f double, cx double, cy double, image_width int, image_height int")
    for df in (correspondence.projected(obs, pixels), correspondence.through_lens(obs, lens, 0.5)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
