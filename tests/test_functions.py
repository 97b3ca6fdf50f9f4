from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orthoquilt.functions import crs, distortion, geometry, linalg
from orthoquilt.functions.linalg import vec


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def xyz(v):
    return (v["x"], v["y"], v["z"])


SEGMENTS = [  # a0, a1, b0, b1, clamp, pa, pb, dist
    ((-10, 0, 0), (10, 0, 0), (0, -10, 0), (0, 10, 0), True, (0, 0, 0), (0, 0, 0), 0),
    ((-10, 0, 0), (10, 0, 0), (0, 1, 0), (1, 2, 0), False, (-1, 0, 0), (-1, 0, 0), 0),
    ((-10, 0, 0), (10, 0, 0), (0, 1, 0), (1, 2, 0), True, (0, 0, 0), (0, 1, 0), 1),
    ((0, 0, 0), (10, 0, 0), (2, 3, 0), (8, 3, 0), True, None, None, 3),
    ((0, 0, 0), (1, 0, 0), (4, 4, 0), (9, 4, 0), True, (1, 0, 0), (4, 4, 0), 5),
    ((0, 0, 0), (1, 0, 0), (4, 4, 0), (9, 4, 0), False, None, None, 4),
    ((0, 0, 0), (0, 0, 5), (1, 0, 7), (3, 0, 7), True, (0, 0, 5), (1, 0, 7), math.sqrt(5)),
]


def test_closest_points(spark):
    rows = []
    for n, (a0, a1, b0, b1, clamp, *_) in enumerate(SEGMENTS):
        for turned, (s, e, t, u) in enumerate(((a0, a1, b0, b1), (a1, a0, b0, b1), (b0, b1, a0, a1))):
            rows.append((n, turned, clamp, *map(float, (*s, *e, *t, *u))))
    rows.append((-1, 0, True, *map(float, (0, 0, 0, 0, 0, 0, 1, 0, 0, 2, 0, 0))))
    names = [f"{a}{k}" for a in ("a0", "a1", "b0", "b1") for k in "xyz"]
    df = spark.createDataFrame(rows, "n int, turned int, clamp boolean, " + ", ".join(f"{n} double" for n in names))
    args = [vec(*(F.col(n + k) for k in "xyz")) for n in ("a0", "a1", "b0", "b1")]
    for clamp in (True, False):
        for r in df.where(F.col("clamp") == clamp).select("n", "turned", geometry.closest_points(*args, clamp=clamp).alias("r")).collect():
            if r["n"] < 0:
                assert r["r"] is None
                continue
            *_, pa, pb, dist = SEGMENTS[r["n"]]
            assert r["r"]["dist"] == pytest.approx(dist, abs=1e-9)
            if pa and r["turned"] < 2:
                assert xyz(r["r"]["pa"]) == pytest.approx(pa, abs=1e-9) and xyz(r["r"]["pb"]) == pytest.approx(pb, abs=1e-9)


def test_random_segments_against_sampling(spark):
    rng = np.random.default_rng(0)
    p = rng.normal(size=(30, 4, 3))
    names = [f"{a}{b}" for a in ("a0", "a1", "b0", "b1") for b in "xyz"]
    df = spark.createDataFrame([tuple(map(float, x.ravel())) for x in p], ", ".join(f"{n} double" for n in names))
    v = lambda n: vec(*(F.col(n + k) for k in "xyz"))
    got = [r["d"] for r in df.select(geometry.closest_points(v("a0"), v("a1"), v("b0"), v("b1"))["dist"].alias("d")).collect()]
    t = np.linspace(0, 1, 200)
    for q, d in zip(p, got, strict=True):
        a, b = q[0] + t[:, None] * (q[1] - q[0]), q[2] + t[:, None] * (q[3] - q[2])
        best = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1)).min()
        assert d <= best + 1e-9 and best - d < 0.05


def test_transforms(spark):
    angles = [F.lit(float(a)) for a in (20, -35, 70)]
    m = linalg.roll_pitch_yaw(*angles)
    r = one(spark, m=m, id=linalg.product(m, linalg.inverse(m)), s=linalg.scale_of(m), none=linalg.scale_of(F.lit(None).cast("array<double>")))
    assert np.allclose(np.array(r["id"]).reshape(4, 4), np.eye(4)) and r["s"] == pytest.approx(1) and r["none"] == 1
    rot = np.array(r["m"]).reshape(4, 4)[:3, :3]
    c, s = lambda a: math.cos(math.radians(a)), lambda a: math.sin(math.radians(a))
    P = np.array([[0, 0, 1], [1, 0, 0], [0, -1, 0]])
    rx = np.array([[1, 0, 0], [0, c(20), -s(20)], [0, s(20), c(20)]])
    ry = np.array([[c(-35), 0, s(-35)], [0, 1, 0], [-s(-35), 0, c(-35)]])
    rz = np.array([[c(70), -s(70), 0], [s(70), c(70), 0], [0, 0, 1]])
    assert np.allclose(rot, P.T @ rz @ ry @ rx @ P)
    parts = linalg.from_parts(F.array(*map(F.lit, (0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0))), F.array(*map(F.lit, (1.0, 2.0, 3.0))), F.lit(2.0))
    got = one(spark, p=linalg.apply(parts, vec(1, 0, 0)), s=linalg.scale_of(parts))
    assert xyz(got["p"]) == pytest.approx((1, 4, 3)) and got["s"] == pytest.approx(2)
    with pytest.raises(Exception, match="determinant"):
        one(spark, p=linalg.from_parts(F.array(*[F.lit(2.0)] * 9), F.array(*[F.lit(0.0)] * 3), F.lit(1.0)))
    q = linalg.from_quaternion(*map(F.lit, (math.sqrt(0.5), 0.0, 0.0, math.sqrt(0.5), 5.0, 6.0, 7.0)))
    assert xyz(one(spark, p=linalg.apply(q, vec(1, 0, 0)))["p"]) == pytest.approx((5, 7, 7))
    a = one(spark, a=linalg.angle_between(vec(1, 0, 0), vec(0, 2, 0)), p=linalg.onto_plane(vec(1, 2, 3), vec(0, 0, 5)))
    assert a["a"] == pytest.approx(math.pi / 2) and xyz(a["p"]) == (1, 2, 0)


def test_frames(spark):
    r = one(
        spark,
        code=crs.utm_code(F.lit(38.5), F.lit(-120.4)),
        origin=crs.to_ecef(F.lit(0.0), F.lit(0.0), F.lit(0.0)),
        pole=crs.to_ecef(F.lit(0.0), F.lit(90.0), F.lit(0.0)),
        middle=crs.to_utm(F.lit(-123.0), F.lit(0.0), 32610),
        albers=crs.to_albers(F.lit(-120.0), F.lit(0.0), 3310),
    )
    assert r["code"] == 32610
    assert xyz(r["origin"]) == pytest.approx((6378137, 0, 0), abs=1e-6) and xyz(r["pole"]) == pytest.approx((0, 0, 6356752.3142), abs=1e-3)
    assert (r["middle"]["x"], r["middle"]["y"]) == pytest.approx((500000, 0), abs=1e-6)
    assert (r["albers"]["x"], r["albers"]["y"]) == pytest.approx((0, -4_000_000), abs=1e-3)
    # Length of the meridian quadrant of WGS84
    quadrant = one(spark, p=crs.to_utm(F.lit(-123.0), F.lit(90.0), 32610))["p"]["y"] / 0.9996
    assert quadrant == pytest.approx(10001965.729, abs=0.01)
    points = spark.createDataFrame([(-120.4, 38.5, 1500.0), (-123.0, 1e-9, 0.0), (-118.1, 64.2, -20.0), (-125.9, -33.3, 8000.0)], "x double, y double, z double")
    p = vec(F.col("x"), F.col("y"), F.col("z"))
    for via in (4978, 32610, 32710):
        back = crs.convert(F.col("q"), via, 4326)
        for row in points.withColumn("q", crs.convert(p, 4326, via)).select("x", "y", "z", back.alias("b")).collect():
            assert xyz(row["b"]) == pytest.approx((row["x"], row["y"], row["z"]), abs=1e-6)
    with pytest.raises(ValueError):
        crs.convert(p, 4326, 1234)


def test_polygons(spark):
    ring = lambda *pts: F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in pts))
    holed = F.array(ring((0, 0), (10, 0), (10, 10), (0, 10)), ring((4, 4), (6, 4), (6, 6), (4, 6)))
    pts = {(1, 1): True, (5, 5): False, (0, 5): False, (10, 10): False, (4, 5): False, (11, 5): False, (9.99, 9.99): True}
    for (x, y), want in pts.items():
        assert one(spark, r=geometry.inside(F.lit(float(x)), F.lit(float(y)), holed))["r"] == want
    r = one(
        spark, a=geometry.polygon_area(holed), c=geometry.centroid(ring((0, 0), (4, 0), (4, 2), (0, 2), (0, 0))),
        near=geometry.within(F.lit(11.0), F.lit(5.0), holed, 1.5), far=geometry.within(F.lit(12.0), F.lit(5.0), holed, 1.5),
        d=geometry.edge_distance(F.lit(13.0), F.lit(14.0), holed),
    )
    assert r["a"] == 96 and (r["c"]["x"], r["c"]["y"]) == (2, 1) and r["near"] and not r["far"] and r["d"] == 5
    t = one(spark, a=geometry.area_3d(vec(0, 0, 0), vec(1, 0, 0), vec(0, 0, 1)), b=geometry.area_2d(vec(0, 0, 0), vec(1, 0, 5), vec(0, 1, 9)))
    assert (t["a"], t["b"]) == (0.5, 0.5)


def test_ray_hits(spark):
    tri = [vec(0, 0, 1), vec(1, 0, 1), vec(0, 1, 1)]
    hit = lambda o, d: one(spark, t=geometry.ray_hits_triangle(vec(*o), vec(*d), *tri))["t"]
    assert hit((0.2, 0.2, 3), (0, 0, -1)) == pytest.approx(2) and hit((0.2, 0.2, -1), (0, 0, 1)) == pytest.approx(2)
    assert hit((0.9, 0.9, 3), (0, 0, -1)) is None and hit((0.2, 0.2, 3), (0, 0, 1)) is None and hit((0.2, 0.2, 3), (1, 0, 0)) is None


def test_distortion(spark):
    params = lambda **k: F.create_map(*(c for n, v in k.items() for c in (F.lit(n), F.lit(v))))
    rest = [F.lit(float(v)) for v in (1000, 3, -2, 800, 600)]
    p = params(k1=-0.05, p1=0.001, b1=2.0)
    there = distortion.warped(F.lit(700.0), F.lit(100.0), p, *rest)
    back = spark.range(1).select(there.alias("t")).select(distortion.ideal(F.col("t.x"), F.col("t.y"), p, *rest).alias("r")).first()["r"]
    assert (back["x"], back["y"]) == pytest.approx((700, 100), abs=1e-6)
    assert one(spark, k=distortion.key(params(k2=0.5, k1=1.0)))["k"] == "k1:1.00000000|k2:0.50000000|s:1.00000000"
    with pytest.raises(Exception, match="distortion"):
        one(spark, p=distortion.checked(params(k2=0.5)))


def test_closest_points_in_numpy_are_those_of_the_columns(spark):
    from orthoquilt.operators import rays

    rng = np.random.default_rng(3)
    p = rng.normal(size=(60, 4, 3)) * 20
    p[40:50, 3] = p[40:50, 2] + (p[40:50, 1] - p[40:50, 0]) * rng.normal(size=(10, 1))  # parallel
    p[50:55, 1] = p[50:55, 0]  # without length
    names = [f"{a}{k}" for a in ("a0", "a1", "b0", "b1") for k in "xyz"]
    df = spark.createDataFrame([(n, *map(float, x.ravel())) for n, x in enumerate(p)], "n int, " + ", ".join(f"{n} double" for n in names))
    v = [vec(*(F.col(n + k) for k in "xyz")) for n in ("a0", "a1", "b0", "b1")]
    want = {r["n"]: r["r"] for r in df.select("n", geometry.closest_points(*v).alias("r")).collect()}
    pa, pb, dist = rays.closest(*(p[:, k] for k in range(4)))
    for n in range(60):
        if want[n] is None:
            assert np.isnan(dist[n]) and 50 <= n < 55
        else:
            assert (*pa[n], *pb[n], dist[n]) == (*xyz(want[n]["pa"]), *xyz(want[n]["pb"]), want[n]["dist"])
