"""The library's own queries over the driver's tables, each with the SQL that checks it (where SQL can)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoquilt.functions import crs, distortion, geometry, linalg
from orthoquilt.functions.linalg import vec
from orthoquilt.operators import cameras as cam
from orthoquilt.operators import correspondence, graph, metrics, overlay, predictors, raster, spatial, votes
from orthoquilt.operators import rays as ray_ops
from orthoquilt.plans import scene, workflows
from orthoquilt.plans.scene import ctes, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


LAST = "lastpx as (select face_id, camera_id, arg_max(class_id, row(k1, k2, class_id)) class_id from obs group by all)"
COUNTED = f"{LAST},\ncounted as (select face_id, class_id, count(*) n from lastpx group by all)"


def last_pixels(spark: SparkSession, d: str) -> DataFrame:
    return votes.last_value(scene.obs(spark, d), ["face_id", "camera_id"], "class_id", ["k1", "k2"])


# Votes ----------------------------------------------------------------------------------------------------------------


@query(f"{ctes('obs')},\n{COUNTED}\nselect face_id, arg_max(class_id, row(n, -class_id)) pred_class, sum(n)::bigint n_obs from counted group by face_id")
def face_consensus(spark, d):
    """The last pixel of each view of a face, votes by class, the class with most votes."""
    best = votes.argmax_class(votes.votes(last_pixels(spark, d)))
    return best.select("face_id", "pred_class", F.col("total").alias("n_obs"))


@query(f"""{ctes('obs')},\n{COUNTED}, seen as (select face_id, count(distinct camera_id) n_views from lastpx group by face_id)
select face_id, class_id, n, n_views, round(n / n_views, 6) frac from counted join seen using (face_id)""")
def face_view_average(spark, d):
    return votes.view_average(last_pixels(spark, d)).withColumn("frac", F.round("frac", 6))


@query(f"""{ctes('obs')}, seen as (select face_id, count(distinct camera_id) n_views from obs group by face_id),
total as (select face_id, class_id channel, sum(weight) total from obs group by all)
select face_id, channel, round(total / n_views, 6) "value", n_views from total join seen using (face_id)""")
def channel_average(spark, d):
    values = scene.obs(spark, d).select("camera_id", "face_id", F.col("class_id").alias("channel"), F.col("weight").alias("value"))
    return votes.channel_average(values).withColumn("value", F.round("value", 6))


@query("""with corner as (select p_partkey face_id, p_size % 5 class_id from part
  union all select p_partkey - 1, p_size % 5 from part where p_partkey > 0 union all select p_partkey - 2, p_size % 5 from part where p_partkey > 1),
counted as (select face_id, class_id::bigint class_id, count(*) n from corner group by all)
select face_id, arg_max(class_id, row(n, md5(face_id || '|' || class_id || '|'), class_id)) class_id, max(n) n from counted group by face_id""")
def face_mode_fair(spark, d):
    parts = table(spark, d, "part")
    k = F.col("p_partkey")
    face = parts.select(k.alias("face_id"), k.alias("v0"), (k + 1).alias("v1"), (k + 2).alias("v2"))
    face = face.union(spark.createDataFrame([(-1, -1, 0, 1), (-2, -2, -1, 0)], "face_id long, v0 long, v1 long, v2 long"))
    vertex = parts.select(k.alias("vertex_id"), (F.col("p_size") % 5).cast("long").alias("class_id"))
    return votes.fair_mode(votes.corners(face).join(vertex, "vertex_id")).where("face_id >= 0").select("face_id", "class_id", "n")


ORACLE_SQL["face_mode_fair"] += " having face_id >= 0"


@query("""with named as (select distinct o_orderpriority name from orders where o_orderpriority is not null),
ranked as (select name, row_number() over (order by name) - 1 i from named) select case when i >= 0 then i + 1 else i end class_id, name from ranked""")
def label_ids(spark, d):
    return votes.label_ids(table(spark, d, "orders"), "o_orderpriority", background=0)


@query("""with named as (select distinct o_orderpriority name from orders where o_orderpriority < '4'),
ranked as (select name, row_number() over (order by name) class_id from named)
select o_orderkey, class_id from orders left join ranked on name = o_orderpriority""")
def remap_labels(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    labels = votes.label_ids(orders.where("o_orderpriority < '4'"), "o_orderpriority")
    return votes.remap(orders, "o_orderpriority", labels).select("o_orderkey", "class_id")


@query(f"""{ctes('obs')}, ignored as (select face_id, camera_id, if(k1 % 5 = 0, 255, class_id) c from obs),
seen as (select face_id, count(distinct camera_id) n_views from ignored group by face_id),
counted as (select face_id, c class_id, count(*) n from ignored where c between 0 and 2 group by all)
select face_id, class_id, n, n_views, round(n / n_views, 6) frac from counted join seen using (face_id)""")
def one_hot_long(spark, d):
    """Ignored labels vote for no class but keep counting as seen."""
    raw = scene.obs(spark, d).withColumn("class_id", F.when(F.col("k1") % 5 == 0, F.lit(255).cast("long")).otherwise(F.col("class_id")))
    return votes.view_average(votes.one_hot(raw, 3)).withColumn("frac", F.round("frac", 6))


@query(f"""{ctes('obs')}, counted as (select face_id, class_id, sum(if(k1 % 2 = 0 and weight > 45, weight, 0)) n from obs group by all)
select face_id, case when sum(n) <> 0 then arg_max(class_id, row(n, -class_id)) end pred_class from counted group by face_id""")
def class_or_null(spark, d):
    w = F.when((F.col("k1") % 2 == 0) & (F.col("weight") > 45), F.col("weight")).otherwise(0.0)
    counted = scene.obs(spark, d).groupBy("face_id", "class_id").agg(F.sum(w).alias("n"))
    return votes.argmax_class(counted).select("face_id", "pred_class")


# Cameras --------------------------------------------------------------------------------------------------------------


@query(f"{ctes('cameras')} select camera_id, image_filename from cameras where camera_id % 7 = 0")
def cameras_every_nth(spark, d):
    return cam.every_nth(scene.cameras(spark, d), 7).select("camera_id", "image_filename")


@query(f"{ctes('cameras')} select camera_id, image_filename from cameras where regexp_matches(image_filename, '[0-4][05]\\.jpg$')")
def cameras_regex(spark, d):
    return cam.matching(scene.cameras(spark, d), r"[0-4][05]\.jpg$").select("camera_id", "image_filename")


@query("select page_id, url from pages where starts_with(url, 'https://') and url like 'https://%/en/%'")
def cameras_in_folder(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    return cam.matching(cam.in_folder(pages, "https:/", "url"), "^https://[^ ]*/en/", "url")


@query(f"""{ctes('cameras')} select camera_id from cameras where (x > 3 and x < 22 and y > 1 and y < 7) or
 (greatest(3 - x, x - 22, 0) * greatest(3 - x, x - 22, 0) + greatest(1 - y, y - 7, 0) * greatest(1 - y, y - 7, 0) < 2.25)""")
def cameras_in_roi(spark, d):
    return cam.in_region(scene.cameras(spark, d), geometry.box(3.0, 1.0, 22.0, 7.0), 1.5).select("camera_id")


@query("select c_custkey, c_name from customer anti join (select * from orders where o_orderstatus = 'P') on c_custkey = o_custkey")
def missing_images(spark, d):
    orders = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return cam.missing(table(spark, d, "customer").select("c_custkey", "c_name"), orders, "c_custkey")


_M = (0.8, -0.6, 0.0, 3.0, 0.6, 0.8, 0.0, -1.0, 0.0, 0.0, 1.0, 2.5, 0.0, 0.0, 0.0, 1.0)
_EMBEDDED = "v as (select vec_id, embedding[1]::double x, embedding[2]::double y, embedding[3]::double z from embeddings)"


def _embedded(spark: SparkSession, d: str) -> DataFrame:
    at = lambda k: F.get("embedding", F.lit(k)).cast("double")
    return table(spark, d, "embeddings").select("vec_id", at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


@query(f"""with {_EMBEDDED} select vec_id, round(0.8 * (x - 3) + 0.6 * (y + 1), 6) x, round(-0.6 * (x - 3) + 0.8 * (y + 1), 6) y, round(z - 2.5, 6) z from v""")
def vertices_to_camera(spark, d):
    m = linalg.inverse(F.array(*map(F.lit, _M)))
    out = _embedded(spark, d).select("vec_id", F.explode(F.array(linalg.apply(m, vec(F.col("x"), F.col("y"), F.col("z"))))).alias("p"))
    return out.select("vec_id", *(F.round(f"p.{k}", 6).alias(k) for k in "xyz"))


@query(f"""{ctes('cameras', 'faces')}, seen as (select camera_id, face_id, 400 + 1000 * (f.x - c.x) / (c.z - f.z) x, 300 - 1000 * (f.y - c.y) / (c.z - f.z) y, c.z - f.z depth
 from (select l_suppkey camera_id, l_partkey face_id from lineitem group by all) l join cameras c using (camera_id) join faces f using (face_id))
select camera_id, face_id, round(x, 6) x, round(y, 6) y, round(depth, 6) depth, depth > 0 and x > 0 and x < 800 and y > 0 and y < 600 in_frame from seen""")
def project_points(spark, d):
    """Faces that a camera is said to see, projected into it."""
    pairs = scene.obs(spark, d).select("camera_id", "face_id").distinct()
    pose = scene.cameras(spark, d).select("camera_id", "cam_to_world", "f", "cx", "cy", "image_width", "image_height")
    joined = pairs.join(pose, "camera_id").join(scene.faces(spark, d).select("face_id", "x", "y", "z"), "face_id")
    pixel = cam.project(linalg.inverse(F.col("cam_to_world")), vec(F.col("x"), F.col("y"), F.col("z")), *(F.col(c) for c in ("f", "cx", "cy", "image_width", "image_height")))
    out = joined.select("camera_id", "face_id", F.explode(F.array(pixel)).alias("p"))
    return out.select("camera_id", "face_id", *(F.round(f"p.{k}", 6).alias(k) for k in ("x", "y", "depth")), cam.in_frame(F.col("p"), F.lit(800), F.lit(600)).alias("in_frame"))


_RAY = """px as (select instance_id, camera_id, ((jmin + jmax) / 2 - 400) / 1000 u, ((imin + imax) / 2 - 300) / 1000 v from detections),
cast_ as (select instance_id ray_id, camera_id, x, y, z, u, v, sqrt(u * u + v * v + 1) n from px join cameras using (camera_id))"""


@query(f"""{ctes('cameras', 'detections')}, {_RAY}
select ray_id, camera_id, round(x, 6) sx, round(y, 6) sy, round(z, 6) sz, round(x + 100 * u / n, 6) ex, round(y - 100 * v / n, 6) ey, round(z - 100 / n, 6) ez from cast_""")
def cast_rays(spark, d):
    rays = _detected_rays(spark, d, None)
    return rays.select("ray_id", "camera_id", *(F.round(f"{e}.{k}", 6).alias(f"{e[0]}{k}") for e in ("start", "end") for k in "xyz"))


def _detected_rays(spark: SparkSession, d: str, limit: float | None) -> DataFrame:
    cams = scene.cameras(spark, d)
    names = cams.select("camera_id", "image_filename")
    found = predictors.box_centres(scene.detections(spark, d)).join(names, "camera_id").select("image_filename", "instance_id", "i", "j")
    return cam.detection_rays(cams, found, 100.0, limit)


@query(f"{ctes('cameras', 'detections')}, {_RAY} select ray_id, camera_id from cast_ where round(degrees(acos(1 / n)), 6) <= 15")
def ray_angle_filter(spark, d):
    rays = _detected_rays(spark, d, None)
    return rays.where(F.round(F.degrees(F.acos(F.abs("direction.z"))), 6) <= 15).select("ray_id", "camera_id")


_TURNS = [(y, p, 0) for y, p in ((0, 0), (90, 0), (180, 0), (270, 0), (0, 90), (0, -90))]


@query(f"""{ctes('cameras')}, turns(k, yaw, pitch) as (values {", ".join(f"({k}, {y}, {p})" for k, (y, p, _) in enumerate(_TURNS))})
select camera_id * 6 + k camera_id, camera_id source_id, replace(image_filename, '.jpg', format('_y{{:03d}}_p{{:03d}}_r000.jpg', yaw, pitch)) image_filename,
 round(sin(radians(yaw)) * cos(radians(pitch)), 6) + 0.0 dx, round(-sin(radians(pitch)), 6) + 0.0 dy, round(-cos(radians(yaw)) * cos(radians(pitch)), 6) + 0.0 dz from cameras, turns""")
def camera_rig(spark, d):
    """Six views from each camera's place: where they look."""
    turns = spark.createDataFrame(_TURNS, "yaw int, pitch int, roll int")
    rig = cam.rig(scene.cameras(spark, d).drop("x", "y", "z"), turns)
    out = rig.select("camera_id", "source_id", "image_filename", F.explode(F.array(cam.view_direction(F.col("cam_to_world")))).alias("v"))
    return out.select("camera_id", "source_id", "image_filename", *((F.round(f"v.{k}", 6) + 0.0).alias(f"d{k}") for k in "xyz"))


@query(f"""{ctes('cameras')} select camera_id, sha256('{{"camera_id":' || camera_id || ',"image_filename":"' || image_filename || '"}}') hash from cameras""")
def camera_hash(spark, d):
    return cam.camera_hash(scene.cameras(spark, d), ["image_filename", "camera_id"])


@query("select page_id, regexp_replace(replace(url, 'https://', 'http://'), '\\.[^./]*$', '') stem from pages where starts_with(url, 'https://')")
def paths_rebased(spark, d):
    pages = table(spark, d, "pages").where("url like 'https://%'")
    return pages.select("page_id", cam.stem(cam.rebased(F.col("url"), "https:/", "http:/")).alias("stem"))


# Frames ---------------------------------------------------------------------------------------------------------------


@query("""with p as (select s_suppkey, (s_suppkey % 90)::double lat, -(60 + s_suppkey % 120)::double lon from supplier)
select s_suppkey, (32700 - round_even((45 + lat) / 90, 0) * 100 + round_even((183 + lon) / 6, 0))::bigint epsg from p""")
def utm_code(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k, crs.utm_code((k % 90).cast("double"), -(60 + k % 120).cast("double")).alias("epsg"))


_E2 = repr(crs.E2)


@query(f"""with p as (select s_suppkey, radians((s_suppkey % 90)::double) phi, radians(-(60 + s_suppkey % 120)::double) lam, s_acctbal h from supplier),
q as (select *, 6378137.0::double / sqrt(1 - {_E2}::double * sin(phi) * sin(phi)) n from p)
select s_suppkey, round((n + h) * cos(phi) * cos(lam), 4) x, round((n + h) * cos(phi) * sin(lam), 4) y, round((n * (1 - {_E2}::double) + h) * sin(phi), 4) z,
 round(degrees(phi), 6) lat, round(h, 3) height from q""")
def geodetic_ecef(spark, d):
    """There, and back again."""
    k = F.col("s_suppkey")
    there = table(spark, d, "supplier").select(k, F.explode(F.array(crs.to_ecef(-(60 + k % 120).cast("double"), (k % 90).cast("double"), F.col("s_acctbal")))).alias("p"))
    both = there.select("s_suppkey", "p", F.explode(F.array(crs.from_ecef(F.col("p")))).alias("g"))
    return both.select("s_suppkey", *(F.round(f"p.{c}", 4).alias(c) for c in "xyz"), F.round("g.y", 6).alias("lat"), F.round("g.z", 3).alias("height"))


_N = repr(1 / 298.257223563 / (2 - 1 / 298.257223563))
#: The transverse Mercator series with isometric latitudes instead of the library's tangents.
_UTM = f"""with p as (select s_suppkey, (s_suppkey % 84)::double lat, (-60 - s_suppkey % 120)::double lon from supplier),
z as (select *, (32700 - round_even((45 + lat) / 90, 0) * 100 + round_even((183 + lon) / 6, 0))::bigint epsg from p),
g as (select *, radians(lat) phi, radians(lon - (epsg % 100 * 6 - 183)) lam, {_N}::double n from z),
c as (select *, sinh(atanh(sin(phi)) - sqrt({_E2}::double) * atanh(sqrt({_E2}::double) * sin(phi))) t from g),
k as (select *, atan2(t, cos(lam)) xi, asinh(sin(lam) / sqrt(t * t + cos(lam) * cos(lam))) eta, 6378137.0 / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) r,
 [n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 + 41 * n ** 4 / 180, 13 * n ** 2 / 48 - 3 * n ** 3 / 5 + 557 * n ** 4 / 1440, 61 * n ** 3 / 240 - 103 * n ** 4 / 140, 49561 * n ** 4 / 161280] a from c)
select s_suppkey, epsg, round(0.9996 * r * (eta + list_sum([a[q] * cos(2 * q * xi) * sinh(2 * q * eta) for q in [1, 2, 3, 4]])) + 500000, 3) x,
 round(0.9996 * r * (xi + list_sum([a[q] * sin(2 * q * xi) * cosh(2 * q * eta) for q in [1, 2, 3, 4]])) + if(epsg >= 32700, 10000000, 0), 3) y from k"""


@query(_UTM)
def utm_forward(spark, d):
    k = F.col("s_suppkey")
    place = table(spark, d, "supplier").select(k, (k % 84).cast("double").alias("lat"), (-60 - k % 120).cast("double").alias("lon"))
    out = place.withColumn("epsg", crs.utm_code(F.col("lat"), F.col("lon")))
    return out.select("s_suppkey", "epsg", F.explode(F.array(crs.to_utm(F.col("lon"), F.col("lat"), F.col("epsg")))).alias("p")).select("s_suppkey", "epsg", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))


@query("select event_id, round(event_id % 90 + (event_id % 60) / 60 + (event_id % 47) / 3600, 9) degrees from events")
def dms_to_degrees(spark, d):
    k = F.col("event_id")
    return table(spark, d, "events").select(k, F.round(crs.dms_to_degrees((k % 90).cast("double"), (k % 60).cast("double"), (k % 47).cast("double")), 9).alias("degrees"))


_K1, _P1 = -0.05, 0.001


@query(f"""with px as (select p_partkey, (p_partkey * 13 % 800)::double x, (p_partkey * 7 % 600)::double y from part),
uv as (select *, (x - 400) / 1000 u, (y - 300) / 1000 v from px), r as (select *, u * u + v * v r2 from uv),
w as (select *, u * (1 + r2 * {_K1}) + {_P1} * (r2 + 2 * u * u) du, v * (1 + r2 * {_K1}) + 2 * {_P1} * u * v dv from r)
select p_partkey, round(400 + 3 + du * 1000 + 3e-8, 6) wx, round(300 - 2 + dv * 1000 + 3e-8, 6) wy, x ix, y iy from w""")
def distort_pixels(spark, d):
    """Ideal pixels to warped ones and back; the small shift before rounding keeps exact halves off the edge."""
    k = F.col("p_partkey")
    params = F.create_map(F.lit("k1"), F.lit(_K1), F.lit("p1"), F.lit(_P1))
    rest = [F.lit(float(v)) for v in (1000, 3, -2, 800, 600)]
    px = scene.spread(table(spark, d, "part").select(k)).select(k, (k * 13 % 800).cast("double").alias("x"), (k * 7 % 600).cast("double").alias("y"))
    there = px.select("p_partkey", F.explode(F.array(distortion.warped(F.col("x"), F.col("y"), params, *rest))).alias("w"))
    back = there.select("p_partkey", "w", F.explode(F.array(distortion.ideal(F.col("w.x"), F.col("w.y"), params, *rest))).alias("i"))
    return back.select("p_partkey", F.round(F.col("w.x") + 3e-8, 6).alias("wx"), F.round(F.col("w.y") + 3e-8, 6).alias("wy"), F.round("i.x", 6).alias("ix"), F.round("i.y", 6).alias("iy"))


@query("select p_partkey, format('k1:{:.8f}|k2:{:.8f}|s:1.00000000', p_size / 100, p_retailprice / 1000) distortion_key from part")
def distortion_key(spark, d):
    params = F.create_map(F.lit("k2"), F.col("p_retailprice") / 1000, F.lit("k1"), F.col("p_size") / 100)
    return table(spark, d, "part").select("p_partkey", distortion.key(params).alias("distortion_key"))


@query("select c_custkey, round(least(179, greatest(0, c_custkey % 181 - 0.5)), 6)::double i, round((c_custkey % 360 + 179.5) % 360, 6)::double j from customer")
def equirect_direction(spark, d):
    """Where each pixel of a 101 x 151 view of each customer's bearing comes from in a 180 x 360 panorama: centre pixels only."""
    k = F.col("c_custkey")
    at = predictors.equirectangular_source(F.lit(50.0), F.lit(75.0), (101, 151), 60.0, (k % 360).cast("double"), (k % 181 - 90).cast("double"), F.lit(0.0), (180, 360))
    out = table(spark, d, "customer").select(k, F.explode(F.array(at)).alias("p"))
    return out.select("c_custkey", F.round("p.i", 6).alias("i"), F.round("p.j", 6).alias("j"))


# Places ---------------------------------------------------------------------------------------------------------------


@query(f"""{ctes('faces', 'boxes')} select face_id, arg_max(name, polygon_id) name from faces left join boxes on x > x0 and x < x1 and y > y0 and y < y1 group by face_id""")
def faces_in_polygons(spark, d):
    return spatial.values_from_polygons(scene.faces(spark, d), scene.boxes(spark, d), "face_id", "name", "polygon_id", 10.0)


@query(f"""{ctes('squares')}, inside as (select vertex_id from vertices where x > 5 and x < 15 and y > 3 and y < 12)
select face_id, v0, v1, v2 from mesh where v0 in (from inside) or v1 in (from inside) or v2 in (from inside)""")
def faces_in_roi(spark, d):
    vertices, tri = scene.grid_mesh(spark, d)
    region = spark.range(1).select(geometry.box(5.0, 3.0, 15.0, 12.0).alias("geom"))
    return spatial.region_crop(vertices, tri, region, 10.0)[0].select("face_id", "v0", "v1", "v2")


@query(f"""{ctes('squares')}, p as (select face_id, a.x ax, a.y ay, a.z az, b.x bx, b.y by_, b.z bz, c.x cx, c.y cy, c.z cz from mesh
 join vertices a on v0 = a.vertex_id join vertices b on v1 = b.vertex_id join vertices c on v2 = c.vertex_id),
n as (select face_id, (by_ - ay) * (cz - az) - (bz - az) * (cy - ay) nx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) ny, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) nz from p)
select face_id, round(sqrt(nx * nx + ny * ny + nz * nz) / 2, 6) area_3d, round(abs(nz) / 2, 6) area_2d from n""")
def triangle_areas(spark, d):
    corner = scene.mesh_corners(*scene.grid_mesh(spark, d))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return corner.select("face_id", F.round(geometry.area_3d(a, b, c), 6).alias("area_3d"), F.round(geometry.area_2d(a, b, c), 6).alias("area_2d"))


_WEIGHED = f"""{COUNTED}, best as (select face_id, arg_max(class_id, row(n, -class_id)) class_id from counted group by face_id),
met as (select polygon_id, b.class_id, z, x, y from faces join best b using (face_id) join boxes on x > x0 and x < x1 and y > y0 and y < y1)"""


@query(f"""{ctes('obs', 'faces', 'boxes')}, {_WEIGHED}, w as (select polygon_id, class_id, round(sum(z), 6) w from met group by all),
top as (select polygon_id, arg_max(class_id, row(w, -class_id)) pred_class from w group by polygon_id) select polygon_id, pred_class from boxes left join top using (polygon_id)""")
def polygon_label(spark, d):
    return _polygon_labels(spark, d, F.col("z"))


def _polygon_labels(spark: SparkSession, d: str, weight) -> DataFrame:
    best = face_consensus(spark, d).select("face_id", F.col("pred_class").alias("class_id"))
    polygons = scene.boxes(spark, d).select("polygon_id", "geom")
    held = spatial.points_in_polygons(scene.faces(spark, d).join(best, "face_id"), polygons, 10.0)
    return spatial.polygon_labels(held.select("polygon_id", "class_id", weight.alias("weight")), polygons)


_GROUND = "(1 - (1 - 0.25) * (z < 10)::int)"

@query(f"""{ctes('obs', 'faces', 'boxes')}, {_WEIGHED}, w as (select polygon_id, class_id, round(sum({_GROUND}), 6) w from met group by all),
top as (select polygon_id, arg_max(class_id, row(w, -class_id)) pred_class from w group by polygon_id) select polygon_id, pred_class from boxes left join top using (polygon_id)""")
def polygon_label_ground(spark, d):
    """Faces near the ground weigh a quarter."""
    return _polygon_labels(spark, d, spatial.ground_weight(F.lit(0.25), (F.col("z") < 10).cast("int")))


_DTM = "dtm as (select floor(x / 4)::bigint c, floor(y / 4)::bigint r, avg(z) g from faces group by all)"


def _heights(spark: SparkSession, d: str) -> DataFrame:
    faces = scene.faces(spark, d)
    terrain = faces.groupBy(F.floor(F.col("y") / 4).alias("row"), F.floor(F.col("x") / 4).alias("col")).agg(F.avg("z").alias("value"))
    return spatial.height_above(faces, terrain.where("(row + col) % 7 <> 3"), (4.0, 0.0, 0.0, 0.0, 4.0, 0.0))


_HEIGHTS = f"{_DTM}, heights as (select face_id, z - g height from faces left join dtm on c = floor(x / 4) and r = floor(y / 4) and (r + c) % 7 <> 3)"


@query(f"{ctes('faces')}, {_HEIGHTS} select face_id, round(height, 6) height from heights")
def height_above_ground(spark, d):
    return _heights(spark, d).select("face_id", F.round("height", 6).alias("height"))


@query(f"{ctes('faces')}, {_HEIGHTS} select (case when height is null then 0 when height <= 2 then 1 else 2 end)::int height_class, count(*) n from heights group by all")
def height_classes(spark, d):
    return _heights(spark, d).groupBy(spatial.height_class(F.col("height"), 2.0).alias("height_class")).agg(F.count("*").alias("n"))


@query(f"""{ctes('obs', 'faces')}, {COUNTED}, {_HEIGHTS}, best as (select face_id, arg_max(class_id, row(n, -class_id)) class_id from counted group by face_id)
select face_id, case when height < -5 then 3 else class_id end class_id from best left join heights using (face_id)""")
def ground_label(spark, d):
    best = face_consensus(spark, d).select("face_id", F.col("pred_class").alias("class_id"))
    return spatial.with_ground(best, _heights(spark, d), -5.0, 3)


@query(f"""with {_EMBEDDED}, pairs as (select a.vec_id point_id, b.vec_id target_id, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), 9) dist
 from v a join v b on a.vec_id <> b.vec_id) select point_id, arg_min(target_id, row(dist, target_id)) target_id, min(dist) dist from pairs group by point_id""")
def nearest_vertex(spark, d):
    """For each vector the nearest other one, however far."""
    v = _embedded(spark, d)
    return spatial.nearest(v.withColumnRenamed("vec_id", "point_id"), v.withColumnRenamed("vec_id", "target_id"), 0.05, apart=True)


# Rays -----------------------------------------------------------------------------------------------------------------


@query(f"""{ctes('rays')}, t as (select *, (sz - 80) / sz t1, (sz - 20) / sz t2 from rays) select ray_id, camera_id, round(sx + (ex - sx) * t1, 6) sx, round(sy + (ey - sy) * t1, 6) sy,
 round(sx + (ex - sx) * t2, 6) ex, round(sy + (ey - sy) * t2, 6) ey from t""")
def ray_clip_planes(spark, d):
    rays = scene.rays(spark, d).withColumn("direction", linalg.unit(linalg.sub(F.col("end"), F.col("start"))))
    return ray_ops.clip_to_planes(rays, 80.0, 20.0).select("ray_id", "camera_id", *(F.round(f"{e}.{k}", 6).alias(f"{e[0]}{k}") for e in ("start", "end") for k in "xy"))


#: Closest points of segments a and b in SQL, told from the five places where they can be: at the crossing of both lines, if it lies on the segments, else at
#: an end of one of them (the library follows the clamped parameters instead).
_CLOSEST = """d as (select *, ax1 - ax0 ux, ay1 - ay0 uy, az1 - az0 uz, bx1 - bx0 vx, by1 - by0 vy, bz1 - bz0 vz, bx0 - ax0 wx, by0 - ay0 wy, bz0 - az0 wz from pairs),
dots as (select *, ux * ux + uy * uy + uz * uz uu, vx * vx + vy * vy + vz * vz vv, ux * vx + uy * vy + uz * vz uv, ux * wx + uy * wy + uz * wz uw, vx * wx + vy * wy + vz * wz vw from d),
cross_ as (select *, (uw * vv - uv * vw) / (uu * vv - uv * uv) s, (uv * uw - uu * vw) / (uu * vv - uv * uv) t from dots),
places as (select a, b, unnest([{'s': s, 't': t, 'free': true}, {'s': 0.0, 't': -vw / vv, 'free': false}, {'s': 1.0, 't': (uv - vw) / vv, 'free': false}, {'s': uw / uu, 't': 0.0, 'free': false},
  {'s': (uw + uv) / uu, 't': 1.0, 'free': false}]) p, * exclude (a, b, s, t) from cross_),
held as (select * replace ({'s': least(1, greatest(0, p.s)), 't': least(1, greatest(0, p.t)), 'free': p.free} as p) from places where not p.free or (p.s between 0 and 1 and p.t between 0 and 1)),
apart as (select a, b, ax0 + p.s * ux px, ay0 + p.s * uy py, az0 + p.s * uz pz, bx0 + p.t * vx qx, by0 + p.t * vy qy, bz0 + p.t * vz qz from held),
closest as (select a, b, min(sqrt((px - qx) ** 2 + (py - qy) ** 2 + (pz - qz) ** 2)) dist,
  arg_min({'x': (px + qx) / 2, 'y': (py + qy) / 2, 'z': (pz + qz) / 2}, sqrt((px - qx) ** 2 + (py - qy) ** 2 + (pz - qz) ** 2)) m from apart group by a, b)"""


def _ray_pairs(where: str) -> str:
    ends = ", ".join(f"{n}.{e}{k} {n}{k}{i}" for n in "ab" for i, e in enumerate("se") for k in "xyz")
    return f"pairs as (select a.ray_id a, b.ray_id b, {ends} from rays a join rays b on a.ray_id < b.ray_id and {where})"


#: Blocks of 400 rays lie at least two apart, so the SQL need not look beyond a block.
@query(f"""{ctes('rays')}, {_ray_pairs("floor(a.ray_id / 400) = floor(b.ray_id / 400) and a.camera_id <> b.camera_id")}, {_CLOSEST}
select a src, b dst, round(greatest(dist, 1e-4), 6) dist, round(1 / greatest(dist, 1e-4), 6) weight from closest where dist <= 0.1""")
def ray_edges(spark, d):
    """Rays of different cameras that pass within 10 centimetres."""
    return ray_ops.edges(scene.rays(spark, d), 0.1, 1e-4).select("src", "dst", F.round("dist", 6).alias("dist"), F.round("weight", 6).alias("weight"))


_NORMAL = """n as (select *, (ex - sx) / l dx, (ey - sy) / l dy, (ez - sz) / l dz from (select *, sqrt((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy) + (ez - sz) * (ez - sz)) l from rays)),
s as (select camera_id, sum(1 - dx * dx) a, sum(-dx * dy) b, sum(-dx * dz) c, sum(1 - dy * dy) d, sum(-dy * dz) e, sum(1 - dz * dz) f,
 sum(sx - dx * (dx * sx + dy * sy + dz * sz)) p, sum(sy - dy * (dx * sx + dy * sy + dz * sz)) q, sum(sz - dz * (dx * sx + dy * sy + dz * sz)) r from n group by camera_id),
k as (select *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) det from s)"""


@query(f"""{ctes('rays')}, {_NORMAL} select camera_id, round((p * (d * f - e * e) + q * (c * e - b * f) + r * (b * e - c * d)) / det, 4) x,
 round((p * (c * e - b * f) + q * (a * f - c * c) + r * (b * c - a * e)) / det, 4) y from k where abs(det) > 1e-3""")
def ray_point_lstsq(spark, d):
    rays = scene.rays(spark, d).withColumn("direction", linalg.unit(linalg.sub(F.col("end"), F.col("start"))))
    return ray_ops.least_squares_point(rays, "camera_id").where("x is not null").select("camera_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


def _ray_groups(spark: SparkSession, d: str) -> DataFrame:
    return scene.rays(spark, d).withColumn("event_group", F.floor(F.col("ray_id") / 8))


@query(f"""{ctes('rays')}, {_ray_pairs("floor(a.ray_id / 8) = floor(b.ray_id / 8)")}, {_CLOSEST}
select floor(a / 8)::bigint event_group, round(avg(m.x), 4) x, round(avg(m.y), 4) y, round(avg(m.z), 4) z from closest group by 1""")
def ray_point_average(spark, d):
    """Mean closest point of each eight rays in a row."""
    found = ray_ops.average_point(_ray_groups(spark, d), "event_group")
    return found.select("event_group", *(F.round(k, 4).alias(k) for k in "xyz"))


@query("""with recursive links as (select distinct l_suppkey a, l_partkey + 1000000 b from lineitem), edges as (select a, b from links union all select b, a from links),
reach(node, component) using key (node) as (select distinct a, a from edges union select e.b, min(reach.component) from reach join edges e on e.a = reach.node
 join recurring.reach p on p.node = e.b where reach.component < p.component group by e.b) select node, component from reach""")
def connected_rays(spark, d):
    """Components of all links of suppliers and parts."""
    return graph.components(_links(spark, d))


def _links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000).alias("dst"))


def _all_links(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d).distinct()


@query()
def communities(spark, d):
    """Communities of all links of suppliers and parts."""
    return graph.communities(_all_links(spark, d).withColumn("weight", F.lit(1.0)))


@query(f"""{ctes('faces')}, b as (select min(x) x0, max(x) x1, min(y) y0, max(y) y1 from faces), t as (select z, (x - x0) / ((x1 - x0) / 6) u, (y - y0) / ((y1 - y0) / 6) v from faces, b),
i as (select z, v, unnest(case when u = floor(u) and u > 0 and u < 6 then [floor(u) - 1, floor(u)] else [least(floor(u), 5)] end)::bigint i from t),
j as (select z, i, unnest(case when v = floor(v) and v > 0 and v < 6 then [floor(v) - 1, floor(v)] else [least(floor(v), 5)] end)::bigint j from i),
h as (select i, j, max(z) t, min(z) l from j group by all) select 0::int surface_id, i, j, t + 1 z from h union all select 1, i, j, l - 2 from h""")
def covering_surface(spark, d):
    return ray_ops.covering_surfaces(scene.faces(spark, d), 6, (1.0, -2.0)).select("surface_id", "i", "j", "z")


# Rasters --------------------------------------------------------------------------------------------------------------


@query("select c col_off, r row_off, 64::bigint width, 64::bigint height from range(0, 500, 48) t(c), range(0, 300, 48) u(r)")
def windows(spark, d):
    return raster.windows(spark, 300, 500, 64, 48)


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return scene.faces(spark, d).select(F.col("y").cast("long").alias("row"), F.col("x").cast("long").alias("col"), (F.col("z") % 5).cast("long").alias("class_id"))


_CELLS = "cells as (select y::bigint row_, x::bigint col, (z % 5)::bigint class_id from faces)"


@query(f"""{ctes('faces')}, {_CELLS}, c as (select unnest(range(0, 50, 6)) col_off), r as (select unnest(range(0, 5000, 6)) row_off)
select col_off, row_off, count(*) n, sum((class_id > 0)::int)::bigint used from cells join c on col >= col_off and col < col_off + 8 join r on row_ >= row_off and row_ < row_off + 8 group by all having sum((class_id > 0)::int) > 0""")
def tile_cells(spark, d):
    cells = _cells(spark, d).withColumnRenamed("class_id", "value")
    return raster.chips(cells, 8, 6).groupBy("col_off", "row_off").agg(F.count("*").alias("n"), F.sum((F.col("value") > 0).cast("long")).alias("used"))


_RAMP = "least(1, greatest(0, least(i, 7 - i) / (8 * 0.25)), greatest(0, least(j, 7 - j) / (8 * 0.25)))"


@query(f"""{ctes('faces')}, {_CELLS}, c as (select unnest(range(0, 50, 15)) col_off), r as (select unnest(range(0, 5000, 15)) row_off),
t as (select row_, col, class_id, row_ - row_off i, col - col_off j, row_off, col_off from cells join c on col >= col_off and col < col_off + 20 join r on row_ >= row_off and row_ < row_off + 20),
p as (select row_, col, (class_id + (col_off + row_off) % 3) % 5 class_id, trunc(255 * least(5, i, 19 - i, j, 19 - j) / 20)::bigint w from t),
s as (select row_, col, class_id, sum(w) w from p group by all)
select row_ "row", col, (case when max(w) > 0 then arg_max(class_id, row(w, -class_id)) else 255 end)::bigint class_id from s group by all""")
def mosaic_max_class(spark, d):
    """Overlapping tiles that disagree, put together by ramp weights: 255 over four tiles is no whole number."""
    tiles = raster.tile_cells(_cells(spark, d), 20, 15)
    tiles = tiles.withColumn("class_id", (F.col("class_id") + (F.col("col_off") + F.col("row_off")) % 3) % 5)
    return raster.mosaic(tiles.withColumn("width", F.lit(20)).withColumn("height", F.lit(20)), 0.25, 4)


@query(f"select i, j, round({_RAMP}, 6) w from range(0, 8) t(i), range(0, 8) u(j)")
def ramp_weights(spark, d):
    grid = spark.range(8).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("j"))
    return grid.select("i", "j", F.round(raster.ramp_weight(F.col("i"), F.col("j"), F.lit(8), F.lit(8), 0.25), 6).alias("w"))


@query(f"""{ctes('faces', 'boxes')}, {_CELLS}, n as (select polygon_id, cells.class_id, count(*) n from cells join boxes on col + 0.5 > x0 and col + 0.5 < x1 and row_ + 0.5 > y0 and row_ + 0.5 < y1 group by all)
select polygon_id, class_id, n, round(n / sum(n) over (partition by polygon_id), 6) frac from n""")
def zonal_counts(spark, d):
    return raster.zonal_counts(_cells(spark, d), scene.boxes(spark, d).select("polygon_id", "geom"), normalise=True).withColumn("frac", F.round("frac", 6))


@query(f"{ctes('faces')} select floor(y / 3)::bigint \"row\", floor(x / 3)::bigint col, round(avg(z), 6) \"value\" from faces group by all")
def downsampled_raster(spark, d):
    cells = scene.faces(spark, d).select(F.col("y").cast("long").alias("row"), F.col("x").cast("long").alias("col"), F.col("z").alias("value"))
    return raster.downsampled(cells, 3).withColumn("value", F.round("value", 6))


@query(f"""{ctes('detections')}, px as (select camera_id, instance_id, label, unnest(range(imin::bigint, imax::bigint)) i, jmin, jmax from detections),
q as (select camera_id, instance_id, label, i, unnest(range(jmin::bigint, jmax::bigint)) j from px),
w as (select camera_id, i, j, arg_max(label, row(instance_id, label)) label from q group by all) select camera_id, label, count(*) n from w group by all""")
def detection_masks(spark, d):
    """Pixels of each label in each image; later boxes cover earlier ones."""
    masks = raster.rectangle_mask(scene.detections(spark, d).withColumn("image_path", F.col("camera_id")))
    return masks.groupBy(F.col("image_path").alias("camera_id"), "label").agg(F.count("*").alias("n"))


# Correspondence -------------------------------------------------------------------------------------------------------


def _seen(scale: float) -> str:
    """obs in SQL: pixels of cameras that look straight down, at an image scale."""
    w, h, f = int(800 * scale), int(600 * scale), 1000 * scale
    return f"""corners as (select face_id, a.x ax, a.y ay, a.z az, b.x bx, b.y by_, b.z bz, c.x cx, c.y cy, c.z cz, p_brand from mesh
 join vertices a on v0 = a.vertex_id join vertices b on v1 = b.vertex_id join vertices c on v2 = c.vertex_id),
drawn as (select camera_id, face_id, {w / 2} + {f} * (ax - x) / (z - az) px, {h / 2} - {f} * (ay - y) / (z - az) py, z - az pd, {w / 2} + {f} * (bx - x) / (z - bz) qx, {h / 2} - {f} * (by_ - y) / (z - bz) qy, z - bz qd,
 {w / 2} + {f} * (cx - x) / (z - cz) rx, {h / 2} - {f} * (cy - y) / (z - cz) ry, z - cz rd from corners, cameras where z > greatest(az, bz, cz)),
spans as (select *, greatest(0, ceil(least(py, qy, ry) - 0.5))::int i0, least({h - 1}, floor(greatest(py, qy, ry) - 0.5))::int i1, greatest(0, ceil(least(px, qx, rx) - 0.5))::int j0,
 least({w - 1}, floor(greatest(px, qx, rx) - 0.5))::int j1 from drawn),
rows_ as (select *, unnest(range(i0, i1 + 1))::int i from spans where i0 <= i1 and j0 <= j1), pixels as (select *, unnest(range(j0, j1 + 1))::int j from rows_),
sides as (select camera_id, i, j, face_id, pd, qd, rd, (rx - qx) * (i + 0.5 - qy) - (ry - qy) * (j + 0.5 - qx) wp, (px - rx) * (i + 0.5 - ry) - (py - ry) * (j + 0.5 - rx) wq,
 (qx - px) * (i + 0.5 - py) - (qy - py) * (j + 0.5 - px) wr from pixels),
seen as (select camera_id, i, j, arg_min(face_id, row(round((wp + wq + wr) / (wp / pd + wq / qd + wr / rd), 9), face_id)) face_id from sides
 where ((wp >= 0 and wq >= 0 and wr >= 0) or (wp <= 0 and wq <= 0 and wr <= 0)) and wp + wq + wr <> 0 group by camera_id, i, j)"""


_SEEN = _seen(0.25)


@query(f"{ctes('squares', 'cameras')}, {_SEEN} select camera_id, i, j, face_id from seen")
def zbuffer_raster(spark, d):
    """Faces of the part mesh in every camera at a quarter of the resolution, where a face has several pixels."""
    corner = scene.mesh_corners(*scene.grid_mesh(spark, d))
    return correspondence.visible_faces(scene.cameras(spark, d), corner, 0.25, None, 10.0)


@query(f"""{ctes('squares', 'cameras')}, {_SEEN} select camera_id, case when face_id % 7 > 0 then face_id % 7 end class_id, count(*) n from seen group by all""")
def rendered_labels(spark, d):
    """How many pixels of each camera show each class; some faces have none."""
    _, tri = scene.grid_mesh(spark, d)
    # one row for each face: parts that are there twice give a face twice, and the join would count its pixels as often
    value = tri.where("face_id % 7 > 0").select("face_id", (F.col("face_id") % 7).alias("class_id")).distinct()
    # a face's pixels are counted before they meet its class, so that no row for each pixel is shuffled
    shown = zbuffer_raster(spark, d).groupBy("camera_id", "face_id").agg(F.count("*").alias("n"))
    return correspondence.rendered(shown, value).groupBy("camera_id", "class_id").agg(F.sum("n").alias("n"))


# Workflows ------------------------------------------------------------------------------------------------------------


def _pixels(spark: SparkSession, d: str, scale: float) -> DataFrame:
    """A class, or none, for every pixel of every camera."""
    # dealt first: a table of cameras is one small file, and one task would make all pixels
    cameras = scene.cameras(spark, d).select("camera_id").repartition(200)
    grid = cameras.select("camera_id", F.explode(F.sequence(F.lit(0), F.lit(int(600 * scale) - 1))).alias("i"))
    grid = grid.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(int(800 * scale) - 1))))
    return grid.withColumn("class_id", (F.col("camera_id") + F.col("i") * 3 + F.col("j")) % 5).where("class_id < 4")


@query(f"""{ctes('squares', 'cameras')}, {_seen(0.1)}, last_ as (select camera_id, face_id, arg_max((camera_id + i * 3 + j) % 5, row(i, j)) class_id from seen where (camera_id + i * 3 + j) % 5 < 4 group by all),
n as (select face_id, class_id, count(*) n from last_ group by all)
select face_id, arg_max(class_id, row(n, -class_id))::bigint pred_class, sum(n)::double n_votes, sum(n)::bigint n_views from n group by face_id""")
def aggregated_images(spark, d):
    """Views to a map, end to end."""
    corner = scene.mesh_corners(*scene.grid_mesh(spark, d))
    found = workflows.aggregate_images(scene.cameras(spark, d), corner, _pixels(spark, d, 0.1), 0.1, None, 10.0)
    return found.withColumn("n_votes", F.col("n_votes").cast("double"))


@query(f"""{ctes('squares', 'cameras', 'boxes')}, {_seen(0.1)}, mid as (select face_id, (ax + bx + cx) / 3 x, (ay + by_ + cy) / 3 y from corners),
named as (select face_id, arg_max(class_id, polygon_id) class_id from mid join boxes on x > x0 and x < x1 and y > y0 and y < y1 group by face_id)
select camera_id, i, j, class_id from seen join named using (face_id)""")
def rendered_polygons(spark, d):
    """A map to views, end to end."""
    corner = scene.mesh_corners(*scene.grid_mesh(spark, d))
    return workflows.render_labels(scene.cameras(spark, d), corner, scene.boxes(spark, d).select("polygon_id", "class_id", "geom"), 0.1, None, 10.0)


@query(f"""{ctes('squares', 'cameras')}, {_seen(0.1)}, heights as (select face_id, (az + bz + cz) / 3 - 20 height from corners where face_id % 11 > 0)
select camera_id, i, j, (case when height is null then 0 when height <= 2 then 1 else 2 end)::int height_class from seen left join heights using (face_id)""")
def height_masks(spark, d):
    corner = scene.mesh_corners(*scene.grid_mesh(spark, d))
    heights = corner.where("face_id % 11 > 0").select("face_id", ((F.col("a.z") + F.col("b.z") + F.col("c.z")) / 3 - 20).alias("height"))
    return workflows.height_masks(correspondence.visible_faces(scene.cameras(spark, d), corner, 0.1, None, 10.0), heights, 2.0)


def _angled(spark: SparkSession, d: str) -> DataFrame:
    """L-shapes: the boxes without their upper right part."""
    p = lambda x, y: F.struct(F.expr(x).alias("x"), F.expr(y).alias("y"))
    ring = F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y0 + 5.25D"), p("x0 + 6.25D", "y0 + 5.25D"), p("x0 + 6.25D", "y1"), p("x0", "y1"))
    return scene.boxes(spark, d).withColumn("geom", F.array(ring))


#: Whether a unit right triangle of the mesh lies in an L-shape: all of it in the box, none of it in the part that is cut off.
_IN_L = """case when face_id % 2 = 0 then greatest(x0 + 6.25, ax) + greatest(y0 + 5.25, ay) >= ax + ay + 1 else not (ax > x0 + 6.25 and ay + 1 > y0 + 5.25) end"""


@query(f"""{ctes('squares', 'boxes')}, t as (select face_id, a.x ax, a.y ay, a.z az, b.x bx, b.y by_, b.z bz, c.x cx, c.y cy, c.z cz from mesh
 join vertices a on v0 = a.vertex_id join vertices b on v1 = b.vertex_id join vertices c on v2 = c.vertex_id),
n as (select *, (by_ - ay) * (cz - az) - (bz - az) * (cy - ay) nx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) ny, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) nz from t),
w as (select polygon_id, face_id % 5 class_id, round(sum(sqrt(nx * nx + ny * ny + nz * nz) / 2), 6) w from n join boxes
 on least(ax, bx, cx) > x0 and greatest(ax, bx, cx) < x1 and least(ay, by_, cy) > y0 and greatest(ay, by_, cy) < y1 and {_IN_L} where face_id % 5 < 4 group by all),
top as (select polygon_id, arg_max(class_id, row(w, -class_id)) pred_class from w group by polygon_id) select polygon_id, pred_class from boxes left join top using (polygon_id)""")
def labelled_polygons(spark, d):
    """The class of each L-shape by the true area of the faces within it."""
    vertices, tri = scene.grid_mesh(spark, d)
    value = tri.select("face_id", F.when(F.col("face_id") % 5 < 4, F.col("face_id") % 5).alias("pred_class"))
    return workflows.label_polygons(scene.mesh_corners(vertices, tri.drop("class_id")), value, _angled(spark, d), 10.0)


@query(f"""{ctes('boxes')}, cut(x0, y0, x1, y1, sign) as (values (0, 0, 12, 10, 1), (6.25, 5.25, 12, 10, -1), (2, 2, 4, 4, -1)),
parts as (select polygon_id b_id, b.x0 + 3 + cut.x0 x0, b.y0 + 2 + cut.y0 y0, b.x0 + 3 + cut.x1 x1, b.y0 + 2 + cut.y1 y1, sign from boxes b, cut),
shared as (select a.polygon_id a_id, b_id, sum(sign * greatest(0, least(a.x1, p.x1) - greatest(a.x0, p.x0)) * greatest(0, least(a.y1, p.y1) - greatest(a.y0, p.y0))) area from boxes a, parts p group by all)
select a_id, b_id, round(area, 6)::double area from shared where area > 1e-9""")
def overlap_of_angled(spark, d):
    """Boxes with moved L-shapes that have a hole."""
    moved = lambda g, dx, dy: F.transform(g, lambda r: F.transform(r, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y"))))
    hole = F.flatten(geometry.box(F.col("x0") + 2, F.col("y0") + 2, F.col("x0") + 4, F.col("y0") + 4))
    b = _angled(spark, d).select(F.col("polygon_id").alias("b_id"), moved(F.concat("geom", F.array(hole)), 3.0, 2.0).alias("b_geom"))
    a = scene.boxes(spark, d).select(F.col("polygon_id").alias("a_id"), F.col("geom").alias("a_geom"))
    return overlay.overlap_table(a, b, 10.0).withColumn("area", F.round("area", 6))


@query(f"""{ctes('boxes')}, xs as (select distinct unnest([x0, x1]) x from boxes), ys as (select distinct unnest([y0, y1]) y from boxes),
sx as (select x, lead(x) over (order by x) x_ from xs), sy as (select y, lead(y) over (order by y) y_ from ys),
held as (select distinct class_id, x, y, x_, y_ from sx, sy join boxes b on b.x0 < x_ and b.x1 > x and b.y0 < y_ and b.y1 > y) select class_id, round(sum((x_ - x) * (y_ - y)), 6) area from held group by class_id""")
def dissolved_area(spark, d):
    """The area that the boxes of each class cover together."""
    merged = overlay.dissolved(scene.boxes(spark, d).select("class_id", "geom"), "class_id", 16.0)
    return merged.groupBy("class_id").agg(F.round(F.sum(geometry.polygon_area(F.col("geom"))), 6).alias("area"))


@query(f"""{ctes('boxes')}, sized as (select *, (x1 - x0) * (y1 - y0) area from boxes), xs as (select distinct unnest([x0, x1]) x from boxes), ys as (select distinct unnest([y0, y1]) y from boxes),
sx as (select x, lead(x) over (order by x) x_ from xs), sy as (select y, lead(y) over (order by y) y_ from ys),
held as (select x, y, x_, y_, arg_min(polygon_id, row(round(area, 9), polygon_id)) polygon_id from sx, sy join sized b on b.x0 < x_ and b.x1 > x and b.y0 < y_ and b.y1 > y group by all)
select polygon_id, round(sum((x_ - x) * (y_ - y)), 6) area from held group by polygon_id""")
def polygons_apart(spark, d):
    """What each box keeps if the smallest has what several cover."""
    own = overlay.apart(scene.boxes(spark, d).select("polygon_id", "geom"), 16.0)
    return own.groupBy("polygon_id").agg(F.round(F.sum(geometry.polygon_area(F.col("geom"))), 6).alias("area"))


@query("""with t as (select o_orderkey, (o_orderkey % 97) / 4 j, (o_orderkey % 89) / 8 - 3 i, (o_orderkey % 13) / 4 w, (o_orderkey % 11) / 8 h from orders)
select o_orderkey, trunc(i)::int::double imin, trunc(j)::int::double jmin, trunc(i + h)::int::double imax, trunc(j + w)::int::double jmax from t""")
def boxes_of_text(spark, d):
    """Detections of fractional boxes, written as "[j, i, w, h]"."""
    k = F.col("o_orderkey")
    text = F.format_string("[%s, %s, %s, %s]", (k % 97) / 4, (k % 89) / 8 - 3, (k % 13) / 4, (k % 11) / 8)
    return table(spark, d, "orders").select("o_orderkey", F.explode(F.array(predictors.box_of_text(text))).alias("b")).select("o_orderkey", "b.*")


# Overlays, metrics, covers --------------------------------------------------------------------------------------------


@query("select quality::bigint true_label, toxic::bigint pred_label, count(*) amount from labels group by all")
def confusion_labels(spark, d):
    pairs = table(spark, d, "labels").select(F.col("quality").cast("long").alias("q"), F.col("toxic").cast("long").alias("t"))
    return metrics.confusion(pairs, "q", "t")


@query("""with cf as (select quality::bigint t, toxic::bigint p, count(*) n from labels group by all), l as (select t label from cf union select p from cf),
m as (select label, (select sum(n) from cf where t = label) num_true, (select sum(n) from cf where p = label) num_pred, (select sum(n) from cf where t = label and p = label) hit, (select sum(n) from cf) total from l)
select label, num_true::bigint num_true, num_pred::bigint num_pred, round(hit / num_true, 6) recall, round(coalesce(hit / num_pred, 0), 6) "precision", round((total - num_true - num_pred + 2 * hit) / total, 6) class_accuracy from m""")
def metrics_per_class(spark, d):
    out = metrics.per_class(confusion_labels(spark, d))
    return out.select("label", "num_true", "num_pred", *(F.round(c, 6).alias(c) for c in ("recall", "precision", "class_accuracy")))


_SHARED = """shared as (select a.polygon_id a_id, b.polygon_id b_id, greatest(0, least(a.x1, b.x1 + 3) - greatest(a.x0, b.x0 + 3)) * greatest(0, least(a.y1, b.y1 + 2) - greatest(a.y0, b.y0 + 2)) area,
 a.class_id ac, b.class_id bc from boxes a, boxes b)"""


def _moved(spark: SparkSession, d: str) -> DataFrame:
    b = scene.boxes(spark, d)
    return b.select(F.col("polygon_id").alias("b_id"), geometry.box(F.col("x0") + 3, F.col("y0") + 2, F.col("x1") + 3, F.col("y1") + 2).alias("b_geom"), F.col("class_id").alias("b_class"))


@query(f"{ctes('boxes')}, {_SHARED} select a_id, b_id, round(area, 6) area from shared where area > 1e-12")
def vector_overlap(spark, d):
    a = scene.boxes(spark, d).select(F.col("polygon_id").alias("a_id"), F.col("geom").alias("a_geom"))
    return overlay.overlap_table(a, _moved(spark, d), 10.0).withColumn("area", F.round("area", 6))


@query(f"""{ctes('boxes')}, {_SHARED}, cf as (select ac true_label, bc::varchar pred_label, sum(area) amount from shared where area > 1e-12 group by all),
whole as (select class_id true_label, sum((x1 - x0) * (y1 - y0)) amount from boxes group by all), rest as (select true_label, 'unlabelled' pred_label, whole.amount - c amount from whole join (select true_label, sum(amount) c from cf group by all) using (true_label))
select true_label, pred_label, round(amount, 4) amount from (from cf union all from rest)""")
def confusion_area(spark, d):
    """Areas of truth classes by predicted class, and what predictions leave uncovered."""
    b = scene.boxes(spark, d)
    shared = vector_overlap(spark, d).join(b.select(F.col("polygon_id").alias("a_id"), F.col("class_id").alias("true_label")), "a_id")
    cf = shared.join(_moved(spark, d).select("b_id", F.col("b_class").alias("pred_label")), "b_id").groupBy("true_label", "pred_label").agg(F.sum("area").alias("amount"))
    whole = b.groupBy(F.col("class_id").alias("true_label")).agg(F.sum(geometry.polygon_area(F.col("geom"))).alias("amount"))
    return metrics.with_unlabelled(cf, whole).withColumn("amount", F.round("amount", 4))


@query("select l_partkey face_id, p_name, p_brand brand, sum(l_quantity)::bigint quantity from lineitem join part on l_partkey = p_partkey group by all")
def join_attributes(spark, d):
    summed = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("face_id")).agg(F.sum("l_quantity").cast("long").alias("quantity"))
    return summed.join(table(spark, d, "part").select(F.col("p_partkey").alias("face_id"), "p_name", F.col("p_brand").alias("brand")), "face_id")


@query()
def min_cover_greedy(spark, d):
    """Suppliers that together cover every part that at least two of them ship."""
    sees = scene.obs(spark, d).select(F.col("camera_id").alias("image_id"), "face_id")
    return graph.greedy_cover(sees, 2)


@query()
def kmeans_chunks(spark, d):
    return graph.camera_chunks(scene.cameras(spark, d), 4)


@query(f"""{ctes('squares')}, f as (select face_id, p_brand class_id, v0, v1, v2 from mesh),
e as (select class_id, least(v0, v1) v, greatest(v0, v1) w from f union all select class_id, least(v1, v2), greatest(v1, v2) from f union all select class_id, least(v2, v0), greatest(v2, v0) from f)
select class_id, v, w from e group by all having count(*) = 1""")
def boundary_edges(spark, d):
    squares = scene.spread(scene.squares(spark, d).select("face_id", "brand"))
    k = F.col("face_id")
    corners = ((k, k + 1, k + 50), (k + 1, k + 51, k + 50))
    tri = F.array(*(F.struct((2 * k + n).alias("face_id"), *(v.alias(f"v{m}") for m, v in enumerate(c)), F.col("brand").alias("class_id")) for n, c in enumerate(corners)))
    return overlay.boundary_edges(squares.select(F.explode(tri).alias("t")).select("t.*"), squares.rdd.getNumPartitions())


@query(f"""{ctes('faces', 'boxes')}, c as (select x, y, polygon_id, (x1 - x0) * (y1 - y0) + polygon_id % 3 area from faces join boxes on x > x0 and x < x1 and y > y0 and y < y1)
select x, y, arg_min(polygon_id, row(area, polygon_id)) polygon_id from c group by all""")
def non_overlap(spark, d):
    """Where several boxes cover a cell, the smallest keeps it."""
    held = spatial.points_in_polygons(scene.faces(spark, d).select("x", "y"), scene.boxes(spark, d).select("polygon_id", "geom"), 10.0)
    return overlay.without_overlap(held.withColumn("area", geometry.polygon_area(F.col("geom")) + F.col("polygon_id") % 3))


@query("select event_id, json_extract_string(props, '$.k') k from events")
def json_labels(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
