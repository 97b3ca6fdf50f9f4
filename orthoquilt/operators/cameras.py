"""Camera sets as rows: camera(camera_id, image_filename, cam_to_world, f, cx, cy, image_width, image_height, ...).

Camera axes: x right, y down, z forward; cx and cy count from the image's centre; pixels are (i row, j column).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orthoquilt.functions import crs, geometry, linalg
from orthoquilt.functions.linalg import let, vec
from orthoquilt.relations import checkpointed


def every_nth(cameras: DataFrame, n: int, first: int = 0) -> DataFrame:
    """Every nth camera by id, where ids are dense positions."""
    return cameras.where(F.pmod(F.col("camera_id") - first, F.lit(n)) == 0)


def in_folder(cameras: DataFrame, folder: str, column: str = "image_filename") -> DataFrame:
    return cameras.where(F.col(column).startswith(folder.rstrip("/") + "/"))


def matching(cameras: DataFrame, pattern: str, column: str = "image_filename") -> DataFrame:
    return cameras.where(F.col(column).rlike(pattern))


def in_region(cameras: DataFrame, rings: Column, buffer: float = 0.0) -> DataFrame:
    """Cameras (x, y) inside one polygon (a Column without references), or within `buffer` of it; a bounding box is tested first."""
    points = F.flatten(rings)
    low = lambda k: F.array_min(F.transform(points, lambda p: p[k])) - buffer
    high = lambda k: F.array_max(F.transform(points, lambda p: p[k])) + buffer
    near = F.col("x").between(low("x"), high("x")) & F.col("y").between(low("y"), high("y"))
    return cameras.where(near & geometry.within(F.col("x"), F.col("y"), rings, buffer))


def missing(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Rows of wanted whose key is not present (missing images, invalid label files)."""
    return wanted.join(present.select(key).distinct(), key, "left_anti")


def required(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """wanted, or an error that names some of its keys that are not present."""
    lost = [r[0] for r in missing(wanted, present, key).select(key).distinct().orderBy(key).limit(5).collect()]
    if lost:
        raise ValueError(f"not present: {', '.join(map(str, lost))}")
    return wanted


def lon_lat(cameras: DataFrame, exif: DataFrame, negate: bool = True) -> DataFrame:
    """camera_id, lon and lat: the camera's own (columns lon, lat, if it has them), else those of its image's EXIF (path, lon, lat), whose degrees have
    no sign: `negate` takes them as west."""
    sign = -1 if negate else 1
    tags = exif.select(F.col("path").alias("image_filename"), (F.col("lon") * sign).alias("__lon"), F.col("lat").alias("__lat"))
    own = {k: F.col(k) if k in cameras.columns else F.lit(None).cast("double") for k in ("lon", "lat")}
    joined = cameras.join(tags, "image_filename", "left")
    return joined.select("camera_id", *(F.coalesce(own[k], F.col(f"__{k}")).alias(k) for k in ("lon", "lat")))


def common_root(paths: DataFrame, column: str = "image_filename") -> str:
    """The longest directory that all paths share: agreeing leading segments of the least and the greatest path."""
    low, high = paths.agg(F.min(column), F.max(column)).first()
    if low is None:
        return ""
    shared = []
    for a, b in zip(low.split("/")[:-1], high.split("/")[:-1]):
        if a != b:
            break
        shared.append(a)
    return "/".join(shared)


def rebased(path: Column, old: str, new: str) -> Column:
    """The path with folder old replaced by new; an error if it does not lie there."""
    old = old.rstrip("/")
    return F.when(path.startswith(old + "/"), F.concat(F.lit(new.rstrip("/")), F.substring(path, F.lit(len(old) + 1), F.length(path)))).otherwise(
        F.raise_error(F.concat(path, F.lit(f" is not in {old}")))
    )


def stem(path: Column) -> Column:
    """The path without its suffix."""
    return F.regexp_replace(path, r"\.[^./]*$", "")


def with_suffix(path: Column, suffix: str) -> Column:
    return F.concat(stem(path), F.lit(suffix))


def location(m: Column) -> Column:
    return vec(linalg.entry(m, 0, 3), linalg.entry(m, 1, 3), linalg.entry(m, 2, 3))


def view_direction(m: Column) -> Column:
    return linalg.unit(linalg.turn(m, vec(0, 0, 1)))


def view_angles(direction: Column) -> Column:
    """(across, along) degrees between a view direction in a metric frame and the nadir, in the x-z and the y-z plane."""
    return F.struct(
        F.degrees(F.atan2(direction["x"], -direction["z"])).alias("across"), F.degrees(F.atan2(direction["y"], -direction["z"])).alias("along")
    )


def locations(cameras: DataFrame, local_to_ecef: Column, epsg: int) -> DataFrame:
    """camera_id, x, y, z of the cameras in a coordinate system, by way of earth-centred coordinates."""
    at = let(linalg.named(m=local_to_ecef, p=location(F.col("cam_to_world"))), lambda g: linalg.apply(g["m"], g["p"]))
    found = cameras.select("camera_id", F.explode(F.array(let(at, lambda p: crs.convert(p, crs.ECEF, epsg)))).alias("p"))
    return found.select("camera_id", "p.x", "p.y", "p.z")


def local_view_angles(cameras: DataFrame, local_to_ecef: Column) -> DataFrame:
    """camera_id, across and along: the angles between view and nadir in the metric frame (east, north, up) at each camera."""
    m = let(linalg.named(a=local_to_ecef, b=F.col("cam_to_world")), lambda g: linalg.product(g["a"], g["b"]))
    posed = cameras.select("camera_id", F.explode(F.array(m)).alias("m"))
    seen = posed.select("camera_id", F.explode(F.array(linalg.named(d=view_direction(F.col("m")), g=crs.from_ecef(location(F.col("m")))))).alias("v"))
    lon, lat, d = F.radians("v.g.x"), F.radians("v.g.y"), F.col("v.d")
    east = vec(-F.sin(lon), F.cos(lon), F.lit(0.0))
    north = vec(-F.sin(lat) * F.cos(lon), -F.sin(lat) * F.sin(lon), F.cos(lat))
    up = vec(F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat))
    local = seen.select("camera_id", F.explode(F.array(vec(linalg.dot(d, east), linalg.dot(d, north), linalg.dot(d, up)))).alias("d"))
    return local.select("camera_id", F.explode(F.array(view_angles(F.col("d")))).alias("a")).select("camera_id", "a.across", "a.along")


def project(m_inverse: Column, p: Column, f: Column, cx: Column, cy: Column, width: Column, height: Column) -> Column:
    """World point -> (x, y, depth) in pixels."""
    local = let(linalg.named(m=m_inverse, p=p), lambda g: linalg.apply(g["m"], g["p"]))
    return let(local, lambda q: F.struct(
        F.try_divide(q["x"] * f, q["z"]).__add__(width / 2 + cx).alias("x"),
        F.try_divide(q["y"] * f, q["z"]).__add__(height / 2 + cy).alias("y"), q["z"].alias("depth")))


def in_frame(pixel: Column, width: Column, height: Column) -> Column:
    return (pixel["depth"] > 0) & (pixel["x"] > 0) & (pixel["x"] < width) & (pixel["y"] > 0) & (pixel["y"] < height)


def cast_ray(m: Column, i: Column, j: Column, f: Column, cx: Column, cy: Column, width: Column, height: Column, length: Column) -> Column:
    """(start, end, direction) of the ray through pixel (i, j), of the given length."""
    local = linalg.unit(vec((j - (width / 2 + cx)) / f, (i - (height / 2 + cy)) / f, 1))
    ends = let(local, lambda d: linalg.named(s=linalg.apply(m, vec(0, 0, 0)), e=linalg.apply(m, linalg.scaled(d, length))))
    return let(ends, lambda r: linalg.named(start=r["s"], end=r["e"], direction=linalg.unit(linalg.sub(r["e"], r["s"]))))


def detection_rays(cameras: DataFrame, detections: DataFrame, length: float, max_angle: float | None = None) -> DataFrame:
    """Rays of detections (image_filename, instance_id, i, j): ray_id, camera_id, start, end, direction. A max_angle (degrees
    from the vertical) drops flatter ones."""
    pose = cameras.select("camera_id", "image_filename", "cam_to_world", "f", "cx", "cy", "image_width", "image_height")
    col = F.col
    ray = cast_ray(
        col("cam_to_world"), col("i"), col("j"), col("f"), col("cx"), col("cy"), col("image_width"), col("image_height"), F.lit(float(length))
    )
    rays = detections.join(pose, "image_filename").select(F.col("instance_id").alias("ray_id"), "camera_id", F.explode(F.array(ray)).alias("r"))
    rays = rays.select("ray_id", "camera_id", "r.*")
    return rays if max_angle is None else rays.where(F.degrees(F.acos(F.least(F.lit(1.0), F.abs(F.col("direction.z"))))) <= max_angle)


def rig(cameras: DataFrame, orientations: DataFrame, suffix: str = "_y%03d_p%03d_r%03d") -> DataFrame:
    """Each camera at each orientation (yaw, pitch, roll in degrees), camera-major: new ids, transforms and filenames.
    The orientations are a short list by nature, so they travel with each camera's row."""
    short = orientations.select("yaw", "pitch", "roll").collect()
    list_ = F.array(*(F.struct(F.lit(k).alias("k"), *(F.lit(float(v)).alias(n) for n, v in zip(("yaw", "pitch", "roll"), r))) for k, r in enumerate(short)))
    wide = cameras.withColumn("o", F.explode(list_))
    turned = linalg.product(F.col("cam_to_world"), linalg.roll_pitch_yaw(F.col("o.roll"), F.col("o.pitch"), F.col("o.yaw")))
    tag = F.format_string(suffix, *(F.round(F.col(f"o.{n}")).cast("int") for n in ("yaw", "pitch", "roll")))
    name = F.concat(stem(F.col("image_filename")), tag, F.regexp_extract("image_filename", r"\.[^./]*$", 0))
    return wide.select(
        (F.col("camera_id") * len(short) + F.col("o.k")).alias("camera_id"), F.col("camera_id").alias("source_id"), name.alias("image_filename"),
        turned.alias("cam_to_world"), *(c for c in cameras.columns if c not in ("camera_id", "image_filename", "cam_to_world")),
    )


def frustum(m: Column, f: Column, width: Column, height: Column, depth: float = 1.0) -> Column:
    """The five vertices of a camera's pyramid in the world: apex, then corners."""
    corner = lambda sx, sy: linalg.apply(m, vec(width / 2 * sx * depth / f, height / 2 * sy * depth / f, depth))
    return F.array(location(m), corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))


def vertical_fov(f: Column, height: Column) -> Column:
    return F.degrees(2 * F.atan(height / 2 / f))


def camera_hash(cameras: DataFrame, columns: list[str]) -> DataFrame:
    """camera_id and a digest of the named columns as JSON."""
    return cameras.select("camera_id", F.sha2(F.to_json(F.struct(*sorted(columns))), 256).alias("hash"))


def dense_ids(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with dense positions by the order: ranks within ranges plus the counts of the ranges before, so no task sorts all rows."""
    ranged = checkpointed(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    counts = ranged.groupBy("__p").agg(F.count("*").alias("__n")).orderBy("__p").collect()  # a row for each partition
    starts, at = [], 0
    for r in counts:
        starts += [F.lit(r[0]), F.lit(at)]
        at += r[1]
    rank = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    base = F.try_element_at(F.create_map(*starts), F.col("__p")) if starts else F.lit(0)
    return ranged.withColumn(name, (rank + base).cast("long")).drop("__p")
