"""Camera files: the XML of a photogrammetry project, COLMAP text models, and positions in EXIF."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoquilt.functions import linalg
from orthoquilt.functions.crs import dms_to_degrees

_CALIBRATION = "struct<_class: string, resolution: struct<_width: int, _height: int>, f: double, cx: double, cy: double, " + ", ".join(
    f"{k}: double" for k in ("b1", "b2", "k1", "k2", "k3", "k4", "p1", "p2")
) + ">"
_SENSOR = f"_id int, resolution struct<_width: int, _height: int>, calibration array<{_CALIBRATION}>"
_CAMERA = "_id int, _sensor_id int, _component_id string, _label string, transform string"
_COMPONENT = "_id string, transform struct<rotation: string, translation: string, scale: string>"


def numbers(text: Column) -> Column:
    """The doubles of a text with blanks between them."""
    return F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != ""), lambda x: x.cast("double"))


def _xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def sensors(spark: SparkSession, path: str, defaults: dict[str, float] | None = None) -> DataFrame:
    """sensor_id, f, cx, cy, image_width, image_height, distortion: the adjusted calibration, else the defaults; sensors with
    neither are left out."""
    default = defaults or {}
    raw = _xml(spark, path, "sensor", _SENSOR).where("_id is not null")
    adjusted = F.get(F.filter(F.coalesce("calibration", F.array()), lambda c: c["_class"] == "adjusted"), F.lit(0))
    out = raw.select(F.col("_id").alias("sensor_id"), "resolution", F.explode(F.array(adjusted)).alias("c"))
    names = ("b1", "b2", "k1", "k2", "k3", "k4", "p1", "p2")
    pairs = F.map_filter(F.create_map(*(x for n in names for x in (F.lit(n), F.col(f"c.{n}")))), lambda _, v: v.isNotNull())
    value = lambda n: F.coalesce(F.col(f"c.{n}"), F.lit(default.get(n)).cast("double"))
    size = lambda n: F.coalesce(F.col(f"resolution._{n}"), F.col(f"c.resolution._{n}")).cast("int")
    found = out.select(
        "sensor_id", value("f").alias("f"), F.coalesce(value("cx"), F.lit(0.0)).alias("cx"), F.coalesce(value("cy"), F.lit(0.0)).alias("cy"),
        size("width").alias("image_width"), size("height").alias("image_height"), pairs.alias("distortion"),
    )
    return found.where("f is not null")


def components(spark: SparkSession, path: str) -> DataFrame:
    """component_id and its 4x4 transform (null where the file gives none)."""
    raw = _xml(spark, path, "component", _COMPONENT).where("_id is not null")
    t = F.col("transform")
    built = linalg.from_parts(numbers(t["rotation"]), numbers(t["translation"]), t["scale"].cast("double"))
    return raw.select(F.col("_id").alias("component_id"), F.when(t["rotation"].isNotNull(), built).alias("local_to_ecef"))


def project_cameras(spark: SparkSession, path: str, active: str | None = None, folder: str = "", suffix: str = "", defaults: dict[str, float] | None = None) -> DataFrame:
    """camera rows of aligned cameras, grouped or not, of the active component; cameras without a valid sensor are left out."""
    raw = _xml(spark, path, "camera", _CAMERA).where("transform is not null and _id is not null")
    if active is not None:
        raw = raw.where(F.coalesce("_component_id", F.lit(active)) == active)
    name = F.concat(F.lit(folder.rstrip("/") + "/" if folder else ""), F.col("_label"), F.lit(suffix))
    rows = raw.select(
        F.col("_id").cast("long").alias("camera_id"), F.col("_sensor_id").alias("sensor_id"), F.col("_component_id").alias("component_id"), name.alias("image_filename"), numbers(F.col("transform")).alias("cam_to_world")
    )
    return rows.where(F.size("cam_to_world") == 16).join(sensors(spark, path, defaults), "sensor_id")


def mesh_metadata(spark: SparkSession, path: str) -> tuple[str | None, tuple[float, ...]]:
    """The CRS text and the shift of a mesh's sidecar file."""
    row = _xml(spark, path, "ModelMetadata", "SRS string, SRSOrigin string").first()
    if row is None:
        return None, (0.0, 0.0, 0.0)
    return row["SRS"], tuple(map(float, (row["SRSOrigin"] or "0,0,0").split(",")))


def colmap_cameras(spark: SparkSession, cameras: str, images: str, folder: str = "") -> DataFrame:
    """camera rows of a COLMAP text model with SIMPLE_RADIAL sensors. Pose lines of images.txt are those that end in a file name after nine
    numbers; the lines of points between them do not. Principal points become offsets from the centre."""
    word = F.split(F.trim("value"), r"\s+")
    lines = lambda path: spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')")
    at = lambda k, kind="double": F.get(word, F.lit(k)).cast(kind)
    model = F.get(word, F.lit(1))
    ok = F.when(model == "SIMPLE_RADIAL", at(4)).otherwise(F.raise_error(F.concat(F.lit("unknown camera model "), model)).cast("double"))
    sensor = lines(cameras).select(
        at(0, "int").alias("sensor_id"), at(2, "int").alias("image_width"), at(3, "int").alias("image_height"), ok.alias("f"), (at(5) - at(2) / 2).alias("cx"), (at(6) - at(3) / 2).alias("cy"),
        F.create_map(F.lit("r"), at(7)).alias("distortion"),
    )
    poses = lines(images).where(r"value rlike '^\\s*\\d+(\\s+[-+0-9.eE]+){7}\\s+\\d+\\s+\\S*[^-+0-9.eE\\s]\\S*\\s*$'")
    world_to_cam = linalg.from_quaternion(*(at(k) for k in range(1, 8)))
    rows = poses.select(
        at(0, "long").alias("camera_id"), at(8, "int").alias("sensor_id"), F.concat(F.lit(folder.rstrip("/") + "/" if folder else ""), F.get(word, F.lit(9))).alias("image_filename"), world_to_cam.alias("w")
    )
    return rows.select("camera_id", "sensor_id", "image_filename", linalg.inverse(F.col("w")).alias("cam_to_world")).join(sensor, "sensor_id")


def colmap_points(spark: SparkSession, path: str) -> DataFrame:
    word = F.split(F.trim("value"), r"\s+")
    at = lambda k, kind: F.get(word, F.lit(k)).cast(kind)
    rows = spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')")
    return rows.select(at(0, "long").alias("point_id"), *(at(k + 1, "double").alias(c) for k, c in enumerate("xyz")), *(at(k + 4, "int").alias(c) for k, c in enumerate("rgb")))


def exif_position(data: bytes) -> tuple[float, ...] | None:
    """(lon d, m, s, lat d, m, s) of the GPS tags in a JPEG or TIFF file's bytes; None without."""
    at = data.find(b"Exif\0\0")
    base = at + 6 if at >= 0 else 0
    order = {b"II": "<", b"MM": ">"}.get(data[base : base + 2])
    if not order:
        return None
    read = lambda kind, p: struct.unpack_from(order + kind, data, base + p)

    def entries(p: int) -> dict[int, tuple[int, int]]:
        (n,) = read("H", p)
        return {read("H", p + 2 + 12 * k)[0]: (read("I", p + 2 + 12 * k + 4)[0], p + 2 + 12 * k + 8) for k in range(n)}

    try:
        main = entries(read("I", 4)[0])
        if 0x8825 not in main:
            return None
        gps = entries(read("I", main[0x8825][1])[0])
        out: list[float] = []
        for tag in (4, 2):
            p = read("I", gps[tag][1])[0]
            out += [a / b if b else 0.0 for a, b in (read("II", p + 8 * k) for k in range(3))]
        return tuple(out)
    except (KeyError, struct.error):
        return None


def exif_positions(files: DataFrame) -> DataFrame:
    """path, lon, lat of image files (path, content); hemispheres are not told apart, as in the files' unsigned degrees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([exif_position(data.as_py() or b"") for data in batch.column(1)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["path", "v"])

    rows = files.select("path", "content").mapInArrow(run, "path string, v array<double>")
    at = lambda k: F.get("v", F.lit(k))
    return rows.select("path", dms_to_degrees(at(0), at(1), at(2)).alias("lon"), dms_to_degrees(at(3), at(4), at(5)).alias("lat"))
