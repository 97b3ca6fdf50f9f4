"""Vector layers, label maps, detections, images and arrays: readers and writers."""

from __future__ import annotations

import ast
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoquilt.operators.cameras import dense_ids
from orthoquilt.operators.predictors import box_of_text
from orthoquilt.relations import RINGS


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """feature_id, part, the named properties, and geom (rings of points) of polygons, multipolygons and points, a row for each polygon."""
    files = spark.read.text(path, wholetext=True)
    feature = f"struct<properties: struct<{properties}>, geometry: struct<type: string, coordinates: string>>"
    parsed = files.select(F.posexplode(F.from_json("value", f"features array<{feature}>")["features"]).alias("feature_id", "f"))
    g = F.col("f.geometry")
    polygon = F.from_json(g["coordinates"], "array<array<array<double>>>")
    many = F.from_json(g["coordinates"], "array<array<array<array<double>>>>")
    point = F.from_json(g["coordinates"], "array<double>")
    parts = F.when(g["type"] == "Polygon", F.array(polygon)).when(g["type"] == "MultiPolygon", many).when(g["type"] == "Point", F.array(F.array(F.array(point))))
    rows = parsed.select(F.col("feature_id").cast("long").alias("feature_id"), "f.properties", F.posexplode_outer(parts).alias("part", "rings"))
    at = lambda p, k: F.get(p, F.lit(k))
    geom = F.transform("rings", lambda r: F.transform(r, lambda p: F.struct(at(p, 0).alias("x"), at(p, 1).alias("y")))).cast(RINGS)
    return rows.select("feature_id", "part", "properties.*", geom.alias("geom"))


def feature_json(geom: Column, properties: list[str]) -> Column:
    """A GeoJSON feature; rings are closed."""
    rings = F.transform(geom, lambda r: F.transform(F.concat(r, F.slice(r, 1, 1)), lambda p: F.array(p["x"], p["y"])))
    return F.to_json(
        F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates")).alias("geometry"))
    )


def write_geojson(df: DataFrame, path: str, properties: list[str], geom: str = "geom") -> None:
    """One feature a line, in as many files as df has partitions."""
    df.select(feature_json(F.col(geom), properties).alias("value")).write.text(path)


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """class_id and name of a JSON object with whole-number keys."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "name"))
    return rows.select(F.col("k").cast("long").alias("class_id"), "name")


def label_map_json(labels: DataFrame) -> DataFrame:
    """One row, the dictionary as a JSON object; no row for an empty dictionary."""
    pairs = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("class_id").cast("int").alias("k"), F.col("name").alias("v")))))
    return labels.groupBy().agg(F.count("*").alias("n"), F.to_json(pairs).alias("value")).where("n > 0").select("value")


def read_detections(spark: SparkSession, path: str, image: str = "image_path", label: str = "label", box: str | None = None) -> DataFrame:
    """detection rows of one CSV file or a folder of them. Instance ids are 0, 1, 2, ... by file name and position; `box` names a column
    such as "[j, i, w, h]", otherwise imin, jmin, imax, jmax are columns."""
    raw = spark.read.option("header", True).csv(path).select(
        "*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__row")
    )
    raw = dense_ids(raw, "__id", "__file", "__block", "__row")  # ids grow within a block of a file
    if box:
        raw = raw.withColumn("__b", box_of_text(F.col(box))).select("*", "__b.*")
    return raw.select(
        F.col("__id").alias("instance_id"), F.col(image).alias("image_path"), F.col(label).alias("label"), *(F.col(c).cast("double").alias(c) for c in ("imin", "jmin", "imax", "jmax"))
    )


def write_detections(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def parse_npy(data: bytes) -> np.ndarray:
    """A plain array of an npy file's bytes (no objects)."""
    if data[:6] != b"\x93NUMPY":
        raise ValueError("not an npy file")
    wide = data[6] > 1
    (n,) = struct.unpack_from("<I" if wide else "<H", data, 8)
    start = 12 if wide else 10
    head = ast.literal_eval(data[start : start + n].decode("latin1"))
    kind = np.dtype(head["descr"])
    if kind.hasobject:
        raise ValueError("arrays of objects are not read")
    return np.frombuffer(data, kind, offset=start + n).reshape(head["shape"], order="F" if head["fortran_order"] else "C")


def array_pixels(files: DataFrame) -> DataFrame:
    """path, i, j, channel, value of npy files (path, content) of two or three axes; not finite: null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                a = parse_npy(data.as_py()).astype(float)
                a = a[:, :, None] if a.ndim == 2 else a
                for top in range(0, a.shape[0], 256):
                    part = a[top : top + 256]
                    i, j, c = (x.ravel() for x in np.indices(part.shape))
                    v = part.ravel()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * len(v), pa.string()), pa.array(i + top, pa.int32()), pa.array(j, pa.int32()), pa.array(c, pa.int32()), pa.array(v, mask=~np.isfinite(v))],
                        ["path", "i", "j", "channel", "value"],
                    )

    return files.select("path", "content").mapInArrow(run, "path string, i int, j int, channel int, value double")


def images(spark: SparkSession, path: str) -> DataFrame:
    """path, height, width, channels and data (0 to 1, channels as red, green, blue) of PNG, JPEG, TIFF, BMP and GIF files."""
    raw = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for h, w, c, data in zip(*(batch.column(k).to_pylist() for k in ("height", "width", "nChannels", "data")), strict=True):
                a = np.frombuffer(data, np.uint8).reshape(h, w, c).astype(float) / 255
                found.append((a[:, :, 2::-1] if c == 3 else a).ravel())
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.names.index(n)) for n in ("origin", "height", "width", "nChannels")] + [pa.array(found, pa.list_(pa.float64()))], ["path", "height", "width", "channels", "data"]
            )

    return raw.mapInArrow(run, "path string, height int, width int, channels int, data array<double>")


def render_value(value: Column, null: int = 0, bits: int = 8) -> Column:
    """A rendered value as an unsigned whole number of 8, 16 or 32 bits; what does not fit, and null, becomes `null`."""
    ok = value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value <= (1 << bits) - 1)
    return F.when(ok, F.floor(value)).otherwise(null).cast("long")


def write_renders(rendered: DataFrame, path: str) -> None:
    """Parquet in a folder for each camera."""
    rendered.repartition("camera_id").write.partitionBy("camera_id").parquet(path)
