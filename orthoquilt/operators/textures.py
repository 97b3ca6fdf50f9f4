"""Textures: values of a mesh's faces or vertices, texture(id, value array<double>), and where they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orthoquilt.operators import spatial, votes
from orthoquilt.sources import rasters, vectors


def standardised(values: DataFrame, key: str, column: str = "value") -> DataFrame:
    """key and value as an array of channels: a number becomes one channel, an array of numbers stays; anything else is an error."""
    kind = values.schema[column].dataType
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
        return values.select(key, F.col(column).cast("array<double>").alias("value"))
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return values.select(key, F.array(F.col(column).cast("double")).alias("value"))
    raise ValueError(f"a texture has one or two dimensions, not {kind.simpleString()}")


def one_channel(texture: DataFrame) -> DataFrame:
    """texture, with equal channels (a single one that was repeated for saving) taken together if they are equal in every row."""
    if texture.where(F.size(F.array_distinct("value")) > 1).take(1):
        return texture
    return texture.withColumn("value", F.slice("value", 1, 1))


def belongs_to(n_values: int, n_faces: int, n_vertices: int) -> str:
    """"face" or "vertex", by the number of values; an error if that does not tell."""
    if n_faces == n_vertices:
        raise ValueError("as many faces as vertices: say which of them have the texture")
    if n_values not in (n_faces, n_vertices):
        raise ValueError(f"{n_values} values for {n_faces} faces or {n_vertices} vertices")
    return "face" if n_values == n_faces else "vertex"


def set_texture(values: DataFrame, faces: DataFrame, vertices: DataFrame, column: str = "value", of: str | None = None) -> tuple[str, DataFrame]:
    """(whose, texture) of values with their positions in the column `id`; without `of`, counts tell whose they are."""
    whose = of or belongs_to(values.count(), faces.count(), vertices.count())
    return whose, standardised(values, "id", column).withColumnRenamed("id", f"{whose}_id")


def get_texture(face_texture: DataFrame | None, vertex_texture: DataFrame | None, faces: DataFrame, of: str | None = None, discrete: bool = True, convert: bool = True) -> DataFrame | None:
    """The texture of faces (face_id, value) or vertices (vertex_id, value), from the other one if need be: the value of most corners, or their mean
    if it is not discrete; the mean of a vertex's faces. None if there is neither; an error if there are both and none is named."""
    if face_texture is None and vertex_texture is None:
        return None
    if of is None:
        if face_texture is not None and vertex_texture is not None:
            raise ValueError("faces and vertices have a texture: say which is wanted")
        of = "face" if face_texture is not None else "vertex"
    own, other = (face_texture, vertex_texture) if of == "face" else (vertex_texture, face_texture)
    if own is not None:
        return standardised(own, f"{of}_id")
    if not convert:
        raise ValueError(f"there is no {of} texture")
    long = standardised(other, "vertex_id" if of == "face" else "face_id").select("*", F.posexplode("value").alias("channel", "v")).drop("value")
    corner = faces.select("face_id", F.explode(F.array("v0", "v1", "v2")).alias("vertex_id"))
    met = corner.join(long, "vertex_id" if of == "face" else "face_id")
    if of == "face" and discrete:
        counted = met.where("v is not null").groupBy("face_id", "channel", F.col("v").alias("class_id")).agg(F.count("*").cast("double").alias("n"))
        best = counted.groupBy("face_id", "channel").agg(F.max(F.struct("n", (-F.col("class_id")).alias("c"))).alias("b"))
        value = best.select("face_id", "channel", (-F.col("b.c")).alias("v"))
    else:
        value = met.groupBy(f"{of}_id", "channel").agg(F.avg("v").alias("v"))
    by_channel = F.transform(F.sort_array(F.collect_list(F.struct("channel", "v"))), lambda s: s["v"])  # as many as channels
    return value.groupBy(f"{of}_id").agg(by_channel.alias("value"))


def load_texture(
    spark: SparkSession, source: str | DataFrame, faces: DataFrame, vertices: DataFrame, size: float = 10.0, column: str = "value",
    labels: DataFrame | None = None, background: int | None = None,
) -> tuple[str, DataFrame, DataFrame | None]:
    """(whose, texture, labels) from a table (id and the column), an npy file, polygons as GeoJSON (the column of the last one that holds a
    face's centre) or a GeoTIFF (the cell that a vertex lies in). Columns of strings become class ids, by `labels` if they are given. faces have corner
    points a, b, c if polygons are asked for; vertices have x and y."""
    found: DataFrame
    whose: str | None = None
    if isinstance(source, DataFrame):
        found = source.select("id", F.col(column).alias("value"))
    elif source.endswith(".npy"):
        cells = vectors.array_pixels(spark.read.format("binaryFile").load(source))
        rows = cells.groupBy(F.col("i").cast("long").alias("id")).agg(F.sort_array(F.collect_list(F.struct("j", "channel", "value"))).alias("all"))
        found = one_channel(rows.select("id", F.transform("all", lambda s: s["value"]).alias("value")))
    elif source.endswith((".geojson", ".json")):
        mid = lambda k: ((F.col(f"a.{k}") + F.col(f"b.{k}") + F.col(f"c.{k}")) / 3).alias(k)
        shapes = vectors.read_geojson(spark, source, f"{column}: string").select("feature_id", F.col(column).alias("value"), "geom")
        found = spatial.values_from_polygons(faces.select(F.col("face_id").alias("id"), mid("x"), mid("y")), shapes, "id", "value", "feature_id", size)
        number = F.expr("try_cast(value as double)")
        if not found.where(F.col("value").isNotNull() & number.isNull()).take(1):
            found = found.withColumn("value", number)
        whose = "face"
    elif source.endswith((".tif", ".tiff")):
        info = rasters.raster_info(spark, source).first()
        cells = rasters.read_geotiff(spark, source).where("band = 0").select("row", "col", "value")
        held = spatial.raster_values(vertices.select(F.col("vertex_id").alias("id"), "x", "y"), cells, tuple(info["transform"]), info["nodata"])
        found, whose = held.select("id", "value"), "vertex"
    else:
        raise ValueError(f"cannot load a texture from {source}")
    if isinstance(found.schema["value"].dataType, T.StringType):
        if labels is None:
            labels = votes.label_ids(found, "value", background)
        named = labels.select(F.col("class_id"), F.col("name").alias("value"))
        found = found.join(named, "value", "left").select("id", F.col("class_id").cast("double").alias("value"))
    of, texture = set_texture(found, faces, vertices, of=whose)
    return of, texture, labels


def merged_meshes(*meshes: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of several meshes in one, ids moved behind those of the meshes before."""
    vertices: DataFrame | None = None
    faces: DataFrame | None = None
    at_vertex, at_face = 0, 0
    for v, f in meshes:
        last_v, last_f = v.agg(F.max("vertex_id")).first()[0], f.agg(F.max("face_id")).first()[0]
        move = lambda c, k: (F.col(c) + k).alias(c)
        v = v.select(move("vertex_id", at_vertex), *(c for c in v.columns if c != "vertex_id"))
        f = f.select(move("face_id", at_face), *(move(c, at_vertex) for c in ("v0", "v1", "v2")), *(c for c in f.columns if c not in ("face_id", "v0", "v1", "v2")))
        vertices = v if vertices is None else vertices.unionByName(v, allowMissingColumns=True)
        faces = f if faces is None else faces.unionByName(f, allowMissingColumns=True)
        at_vertex += 0 if last_v is None else last_v + 1
        at_face += 0 if last_f is None else last_f + 1
    return vertices, faces


def frusta(cameras: DataFrame, depth: float) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of the pyramids that cameras see up to a depth: apex, four corners, six triangles each."""
    from orthoquilt.functions import linalg

    def corner(sx: float, sy: float) -> Column:
        x, y = (s * F.col(n) / 2 * depth / F.col("f") for s, n in ((sx, "image_width"), (sy, "image_height")))
        return linalg.apply(F.col("cam_to_world"), linalg.vec(x, y, F.lit(float(depth))))

    points = F.array(linalg.apply(F.col("cam_to_world"), linalg.vec(0, 0, 0)), *(corner(sx, sy) for sx, sy in ((-1, -1), (1, -1), (1, 1), (-1, 1))))
    vertices = cameras.select("camera_id", F.posexplode(points).alias("k", "p")).select((F.col("camera_id") * 5 + F.col("k")).alias("vertex_id"), "camera_id", "p.x", "p.y", "p.z")
    tri = F.array(*(F.array(*map(F.lit, t)) for t in ((0, 1, 2), (0, 2, 3), (0, 3, 4), (0, 4, 1), (1, 2, 3), (1, 3, 4))))
    faces = cameras.select("camera_id", F.posexplode(tri).alias("k", "t"))
    at = lambda n: (F.col("camera_id") * 5 + F.col("t")[n]).alias(f"v{n}")
    return vertices, faces.select((F.col("camera_id") * 6 + F.col("k")).alias("face_id"), "camera_id", at(0), at(1), at(2))
