"""A scene over the driver's star-schema tables: who is seen by whom, where things are. Every relation covers its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoquilt.functions import geometry
from orthoquilt.functions.linalg import vec

#: The same relations for DuckDB, as common table expressions.
SQL = {
    "obs": "obs as (select l_partkey face_id, l_suppkey camera_id, l_orderkey k1, l_linenumber k2, l_quantity weight, "
    "(case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end)::bigint class_id from lineitem)",
    "faces": "faces as (select p_partkey face_id, (p_partkey % 50)::double x, floor(p_partkey / 50)::double y, p_size::double z, p_brand brand from part)",
    "cameras": "cameras as (select s_suppkey camera_id, (s_suppkey % 10 * 5)::double x, floor(s_suppkey / 10)::double y, 60 + s_acctbal / 1000 z, "
    "s_name || '.jpg' image_filename from supplier)",
    "boxes": "boxes as (select n_nationkey::bigint polygon_id, n_name name, n_regionkey::bigint class_id, (n_nationkey % 5 * 10 - 0.5)::double x0, "
    "(floor(n_nationkey / 5) * 8 - 0.5)::double y0, (n_nationkey % 5 * 10 + 11.5)::double x1, (floor(n_nationkey / 5) * 8 + 9.5)::double y1 from nation)",
    "detections": "detections as (select o_orderkey instance_id, o_custkey % 100 camera_id, (o_orderkey % 500)::double imin, (o_orderkey % 700)::double jmin, "
    "(o_orderkey % 500 + 1 + o_orderkey % 7)::double imax, (o_orderkey % 700 + 2 + o_orderkey % 11)::double jmax, o_orderpriority label from orders)",
    "rays": "rays as (select event_id ray_id, user_id camera_id, (event_id % 40 + floor(event_id / 400) * 50)::double sx, (event_id * 7 % 40)::double sy, 100.0::double sz, "
    "(event_id % 40 + floor(event_id / 400) * 50 + value / 100)::double ex, (event_id * 7 % 40 + event_id % 3)::double ey, 0.0::double ez from events)",
}


def ctes(*names: str) -> str:
    return "with " + ",\n".join(SQL[n] for n in names)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """df dealt over a task for each so many rows. A table that compresses well is one small file, and a single task would do all that is asked of it."""
    return df.repartition(max(1, -(-df.count() // rows)))


def obs(spark: SparkSession, d: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("face_id"), F.col("l_suppkey").alias("camera_id"), F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"),
        F.col("l_quantity").alias("weight"), F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2).cast("long").alias("class_id"),
    )


def faces(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        k.alias("face_id"), (k % 50).cast("double").alias("x"), F.floor(k / 50).cast("double").alias("y"), F.col("p_size").cast("double").alias("z"), F.col("p_brand").alias("brand")
    )


def cameras(spark: SparkSession, d: str) -> DataFrame:
    """Cameras that look straight down, 800 x 600 pixels, f = 1000."""
    k = F.col("s_suppkey")
    pose = table(spark, d, "supplier").select(
        k.alias("camera_id"), (k % 10 * 5).cast("double").alias("x"), F.floor(k / 10).cast("double").alias("y"), (60 + F.col("s_acctbal") / 1000).alias("z"),
        F.concat("s_name", F.lit(".jpg")).alias("image_filename"),
    )
    zero, one = F.lit(0.0), F.lit(1.0)
    down = F.array(one, zero, zero, F.col("x"), zero, -one, zero, F.col("y"), zero, zero, -one, F.col("z"), zero, zero, zero, one)
    fixed = {"f": 1000.0, "cx": 0.0, "cy": 0.0}
    return pose.select(
        "*", down.alias("cam_to_world"), *(F.lit(v).alias(n) for n, v in fixed.items()), F.lit(800).alias("image_width"), F.lit(600).alias("image_height")
    )


def boxes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey").cast("long")
    out = table(spark, d, "nation").select(
        k.alias("polygon_id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("class_id"), (k % 5 * 10 - 0.5).cast("double").alias("x0"),
        (F.floor(k / 5) * 8 - 0.5).cast("double").alias("y0"), (k % 5 * 10 + 11.5).cast("double").alias("x1"), (F.floor(k / 5) * 8 + 9.5).cast("double").alias("y1"),
    )
    return out.withColumn("geom", geometry.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))


def detections(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        k.alias("instance_id"), (F.col("o_custkey") % 100).alias("camera_id"), (k % 500).cast("double").alias("imin"), (k % 700).cast("double").alias("jmin"),
        (k % 500 + 1 + k % 7).cast("double").alias("imax"), (k % 700 + 2 + k % 11).cast("double").alias("jmax"), F.col("o_orderpriority").alias("label"),
    )


def rays(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    x = (k % 40 + F.floor(k / 400) * 50).cast("double")
    start = vec(x, (k * 7 % 40).cast("double"), 100)
    end = vec(x + F.col("value") / 100, (k * 7 % 40 + k % 3).cast("double"), 0)
    return table(spark, d, "events").select(k.alias("ray_id"), F.col("user_id").alias("camera_id"), start.alias("start"), end.alias("end"))


def squares(spark: SparkSession, d: str) -> DataFrame:
    """The parts, as faces, that have a unit square between them and their neighbours."""
    p = faces(spark, d)
    last = p.agg(F.max("face_id")).first()[0]
    k = F.col("face_id")
    return p.where((k % 50 < 49) & (k + 51 <= (last or 0)))


def grid_mesh(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of two triangles for each unit square between neighbouring parts."""
    vertices = faces(spark, d).select(F.col("face_id").alias("vertex_id"), "x", "y", "z")
    k = F.col("face_id")
    tri = F.array(F.struct((2 * k).alias("face_id"), k.alias("v0"), (k + 1).alias("v1"), (k + 50).alias("v2")), F.struct((2 * k + 1).alias("face_id"), (k + 1).alias("v0"), (k + 51).alias("v1"), (k + 50).alias("v2")))
    brand = F.pmod(F.crc32(F.encode("brand", "UTF-8")), F.lit(3)).cast("long").alias("class_id")
    return vertices, squares(spark, d).select(F.explode(tri).alias("t"), brand).select("t.*", "class_id")


def mesh_corners(vertices: DataFrame, tri: DataFrame) -> DataFrame:
    """face_id, a, b, c: the faces with their corner points."""
    out = tri
    for v, k in zip(("v0", "v1", "v2"), "abc", strict=True):
        out = out.join(vertices.select(F.col("vertex_id").alias(v), vec(F.col("x"), F.col("y"), F.col("z")).alias(k)), v)
    return out


SQL["squares"] = (
    "squares as (select p_partkey k, p_brand from part where p_partkey % 50 < 49 and p_partkey + 51 <= (select max(p_partkey) from part)),\n"
    "mesh as (select 2 * k face_id, k v0, k + 1 v1, k + 50 v2, p_brand from squares union all select 2 * k + 1, k + 1, k + 51, k + 50, p_brand from squares),\n"
    "vertices as (select p_partkey vertex_id, (p_partkey % 50)::double x, floor(p_partkey / 50)::double y, p_size::double z from part)"
)
