"""The end-to-end plans: from views to a map, from a map to views, from detections to places."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoquilt.functions import crs, geometry
from orthoquilt.functions.linalg import let, norm, sub, vec
from orthoquilt.operators import cameras as cam
from orthoquilt.operators import correspondence, graph, metrics, overlay, raster, rays, spatial, votes
from orthoquilt.relations import checkpointed
from orthoquilt.sources import rasters


def aggregate_images(cameras: DataFrame, faces: DataFrame, pixels: DataFrame, scale: float, reach: float, cell: float, every: int = 1, apply_distortion: bool = False) -> DataFrame:
    """Views to a map: face_id, pred_class, n_views and votes from pixels (camera_id, i, j, class_id) at the scale."""
    chosen = cam.every_nth(cameras, every) if every > 1 else cameras
    obs = correspondence.visible_faces(chosen, faces, scale, reach, cell)
    if apply_distortion:
        obs = correspondence.through_lens(obs, chosen, scale)
    views = checkpointed(correspondence.projected(obs, pixels))  # read twice
    best = votes.argmax_class(votes.votes(views))
    return best.join(votes.view_counts(views), "face_id").select("face_id", "pred_class", F.col("total").alias("n_votes"), "n_views")


def export_labels(faces: DataFrame, vertices: DataFrame, face_class: DataFrame) -> DataFrame:
    """Outlines of the dissolved classes: class_id, ring_id, ring."""
    labelled = faces.join(face_class.select("face_id", F.col("pred_class").alias("class_id")), "face_id")
    return overlay.outlines(overlay.boundary_edges(labelled), vertices)


def render_labels(cameras: DataFrame, faces: DataFrame, polygons: DataFrame, scale: float, reach: float, cell: float, heights: DataFrame | None = None, threshold: float = 2.0, ground: int = 0, apply_distortion: bool = False) -> DataFrame:
    """A map to views: camera_id, i, j, class_id. Faces take the class of the last polygon that holds their centre, low ones the ground's."""
    mid = lambda k: (F.col(f"a.{k}") + F.col(f"b.{k}") + F.col(f"c.{k}")) / 3
    centres = faces.select("face_id", mid("x").alias("x"), mid("y").alias("y"))
    value = spatial.values_from_polygons(centres, polygons, "face_id", "class_id", "polygon_id", cell)
    if heights is not None:
        value = spatial.with_ground(value, heights, threshold, ground)
    obs = correspondence.visible_faces(cameras, faces, scale, reach, cell)
    if apply_distortion:
        obs = correspondence.through_lens(obs, cameras, scale)
    return correspondence.rendered(obs, value).where("class_id is not null").select("camera_id", "i", "j", "class_id")


def label_polygons(faces: DataFrame, face_class: DataFrame, polygons: DataFrame, size: float, clip: bool = False, weight: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """The class of each polygon by area: faces wholly inside, or with `clip` the parts inside, weighted by true area and by weight
    (face_id, weight)."""
    area = spatial.face_weight(F.col("a"), F.col("b"), F.col("c"), F.lit(1.0))
    known = faces.join(face_class.select("face_id", F.col("pred_class").alias("class_id")).where("class_id is not null"), "face_id")
    if weight is not None:
        known = known.join(weight, "face_id")
    known = known.withColumn("w", area * (F.col("weight") if weight is not None else 1.0)).where("w is not null")
    plain = polygons.select("polygon_id", "geom")
    if clip:
        pairs = overlay.face_shares(known, plain, size).join(known.select("face_id", "class_id", "w"), "face_id").select("polygon_id", "class_id", (F.col("w") * F.col("share")).alias("weight"))
    else:
        pairs = spatial.faces_within(known.select("face_id", "a", "b", "c", "class_id", "w"), plain, size).select("polygon_id", "class_id", F.col("w").alias("weight"))
    return spatial.polygon_labels(pairs, plain, labels)


def multiview_detections(
    cameras: DataFrame, detections: DataFrame, length: float, threshold: float, surface: DataFrame | None = None, cell: float = 10.0,
    ray_limit: float | None = None, max_angle: float | None = None, transform: Callable[[Column], Column] = lambda d: d, resolution: float = 1.0, ecef: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Detections to places: (ray_id, community), and community, size, x, y, z (with ecef also lon, lat, height). Rays are cut to the surface if
    there is one; isolated rays have no community."""
    ray = cam.detection_rays(cameras, detections, length, max_angle)
    if surface is not None:
        ray = rays.clip_to_surfaces(ray, surface, cell, ray_limit)
    elif ray_limit is not None:
        ray = ray.where(norm(sub(F.col("end"), F.col("start"))) <= ray_limit)
    edge = rays.edges(ray, threshold, transform=transform)
    member = graph.communities(edge, resolution).withColumnRenamed("node", "ray_id")
    point = rays.average_point(ray.join(member, "ray_id"), "community")
    sizes = member.groupBy("community").agg(F.count("*").alias("size"))
    places = sizes.join(point, "community").select("community", "size", "x", "y", "z")
    if ecef:
        at = places.select("*", F.explode(F.array(crs.from_ecef(vec(F.col("x"), F.col("y"), F.col("z"))))).alias("g"))
        places = at.select("community", "size", "x", "y", "z", F.col("g.x").alias("lon"), F.col("g.y").alias("lat"), F.col("g.z").alias("height"))
    return ray.select("ray_id").join(member, "ray_id", "left"), places


def project_detections(cameras: DataFrame, faces: DataFrame, vertices: DataFrame, triangles: DataFrame, detections: DataFrame, scale: float, reach: float, cell: float) -> tuple[DataFrame, DataFrame]:
    """Detections (image_path, instance_id, label, box) to the mesh: (face_id, instance_id, n_views), and outlines of each instance's faces
    with its label."""
    mask = raster.rectangle_mask(detections.withColumn("label", F.col("instance_id")))
    named = mask.join(cameras.select("camera_id", F.col("image_filename").alias("image_path")), "image_path")
    pixels = named.select("camera_id", F.floor(F.col("i") * scale).cast("int").alias("i"), F.floor(F.col("j") * scale).cast("int").alias("j"), F.col("label").alias("class_id"))
    pixels = pixels.groupBy("camera_id", "i", "j").agg(F.max("class_id").alias("class_id"))
    views = correspondence.projected(correspondence.visible_faces(cameras, faces, scale, reach, cell), pixels)
    seen = views.groupBy("face_id", F.col("class_id").alias("instance_id")).agg(F.count_distinct("camera_id").alias("n_views"))
    edges = overlay.boundary_edges(triangles.join(seen.select("face_id", F.col("instance_id").alias("class_id")), "face_id"))
    rings = overlay.outlines(edges, vertices).withColumnRenamed("class_id", "instance_id")
    return seen, rings.join(detections.select("instance_id", "label", "image_path"), "instance_id")


def covering_images(obs: DataFrame, min_views: int = 1) -> DataFrame:
    """A small set of images that sees every face that enough images see: image_id, rank, n_new."""
    return graph.greedy_cover(obs.select(F.col("camera_id").alias("image_id"), "face_id"), min_views)


def height_masks(obs: DataFrame, heights: DataFrame, cut: float) -> DataFrame:
    """camera_id, i, j, height_class of each pixel: 0 unknown, 1 up to the cut, 2 above."""
    seen = correspondence.rendered(obs, heights.select("face_id", "height"))
    return seen.select("camera_id", "i", "j", spatial.height_class(F.col("height"), cut).alias("height_class"))


def confusion_of_layers(truth: DataFrame, prediction: DataFrame, size: float, transform: tuple[float, ...] | None = None, normalise: bool = False) -> DataFrame:
    """true_label, pred_label and amount of truth polygons (polygon_id, label, geom) against predicted polygons (the same columns; amounts are areas, with
    what no prediction covers as `unlabelled`) or, with the transform of a raster, cells (row, col, label; amounts are cells whose centres lie in a polygon)."""
    if transform is not None:
        a, b, c, d, e, f = transform
        x, y = F.col("col") + 0.5, F.col("row") + 0.5
        placed = prediction.select(F.col("label").alias("pred_label"), (a * x + b * y + c).alias("x"), (d * x + e * y + f).alias("y")).where("pred_label is not null")
        held = spatial.points_in_polygons(placed, truth.select(F.col("label").alias("true_label"), "geom"), size)
        cf = metrics.confusion(held, "true_label", "pred_label")
    else:
        sides = [df.select(F.col("polygon_id").alias(f"{k}_id"), F.col("geom").alias(f"{k}_geom")) for df, k in ((truth, "a"), (prediction, "b"))]
        met = overlay.overlap_table(*sides, size)
        met = met.join(truth.select(F.col("polygon_id").alias("a_id"), F.col("label").alias("true_label")), "a_id").join(prediction.select(F.col("polygon_id").alias("b_id"), F.col("label").alias("pred_label")), "b_id")
        whole = truth.groupBy(F.col("label").alias("true_label")).agg(F.sum(geometry.polygon_area(F.col("geom"))).alias("amount"))
        cf = metrics.with_unlabelled(met.groupBy("true_label", "pred_label").agg(F.sum("area").alias("amount")), whole)
    return metrics.normalised(cf) if normalise else cf


def chip_raster(
    spark: SparkSession, path: str, folder: str, size: int, stride: int, labels: DataFrame | None = None, roi: DataFrame | None = None, keep_empty: bool = False,
    background: int = 0, suffix: str = ".tif",
) -> DataFrame:
    """Cut a GeoTIFF's first band into tiles of one size, written into a folder as `stem:col:row:width:height`; with labels (polygon_id, class_id, geom in the
    raster's coordinates) the tiles hold classes (cell centres; the later polygon wins), and those of background only are left out. `roi` (geom) keeps
    tiles with a cell in it. Gives the names written."""
    info = rasters.raster_info(spark, path).first()
    transform = tuple(info["transform"])
    a, b, c, d, e, f = transform
    cells = rasters.read_geotiff(spark, path).where("band = 0").select("row", "col", "value")
    x = (F.col("col") + 0.5) * a + (F.col("row") + 0.5) * b + c
    y = (F.col("col") + 0.5) * d + (F.col("row") + 0.5) * e + f
    at = cells.withColumns({"x": x, "y": y}).withColumn("cell", F.struct("row", "col"))
    reach = size * max(abs(a) + abs(b), abs(d) + abs(e))
    if labels is not None:
        named = spatial.values_from_polygons(at.select("cell", "x", "y"), labels, "cell", "class_id", "polygon_id", reach, F.lit(background))
        cells = named.select("cell.row", "cell.col", F.col("class_id").alias("value"))
    tiles = raster.chips(cells, size, stride, background, keep_empty or labels is None)
    if roi is not None:
        held = spatial.points_in_polygons(at.select("row", "col", "x", "y"), roi.select("geom"), reach).select("row", "col").distinct()
        kept = tiles.join(held, ["row", "col"], "left_semi").select("col_off", "row_off").distinct()
        tiles = tiles.join(kept, ["col_off", "row_off"], "left_semi")
    stem = path.rstrip("/").split("/")[-1].rsplit(".", 1)[0]
    size_ = F.lit(size).cast("long")
    named = tiles.withColumns({"width": size_, "height": size_}).withColumn("name", F.concat(raster.window_name(F.col("col_off"), F.col("row_off"), size_, size_, stem), F.lit(suffix)))
    kind = "uint8" if labels is not None else "float32"
    rasters.write_files(rasters.encoded(named, transform, kind, background, info["epsg"]), folder)
    return named.select("name", "col_off", "row_off").distinct()


def assemble_predictions(spark: SparkSession, folder: str, share: float = 0.25, max_overlap: int = 4, nodata: int = 255) -> DataFrame:
    """row, col, class_id of the mosaic of predicted tiles, GeoTIFF files named by their windows; rows and columns count from the least window's."""
    cells = rasters.decoded(rasters.files_in(spark, folder)).where("band = 0")
    tiles = cells.select("path", F.col("row").alias("i"), F.col("col").alias("j"), F.col("value").cast("long").alias("class_id"))
    tiles = tiles.withColumn("w", raster.window_of_name(F.col("path"))).select("w.*", "i", "j", "class_id")
    return raster.mosaic(tiles, share, max_overlap, nodata)


def saved_images(cameras: DataFrame, folder: str, source: str = "image_filename") -> DataFrame:
    """Copy the cameras' images into a folder by their relative paths, where the rows are; nothing is deleted. Gives what was copied to where."""
    plan = cameras.select(F.col(source).alias("source"), F.concat(F.lit(folder.rstrip("/") + "/"), F.regexp_replace(F.col(source), "^[a-z]+://[^/]*", "")).alias("target"))
    plan = plan.withColumn("target", F.regexp_replace("target", "(?<![:/])//+", "/"))

    def copy(rows: Iterator) -> None:
        from pyarrow import fs

        for row in rows:
            (a, p), (b, q) = (fs.FileSystem.from_uri(row[k] if "://" in row[k] else "file://" + row[k]) for k in ("source", "target"))
            b.create_dir(q.rsplit("/", 1)[0], recursive=True)
            fs.copy_files(p, q, source_filesystem=a, destination_filesystem=b)

    plan.foreachPartition(copy)
    return plan


def staged(spark: SparkSession, folder: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of a stage: read from the folder if an earlier run has finished it there, else made and written, so a plan can go on where it stopped."""
    path = f"{folder.rstrip('/')}/{name}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def in_frame_of(vertices: DataFrame, source: int, target: int) -> DataFrame:
    """vertices (x, y, z) from one EPSG code to another."""
    moved = vertices.select("*", F.explode(F.array(let(vec(F.col("x"), F.col("y"), F.col("z")), lambda p: crs.convert(p, source, target)))).alias("__p"))
    rest = [c for c in vertices.columns if c not in "xyz"]
    return moved.select(*rest, *(F.col(f"__p.{k}").alias(k) for k in "xyz"))
