"""Rasters in long form, cell(row, col, value), and tiles of them: windows, chips, mosaics, zonal counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoquilt.functions import geometry
from orthoquilt.operators.spatial import bounds


def windows(spark: SparkSession, height: int, width: int, size: int, stride: int) -> DataFrame:
    """col_off, row_off, width, height of all windows, column after column; those at the far edges are not clipped."""
    cols = spark.range(0, width, stride).select(F.col("id").alias("col_off"))
    return cols.select("col_off", F.explode(F.sequence(*(F.lit(v).cast("long") for v in (0, max(0, height - 1), stride)))).alias("row_off")).select(
        "col_off", "row_off", F.lit(size).cast("long").alias("width"), F.lit(size).cast("long").alias("height")
    )


def window_name(col_off: Column, row_off: Column, width: Column, height: Column, stem: str = "tile") -> Column:
    return F.format_string(f"{stem}:%d:%d:%d:%d", col_off, row_off, width, height)


def window_of_name(name: Column) -> Column:
    """The window in a file name such as stem:col:row:width:height.suffix."""
    parts = F.split(F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.[^.:]*$", ""), ":")
    at = lambda k: F.element_at(parts, -k).cast("long")
    return F.struct(at(4).alias("col_off"), at(3).alias("row_off"), at(2).alias("width"), at(1).alias("height"))


def extent(tiles: DataFrame) -> DataFrame:
    """One row: the box around all windows."""
    return tiles.agg(
        F.min("col_off").alias("col_min"), F.min("row_off").alias("row_min"), F.max(F.col("col_off") + F.col("width")).alias("col_max"), F.max(F.col("row_off") + F.col("height")).alias("row_max")
    )


def tile_cells(cells: DataFrame, size: int, stride: int) -> DataFrame:
    """Each cell in every window that holds it: col_off, row_off, i, j (inside the window), and the cell's other columns.
    The windows of a cell follow from its position, so nothing is joined."""

    def offsets(c: Column) -> Column:
        last = F.floor(c / stride)
        first = F.greatest(F.lit(0), F.floor((c - size) / stride) + 1)
        return F.when(first <= last, F.transform(F.sequence(first, last), lambda k: k * stride)).otherwise(F.array().cast("array<bigint>"))

    out = cells.withColumn("col_off", F.explode(offsets(F.col("col")))).withColumn("row_off", F.explode(offsets(F.col("row"))))
    return out.withColumn("i", F.col("row") - F.col("row_off")).withColumn("j", F.col("col") - F.col("col_off"))


def chips(cells: DataFrame, size: int, stride: int, background: int = 0, keep_empty: bool = False) -> DataFrame:
    """tile_cells without the tiles that hold nothing but background."""
    dealt = tile_cells(cells, size, stride)
    if keep_empty:
        return dealt
    used = dealt.where(F.col("value").isNotNull() & (F.col("value") != background)).select("col_off", "row_off").distinct()
    return dealt.join(used, ["col_off", "row_off"], "left_semi")


def ramp_weight(i: Column, j: Column, height: Column, width: Column, share: float) -> Column:
    """Weight that rises from 0 at a tile's edges to 1 over a share of its side, the least of both axes."""

    def ramp(k: Column, n: Column) -> Column:
        rise = F.try_divide(F.least(k, n - 1 - k).cast("double"), n * F.lit(float(share)))
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(rise, F.lit(1.0))))

    return F.least(ramp(i, height), ramp(j, width))


def mosaic(tiles: DataFrame, share: float, max_overlap: int, nodata: int = 255) -> DataFrame:
    """row, col and class_id of overlapping predictions tiles(col_off, row_off, width, height, i, j, class_id): weights are ramps times
    255 / max_overlap, cut to whole numbers; the heaviest class wins, the lowest on a tie; nodata where all weights are zero."""
    w = F.floor(ramp_weight(F.col("i"), F.col("j"), F.col("height"), F.col("width"), share) * (255 / max_overlap)).cast("long")
    placed = tiles.select((F.col("row_off") + F.col("i")).alias("row"), (F.col("col_off") + F.col("j")).alias("col"), "class_id", w.alias("w"))
    summed = placed.groupBy("row", "col", "class_id").agg(F.sum("w").alias("w"))
    best = summed.groupBy("row", "col").agg(F.max(F.struct("w", (-F.col("class_id")).alias("c"))).alias("b"))
    return best.select("row", "col", F.when(F.col("b.w") > 0, -F.col("b.c")).otherwise(nodata).cast("long").alias("class_id"))


def downsampled(cells: DataFrame, factor: int) -> DataFrame:
    """Means of blocks of factor x factor cells; null cells are left out."""
    return cells.groupBy(F.floor(F.col("row") / factor).alias("row"), F.floor(F.col("col") / factor).alias("col")).agg(F.avg("value").alias("value"))


def resampled(cells: DataFrame, height: int, width: int, factor: float) -> DataFrame:
    """row, col, value of a raster of int(height / factor) x int(width / factor) cells by bilinear weights: when a raster shrinks, the tent around a
    target cell's centre is as wide as the target cell on either side, so every source cell counts. Null cells and those beyond the edge are left out
    and the other weights made up for."""
    rows, cols = int(height / factor), int(width / factor)

    def spread(df: DataFrame, axis: str, n: int, m: int) -> DataFrame:
        """A row for each target that a source cell counts for, with its weight."""
        step = max(n / m, 1.0)
        ratio = n / m
        centre = F.col(axis) + 0.5
        low = F.greatest(F.lit(0), F.floor((centre - step) / ratio - 0.5).cast("long"))
        high = F.least(F.lit(m - 1), F.ceil((centre + step) / ratio - 0.5).cast("long"))
        out = df.where(low <= high).withColumn(f"t_{axis}", F.explode(F.sequence(low.cast("long"), high.cast("long"))))
        weight = 1 - F.abs(centre - (F.col(f"t_{axis}") + 0.5) * ratio) / step
        return out.withColumn(f"w_{axis}", weight).where(F.col(f"w_{axis}") > 1e-12)

    met = spread(spread(cells.where("value is not null"), "row", height, rows), "col", width, cols)
    w = F.col("w_row") * F.col("w_col")
    summed = met.groupBy(F.col("t_row").alias("row"), F.col("t_col").alias("col")).agg(F.sum(w * F.col("value")).alias("v"), F.sum(w).alias("w"))
    return summed.select("row", "col", (F.col("v") / F.col("w")).alias("value"))


def without_transparent(tiles: DataFrame, alpha: DataFrame) -> DataFrame:
    """tiles (col_off, row_off, row, col, ...) with null values where alpha (row, col, alpha) is zero, without those that are transparent all over."""
    seen = tiles.join(alpha.select("row", "col", "alpha"), ["row", "col"], "left")
    clear = seen.withColumn("value", F.when(F.coalesce(F.col("alpha"), F.lit(0)) > 0, F.col("value"))).drop("alpha")
    used = clear.where("value is not null").select("col_off", "row_off").distinct()
    return clear.join(used, ["col_off", "row_off"], "left_semi")


def padded(tiles: DataFrame, size: int, fill: float = 0.0) -> DataFrame:
    """tiles (col_off, row_off, i, j, value) with a row for each cell of their full size."""
    place = F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))
    grid = tiles.select("col_off", "row_off").distinct().withColumn("i", F.explode(place)).withColumn("j", F.explode(place))
    met = grid.join(tiles.select("col_off", "row_off", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "value"), ["col_off", "row_off", "i", "j"], "left")
    return met.withColumn("value", F.coalesce("value", F.lit(fill)))


def zonal_counts(cells: DataFrame, polygons: DataFrame, normalise: bool = False) -> DataFrame:
    """polygon_id, class_id and n of cell(row, col, class_id) whose centres (col + 0.5, row + 0.5) lie in polygon(polygon_id, geom, in cell
    units). Polygons are spread over the rows and columns of their bounding boxes, so they meet cells by an equi join."""
    (x0, x1), (y0, y1) = bounds(F.col("geom"), "x"), bounds(F.col("geom"), "y")
    whole = lambda v: F.floor(v).cast("long")
    wide = polygons.select("polygon_id", "geom", F.explode(F.sequence(whole(y0), whole(y1))).alias("row"), x0.alias("x0"), x1.alias("x1"))
    wide = wide.select("polygon_id", "geom", "row", F.explode(F.sequence(whole(F.col("x0")), whole(F.col("x1")))).alias("col"))
    met = wide.join(cells.where("class_id is not null"), ["row", "col"])
    held = met.where(geometry.inside(F.col("col") + 0.5, F.col("row") + 0.5, F.col("geom")))
    counted = held.groupBy("polygon_id", "class_id").agg(F.count("*").alias("n"))
    if not normalise:
        return counted
    total = counted.groupBy("polygon_id").agg(F.sum("n").alias("t"))
    return counted.join(total, "polygon_id").select("polygon_id", "class_id", "n", (F.col("n") / F.col("t")).alias("frac"))


def rectangle_mask(detections: DataFrame) -> DataFrame:
    """image_path, i, j and label of pixels in boxes, half open; the later detection (instance_id) wins."""
    whole = lambda c: F.col(c).cast("long")
    rows = detections.where("floor(imax) > floor(imin) and floor(jmax) > floor(jmin)").withColumn("i", F.explode(F.sequence(whole("imin"), whole("imax") - 1)))
    rows = rows.withColumn("j", F.explode(F.sequence(whole("jmin"), whole("jmax") - 1)))
    return rows.groupBy("image_path", "i", "j").agg(F.max(F.struct("instance_id", "label"))["label"].alias("label"))


def polygon_mask(regions: DataFrame) -> DataFrame:
    """image_path, i, j, label of pixels of regions(image_path, label, geom): outer rings are filled, their border pixels included, holes closed.
    Rows are scanned: each pixel of a row between the crossings of the ring, or on an edge."""
    ring = F.get(F.col("geom"), F.lit(0))
    (x0, x1), (y0, y1) = bounds(F.array(ring), "x"), bounds(F.array(ring), "y")
    rows = regions.select("image_path", "label", F.array(ring).alias("geom"), F.explode(F.sequence(F.ceil(y0), F.floor(y1))).alias("i"), x0.alias("x0"), x1.alias("x1"))
    cells = rows.select("image_path", "label", "geom", "i", F.explode(F.sequence(F.ceil("x0"), F.floor("x1"))).alias("j"))
    x, y = F.col("j").cast("double"), F.col("i").cast("double")
    held = cells.where(geometry.inside(x, y, F.col("geom")) | (geometry.edge_distance(x, y, F.col("geom")) < 1e-9))
    return held.select("image_path", "i", "j", "label").distinct()


def reprojected(cells: DataFrame, spark: SparkSession, height: int, width: int, to_source) -> DataFrame:
    """The target grid's cells, each with the source cell that `to_source(col + 0.5, row + 0.5)` -> struct(x, y) falls into (nearest)."""
    grid = spark.range(height).select(F.col("id").alias("row")).withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))))
    at = to_source(F.col("col") + 0.5, F.col("row") + 0.5)
    aimed = grid.withColumn("at", at).select("row", "col", F.floor("at.y").cast("long").alias("s_row"), F.floor("at.x").cast("long").alias("s_col"))
    return aimed.join(cells.select(F.col("row").alias("s_row"), F.col("col").alias("s_col"), "value"), ["s_row", "s_col"]).select("row", "col", "value")
