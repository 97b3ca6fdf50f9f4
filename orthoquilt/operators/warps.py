"""Distortion maps and what is looked up through them: warp(model_key, i, j, to_i, to_j).

A map has a row for each pixel of a destination image; to_i, to_j is the place in the source image that it shows. Cameras that share
a lens share one map (model_key), so maps grow with the lenses, not with the images. Rows of a map meet pixels by equi joins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthoquilt.functions import distortion

#: Lens models by name: (x, y, parameters, f, cx, cy, width, height) -> struct(x, y) of the ideal pixel's place in the distorted image.
MODELS: dict[str, Callable[..., Column]] = {"frame": distortion.warped}
_LENS = ("f", "cx", "cy", "image_width", "image_height")


def register_model(name: str, warped: Callable[..., Column]) -> None:
    """Make a lens model known to `distortion_map` by a name."""
    MODELS[name] = warped


def with_model_key(cameras: DataFrame, scale: float = 1.0) -> DataFrame:
    """cameras with model_key: the distortion's key at the scale, with what else the warp depends on."""
    return cameras.withColumn("model_key", F.concat_ws("|", distortion.key(F.col("distortion"), scale), *_LENS))


def distortion_map(cameras: DataFrame, scale: float = 1.0, model: str = "frame") -> DataFrame:
    """The ideal image's pixels, and where the distorted one shows them, for each lens of cameras (distortion, f, cx, cy, image_width,
    image_height). A scaled image's pixels stand for the centres of the original's blocks."""
    lens = with_model_key(cameras, scale).select("model_key", "distortion", *(F.col(c).cast("double").alias(c) for c in _LENS)).dropDuplicates(["model_key"])
    whole = abs(scale - 1) < 1e-8
    count = lambda c: F.floor(F.col(c) * scale).cast("int")
    grid = lens.withColumn("i", F.explode(F.sequence(F.lit(0), count("image_height") - 1)))
    grid = grid.withColumn("j", F.explode(F.sequence(F.lit(0), count("image_width") - 1)))
    at = lambda k: F.col(k).cast("double") if whole else (F.col(k) + 0.5) / scale
    place = MODELS[model](at("j"), at("i"), F.col("distortion"), *(F.col(c) for c in _LENS))
    back = 1.0 if whole else scale
    found = grid.select("model_key", "i", "j", F.explode(F.array(place)).alias("p"))
    return found.select("model_key", "i", "j", (F.col("p.y") * back).alias("to_i"), (F.col("p.x") * back).alias("to_j"))


def inverse_map(warp: DataFrame, downsample: int = 1, fill: float | None = -1.0) -> DataFrame:
    """The map the other way: for each whole pixel of the source image the place (to_i, to_j) in the destination, linear between every
    `downsample`th pixel of the map; `fill` (None: no row) where the map does not reach. The corners of neighbouring pixels make quads, cut
    along the shorter diagonal; a pixel on a border of triangles takes the first of them."""
    step = downsample
    node = warp.where(f"i % {step} = 0 and j % {step} = 0").select("model_key", "i", "j", F.struct("to_i", "to_j", F.col("i").cast("double").alias("i"), F.col("j").cast("double").alias("j")).alias("p"))
    key = ["model_key", "i", "j"]
    shifted = lambda di, dj, name: node.select("model_key", (F.col("i") - di * step).alias("i"), (F.col("j") - dj * step).alias("j"), F.col("p").alias(name))
    quad = node.join(shifted(0, 1, "q"), key).join(shifted(1, 0, "r"), key).join(shifted(1, 1, "s"), key)
    span = lambda a, b: F.hypot(F.col(f"{a}.to_i") - F.col(f"{b}.to_i"), F.col(f"{a}.to_j") - F.col(f"{b}.to_j"))
    tri = lambda a, b, c: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.col(c).alias("c"))
    both = F.when(span("p", "s") <= span("q", "r"), F.array(tri("p", "q", "s"), tri("p", "s", "r"))).otherwise(F.array(tri("p", "q", "r"), tri("q", "s", "r")))
    parts = quad.select("model_key", F.col("i").alias("qi"), F.col("j").alias("qj"), F.posexplode(both).alias("half", "t"))
    low = lambda k: F.ceil(F.least(*(F.col(f"t.{v}.{k}") for v in "abc")) - 1e-9)
    high = lambda k: F.floor(F.greatest(*(F.col(f"t.{v}.{k}") for v in "abc")) + 1e-9)
    parts = parts.select("*", low("to_i").alias("i0"), high("to_i").alias("i1"), low("to_j").alias("j0"), high("to_j").alias("j1")).where("i0 <= i1 and j0 <= j1")
    cells = parts.withColumn("x", F.explode(F.sequence("i0", "i1"))).withColumn("y", F.explode(F.sequence("j0", "j1")))
    u = lambda v, k: F.col(f"t.{v}.{k}")
    cross = lambda v, w: (u(w, "to_i") - u(v, "to_i")) * (F.col("y") - u(v, "to_j")) - (u(w, "to_j") - u(v, "to_j")) * (F.col("x") - u(v, "to_i"))
    sides = cells.select("*", cross("b", "c").alias("wa"), cross("c", "a").alias("wb"), cross("a", "b").alias("wc")).withColumn("w", F.expr("wa + wb + wc")).where("w <> 0")
    held = sides.where("least(wa / w, wb / w, wc / w) >= -1e-9")
    mixed = lambda k: (F.col("wa") * u("a", k) + F.col("wb") * u("b", k) + F.col("wc") * u("c", k)) / F.col("w")
    best = held.groupBy("model_key", F.col("x").cast("int").alias("i"), F.col("y").cast("int").alias("j")).agg(
        F.min(F.struct("qi", "qj", "half", mixed("i").alias("to_i"), mixed("j").alias("to_j"))).alias("m")
    )
    grid = warp.select("model_key", "i", "j")
    found = best.select("model_key", "i", "j", "m.to_i", "m.to_j").join(grid, key, "left_semi")
    if fill is None:
        return found
    return grid.join(found, key, "left").select(*key, *(F.coalesce(c, F.lit(float(fill))).alias(c) for c in ("to_i", "to_j")))


def warp_lookup(pixels: DataFrame, warp: DataFrame) -> DataFrame:
    """pixels (model_key, i, j whole) with to_i, to_j; pixels outside the map give no row."""
    return pixels.join(warp, ["model_key", "i", "j"])


def warped_image(pixels: DataFrame, warp: DataFrame, order: int = 1, fill: float = 0.0) -> DataFrame:
    """image_id, i, j, value of each image of pixels (image_id, model_key, i, j, value) seen through the map: the nearest pixel (order 0) or the
    mean of four by distance (order 1). What lies outside the image counts as `fill`."""
    images = pixels.select("image_id", "model_key").distinct()
    aimed = images.join(warp, "model_key")
    source = pixels.select("image_id", F.col("i").alias("si"), F.col("j").alias("sj"), "value")
    if order == 0:
        at = lambda c: F.rint(c).cast("int")
        out = aimed.select("image_id", "i", "j", at("to_i").alias("si"), at("to_j").alias("sj")).join(source, ["image_id", "si", "sj"], "left")
        return out.select("image_id", "i", "j", F.coalesce("value", F.lit(fill)).alias("value"))
    fi, fj = F.floor("to_i"), F.floor("to_j")
    near = F.array(
        *(
            F.struct(
                (fi + di).cast("int").alias("si"), (fj + dj).cast("int").alias("sj"),
                ((F.col("to_i") - fi if di else 1 - F.col("to_i") + fi) * (F.col("to_j") - fj if dj else 1 - F.col("to_j") + fj)).alias("w"),
            )
            for di in (0, 1) for dj in (0, 1)
        )
    )
    four = aimed.select("image_id", "i", "j", F.explode(near).alias("n")).select("image_id", "i", "j", "n.*").where("w > 0")
    met = four.join(source, ["image_id", "si", "sj"], "left")
    return met.groupBy("image_id", "i", "j").agg(F.sum(F.col("w") * F.coalesce("value", F.lit(fill))).alias("value"))
