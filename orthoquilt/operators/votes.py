"""Votes of views on faces. Relations: obs(camera_id, face_id, class_id, ... ), face_class(face_id, class_id, n, ...).

Everything is a partial and a final hash aggregate; no face's views meet before they are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_value(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The value of the last row of each key; `order` must tell rows apart, the value itself breaks what ties remain."""
    return df.groupBy(*keys).agg(F.max(F.struct(*order, F.col(value).alias("__v")))["__v"].alias(value))


def votes(views: DataFrame, keys: tuple[str, ...] = ("face_id",)) -> DataFrame:
    """How many views give each class to each face (a row for each face and class); null classes are no votes."""
    return views.where("class_id is not null").groupBy(*keys, "class_id").agg(F.count("*").alias("n"))


def view_counts(views: DataFrame) -> DataFrame:
    """In how many cameras a face is seen; a null class still counts as seen."""
    return views.groupBy("face_id").agg(F.count_distinct("camera_id").alias("n_views"))


def view_average(views: DataFrame) -> DataFrame:
    """frac: votes of each class by the cameras that see the face. One row for each (camera, face) is expected."""
    counted = votes(views)
    return counted.join(view_counts(views), "face_id").select("face_id", "class_id", "n", "n_views", (F.col("n") / F.col("n_views")).alias("frac"))


def channel_average(values: DataFrame) -> DataFrame:
    """Mean over cameras of each channel of values (camera_id, face_id, channel, value): finite values only, by the cameras
    with any finite channel."""
    finite = values.where("value is not null and not isnan(value) and abs(value) < double('inf')")
    seen = finite.groupBy("face_id").agg(F.count_distinct("camera_id").alias("n_views"))
    total = finite.groupBy("face_id", "channel").agg(F.sum("value").alias("total"))
    return total.join(seen, "face_id").select("face_id", "channel", (F.col("total") / F.col("n_views")).alias("value"), "n_views")


def argmax_class(counted: DataFrame, keys: tuple[str, ...] = ("face_id",), amount: str = "n") -> DataFrame:
    """The class of the largest amount, the lowest class on a tie; null where nothing is above zero or an amount is not finite."""
    bad = F.max(F.isnan(F.col(amount).cast("double")) | F.col(amount).isNull() | (F.abs(F.col(amount).cast("double")) == float("inf")))
    best = F.max(F.struct(F.col(amount).alias("a"), (-F.col("class_id")).alias("c")))
    out = counted.groupBy(*keys).agg(best.alias("best"), bad.alias("bad"), F.sum(amount).alias("total"))
    good = ~F.col("bad") & (F.col("total") != 0)
    return out.select(*keys, F.when(good, -F.col("best")["c"]).alias("pred_class"), "total")


def fair_mode(values: DataFrame, keys: tuple[str, ...] = ("face_id",), seed: str = "") -> DataFrame:
    """The most frequent class; ties are broken by a hash of keys and class, so no class is favoured, and runs agree."""
    mix = F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in keys), F.col("class_id").cast("string"), F.lit(seed)))
    counted = values.where("class_id is not null").groupBy(*keys, "class_id").agg(F.count("*").alias("n"))
    best = F.max(F.struct("n", mix.alias("h"), F.col("class_id").alias("c")))
    return counted.groupBy(*keys).agg(best["c"].alias("class_id"), best["n"].alias("n"))


def corners(face: DataFrame) -> DataFrame:
    """face(face_id, v0, v1, v2) -> (face_id, vertex_id), three rows for each face."""
    return face.select("face_id", F.explode(F.array("v0", "v1", "v2")).alias("vertex_id"))


def vertex_to_face(face: DataFrame, vertex_value: DataFrame, discrete: bool = True) -> DataFrame:
    """A face's value from its corners: the fair mode of classes (class_id), or the mean of values (value)."""
    joined = corners(face).join(vertex_value, "vertex_id")
    return fair_mode(joined).drop("n") if discrete else joined.groupBy("face_id").agg(F.avg("value").alias("value"))


def label_ids(values: DataFrame, column: str, background: int | None = 0) -> DataFrame:
    """class_id and name of the distinct values in order, ids skipping `background`. The dictionary is small by nature."""
    names = values.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("name")).distinct()
    ranked = names.groupBy().agg(F.sort_array(F.collect_set("name")).alias("names")).select(F.posexplode("names").alias("i", "name"))
    at = F.col("i").cast("long")
    return ranked.select((at if background is None else F.when(at >= background, at + 1).otherwise(at)).alias("class_id"), "name")


def is_discrete(values: DataFrame, column: str) -> Column | bool:
    """Whether all finite values are whole numbers."""
    v = F.col(column).cast("double")
    return values.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).agg(F.coalesce(F.max(F.abs(v - F.round(v))), F.lit(0.0))).first()[0] == 0


def remap(values: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """values with class_id from labels(class_id, name); unknown names get null. Names must be unique."""
    if labels.groupBy("name").count().where("count > 1").take(1):
        raise ValueError("a label name stands for more than one id")
    return values.join(labels.select("class_id", F.col("name").alias(column)), column, "left")


def one_hot(values: DataFrame, classes: int) -> DataFrame:
    """class_id set to null where it is not in [0, classes): such rows keep counting as seen, for no class."""
    return values.withColumn("class_id", F.when(F.col("class_id").between(0, classes - 1), F.col("class_id")))


def add_label(labels: DataFrame, name: str) -> DataFrame:
    """labels and, if the name is new, it under the highest id plus one."""
    fresh = labels.agg(F.coalesce(F.max("class_id") + 1, F.lit(0)).cast("long").alias("class_id"), F.max(F.col("name") == name).alias("known"))
    return labels.select("class_id", "name").union(fresh.where("not coalesce(known, false)").select("class_id", F.lit(name)))
