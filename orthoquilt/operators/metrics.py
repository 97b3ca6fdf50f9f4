"""Confusion matrices in long form, cf(true_label, pred_label, amount), and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(pairs: DataFrame, truth: str, prediction: str, labels_from: str = "both") -> DataFrame:
    """Counts of (truth, prediction); `labels_from` gt or pred keeps only labels that occur there."""
    named = pairs.select(F.col(truth).alias("true_label"), F.col(prediction).alias("pred_label")).dropna()
    cf = named.groupBy("true_label", "pred_label").agg(F.count("*").alias("amount"))
    if labels_from == "both":
        return cf
    known = named.select(F.col("true_label" if labels_from == "gt" else "pred_label").alias("k")).distinct()
    first = cf.join(known.withColumnRenamed("k", "true_label"), "true_label", "left_semi")
    return first.join(known.withColumnRenamed("k", "pred_label"), "pred_label", "left_semi").select("true_label", "pred_label", "amount")


def normalised(cf: DataFrame) -> DataFrame:
    """frac: the amount by its truth's total."""
    total = cf.groupBy("true_label").agg(F.sum("amount").alias("t"))
    return cf.join(total, "true_label").select("true_label", "pred_label", "amount", F.try_divide(F.col("amount"), F.col("t")).alias("frac"))


def with_unlabelled(cf: DataFrame, truth_total: DataFrame, name: str = "unlabelled") -> DataFrame:
    """cf and for each truth (true_label, amount) the amount that no prediction covers."""
    covered = cf.groupBy("true_label").agg(F.sum("amount").alias("c"))
    rest = truth_total.join(covered, "true_label", "left").select(
        "true_label", F.lit(name).alias("pred_label"), (F.col("amount") - F.coalesce("c", F.lit(0.0))).alias("amount")
    )
    return cf.select("true_label", F.col("pred_label").cast("string"), F.col("amount").cast("double")).union(rest)


def accuracy(cf: DataFrame) -> DataFrame:
    """One row: the share on the diagonal."""
    hit = F.sum(F.when(F.col("true_label") == F.col("pred_label"), F.col("amount")).otherwise(0))
    return cf.agg(F.try_divide(hit, F.sum("amount")).alias("accuracy"))


def per_class(cf: DataFrame) -> DataFrame:
    """For each label: num_true, num_pred, recall (null without truth), precision (0 without predictions), accuracy against the rest."""
    sides = cf.select(F.col("true_label").alias("label"), F.col("amount").alias("t"), F.lit(0).alias("p"), F.when(F.col("true_label") == F.col("pred_label"), F.col("amount")).otherwise(0).alias("hit")).unionByName(
        cf.select(F.col("pred_label").alias("label"), F.lit(0).alias("t"), F.col("amount").alias("p"), F.lit(0).alias("hit"))
    )
    rows = sides.groupBy("label").agg(F.sum("t").alias("num_true"), F.sum("p").alias("num_pred"), F.sum("hit").alias("hit"))
    total = cf.agg(F.sum("amount")).first()[0]
    return rows.select(
        "label", "num_true", "num_pred",
        F.try_divide(F.col("hit"), F.col("num_true")).alias("recall"),
        F.coalesce(F.try_divide(F.col("hit"), F.col("num_pred")), F.lit(0.0)).alias("precision"),
        F.try_divide(F.lit(total) - F.col("num_true") - F.col("num_pred") + 2 * F.col("hit"), F.lit(total)).alias("class_accuracy"),
    )


def class_means(per: DataFrame) -> DataFrame:
    """One row: mean recall and precision over the classes that have truth."""
    return per.where("num_true > 0").agg(F.avg("recall").alias("mean_recall"), F.avg("precision").alias("mean_precision"), F.avg("class_accuracy").alias("mean_class_accuracy"))
