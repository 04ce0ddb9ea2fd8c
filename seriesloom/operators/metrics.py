"""Confusion counts and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """n for every pair (true_idx, pred_idx) of the labels' indices, 0 included."""
    counted = scored.groupBy("true_idx", "pred_idx").agg(F.count(F.lit(1)).alias("n"))
    idx = labels.select("label_idx")
    known = idx.select(F.col("label_idx").alias("true_idx"), F.collect_set("label_idx").over(Window.partitionBy()).alias("_all"))
    every = known.select("true_idx", F.explode("_all").alias("pred_idx"))
    return every.join(counted, ["true_idx", "pred_idx"], "left").select("true_idx", "pred_idx", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def row_shares(matrix: DataFrame) -> DataFrame:
    """Each cell as a share of its true class; 0 for a class without rows."""
    total = F.sum("n").over(Window.partitionBy("true_idx"))
    return matrix.select("true_idx", "pred_idx", F.when(total > 0, F.col("n") / total).otherwise(0.0).alias("share"))


def per_class(matrix: DataFrame, labels: DataFrame) -> DataFrame:
    """label, precision, recall, f1 and support of each class; 0 where a denominator is 0."""
    hit = F.sum(F.when(F.col("true_idx") == F.col("pred_idx"), F.col("n")).otherwise(0))
    rows = matrix.groupBy(F.col("true_idx").alias("label_idx")).agg(F.sum("n").alias("support"), hit.alias("hits"))
    columns = matrix.groupBy(F.col("pred_idx").alias("label_idx")).agg(F.sum("n").alias("predicted"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = rows.join(columns, "label_idx").join(labels, "label_idx")
    out = out.withColumn("precision", share(F.col("hits"), F.col("predicted"))).withColumn("recall", share(F.col("hits"), F.col("support")))
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", share(2 * p * r, p + r)).select(*labels.columns, "precision", "recall", "f1", "support")


def overall(matrix: DataFrame, classes: DataFrame) -> DataFrame:
    """accuracy (NaN without rows) and macro_f1 over classes with support (0 without any)."""
    acc = matrix.agg(F.sum(F.when(F.col("true_idx") == F.col("pred_idx"), F.col("n")).otherwise(0)).alias("hits"), F.sum("n").alias("total"), F.lit(1).alias("_one"))
    f1 = classes.where("support > 0").agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"), F.lit(1).alias("_one"))
    return acc.join(f1, "_one").select(F.when(F.col("total") > 0, F.col("hits") / F.col("total")).otherwise(F.lit(float("nan"))).alias("accuracy"), "macro_f1")
