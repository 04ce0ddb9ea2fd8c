"""Train and test by whole run, and evenly spaced samples of each class."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import severity_order
from .eda import RUN
from .ranks import numbered


def step_of(test_fraction: float) -> int:
    """Every how many runs one is for testing."""
    return max(2, math.floor(1 / test_fraction + 0.5))


def run_split(runs: DataFrame, test_fraction: float = 0.2) -> DataFrame:
    """accident_type, severity_id, split for types with two runs or more; every step-th run in severity
    order is for testing, or the last one if none would be."""
    step = step_of(test_fraction)
    w = Window.partitionBy("accident_type")
    ranked = runs.select(*RUN).distinct().withColumn("_r", F.row_number().over(w.orderBy(*severity_order(F.col("severity_id"))))).withColumn("_n", F.count(F.lit(1)).over(w)).where("_n >= 2")
    test = (F.col("_r") % step == 0) | ((F.col("_n") < step) & (F.col("_r") == F.col("_n")))
    return ranked.select(*RUN, F.when(test, "test").otherwise("train").alias("split"))


def single_run_types(runs: DataFrame) -> DataFrame:
    return runs.select(*RUN).distinct().groupBy("accident_type").agg(F.count(F.lit(1)).alias("n_runs")).where("n_runs < 2").select("accident_type")


def routed(windows: DataFrame, runs: DataFrame, test_fraction: float = 0.2) -> DataFrame:
    """`windows` with split: train for single-run types and train runs, test for all others."""
    split = run_split(runs, test_fraction)
    single = single_run_types(runs).withColumn("_single", F.lit(True))
    out = windows.join(split, RUN, "left").join(single, "accident_type", "left")
    return out.withColumn("split", F.when(F.col("_single") | (F.col("split") == "train"), "train").otherwise("test")).drop("_single")


def subsample(items: DataFrame, most: int, order: list, label: str = "accident_type") -> DataFrame:
    """At most `most` items of each label, evenly spaced in `order`, first and last included.

    Items are numbered over all labels at once, so a frequent label is sorted by many tasks; items
    that are equal in `order` keep any order among themselves."""
    ranked = numbered(items, [F.col(label), *order], "_no")
    sizes = ranked.groupBy(F.col(label).alias("_label")).agg(F.min("_no").alias("_least"), F.count(F.lit(1)).alias("_n"))
    ranked = ranked.join(sizes, F.col(label).eqNullSafe(F.col("_label"))).withColumn("_k", F.col("_no") - F.col("_least"))
    gap = max(most - 1, 1)
    # kept: k = floor(i * (n - 1) / (most - 1)) for an i below most
    i = F.floor((F.col("_k") * gap + F.col("_n") - 2) / F.greatest(F.col("_n") - 1, F.lit(1)))
    hit = (i < most) & (F.floor(i * (F.col("_n") - 1) / gap) == F.col("_k"))
    return ranked.where((F.col("_n") <= most) | hit).drop("_k", "_n", "_no", "_least", "_label")
