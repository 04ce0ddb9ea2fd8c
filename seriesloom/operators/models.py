"""Classifiers on labelled vectors: exact CART, multi-class boosting, Gaussian naive Bayes, forests.

Training rows come from `splits.subsample`, so there are at most cap * classes of them; `matrix`
checks that before they reach the driver.  Scoring is a Column expression or runs in Spark ML.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import argmax, softmax
from ..shared import staged
from .trees import Tree, fit_tree

#: Cells of a training matrix that the driver and each executor may hold.
MOST_CELLS = 50_000_000


def matrix(rows: DataFrame, features: list[str], label: str, order: list) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) of a capped sample in the given order; refuses a larger one."""
    n = rows.count()
    if n * len(features) > MOST_CELLS:
        raise ValueError(f"{n} rows of {len(features)} features are over {MOST_CELLS} cells; lower the cap of the sample")
    local = rows.orderBy(*order).select(*(F.col(f).cast("double") for f in features), F.col(label).cast("long").alias("_y")).toPandas()
    return local[features].to_numpy(np.float64), local["_y"].to_numpy(np.int64)


@dataclass
class Cart:
    tree: Tree
    classes: int

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, classes: int, max_depth: int = 8, min_leaf: int = 5) -> Cart:
        return cls(fit_tree(x, y, max_depth, min_leaf, classes), classes)

    def prediction(self, features: list[str]) -> Column:
        """Index of the leaf's most frequent class, the lowest on ties."""
        return self.tree.column(features, lambda counts: F.lit(int(np.argmax(counts))))


@dataclass
class Boosting:
    """trees[round][class], each a regression tree on the residuals of that class."""

    trees: list[list[Tree]]
    rate: float
    classes: int

    @classmethod
    def fit(cls, spark, x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 18, rate: float = 0.3, max_depth: int = 3, min_leaf: int = 10) -> Boosting:
        """Scores start at 0; the classes of a round see the probabilities from before it, so their trees
        are fitted side by side, one task a class; x is sent to the executors once."""
        scores, target = np.zeros((len(x), classes)), np.eye(classes)[y]
        shared = spark.sparkContext.broadcast((x, np.argsort(x, axis=0, kind="stable").T))
        out = []
        for _ in range(rounds):
            powers = np.exp(scores - scores.max(1, keepdims=True))
            residuals = target - powers / powers.sum(1, keepdims=True)

            def fit_class(part: pd.DataFrame) -> pd.DataFrame:
                rows, order = shared.value
                k = int(part["k"].iloc[0])
                t = fit_tree(rows, residuals[:, k], max_depth, min_leaf, order=order)
                return pd.DataFrame([(k, t.feature, t.threshold, t.left, t.right, t.value)], columns=["k", "feature", "threshold", "l", "r", "value"])

            schema = "k long, feature array<long>, threshold array<double>, l array<long>, r array<long>, value array<double>"
            fitted = spark.range(classes).withColumnRenamed("id", "k").repartition(classes, "k").groupBy("k").applyInPandas(fit_class, schema).collect()
            trees = [Tree(list(r["feature"]), list(r["threshold"]), list(r["l"]), list(r["r"]), list(r["value"])) for r in sorted(fitted, key=lambda r: r["k"])]
            scores += rate * np.stack([t.predict(x) for t in trees], 1)
            out.append(trees)
        shared.destroy()
        return cls(out, rate, classes)

    def probabilities(self, features: list[str]) -> Column:
        """Softmax over the classes' sums of tree expressions."""
        sums = [sum((F.lit(self.rate) * r[k].column(features) for r in self.trees), F.lit(0.0)) for k in range(self.classes)]
        return softmax(F.array(*sums))

    def predict_proba(self, x: np.ndarray) -> np.ndarray:
        scores = sum(self.rate * np.stack([t.predict(x) for t in r], 1) for r in self.trees)
        powers = np.exp(scores - scores.max(1, keepdims=True))
        return powers / powers.sum(1, keepdims=True)

    def prediction(self, features: list[str]) -> Column:
        return argmax(self.probabilities(features))


SMOOTHING = 1e-9


def bayes_parameters(rows: DataFrame, label: str = "label") -> DataFrame:
    """label, feature, prior, mean, var of long rows (row_id, label, feature, value).

    Every variance gets 1e-9 times the largest variance of a feature over all rows."""
    largest = rows.groupBy("feature").agg(F.var_pop("value").alias("v")).agg((F.max("v") * SMOOTHING).alias("extra"), F.lit(1).alias("_one"))
    stats = rows.groupBy(label, "feature").agg(F.avg("value").alias("mean"), F.var_pop("value").alias("var0"), F.count(F.lit(1)).alias("n"))
    total = rows.groupBy("feature").agg(F.count(F.lit(1)).alias("total"))
    joined = stats.join(total, "feature").withColumn("_one", F.lit(1)).join(F.broadcast(largest), "_one")
    return joined.select(label, "feature", (F.col("n") / F.col("total")).alias("prior"), "mean", (F.col("var0") + F.col("extra")).alias("var"))


def bayes_predict(rows: DataFrame, parameters: DataFrame, label: str = "label") -> DataFrame:
    """row_id and predicted: the label of the largest log-likelihood, the lowest on ties."""
    p = parameters.withColumnRenamed(label, "predicted")
    v = F.col("value") - F.col("mean")
    term = -0.5 * F.ln(2.0 * math.pi * F.col("var")) - v * v / (2.0 * F.col("var"))
    scored = rows.select("row_id", "feature", "value").join(p, "feature").groupBy("row_id", "predicted").agg((F.sum(term) + F.ln(F.first("prior"))).alias("ll"))
    return scored.groupBy("row_id").agg(F.min_by("predicted", F.struct(-F.round("ll", 6), "predicted")).alias("predicted"))


def forest(train: DataFrame, features: list[str], label: str, trees: int = 50, depth: int = 12, seed: int = 7):
    """A fitted Spark ML pipeline: vector assembler and random forest."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    assembler = VectorAssembler(inputCols=features, outputCol="_features")
    return Pipeline(stages=[assembler, RandomForestClassifier(featuresCol="_features", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)]).fit(train)


def permutation_importance(rows: DataFrame, features: list[str], prediction: Column, label: str, order: list, shift: int = 1) -> DataFrame:
    """feature, accuracy_drop: how much accuracy falls when one feature's values move to other rows.

    Rows are numbered once in a hash order, by many tasks; each feature's values come from the row `shift`
    places before, those of the first rows from themselves."""
    from .ranks import numbered

    kept = numbered(rows.select(*features, label, F.xxhash64(*order).alias("_h"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order))), ["_h", *(f"_o{i}" for i in range(len(order)))], "_no")
    before = kept.select((F.col("_no") + shift).alias("_to"), F.struct(*features).alias("_moved"))
    both = staged(kept.join(before, kept["_no"] == before["_to"], "left").drop("_to"), "moved")
    right = lambda c: (c == F.col(label)).cast("double")
    out = None
    base = both.withColumn("_base", right(prediction))
    for f in features:
        swapped = base.withColumn(f, F.coalesce(F.col(f"_moved.{f}"), F.col(f)))
        one = swapped.agg((F.avg("_base") - F.avg(right(prediction))).alias("accuracy_drop")).select(F.lit(f).alias("feature"), "accuracy_drop")
        out = one if out is None else out.union(one)
    return out
