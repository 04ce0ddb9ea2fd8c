"""Out-of-distribution detection from a classifier's largest probability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import running


def threshold(known: DataFrame, score: str = "score", share: float = 0.05) -> DataFrame:
    """The score at place floor(share * n) of the ascending known scores; no interpolation."""
    counted = running(known.groupBy(score).agg(F.count(F.lit(1)).alias("_n")), score, "_n", "_below")
    total = known.agg(F.count(F.lit(1)).alias("_all"))
    at = F.least(F.floor(F.col("_all") * share), F.col("_all") - 1)
    found = counted.join(F.broadcast(total), (F.col("_below") <= at) & (at < F.col("_below") + F.col("_n")))
    return found.select(F.col(score).alias("threshold"))


def rates(scores: DataFrame, limit: DataFrame, score: str = "score") -> DataFrame:
    """Shares of known and of OOD rows (is_ood) strictly below the threshold."""
    flag = (F.col(score) < F.col("threshold")).cast("double")
    one = limit.withColumn("_one", F.lit(1))
    return scores.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one").agg(
        F.first("threshold").alias("threshold"),
        F.avg(F.when(~F.col("is_ood"), flag)).alias("false_alarm_rate"),
        F.avg(F.when(F.col("is_ood"), flag)).alias("ood_detection_rate"),
    )


def mean_scores(scores: DataFrame, score: str = "score") -> DataFrame:
    """The mean score of known and of OOD rows; null for a side without rows."""
    return scores.agg(F.avg(F.when(~F.col("is_ood"), F.col(score))).alias("known_mean"), F.avg(F.when(F.col("is_ood"), F.col(score))).alias("ood_mean"))


def auroc(scores: DataFrame, score: str = "score") -> DataFrame:
    """P(ood < known) + P(equal) / 2 over all pairs, from sorted counts: each distinct score adds its
    OOD rows times the known rows above it and half those beside it."""
    by_score = scores.groupBy(score).agg(F.sum(F.col("is_ood").cast("long")).alias("o"), F.sum((~F.col("is_ood")).cast("long")).alias("k"))
    below = running(by_score, score, "k")
    above = F.col("known") - F.col("before") - F.col("k")
    known = by_score.agg(F.sum("k").alias("known"), F.lit(1).alias("_one"))
    wins = below.withColumn("_one", F.lit(1)).join(F.broadcast(known), "_one").withColumn("w", F.col("o") * (above + F.col("k") / 2))
    return wins.agg((F.sum("w") / (F.sum("o") * F.sum("k"))).alias("auroc"))
