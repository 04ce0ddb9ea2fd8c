"""The analyses as whole plans: readings in, result document out.

Every plan takes readings (accident_type, severity_id, time_seconds, sensors), the runs they come from
and the sensors' names; order within a run is time.  Splits are made by run before windows are cut.
`python -m seriesloom.plans.diagnosis PLAN ROOT OUT [name=value ...]` runs one on run files.
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import severity_order
from ..operators import eda as runs_
from ..operators import kinetics as physics
from ..operators import metrics, models, ood, sequences, splits, windows
from ..operators.lstm import Lstm
from ..sources import results, runs

TIME = ["time_seconds"]


def _rows(readings: DataFrame) -> DataFrame:
    return runs_.with_rows(readings, TIME)


def eda(readings: DataFrame, runs_df: DataFrame, sensors: list[str]) -> dict:
    """Runs and durations of each type."""
    found = results.rows(runs_.summary(runs_.run_durations(readings, TIME, runs_df)), ["accident_type"])
    return {"total_samples": sum(r["sample_count"] for r in found), "accident_types": found}


def features(readings: DataFrame, runs_df: DataFrame, sensors: list[str], size: int = 5, stride: int = 3) -> tuple[DataFrame, dict]:
    """Windows of all runs, and their numbers by type."""
    w = windows.grouped(_rows(readings), sensors, size, stride)
    per = results.rows(windows.per_type(w, runs_df.select("accident_type").distinct()), ["accident_type"])
    return w, {
        "window_size_rows": size, "stride_rows": stride, "total_windows": sum(r["n_windows"] for r in per),
        "windows_per_accident_type": [[r["accident_type"], r["n_windows"]] for r in per if r["n_windows"]],
        "accident_types_with_zero_windows": [r["accident_type"] for r in per if not r["n_windows"]],
    }


def _labelled(readings, runs_df, sensors, size, stride, fraction, cap, test_cap=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Capped train and test windows with label_idx, and the labels."""
    labels = runs_.label_index(runs_df)
    w = splits.routed(windows.grouped(_rows(readings), sensors, size, stride), runs_df, fraction).join(labels, "accident_type")
    order = [*severity_order(F.col("severity_id")), "window_start_seconds"]
    take = lambda name, most: splits.subsample(w.where(F.col("split") == name), most, order).persist()
    return take("train", cap), take("test", cap // 2 if test_cap is None else test_cap), labels


def _evaluated(scored: DataFrame, labels: DataFrame) -> dict:
    m = metrics.confusion(scored.select(F.col("label_idx").alias("true_idx"), "pred_idx"), labels).persist()
    per = metrics.per_class(m, labels).persist()
    return results.evaluation(metrics.overall(m, per), per, m)


def _order() -> list:
    return ["accident_type", *severity_order(F.col("severity_id")), "window_start_seconds"]


def baseline(readings: DataFrame, runs_df: DataFrame, sensors: list[str], size: int = 5, stride: int = 3, fraction: float = 0.2, cap: int = 2000) -> dict:
    """Gaussian naive Bayes and a random forest of 50 trees."""
    train, test, labels = _labelled(readings, runs_df, sensors, size, stride, fraction, cap)
    names = windows.names(sensors)
    key = F.struct(*runs_.RUN, "window_start_seconds")
    long = lambda df: df.select(key.alias("row_id"), "label_idx", F.posexplode(F.array(*names)).alias("feature", "value"))
    bayes = models.bayes_predict(long(test), models.bayes_parameters(long(train), "label_idx"), "label_idx").withColumnRenamed("predicted", "pred_idx")
    bayes = bayes.join(test.select(key.alias("row_id"), "label_idx"), "row_id")
    forest = models.forest(train, names, "label_idx", 50, 20).transform(test).withColumn("pred_idx", F.col("prediction").cast("int"))
    single = results.rows(splits.single_run_types(runs_df), ["accident_type"])
    return {
        "window_size_rows": size, "stride_rows": stride, "test_fraction": fraction, "max_windows_per_class": cap, "single_run_types": [r["accident_type"] for r in single],
        "n_train": train.count(), "n_test": test.count(), "gaussian_naive_bayes": _evaluated(bayes, labels), "random_forest": _evaluated(forest, labels),
    }


def scratch(readings: DataFrame, runs_df: DataFrame, sensors: list[str], size: int = 5, stride: int = 3, fraction: float = 0.2, cap: int = 500, rounds: int = 18) -> dict:
    """Exact CART (depth 8, leaf 5) and boosting (rate 0.3, depth 3, leaf 10)."""
    spark, names = readings.sparkSession, windows.names(sensors)
    train, test, labels = _labelled(readings, runs_df, sensors, size, stride, fraction, cap, max(cap // 2, 1))
    x, y = models.matrix(train, names, "label_idx", _order())
    k = labels.count()
    cart = test.withColumn("pred_idx", models.Cart.fit(x, y, k).prediction(names))
    boosted = test.withColumn("pred_idx", models.Boosting.fit(spark, x, y, k, rounds).prediction(names))
    return {
        "window_size_rows": size, "stride_rows": stride, "test_fraction": fraction, "max_windows_per_class": cap, "boosting_rounds": rounds,
        "n_train": len(x), "n_test": test.count(), "cart_tree": _evaluated(cart, labels), "gradient_boosting": _evaluated(boosted, labels),
    }


def out_of_distribution(readings: DataFrame, runs_df: DataFrame, sensors: list[str], unknown: str, size: int = 5, stride: int = 3, fraction: float = 0.2, cap: int = 500, rounds: int = 18) -> dict:
    """Boosting on the known types; types named in `unknown` (comma-separated) must stand out."""
    spark, names = readings.sparkSession, windows.names(sensors)
    held = [t.strip() for t in unknown.split(",")]
    apart = F.col("accident_type").isin(held)
    train, test, labels = _labelled(readings.where(~apart), runs_df.where(~apart), sensors, size, stride, fraction, cap, max(cap // 2, 1))
    x, y = models.matrix(train, names, "label_idx", _order())
    model = models.Boosting.fit(spark, x, y, labels.count(), rounds)
    other = splits.subsample(windows.grouped(_rows(readings.where(apart)), sensors, size, stride), max(cap // 2, 1), [*severity_order(F.col("severity_id")), "window_start_seconds"])
    score = F.array_max(model.probabilities(names)).alias("score")
    scores = test.select(score, F.lit(False).alias("is_ood")).union(other.select(score, F.lit(True).alias("is_ood"))).persist()
    known = scores.where("not is_ood")
    if known.isEmpty():
        raise ValueError("no test windows of known types to calibrate on")
    limit = ood.threshold(known)
    found = ood.rates(scores, limit).first().asDict()
    ordered = lambda flag: [r["score"] for r in results.rows(scores.where(F.col("is_ood") == flag), ["score"], 1_000_000)]
    return {
        "ood_types": held, "known_labels": [r["accident_type"] for r in results.rows(labels, ["label_idx"])], "known_evaluation": _evaluated(test.withColumn("pred_idx", model.prediction(names)), labels),
        **found, "auroc": ood.auroc(scores).first()["auroc"], "known_scores": ordered(False), "ood_scores": ordered(True),
    }


def kinetics(readings: DataFrame, runs_df: DataFrame, sensors: list[str], sensor: str = "PWR", up: str = "RI", down: str = "RW", final: float = 0.0006, until: float = 120.0) -> dict:
    """Simulated ramps up and down, and the relative power of the longest run of two types."""
    spark = readings.sparkSession
    scenarios = spark.createDataFrame([("up", 10.0, 25.0, final, 0.0), ("down", 10.0, 25.0, -final, 0.0)], "scenario string, start double, end double, final double, feedback double")
    simulated = results.rows(physics.simulations(scenarios), ["scenario", "point"])
    own = readings.where(F.col("accident_type").isin(up, down))
    longest = runs_.longest_run(runs_.run_durations(own, TIME)).select(*runs_.RUN)
    real = results.rows(runs_.relative(_rows(own.join(longest, runs_.RUN)), sensor, until).select("accident_type", "time_seconds", "relative"), ["accident_type", "time_seconds"])
    series = lambda name: [[r["t"], r["power"]] for r in simulated if r["scenario"] == name]
    trace = lambda name: [[r["time_seconds"], r["relative"]] for r in real if r["accident_type"] == name]
    return {
        "note": "no thermal feedback: simulated and recorded power agree in direction only", "reactivity": final, "ramp_start_seconds": 10.0, "ramp_end_seconds": 25.0,
        "simulated_up": series("up"), "simulated_down": series("down"), "recorded_up": trace(up), "recorded_down": trace(down),
    }


def lstm(readings: DataFrame, runs_df: DataFrame, sensors: list[str], length: int = 30, fraction: float = 0.2, cap: int = 300, hidden: int = 32, epochs: int = 30) -> dict:
    """The recurrent classifier on whole runs."""
    labels = runs_.label_index(runs_df)
    every = splits.routed(sequences.sequences(_rows(readings), sensors, length), runs_df, fraction).join(labels, "accident_type")
    take = lambda name, most: splits.subsample(every.where(F.col("split") == name), most, severity_order(F.col("severity_id")))
    train, test = take("train", cap).persist(), take("test", max(cap // 2, 1)).persist()
    stats = sequences.normalization(train)
    model = Lstm.fit(sequences.normalized(train, stats), labels.count(), hidden, epochs)
    scored = model.predict(sequences.normalized(test, stats))
    return {"seq_len": length, "test_fraction": fraction, "max_runs_per_class": cap, "hidden": hidden, "epochs": epochs, "n_train": train.count(), "n_test": test.count(), "losses": model.losses, "eval": _evaluated(scored, labels)}


PLANS = {"eda": eda, "features": lambda *a, **k: features(*a, **k)[1], "baseline": baseline, "scratch": scratch, "ood": out_of_distribution, "kinetics": kinetics, "lstm": lstm}


def main(args: list[str]) -> None:
    plan, root, out, *rest = args
    options = {k: (json.loads(v) if v[:1].isdigit() else v) for k, _, v in (x.partition("=") for x in rest)}
    spark = SparkSession.builder.appName(f"seriesloom {plan}").getOrCreate()
    results.write_document(spark, PLANS[plan](*runs.load(spark, root), **options), out)


if __name__ == "__main__":
    main(sys.argv[1:])
