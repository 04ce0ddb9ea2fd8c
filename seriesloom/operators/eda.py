"""Runs, durations, class balance, histograms and axis extents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import severity_order

RUN = ["accident_type", "severity_id"]


def with_rows(readings: DataFrame, order: list, run: list[str] = RUN) -> DataFrame:
    """`readings` with row_idx (from 0 in the total order `order`) and n_rows of the run."""
    w = Window.partitionBy(*run)
    return readings.withColumn("row_idx", F.row_number().over(w.orderBy(*order)) - 1).withColumn("n_rows", F.count(F.lit(1)).over(w))


def run_durations(readings: DataFrame, order: list, runs: DataFrame | None = None) -> DataFrame:
    """n_rows and duration_seconds (the last row's time) of each run.

    Runs of `runs` without readings have 0 rows and a null duration."""
    out = readings.groupBy(*RUN).agg(F.count(F.lit(1)).alias("n_rows"), F.max_by("time_seconds", F.struct(*order)).alias("duration_seconds"))
    if runs is not None:
        out = runs.select(*RUN).distinct().join(out, RUN, "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0).cast("long")))
    return out


def summary(durations: DataFrame) -> DataFrame:
    """Runs and least, mean and greatest duration of each type; 0 where no run has a duration."""
    stat = lambda f: F.coalesce(f("duration_seconds"), F.lit(0.0))
    return durations.groupBy("accident_type").agg(
        F.count(F.lit(1)).alias("sample_count"), stat(F.min).alias("min_duration_seconds"), stat(F.avg).alias("mean_duration_seconds"), stat(F.max).alias("max_duration_seconds")
    )


def types(readings: DataFrame) -> DataFrame:
    """Sorted distinct types."""
    return readings.select("accident_type").distinct().orderBy("accident_type")


def label_index(labels: DataFrame, column: str = "accident_type") -> DataFrame:
    """Each distinct label and its place in sorted order, from 0."""
    distinct = labels.select(column).distinct()
    return distinct.withColumn("label_idx", F.row_number().over(Window.orderBy(column)) - 1)


def histogram(values: DataFrame, column: str, width: float) -> DataFrame:
    """Counts of floor(v / width), all bins from 0 to ceil(max / width) present, the last taking what
    lies beyond and the first what is negative; the maximum is 0 at least; no bins without values."""
    bins = values.agg(F.when(F.max(column).isNotNull(), F.ceil(F.greatest(F.max(column), F.lit(0)) / width) + 1).cast("int").alias("n")).where("n is not null")
    every = bins.select("n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("bin"))
    # ceil(max / w) is never below floor(v / w), so the clamp to the last bin binds no value
    counted = values.where(F.col(column).isNotNull()).groupBy(F.greatest(F.floor(F.col(column) / width), F.lit(0)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n_values"))
    return every.join(counted, "bin", "left").select("bin", (F.col("bin") * width).cast("double").alias("bin_start"), F.coalesce("n_values", F.lit(0).cast("long")).alias("n_values"))


def extents(series: DataFrame, x: str, y: str, headroom: float = 0.1, pad: float = 0.05) -> DataFrame:
    """Axis extents over all series: x as it is, y padded by a share of its range (of 1 at least), and the bar top, from 0 on."""
    span = F.greatest(F.max(y) - F.min(y), F.lit(1.0)) * pad
    return series.agg(F.min(x).alias("x_min"), F.max(x).alias("x_max"), (F.min(y) - span).alias("y_min"), (F.max(y) + span).alias("y_max"), F.when(F.max(y).isNotNull(), F.greatest(F.max(y), F.lit(0.0)) * (1 + headroom)).alias("bar_top"))


def longest_run(durations: DataFrame) -> DataFrame:
    """The longest run of each type that has a duration, the first by severity on ties."""
    return _first(durations.where(F.col("duration_seconds").isNotNull()), [-F.col("duration_seconds"), *severity_order(F.col("severity_id"))])


def first_runs(durations: DataFrame, wanted: list[str]) -> DataFrame:
    """The first run by severity of each wanted type that has one."""
    return _first(durations.where(F.col("accident_type").isin(wanted)), severity_order(F.col("severity_id")))


def _first(rows: DataFrame, order: list) -> DataFrame:
    """The least row of each type by `order`; an aggregate, so a frequent type is no one task's work."""
    keys = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(order)))
    return rows.groupBy("accident_type").agg(F.min_by(F.struct(*rows.columns), keys).alias("_r")).select("_r.*")


def relative(rows: DataFrame, value: str, until: float | None = None) -> DataFrame:
    """value / first value of the run (null for 0), on the rows before time first passes `until`."""
    w = Window.partitionBy(*RUN).orderBy("row_idx")
    if until is not None:
        past = F.max((F.col("time_seconds") > until).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("_past", past).where("_past = 0").drop("_past")
    first = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("relative", F.try_divide(F.col(value), first))


def every(rows: DataFrame, stride: int, index: str = "row_idx") -> DataFrame:
    """Each stride-th row, the first included."""
    return rows.where(F.col(index) % stride == 0)


def ecdf(scores: DataFrame, column: str) -> DataFrame:
    """Each score with the share of scores before it, from 0 to (n - 1) / n."""
    from .ranks import running

    counted = running(scores.groupBy(column).agg(F.count(F.lit(1)).alias("_n")), column, "_n", "_below")
    total = scores.agg(F.count(F.lit(1)).alias("_all"), F.lit(1).alias("_one"))
    each = counted.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    return each.select(column, ((F.col("_below") + F.col("_k")) / F.col("_all")).alias("fraction"))


def midpoint(start: str = "window_start_seconds", end: str = "window_end_seconds") -> Column:
    return (F.col(start) + F.col(end)) / 2
