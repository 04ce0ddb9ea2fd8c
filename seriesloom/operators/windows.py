"""Strided rolling windows over runs: mean, population deviation, least-squares slope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .eda import RUN


def rolling(rows: DataFrame, sensors: list[str], size: int = 5, stride: int = 3, flat: float = 0.0) -> DataFrame:
    """Complete windows of `size` rows from every stride-th row; rows need row_idx and n_rows.  `flat` is the
    slope where all times with a value are equal; where there is no value it is 0.

    One window frame a row: best for few sensors, or stride 1."""
    _valid(size, stride)
    ahead = Window.partitionBy(*RUN).orderBy("row_idx").rowsBetween(0, size - 1)
    t = F.col("time_seconds")
    features = [f(F.col(s)).over(ahead).alias(f"{s}_{k}") for s in sensors for k, f in (("mean", F.avg), ("std", F.stddev_pop))]
    none = {s: F.lit(0.0) if flat == 0 else F.when(F.regr_count(F.col(s), t).over(ahead) > 0, flat).otherwise(0.0) for s in sensors}
    slopes = [F.coalesce(F.regr_slope(F.col(s), t).over(ahead), none[s]).alias(f"{s}_slope") for s in sensors]
    out = rows.select(*RUN, "row_idx", "n_rows", t.alias("window_start_seconds"), F.last(t).over(ahead).alias("window_end_seconds"), *features, *slopes)
    return out.where((F.col("row_idx") % stride == 0) & (F.col("row_idx") + size <= F.col("n_rows"))).select(*RUN, "window_start_seconds", "window_end_seconds", *names(sensors))


def grouped(rows: DataFrame, sensors: list[str], size: int = 5, stride: int = 3, flat: float = 0.0) -> DataFrame:
    """The same windows: the rows of each are gathered once and all features folded from them in row order.
    Best for many sensors.

    The steps of the fold are the textbook's and DuckDB's, so that last digits are SQL's too: products for
    the slope are added without rounding them first, those for the deviation after it."""
    _valid(size, stride)
    ahead = Window.partitionBy(*RUN).orderBy("row_idx").rowsBetween(0, size - 1)
    frames = rows.select(*RUN, "row_idx", "n_rows", F.collect_list(F.struct("time_seconds", *sensors)).over(ahead).alias("_rows"))
    frames = frames.where((F.col("row_idx") % stride == 0) & (F.col("row_idx") + size <= F.col("n_rows")))
    folded = frames.select(*RUN, F.col("_rows")[0]["time_seconds"].alias("window_start_seconds"), F.col("_rows")[size - 1]["time_seconds"].alias("window_end_seconds"), *(_folded(s, flat).alias(s) for s in sensors))
    return folded.select(*RUN, "window_start_seconds", "window_end_seconds", *(F.col(s)[k].alias(f"{s}_{k}") for s in sensors for k in ("mean", "std", "slope")))


def _folded(sensor: str, flat: float) -> Column:
    """struct<mean, std, slope> of `_rows` from running means and moments; nulls are left out."""
    zero = F.lit(0.0)

    def step(a: Column, row: Column) -> Column:
        y, t = row[sensor].cast("double"), row["time_seconds"]
        n, pairs = a["n"] + 1, a["pairs"] + 1
        mean = a["mean"] + (y - a["mean"]) / n
        mean_t, mean_y = a["mean_t"] + (t - a["mean_t"]) / pairs, a["mean_y"] + (y - a["mean_y"]) / pairs
        own = {"n": n, "sum": a["sum"] + y, "mean": mean, "square": a["square"] + (y - mean) * (y - a["mean"])}
        both = {"pairs": pairs, "mean_t": mean_t, "mean_y": mean_y, "product": _fused(t - a["mean_t"], y - mean_y, a["product"]), "square_t": a["square_t"] + (t - mean_t) * (t - a["mean_t"])}
        new = {k: F.when(y.isNull(), a[k]).otherwise(v) for k, v in own.items()} | {k: F.when(y.isNull() | t.isNull(), a[k]).otherwise(v) for k, v in both.items()}
        return F.struct(*(v.alias(k) for k, v in new.items()))

    def finish(a: Column) -> Column:
        some = a["n"] > 0
        slope = F.try_divide(F.try_divide(a["product"], a["pairs"]), F.try_divide(a["square_t"], a["pairs"]))
        none = F.when(a["pairs"] > 0, F.lit(flat)).otherwise(zero)
        return F.struct(F.when(some, a["sum"] / a["n"]).alias("mean"), F.when(some, F.sqrt(a["square"] / a["n"])).alias("std"), F.coalesce(slope, none).alias("slope"))

    begin = F.struct(*(zero.alias(k) for k in ("n", "sum", "mean", "square", "pairs", "mean_t", "mean_y", "product", "square_t")))
    return F.aggregate("_rows", begin, step, finish)


def _fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c, rounded once; the texts that reflect returns are exact."""
    return F.reflect(F.lit("java.lang.Math"), F.lit("fma"), a, b, c).cast("double")


def _valid(size: int, stride: int) -> None:
    if size < 2 or stride < 1:
        raise ValueError(f"a window needs 2 rows or more and a stride of 1 or more, not {size} and {stride}")


def names(sensors: list[str]) -> list[str]:
    """Feature names in sensor order."""
    return [f"{s}_{k}" for s in sensors for k in ("mean", "std", "slope")]


def per_type(windows: DataFrame, types: DataFrame) -> DataFrame:
    """Windows of every type, 0 where it has none."""
    counted = windows.groupBy("accident_type").agg(F.count(F.lit(1)).alias("n_windows"))
    return types.join(counted, "accident_type", "left").select("accident_type", F.coalesce("n_windows", F.lit(0).cast("long")).alias("n_windows"))


def without(windows: DataFrame, types: DataFrame) -> DataFrame:
    """Types that have no window."""
    return types.join(windows.select("accident_type"), "accident_type", "left_anti")
