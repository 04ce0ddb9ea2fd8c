"""Fixed-length sequences of a run and their normalization."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hold_last, z_scored
from .eda import RUN

LEAST_STD = 1e-8


def sequences(rows: DataFrame, sensors: list[str], length: int) -> DataFrame:
    """sequence ARRAY<ARRAY<DOUBLE>>: the first `length` rows of each run, the last one repeated.

    Rows past the length never reach the aggregation but the run's early rows; runs without rows have
    no sequence."""
    head = rows.where(F.col("row_idx") < length)
    step = F.struct("row_idx", F.array(*(F.col(s).cast("double") for s in sensors)).alias("v"))
    out = head.groupBy(*RUN).agg(F.sort_array(F.collect_list(step)).alias("s"))
    return out.select(*RUN, hold_last(F.transform("s", lambda x: x["v"]), length).alias("sequence"))


def normalization(train: DataFrame) -> DataFrame:
    """Per sensor place: mean and population deviation (at least 1e-8) over all steps of `train`."""
    steps = train.select(F.explode("sequence").alias("step")).select(F.posexplode("step").alias("sensor", "v"))
    return steps.groupBy("sensor").agg(F.avg("v").alias("mean"), F.greatest(F.stddev_pop("v"), F.lit(LEAST_STD)).alias("std"))


def normalized(seqs: DataFrame, stats: DataFrame) -> DataFrame:
    """`seqs` with z-scored steps; `stats` has a row a sensor."""
    ordered = F.sort_array(F.collect_list(F.struct("sensor", "mean", "std")))
    one = stats.agg(ordered.alias("st")).select(F.transform("st", lambda x: x["mean"]).alias("_m"), F.transform("st", lambda x: x["std"]).alias("_s"), F.lit(1).alias("_one"))
    joined = seqs.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one")
    return joined.withColumn("sequence", F.transform("sequence", lambda step: z_scored(step, F.col("_m"), F.col("_s")))).drop("_m", "_s", "_one")
