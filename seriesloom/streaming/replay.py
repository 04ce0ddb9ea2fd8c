"""Rolling-window features on a stream of readings.

State of a run: its number of rows so far and the last rows that a coming window can need.  Readings
come in time order within a run, as a sensor sends them; rows older than the last one are late and
are left out.  A drained stream gives the windows that the batch operator gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "accident_type string, severity_id string, window_start_seconds double, window_end_seconds double, value_mean double, value_std double, value_slope double"


def features(t: np.ndarray, v: np.ndarray) -> tuple[float, float, float]:
    """Mean, population deviation and slope of one window."""
    dt = t - t.mean()
    spread = float((dt * dt).sum())
    return float(v.mean()), float(v.std()), float((dt * (v - v.mean())).sum() / spread) if spread else 0.0


def incremental(readings: DataFrame, size: int = 5, stride: int = 3) -> DataFrame:
    """Windows of a stream with accident_type, severity_id, time_seconds, event_id and value."""

    def advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, times, values, last = state.get if state.exists else (0, [], [], None)
        times, values, out = list(times), list(values), []
        rows = pd.concat(list(parts)).sort_values(["time_seconds", "event_id"])
        for t, v in zip(rows["time_seconds"], rows["value"], strict=True):
            if last is not None and t < last:
                continue
            last, count = t, count + 1
            times, values = [*times, t][-size:], [*values, v][-size:]
            if count >= size and (count - size) % stride == 0:
                out.append((*key, times[0], times[-1], *features(np.array(times), np.array(values))))
        state.update((count, times, values, last))
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in OUT.split(", ")])

    schema = "count long, times array<double>, vals array<double>, last double"
    return readings.groupBy("accident_type", "severity_id").applyInPandasWithState(advance, OUT, schema, "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, path: str) -> DataFrame:
    """Runs `stream` over all that is there now, writes it to `path`, and returns what it wrote."""
    spark = stream.sparkSession
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
