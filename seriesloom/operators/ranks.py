"""Ranks and running sums over a whole table, without one task that sorts it all.

Rows are sorted by range; a row's place in its part is known there, and one row a part is summed up
for the places before it.  Parts are written once, so both steps see the same ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import staged


def numbered(rows: DataFrame, keys: list, name: str = "row_no") -> DataFrame:
    """`rows` with their number, from 0, in the order of `keys`."""
    at = F.monotonically_increasing_id()
    kept = staged(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", at), "numbered")
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = kept.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = kept.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return out.withColumn(name, F.col("_before") + F.expr("_at & 8589934591")).drop("_at", "_part", "_before")


def running(rows: DataFrame, key: str, value: str, name: str = "before") -> DataFrame:
    """`rows`, one for each value of `key`, with the sum of `value` over all lower keys."""
    kept = staged(rows.repartitionByRange(key).withColumn("_part", F.spark_partition_id()), "running")
    upto = lambda w: F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = kept.withColumn("_in", upto(Window.partitionBy("_part").orderBy(key)))
    sums = kept.groupBy("_part").agg(F.sum(value).alias(value)).select("_part", upto(Window.orderBy("_part")).alias("_before"))
    return inside.join(F.broadcast(sums), "_part").withColumn(name, F.col("_in") + F.col("_before")).drop("_in", "_part", "_before")
