"""Run files: <root>/<type>/<severity>.csv with a header, time first, then sensors.

Headers drift between files.  The most frequent header (the lexically first on ties) is canonical;
files are read in groups of equal headers, each with its own explicit schema, and projected to the
canonical sensors by name: further columns are dropped, a missing one is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PATH = r"([^/]+)/([^/]+)\.csv$"


def files(spark: SparkSession, root: str) -> DataFrame:
    """path, accident_type, severity_id, header of each run file directly below a type's folder."""
    lines = spark.read.text(f"{root}/*/*.csv").select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
    first = lines.groupBy("file_path").agg(F.min_by("value", F.struct("file_block_start", "at")).alias("header"))
    return first.select(
        F.col("file_path").alias("path"), F.url_decode(F.regexp_extract("file_path", PATH, 1)).alias("accident_type"), F.url_decode(F.regexp_extract("file_path", PATH, 2)).alias("severity_id"), "header"
    )


def accident_types(runs: DataFrame) -> list[str]:
    """Sorted distinct types; their number is that of folders."""
    return [r[0] for r in runs.select("accident_type").distinct().orderBy("accident_type").collect()]


def canonical_header(headers: DataFrame, column: str = "header") -> DataFrame:
    """header, n of the most frequent header."""
    return headers.groupBy(F.col(column).alias("header")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "header").limit(1)


def load(spark: SparkSession, root: str, types: list[str] | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """(readings, runs, sensors): readings have accident_type, severity_id, time_seconds and sensors;
    `runs` lists every file, also those without rows.  Unparsable values and short rows fail."""
    runs = files(spark, root)
    if types is not None:
        runs = runs.where(F.col("accident_type").isin(types))
    found = canonical_header(runs).first()
    if found is None:
        raise FileNotFoundError(f"no run files below {root}")
    sensors = [c.strip() for c in found["header"].split(",")][1:]
    out = None
    for row in runs.groupBy("header").agg(F.collect_list("path").alias("paths")).collect():
        names = [c.strip() for c in row["header"].split(",")]
        missing = [s for s in sensors if s not in names[1:]]
        if missing:
            raise ValueError(f"{row['paths'][0]} lacks {', '.join(missing)}")
        schema = T.StructType([T.StructField(f"c{i}", T.DoubleType()) for i in range(len(names))])
        part = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", True).csv(row["paths"])
        place = {n: i for i, n in reversed(list(enumerate(names[1:], 1)))}
        path = F.col("_metadata.file_path")
        part = part.select(
            F.url_decode(F.regexp_extract(path, PATH, 1)).alias("accident_type"), F.url_decode(F.regexp_extract(path, PATH, 2)).alias("severity_id"),
            F.col("c0").alias("time_seconds"), *(F.col(f"c{place[s]}").alias(s) for s in sensors),
        )
        out = part if out is None else out.unionByName(part)
    return out, runs.select("accident_type", "severity_id"), sensors


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as readings: type event_type, run user_id, sensor value."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_type").alias("accident_type"), F.col("user_id").cast("string").alias("severity_id"), _seconds(F.col("ts")).alias("time_seconds"), "ts", "event_id", "value")


def lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lineitem table as readings of four sensors: type l_returnflag, run l_suppkey."""
    i = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return i.select(
        F.col("l_returnflag").alias("accident_type"), F.col("l_suppkey").cast("string").alias("severity_id"), _seconds(F.col("l_shipdate")).alias("time_seconds"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    )


def _seconds(ts):
    """Seconds since 2020 began, so that sums of squares of times keep their digits."""
    return (F.unix_micros(ts.cast("timestamp")) - 1_577_836_800_000_000) / 1e6
