"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Where it is unset and all of Spark is one process, as in tests,
    a folder of this machine is put there, deleted when Python ends; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share (master {master})")
        own = tempfile.mkdtemp(prefix="seriesloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; all that is written there for later steps is below it."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def own_path(spark: SparkSession, label: str, folder: str | None = None) -> str:
    """A new path below `own_dir`, or below a `folder` that came from here."""
    return f"{folder or own_dir(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str, folder: str | None = None, codec: str | None = None) -> DataFrame:
    """`df` written once to the shared folder and read from there, so that later steps neither repeat
    its work nor depend on an executor that made it; compressed with `codec` if it is given."""
    spark = df.sparkSession
    path = own_path(spark, label, folder)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a path that came from `own_path`, once nothing still to be computed reads it."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(found, True)


def release(spark: SparkSession) -> None:
    """Asks both sides of the driver for a collection: Spark deletes shuffle files once nothing refers to the
    query they belong to, neither Python's frames nor the JVM, which may not collect for half an hour."""
    gc.collect()
    spark._jvm.System.gc()


def clear(spark: SparkSession) -> None:
    """Deletes all that this application put below `own_dir`; call it when no result is read any more."""
    delete(spark, own_dir(spark))
