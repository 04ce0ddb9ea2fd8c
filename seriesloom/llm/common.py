"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import staged  # noqa: F401

#: White space that parts words, and a word, as the contracts give them.
BLANKS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(column), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


#: Compression of staged texts, which takes a third less disk than Spark's own.
TEXTS = "zstd"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def batches(spark: SparkSession, size: int) -> AbstractContextManager[None]:
    """Plans that run inside send rows to Python in batches of about `size` bytes; a row is never cut."""
    return setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def tidy_shuffles(spark: SparkSession) -> AbstractContextManager[None]:
    """Shuffle files of a query that begins and ends inside go when it ends, and don't wait for the JVM to collect
    what refers to them; should it run again, it makes them anew."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


T = TypeVar("T")


def tidied(parts: Iterator[T]) -> Iterator[T]:
    """The same batches; after each one and at the end this worker hands free memory back to the machine.
    Workers outlive their tasks, and the C library keeps what they freed, so an executor would
    carry the peaks of all stages at once."""
    for part in parts:
        yield part
        del part
        give_back()
    give_back()


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def whole_row(df: DataFrame) -> Column:
    """All columns of `df` in one struct, so that names an operator adds can't clash with them."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`").alias(c) for c in df.columns))
