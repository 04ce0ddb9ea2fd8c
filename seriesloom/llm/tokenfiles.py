"""Token-ID output: texts become token ids in compressed binary files, in ascending id order.

A file set is a folder in the shared file system.  `table` holds one frequency table for all;
`frames` holds rows of whole documents: the ids of about half a million tokens as a stream of
`rans` (independent blocks of interleaved lanes, checkpoints, checksums), with the documents' ids
and lengths beside it.  Spark's writers store the rows, so writing commits as a whole and every
file system that Spark knows serves.

Steps: tokenize once and keep the ids; count ids (a row for each id of the vocabulary reaches the
driver); sort documents by range and encode frames; read all back by decoding.

* null text: no ids but the end id; null document ids come first; repeated ids stand side by side in
  the order of a hash of their tokens; empty table: an empty file set.
* Other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rans
from ..shared import own_path
from .common import staged, table
from .tokens import cached

MODEL = "byte_bpe_50k.json"
END_ID = 0
FRAME = 1 << 19
FRAMES = "part int, frame int, first long, n_tokens long, doc_ids array<long>, no_id array<boolean>, lengths array<long>, data binary"


def _pack(ids: bytes, width: str) -> bytes:
    return pa.compress(np.frombuffer(ids, "<u4").astype(width).tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int, width: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(width).itemsize, codec="zstd", asbytes=True), width)


def tokenized(docs: DataFrame, model: str, end_id: int, width: str, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_tokens and the packed ids of each document, end id included."""

    @F.pandas_udf("n_tokens long, ids binary")
    def encoded(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        end = np.array([end_id], "<u4").tobytes()
        for texts in parts:
            ids = [x + end for x in cached(model).encode(texts.tolist())]
            yield pd.DataFrame({"n_tokens": [len(x) // 4 for x in ids], "ids": [_pack(x, width) for x in ids]})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), encoded.asNondeterministic()(F.col(text_col)).alias("t")).select("doc_id", "t.*")


def id_counts(tokens: DataFrame, width: str) -> np.ndarray:
    """How often each id occurs; partial counts are summed by Spark."""

    def counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(0, np.int64)
        for part in parts:
            for data, n in zip(part["ids"], part["n_tokens"], strict=True):
                add = np.bincount(_unpack(data, n, width))
                if len(add) > len(sums):
                    sums = np.pad(sums, (0, len(add) - len(sums)))
                sums[: len(add)] += add
        seen = np.flatnonzero(sums)
        yield pd.DataFrame({"id": seen, "n": sums[seen]})

    rows = tokens.select("n_tokens", "ids").mapInPandas(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max((r["id"] for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        out[r["id"]] = r["n"]
    return out


def write_tokens(docs: DataFrame, path: str, model: str = MODEL, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the file set of `docs` to the folder `path`, which must not exist yet."""
    spark = docs.sparkSession
    width = "<u2" if cached(model).tok.get_vocab_size() <= 1 << 16 else "<u4"
    tokens = staged(tokenized(docs, model, end_id, width, id_col, text_col), "tokens")
    shared = rans.Table(id_counts(tokens, width)).to_bytes()
    spark.createDataFrame([(bytearray(shared),)], "freq binary").coalesce(1).write.parquet(f"{path}/table")

    def framed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table_, part_no, first, frame = rans.Table.from_bytes(shared), TaskContext.get().partitionId(), 0, 0

        def sealed(held: list) -> pd.DataFrame:
            ids = np.concatenate([x for _, _, x in held])
            row = (part_no, frame, first, len(ids), [i for i, _, _ in held], [x for _, x, _ in held], [len(x) for _, _, x in held], rans.encode(ids, table_))
            return pd.DataFrame([row], columns=[c.split(" ")[0] for c in FRAMES.split(", ")])

        held, size = [], 0
        for part in parts:
            for i, none, n, data in zip(part["id"], part["none"], part["n_tokens"], part["ids"], strict=True):
                held.append((i, none, _unpack(data, n, width)))
                size += n
                if size >= FRAME:
                    yield sealed(held)
                    held, size, first, frame = [], 0, first + size, frame + 1
        if held:
            yield sealed(held)

    # at = a hash of the tokens parts documents of one id, so that a hot id is split too
    ordered = tokens.withColumn("at", F.xxhash64("ids")).repartitionByRange("doc_id", "at").sortWithinPartitions("doc_id", "at")
    ids = (F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"))
    ordered.select(*ids, "n_tokens", "ids").mapInPandas(framed, FRAMES).write.option("compression", "none").parquet(f"{path}/frames")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row for each document of a file set: doc_id, start, n_tokens, ids_crc32 (and ids)."""
    frames = spark.read.schema(FRAMES).parquet(f"{path}/frames")
    shared = bytes(spark.read.parquet(f"{path}/table").first()["freq"])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = frames.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    schema = "id long, none boolean, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def decoded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table_ = rans.Table.from_bytes(shared)
        for part in parts:
            for r in part.itertuples():
                ids = rans.decode(r.data, table_)
                ends = np.cumsum(r.lengths)
                cuts = list(zip((ends - r.lengths).tolist(), ends.tolist(), strict=True))
                out = {"id": r.doc_ids, "none": r.no_id, "start": r.base + r.first + ends - r.lengths, "n_tokens": r.lengths, "ids_crc32": [zlib.crc32(ids[a:b].tobytes()) for a, b in cuts]}
                yield pd.DataFrame(out | ({"ids": [ids[a:b] for a, b in cuts]} if with_ids else {}))

    # a row for each file part, a few bytes each: frames stay where they are
    return frames.join(F.broadcast(offsets), "part").select("base", "first", "doc_ids", "no_id", "lengths", "data").mapInPandas(decoded, schema).select(
        F.when(~F.col("none"), F.col("id")).alias("doc_id"), "start", "n_tokens", "ids_crc32", *["ids"] * with_ids
    )


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = own_path(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path)
