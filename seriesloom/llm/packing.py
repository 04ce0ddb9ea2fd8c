"""Best-fit packing of tokenized documents into sequences of fixed length.

Documents longer than a sequence are cut into pieces of its length and a rest; all pieces are then
packed best-fit decreasing: from the longest on, each goes to the open sequence with the least room
that still holds it, which a segment tree over the 2048 possible capacities finds.

Lengths are whole numbers, so pieces of one length are alike and so are sequences with one amount
of room.  The driver therefore packs runs: it gets the number of pieces of each length (2048 numbers
at most, whatever the corpus), and a step of the packing moves a run of equal sequences at once.
The outcome is that of packing piece by piece.  Each piece then finds its place by its length and
its rank among the pieces of that length, with no shuffle by sequence.

* null or empty text: the end id alone; null ids and repeated rows are packed row by row; empty
  table: no rows; other columns are left out.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, staged, table, tidied
from .tokens import cached

MODEL = "word_bpe_49k.json"
END_ID = 0
LENGTH = 2048
#: Bytes of rows that Python gets at once.
BATCH = 1 << 22


class CapacityTree:
    """Which amounts of room any open sequence has; the least one of at least `size` in log time."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.leaves)

    def set(self, room: int, there: bool) -> None:
        i = self.leaves + room
        while i and self.any[i] != there:
            self.any[i] = there
            i //= 2
            there = self.any[2 * i] or self.any[2 * i + 1] if i else there

    def tightest(self, size: int) -> int | None:
        i = self.leaves + size
        if self.any[i]:
            return size
        while i > 1 and (i % 2 or not self.any[i + 1]):  # up until a right sibling has some
            i //= 2
        if i <= 1:
            return None
        i += 1
        while i < self.leaves:  # down to its leftmost
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.leaves


def best_fit_decreasing(counts: dict[int, int], capacity: int = LENGTH) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces a sequence, offset) for {length: pieces}.

    The pieces of that length from the rank on go to sequences from that one on, so many to each and
    side by side from the offset, up to the rank of the next row of that length."""
    tree, runs = CapacityTree(capacity), {}
    opened, rows = 0, []

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            runs.setdefault(room, []).append((first, n))
            tree.set(room, True)

    for size in sorted(counts, reverse=True):
        rank, total = 0, counts[size]
        while rank < total:
            left = total - rank
            room = tree.tightest(size)
            if room is None:
                room, n = capacity, -(-left // (capacity // size))
                first, opened = opened, opened + n
            else:
                first, n = runs[room].pop()
                if not runs[room]:
                    tree.set(room, False)
            each = room // size  # the tightest sequence stays the tightest until it is full
            full, rest = min(n, left // each), left % each if left // each < n else 0
            if full:
                rows.append((size, rank, first, each, capacity - room))
                put(room - each * size, first, full)
                rank += full * each
            if rest:
                rows.append((size, rank, first + full, rest, capacity - room))
                put(room - rest * size, first + full, 1)
                rank += rest
            used = full + bool(rest)
            put(room, first + used, n - used)
    return np.array(rows, np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, model: str, length: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """The pieces of each document; `nth` numbers those of one length and task."""

    @F.pandas_udf("array<struct<start: bigint, length: bigint, ids_crc32: bigint, part: int, nth: bigint>>")
    def cut(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        end, part_no, seen = np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), Counter()

        def of(ids: bytes) -> list[dict]:
            out = []
            for at in range(0, len(ids), 4 * length):
                own = ids[at : at + 4 * length]
                out.append({"start": at // 4, "length": len(own) // 4, "ids_crc32": zlib.crc32(own), "part": part_no, "nth": seen[len(own)]})
                seen[len(own)] += 1
            return out

        for texts in tidied(parts):
            yield pd.Series([of(ids + end) for ids in cached(model).encode(texts.tolist())])

    # said to be non-deterministic, else Spark runs it twice: for the rows and to filter empty lists
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), cut.asNondeterministic()(F.col(text_col)).alias("pieces"))
    return rows.select("doc_id", F.posexplode("pieces").alias("piece", "p")).select("doc_id", "piece", "p.*")


def pack(docs: DataFrame, model: str = MODEL, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    with batches(docs.sparkSession, BATCH):
        cut = staged(pieces(docs, model, length, end_id, id_col, text_col), "pieces")
    each = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = best_fit_decreasing(counts, length)
    order = np.lexsort((plan[:, 1], plan[:, 0]))
    plan = plan[order]
    keys = plan[:, 0] << 48 | plan[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def placed(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, rank = size.to_numpy(np.int64), rank.to_numpy(np.int64)
        row = plan[np.searchsorted(keys, size << 48 | rank, "right") - 1]
        nth = rank - row[:, 1]
        return pd.DataFrame({"sequence_id": row[:, 2] + nth // row[:, 3], "offset": row[:, 4] + nth % row[:, 3] * size})

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = each.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = cut.join(offsets, ["part", "length"]).withColumn("at", placed("length", F.col("before") + F.col("nth")))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
