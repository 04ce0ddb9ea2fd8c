"""Approximate nearest neighbours by a forest of hash prefixes.

Every tree hashes vectors to strings of bits, the signs of random projections, and keeps them in a
sorted array.  A query goes down each tree to its longest matching prefix, a stretch of the array,
and then up all trees in step: with each bit less the stretches grow and give more candidates.  It
stops at the first level where a vector as near as the query's k-th so far would, over all trees,
have been missed with a probability of at most 1 - `recall`; so clustered data stops early and
structureless data goes far up, at any size, without a cap on candidates.

For the largest inner product vectors get one coordinate more that evens out their norms; scores are
exact, on the original vectors, in double precision, summed from the first coordinate to the last.

The sorted arrays are cut into blocks of rows, all hashed by the same planes, so a prefix's stretch in
the whole forest is the union of its stretches in the blocks.  Blocks of queries meet blocks of rows, a
task each, and a query's best from all blocks are merged.  Rows are dealt to blocks at random, so of the k
nearest in the table a block of 1 / p of all rows has about k / p, and at most k / p + 2 sqrt(k / p) but for
rare cases: ascending stops by the score of that rank in the block, which suits the whole table and
not the block's own rows.  Sending queries to all blocks grows with the product of both numbers.

* Vectors that are null, zero, of other length than the shortest-id valid one, or that hold null or
  non-finite numbers take no part, as query or as candidate.
* Very long vectors are summed coordinate by coordinate.  Ties go to the smaller id (null last; 2 ** 63 - 1 stands for null on the way).  Repeated rows are rows of their own; a row is never its own
  neighbour.  Fewer candidates than k: all of them; no valid query: no rows; other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

K, RECALL, TREES, DEPTH, SEED = 20, 0.9, 96, 32, 5
INDEX_BLOCK, QUERY_BLOCK = 16_384, 65_536
STEP, CLOSE = 256, 1e-12
NO_ID = (1 << 63) - 1


def scores_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in the order of coordinates whatever the number of rows."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


class Forest:
    """Sorted arrays of hash strings over the rows of one block."""

    def __init__(self, vectors: np.ndarray, largest_norm: float, trees: int, depth: int, seed: int):
        self.vectors, self.trees, self.depth, self.largest = vectors, trees, depth, largest_norm
        self.planes = np.random.default_rng(seed).standard_normal((trees, vectors.shape[1] + 1, depth))
        extra = np.sqrt(np.maximum(0.0, largest_norm**2 - (vectors**2).sum(1)))
        codes = self.hashed(np.column_stack((vectors, extra)))
        self.order = np.argsort(codes, axis=1, kind="stable").astype(np.int32)
        self.codes = np.take_along_axis(codes, self.order, 1)

    def hashed(self, rows: np.ndarray) -> np.ndarray:
        """A row for each tree: the bits of all `rows` as numbers, first bit highest."""
        weights = (1 << np.arange(self.depth - 1, -1, -1)).astype(np.float64)
        return np.stack([((rows @ p > 0) @ weights).astype(np.int64) for p in self.planes])

    def stretches(self, codes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """For each (tree, query) the part of the sorted array that shares `level` bits."""
        low = codes >> (self.depth - level) << (self.depth - level)
        high = low + (1 << (self.depth - level))
        pairs = [(np.searchsorted(own, a), np.searchsorted(own, b)) for own, a, b in zip(self.codes, low, high, strict=True)]
        return np.stack([x for x, _ in pairs]), np.stack([x for _, x in pairs])

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, recall: float, share: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of candidates, with the k best of each query and all that tie with
        the last of them; `own` is the query's own row here, or -1; `share` is that of all rows that are here."""
        nq, n = len(queries), len(self.vectors)
        codes = self.hashed(np.column_stack((queries, np.zeros(nq))))
        norms = np.sqrt((queries**2).sum(1)) * self.largest
        seen, tag = np.zeros(nq * n, bool), np.zeros(nq * n, np.int32)
        seen[(np.arange(nq) * n + own)[own >= 0]] = True
        asked, row, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        kth, due = np.full(nq, -np.inf), np.full(nq, -np.inf)
        rank = min(k, math.ceil(k * share + 2 * math.sqrt(k * share)))
        close = CLOSE * norms * queries.shape[1]  # sums in another order differ by less
        active, was = np.arange(nq), None
        for level in range(self.depth, -1, -1):
            lo, hi = self.stretches(codes[:, active], level)
            sides = [(lo, hi)] if was is None else [(lo, was[0]), (was[1], hi)]
            at = np.concatenate([self.places(x, y, active) for x, y in sides])
            at = at[~seen[at]]
            tag[at] = np.arange(len(at))
            at = at[tag[at] == np.arange(len(at))]  # each once
            seen[at] = True
            new_asked, new_row = at // n, at % n
            new = np.concatenate([np.einsum("ij,ij->i", self.vectors[new_row[i : i + 32_768]], queries[new_asked[i : i + 32_768]]) for i in range(0, len(at), 32_768)] or [np.zeros(0)])
            fit = new >= (kth - close)[new_asked]
            asked, row, score = (np.concatenate(x) for x in ((asked, new_asked[fit]), (row, new_row[fit]), (score, new[fit])))
            order = np.lexsort((-score, asked))
            asked, row, score = asked[order], row[order], score[order]
            first = np.searchsorted(asked, np.arange(nq))
            full = np.diff(np.append(first, len(asked))) >= k
            kth[full] = score[first[full] + k - 1]
            some = np.diff(np.append(first, len(asked))) >= rank
            due[some] = score[first[some] + rank - 1]
            keep = score >= (kth - close)[asked]
            asked, row, score = asked[keep], row[keep], score[keep]
            near = np.arccos(np.clip(due[active] / norms[active], -1, 1))
            missed = (1 - (1 - near / math.pi) ** level) ** self.trees
            going = (missed > 1 - recall) if level else np.zeros(len(active), bool)
            was = lo[:, going], hi[:, going]
            active = active[going]
            if not len(active):
                break
        return asked, row, scores_of(self.vectors[row], queries[asked])

    def places(self, lo: np.ndarray, hi: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """query * rows + row for all rows in the given stretches of (tree, query)."""
        n = (hi - lo).ravel()
        some = np.flatnonzero(n)
        n = n[some]
        tree, which = some // len(asked), some % len(asked)
        begin = lo.ravel()[some] + tree * len(self.vectors)
        spots = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(asked[which] * len(self.vectors), n) + self.order.ravel()[spots]


def nearest(table_: DataFrame, every: int, k: int = K, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows to each row whose id is divisible by `every`."""
    vector = F.col(vector_col).cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = table_.select(F.col(id_col).cast("long").alias("id"), vector.alias("v"), F.monotonically_increasing_id().alias("row"))
    rows = staged(rows.where(F.col("v").isNotNull() & F.forall("v", fine) & F.exists("v", lambda x: x != 0)), "vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    first = rows.agg(F.min_by(F.size("v"), F.struct(F.col("id").isNull(), "id", "row")).alias("dim")).first()
    rows = rows.where(F.size("v") == (first["dim"] or 0))
    found = rows.agg(F.max(norm).alias("norm"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("id") % every == 0, 1)).alias("q")).first()
    largest = found["norm"] or 1.0
    parts, groups = max(1, -(-found["n"] // INDEX_BLOCK)), max(1, -(-found["q"] // QUERY_BLOCK))
    deal = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "row"), F.lit(n)).cast("int")
    best = "query_id long, query_row long, vec_id long, score double"

    def searched(part: pd.DataFrame) -> pd.DataFrame:
        own, asking = part[~part["asks"]], part[part["asks"]]
        columns = ["query_id", "query_row", "vec_id", "score"]
        if own.empty or asking.empty:
            return pd.DataFrame({c: [] for c in columns})
        forest = Forest(np.stack(own["v"].to_numpy()), largest, trees, depth, seed)
        at = {r: i for i, r in enumerate(own["row"])}
        ids, out = own["id"].to_numpy(np.int64), []
        for a in range(0, len(asking), STEP):
            some = asking.iloc[a : a + STEP].reset_index(drop=True)
            mine = np.array([at.get(r, -1) for r in some["row"]])
            asked, row, score = forest.search(np.stack(some["v"].to_numpy()), mine, k, recall, 1 / parts)
            found = pd.DataFrame({"query_id": some["id"].to_numpy()[asked], "query_row": some["row"].to_numpy()[asked], "vec_id": ids[row], "score": score})
            found = found.sort_values(["query_row", "score", "vec_id"], ascending=[True, False, True], kind="stable")
            out.append(found[found.groupby("query_row").cumcount() < k])
        return pd.concat(out)

    index = rows.select(F.coalesce("id", F.lit(NO_ID)).alias("id"), "v", "row", deal(parts, 1).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), F.lit(False).alias("asks"))
    asks = rows.where(F.col("id") % every == 0).select("id", "v", "row", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), deal(groups, 2).alias("grp"), F.lit(True).alias("asks"))
    local = index.union(asks).groupBy("part", "grp").applyInPandas(searched, best)
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), 20)
