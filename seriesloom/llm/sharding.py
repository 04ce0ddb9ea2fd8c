"""Sharding: a Feistel permutation over global row numbers deals rows out to shards.

Rows are numbered by (id, text checksum, size).  A keyed Feistel network over the pairs
Z_a x Z_b with a * b >= n, walked on until it lands below n, permutes those numbers; shard and
slot are the remainder and the quotient of the permuted number by the number of shards.  Both can
be computed for any row number, and `unpermuted` turns them back into the row number.

* null id: numbered first; null text: empty, of size 1; repeated rows: numbered apart, any order
  among rows that are equal in all three columns (their results differ in place only).
* empty table: no rows.  Other columns of the input are left out.
* The law is `rows`: shard sizes differ by one at most.  The method has no use for groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table, text_of

ROUNDS = 8
SEED = 20_240_601


def _network(x: Column, a: Column, b: Column, seed: int, back: bool = False) -> Column:
    """One pass of the network (or of its inverse) over x in [0, a * b)."""

    def turn(state: Column, i: Column) -> Column:
        left, right = state["l"], state["r"]
        key = F.xxhash64(F.lit(seed), i, F.when(i % 2 == 0, right).otherwise(left))
        key = -F.pmod(key, F.when(i % 2 == 0, a).otherwise(b)) if back else key
        return F.struct(
            F.when(i % 2 == 0, F.pmod(left + F.pmod(key, a), a)).otherwise(left).alias("l"),
            F.when(i % 2 == 0, right).otherwise(F.pmod(right + F.pmod(key, b), b)).alias("r"),
        )

    rounds = F.array(*map(F.lit, range(ROUNDS)[:: -1 if back else 1]))
    start = F.struct((x % a).alias("l"), ((x - x % a) / a).cast("long").alias("r"))
    return F.aggregate(rounds, start, turn, lambda s: s["r"] * a + s["l"])


def _walked(x: Column, n: Column, seed: int, back: bool) -> Column:
    """The network, applied until the number is below n.  As many steps as there are numbers from
    n to a * b always suffice; few rows take more than the first one."""
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = ((n + a - 1 - F.pmod(n - 1, a)) / a).cast("long")
    once = _network(x, a, b, seed, back)
    more = F.aggregate(F.sequence(F.lit(1).cast("long"), a * b - n), once, lambda y, _: F.when(y < n, y).otherwise(_network(y, a, b, seed, back)))
    return F.when(once < n, once).otherwise(more)


def permuted(x: Column, n: Column, seed: int = SEED) -> Column:
    """The place of row number x of n (both BIGINT) in the shuffle."""
    return _walked(x, n, seed, False)


def unpermuted(y: Column, n: Column, seed: int = SEED) -> Column:
    """The row number at place y."""
    return _walked(y, n, seed, True)


def numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` with row_no (from 0 in the order of `keys`, nulls first) and n_rows, both BIGINT.

    A range exchange sorts slim rows; the place inside a partition is known at once, and one row
    for each partition is summed up for the places before it."""
    at = F.monotonically_increasing_id()
    sorted_rows = rows.withColumn("_at", at).repartitionByRange(*keys, "_at").sortWithinPartitions(*keys, "_at").drop("_at")
    kept = staged(sorted_rows.withColumn("_place", at), "numbered")
    part = F.shiftright("_place", 33).alias("_part")
    parts = kept.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    everything = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_part", F.coalesce(F.sum("_n").over(everything), F.lit(0).cast("long")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("n_rows"))
    return (
        kept.withColumn("_part", part).join(offsets, "_part")
        .withColumn("row_no", F.col("_before") + F.expr("_place & 8589934591"))
        .drop("_part", "_place", "_before")
    )


def shard(docs: DataFrame, shards: int = 8, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, size, text_crc32, row_no, law, shard, slot, grown_shard."""
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text_of(text_col)) + 1).cast("long").alias("size"),
        F.crc32(text_of(text_col).cast("binary")).alias("text_crc32"),
    )
    placed = numbered(slim, ["doc_id", "text_crc32", "size"]).withColumn("_y", permuted(F.col("row_no"), F.col("n_rows"), seed))
    return placed.select(
        "doc_id", "size", "text_crc32", "row_no",
        F.lit("rows").alias("law"),
        (F.col("_y") % shards).cast("int").alias("shard"),
        ((F.col("_y") - F.col("_y") % shards) / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
