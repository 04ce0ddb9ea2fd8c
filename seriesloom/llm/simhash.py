"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints: each run of `shingle` words (ASCII lower case) is hashed by XXH64; a bit of the
fingerprint is set if more than half of the hashes set it.  Equal fingerprints are joined into one
row first, so copies cost nothing from there on.

Join: two fingerprints that differ in at most `bits` places agree in at least two of `bits` + 2
blocks of places.  For each pair of blocks, fingerprints that agree there meet in one task, which
walks the binary trie over their other places: pairs of nodes go down together, differing places
add up, and a pair is dropped as soon as they exceed the budget.  Each pair of fingerprints within
the budget meets at least once.  Where what is left of the trie can't exceed the budget all below
is linked at once, and node pairs whose leaves are connected already are left out, so a dense
group costs its size and not its square.  A task returns one edge for each fingerprint at most.

Classes: alternating large-star and small-star rounds join the edges of all tasks, each round
written to the shared folder.

* null or empty text: fingerprint 0, linked like any other; fewer words than a shingle: all words
  are the one shingle; null id: gets its class id but never gives it, unless the whole class is null.
* repeated rows are rows of one class; empty table: no rows; other columns are left out.
* Within a key there are distinct fingerprints only, all sharing the key's places.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table, whole_row

SHINGLE, BITS, SEED = 4, 4, 42
PAIRS_AT_ONCE = 1 << 20
SMALL = 64


def shingle_hashes(words: list[bytes], shingle: int, seed: int) -> np.ndarray:
    """The hash of each run of `shingle` words in their order, repeats included."""
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]).tolist()
    starts, k = [0, *ends], min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[k - 1 :], strict=False)], "<u8")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that more than half of the hashes set."""
    sums = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 16):
        sums += np.unpackbits(hashes[part : part + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * sums > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a whole text as an unsigned 64-bit integer."""
    words = words_of(text)
    return majority(shingle_hashes(words, shingle, seed)) if words else 0


def fingerprinted(text: Column, shingle: int, seed: int) -> Column:
    """The fingerprint as a BIGINT of the same bits."""

    @F.pandas_udf("long")
    def prints(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(np.array([fingerprint(t, shingle, seed) for t in texts], np.uint64).view(np.int64))

    return prints(text)


def block_masks(bits: int) -> list[int]:
    """`bits` + 2 neighbouring blocks of the 64 places, as masks."""
    edges = np.linspace(0, 64, bits + 3).round().astype(int).tolist()
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]


class Links:
    """Classes of 0..n-1 under vectorised union by least member."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        of = self.of
        while len(a):
            a, b = of[a], of[b]
            apart = a != b
            a, b = a[apart], b[apart]
            if not len(a):
                break
            np.minimum.at(of, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(of, up := of[of]):
                of = up
        self.of = of


def trie_links(keys: np.ndarray, codes: np.ndarray, member: np.ndarray, free: int, bits: int, links: Links) -> None:
    """Links members whose codes of one key differ in at most `bits` of the lowest `free` places.

    Rows are sorted by (key, code); `member` maps rows to the numbers that `links` joins."""
    if not len(keys):
        return
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    last = np.append(first[1:], len(keys))
    big = last - first > 1
    zero = np.zeros(big.sum(), np.int64)
    stack = [(free, first[big], last[big], first[big], last[big], zero)]
    ones: dict[int, np.ndarray] = {}

    def uniform() -> tuple[np.ndarray, np.ndarray]:
        label = links.of[member]
        return label, np.append(0, np.cumsum(label[1:] != label[:-1]))

    while stack:
        level, a, b, c, d, err = stack.pop()
        if len(a) > PAIRS_AT_ONCE:
            half = len(a) // 2
            stack += [(level, *(x[half:] for x in (a, b, c, d, err))), (level, *(x[:half] for x in (a, b, c, d, err)))]
            continue
        label, changes = uniform()
        todo = (changes[a] != changes[b - 1]) | (changes[c] != changes[d - 1]) | (label[a] != label[c])
        a, b, c, d, err = a[todo], b[todo], c[todo], d[todo], err[todo]
        sure = err + level <= bits
        for lo, hi, hub in ((a, b, c), (c, d, a)):
            n = (hi - lo)[sure]
            rows = np.repeat(lo[sure] - np.cumsum(n) + n, n) + np.arange(n.sum())
            links.join(member[rows], member[np.repeat(hub[sure], n)])
        a, b, c, d, err = a[~sure], b[~sure], c[~sure], d[~sure], err[~sure]
        small = (b - a) * (d - c) <= SMALL
        for at in range(0, int(small.sum()), PAIRS_AT_ONCE // SMALL):
            pick = np.flatnonzero(small)[at : at + PAIRS_AT_ONCE // SMALL]
            m, n = (b - a)[pick], (d - c)[pick]
            total = m * n
            pair = np.repeat(np.arange(len(pick)), total)
            k = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
            left, right = a[pick][pair] + k // n[pair], c[pick][pair] + k % n[pair]
            near = (left < right) & (np.bitwise_count(codes[left] ^ codes[right]) <= bits)
            links.join(member[left[near]], member[right[near]])
        a, b, c, d, err = a[~small], b[~small], c[~small], d[~small], err[~small]
        if not len(a):
            continue
        level -= 1
        if level not in ones:
            ones[level] = np.append(0, np.cumsum((codes >> np.uint64(level)) & np.uint64(1), dtype=np.int64))
        one = ones[level]
        mid, mid2 = b - (one[b] - one[a]), d - (one[d] - one[c])
        own = a == c
        kids = [(a, mid, c, mid2, err), (mid, b, mid2, d, err), (a, mid, mid2, d, err + 1), (mid[~own], b[~own], c[~own], mid2[~own], err[~own] + 1)]
        fresh = [np.concatenate(x) for x in zip(*kids, strict=True)]
        live = (fresh[0] < fresh[1]) & (fresh[2] < fresh[3]) & (fresh[4] <= bits)
        if live.any():
            stack.append((level, *(x[live] for x in fresh)))


def squeezed(values: np.ndarray, mask: int) -> np.ndarray:
    """The places of `mask`, moved together to the low end."""
    out, at = np.zeros(len(values), np.uint64), 0
    while mask:
        low = (mask & -mask).bit_length() - 1
        run = 0
        while mask >> (low + run) & 1:
            run += 1
        out |= ((values >> np.uint64(low)) & np.uint64((1 << run) - 1)) << np.uint64(at)
        at, mask = at + run, mask >> (low + run) << (low + run)
    return out


def edges(prints: DataFrame, bits: int) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints `print` (BIGINT) as links do."""
    masks = block_masks(bits)
    kinds = list(itertools.combinations(range(len(masks)), 2))
    mask_of = [masks[i] | masks[j] for i, j in kinds]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keyed = prints.select("print", F.posexplode(F.array(*(F.col("print").bitwiseAND(F.lit(signed(m))) for m in mask_of))).alias("kind", "key"))

    def joined(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(p["kind"].to_numpy(np.int64), p["print"].to_numpy(np.int64)) for p in parts]
        if not rows:
            return
        kind, value = (np.concatenate(x) for x in zip(*rows, strict=True))
        known, member = np.unique(value, return_inverse=True)
        links = Links(len(known))
        for k, mask in enumerate(mask_of):
            own = np.flatnonzero(kind == k)
            bits64 = value[own].view(np.uint64)
            key, code = squeezed(bits64, mask), squeezed(bits64, ~mask & ((1 << 64) - 1))
            order = np.lexsort((code, key))
            trie_links(key[order], code[order], member[own][order], 64 - mask.bit_count(), bits, links)
        far = np.flatnonzero(links.of != np.arange(len(known)))
        yield pd.DataFrame({"a": known[far], "b": known[links.of[far]]})

    return keyed.repartition("kind", "key").select("kind", "print").mapInPandas(joined, "a long, b long")


def connected(links: DataFrame, folder: str | None = None) -> DataFrame:
    """(node, root) for every node of edges (a, b), root being the least node it is connected to; its
    rounds are staged in `folder`.

    Joins by a node have one row of that node on one side, so a node of many edges can be split there,
    and sums by a node are made before the shuffle."""
    big, small = F.greatest("a", "b"), F.least("a", "b")
    now = staged(links.select(big.alias("a"), small.alias("b")).where("a <> b").distinct(), "links", folder)
    mark = None
    while True:
        # large star: neighbours above a node go to the least node around it
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        spread = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: a node and its lower neighbours go to the least of them
        spread = staged(spread.distinct(), "links", folder)
        lowest = spread.groupBy("a").agg(F.min("b").alias("m"))
        joined = spread.join(lowest, "a")
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(lowest.select("a", F.col("m").alias("b")))
        now = staged(moved.where("a <> b").distinct(), "links", folder)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if tuple(seen) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = tuple(seen)


def print_classes(rows: DataFrame, bits: int) -> DataFrame:
    """(print, root) for the fingerprints in `rows` that are connected to a lower one."""
    prints = staged(rows.select("print").distinct(), "prints")
    return connected(staged(edges(prints, bits), "edges")).select(F.col("node").alias("print"), "root")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, fingerprint (hex) and component_id."""
    rows = staged(docs.select(F.col(id_col).alias("doc_id"), fingerprinted(F.col(text_col), shingle, seed).alias("print")), "fingerprints")
    roots = print_classes(rows, bits)
    least = rows.groupBy("print").agg(F.min("doc_id").alias("least")).join(roots, "print", "left").withColumn("root", F.coalesce("root", "print"))
    ids = least.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = least.join(ids, "root").select("print", "component_id")
    return rows.join(of_print, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` with all their columns, one of each class: the one of least id (null last)."""
    kept = staged(docs.select(F.monotonically_increasing_id().alias("_at"), whole_row(docs).alias("_row"), F.col(id_col).alias("_id"), fingerprinted(F.col(text_col), shingle, seed).alias("print")), "dedup")
    roots = print_classes(kept, bits)
    best = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_at").alias("at"))).alias("best")
    by_print = kept.select("_id", "_at", "print").groupBy("print").agg(best).join(roots, "print", "left")
    chosen = by_print.groupBy(F.coalesce("root", "print").alias("root")).agg(F.min("best").alias("best")).select(F.col("best.at").alias("_at"))
    return kept.join(chosen, "_at", "left_semi").select("_row.*")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
