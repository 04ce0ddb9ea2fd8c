"""A static range asymmetric numeral system over token ids, in NumPy.

One frequency table, normalised to 2 ** 20, serves all blocks.  A block holds up to 32,768 tokens
dealt to 64 interleaved lanes; lanes, blocks and the stretches between checkpoints are independent,
so a decoder runs all stretches of all its blocks side by side.

Bytes of a stream: magic, table checksum, number of tokens; for each block its tokens, its words,
its CRC-32 (of ids as little-endian unsigned 32-bit integers); then for each block and checkpoint
the word offset and the lanes' states; then the blocks' 32-bit words.  All little-endian.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"SLR1"
BITS = 20
LOW = np.uint64(1 << 31)
WORD_BITS = np.uint64(32)
LANES, STEPS, STRETCH = 64, 512, 256
BLOCK = LANES * STEPS
HEAD, PER_BLOCK = struct.Struct("<4sIQ"), np.dtype([("tokens", "<u4"), ("words", "<u4"), ("crc", "<u4")])


class Table:
    """Frequencies of ids 0..n-1, none for ids that never occur, from counts of a corpus."""

    def __init__(self, counts: np.ndarray):
        counts = np.asarray(counts, np.int64)
        total, seen = int(counts.sum()), np.flatnonzero(counts)
        if len(seen) > 1 << BITS:
            raise ValueError(f"{len(seen)} different ids; a table holds {1 << BITS}")
        freq = np.zeros(len(counts), np.int64)
        if total:
            freq[seen] = np.maximum(1, (counts[seen].astype(np.float64) * (1 << BITS) / total).astype(np.int64))
            order = seen[np.argsort(-counts[seen], kind="stable")]
            over = int(freq.sum()) - (1 << BITS)
            freq[order[0]] -= min(over, 0)
            while over > 0:  # take back from the most frequent first, never below 1
                for i in order.tolist():
                    cut = min(over, int(freq[i]) // 2)
                    freq[i] -= cut
                    over -= cut
                    if not over:
                        break
        self.freq = freq.astype("<u4")
        start = np.cumsum(freq) - freq
        self.f64, self.start = freq.astype(np.uint64), start.astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.of_slot = np.repeat(self.f64, freq)
        self.rest = np.arange(len(self.symbol), dtype=np.uint64) - np.repeat(self.start, freq)
        self.crc = zlib.crc32(self.freq.tobytes())

    def to_bytes(self) -> bytes:
        return zlib.compress(self.freq.tobytes())

    @classmethod
    def from_bytes(cls, data: bytes) -> Table:
        """The same table again: frequencies that sum to 2 ** 20 are their own counts."""
        return cls(np.frombuffer(zlib.decompress(data), "<u4"))


def encode(ids: np.ndarray, table: Table) -> bytes:
    ids = np.ascontiguousarray(ids, "<u4")
    n = len(ids)
    nb = -(-n // BLOCK)
    if not nb:
        return HEAD.pack(MAGIC, table.crc, 0)
    if ids.max() >= len(table.freq) or not table.freq[ids].all():
        raise ValueError("an id that the table doesn't have")
    deal = lambda a: np.ascontiguousarray(np.pad(a, (0, nb * BLOCK - n)).reshape(nb, STEPS, LANES).transpose(1, 0, 2))
    there = deal(np.ones(n, bool))
    dealt = deal(ids)
    freq, start = np.where(there, table.f64[dealt], np.uint64(1)), table.start[dealt]
    limit = freq << np.uint64(63 - BITS)
    x = np.full((nb, LANES), LOW, np.uint64)
    words, sent = np.zeros((STEPS, nb, LANES), "<u4"), np.zeros((STEPS, nb, LANES), bool)
    states = np.zeros((nb, STEPS // STRETCH, LANES), "<u8")
    shift = np.uint64(BITS)
    for t in range(STEPS - 1, -1, -1):
        out = (x >= limit[t]) & there[t]
        words[t] = x  # the low 32 bits
        sent[t] = out
        x = np.where(out, x >> WORD_BITS, x)
        q = x // freq[t]
        x = np.where(there[t], (q << shift) + (x - q * freq[t]) + start[t], x)
        if t % STRETCH == 0:
            states[:, t // STRETCH] = x
    per_step = sent.sum(2)
    offsets = (np.cumsum(per_step, 0) - per_step)[::STRETCH].T.astype("<u4")
    blocks = np.zeros(nb, PER_BLOCK)
    blocks["tokens"] = np.minimum(BLOCK, n - BLOCK * np.arange(nb))
    blocks["words"] = per_step.sum(0)
    blocks["crc"] = [zlib.crc32(ids[i : i + BLOCK].tobytes()) for i in range(0, n, BLOCK)]
    stream = words.transpose(1, 0, 2)[sent.transpose(1, 0, 2)]
    return b"".join((HEAD.pack(MAGIC, table.crc, n), blocks.tobytes(), offsets.tobytes(), states.tobytes(), stream.tobytes()))


def decode(data: bytes, table: Table) -> np.ndarray:
    """The ids again; raises ValueError where a checksum doesn't hold."""
    magic, crc, n = HEAD.unpack_from(data)
    if magic != MAGIC or crc != table.crc:
        raise ValueError("no stream of this table")
    if not n:
        return np.zeros(0, "<u4")
    nb, per = -(-n // BLOCK), STEPS // STRETCH
    at = HEAD.size
    blocks = np.frombuffer(data, PER_BLOCK, nb, at)
    at += blocks.nbytes
    offsets = np.frombuffer(data, "<u4", nb * per, at).reshape(nb, per)
    at += offsets.nbytes
    states = np.frombuffer(data, "<u8", nb * per * LANES, at)
    at += states.nbytes
    stream = np.append(np.frombuffer(data, "<u4", -1, at), np.zeros(1, "<u4")).astype(np.uint64)
    base = np.cumsum(blocks["words"].astype(np.int64)) - blocks["words"]
    place = (base[:, None] + offsets).ravel()
    x = states.reshape(nb * per, LANES).astype(np.uint64)
    first = (np.arange(nb * per) % per * STRETCH * LANES)[:, None] + np.arange(LANES)
    left = np.repeat(blocks["tokens"].astype(np.int64), per)[:, None] - first
    out = np.zeros((STRETCH, nb * per, LANES), "<u4")
    mask, shift = np.uint64((1 << BITS) - 1), np.uint64(BITS)
    for t in range(STRETCH):
        there = left > t * LANES
        slot = x & mask
        out[t] = table.symbol[slot]
        y = table.of_slot[slot] * (x >> shift) + table.rest[slot]
        more = (y < LOW) & there
        taken = np.cumsum(more, 1)
        word = stream[np.where(more, place[:, None] + taken - 1, len(stream) - 1)]
        x = np.where(there, np.where(more, (y << WORD_BITS) | word, y), x)
        place = place + taken[:, -1]
    ids = np.ascontiguousarray(out.transpose(1, 0, 2)).reshape(nb * BLOCK)[:n]
    for i, want in enumerate(blocks["crc"].tolist()):
        if zlib.crc32(ids[i * BLOCK : (i + 1) * BLOCK].tobytes()) != want:
            raise ValueError(f"block {i} doesn't match its checksum")
    return ids
