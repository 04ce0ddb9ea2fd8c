"""Cached use of the public tokenizers inside Spark's Python workers.

Plain Latin texts are cut into words by array operations over their bytes, and words are looked up by
their bytes; a word that is not there yet is merged and kept.  Other texts are cut at spaces into
units which no token can cross, and units are kept likewise.  The tables only save time: a full one
is emptied, and the ids stay the same.  The library cuts and normalises all but plain
Latin units and encodes what `cut` leaves whole; merges run over the library's merge table for
all new words of a batch at once, since its own word-by-word call took 20 times as long.

Why units are safe
* byte-level BPE: its pattern lets a token begin with one space and never hold one further on,
  so " x" with a non-blank x always begins a new pre-token.
* word BPE: white space is dropped before merging, so no token crosses a space.
* A text holding an added token's string goes to the library whole, as do units with characters
  outside Latin script, where two libraries' Unicode tables could disagree.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import regex

CACHE_ENTRIES = 300_000
#: Characters of text that are taken together.
PART = 1_000_000
#: What a byte of plain text is.
NO_KIND, SPACE, LINE, LETTER, DIGIT, MARK, OTHER_KIND = range(7)
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Printable ASCII and the Latin-1 letters: decomposed here; all else is left to the library.
PLAIN = regex.compile(r"[\x20-\x7E\nÀ-ÖØ-öø-ÿŒœ‘’“”–—…€]*")


def tokenizer_path(name: str) -> str:
    """`name` itself if it is a path, else the installed public file of that name."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands
    for itself, the rest follow from U+0100 in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Merger:
    """The merges of a BPE model over many words at once.

    It takes vocabulary and merge ranks from the library's own model file and applies the
    lowest-ranked merge of every word, leftmost first, until no word has one left, as the library
    does word by word.  One row of the arrays is a word, linked lists hold its live symbols.
    """

    SLOTS = 1 << 18
    NONE = np.int32(2**31 - 1)

    def __init__(self, model: dict):
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = byte_alphabet()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.width = np.int64(max(vocab.values()) + 1)
        self.keys, self.rank = np.full(self.SLOTS, -1, np.int64), np.zeros(self.SLOTS, np.int32)
        for r, (a, b) in enumerate(pairs):
            key = vocab[a] * int(self.width) + vocab[b]
            at = int(self.slot(np.array([key], np.int64))[0])
            while self.keys[at] not in (-1, key):
                at = (at + 1) % self.SLOTS
            if self.keys[at] == -1:
                self.keys[at], self.rank[at] = key, r

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, NONE without one (an id of -1 has none)."""
        keys = left * self.width + right
        at, out = self.slot(keys), np.full(len(keys), self.NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        while len(todo):
            here = self.keys[at[todo]]
            hit = todo[here == keys[todo]]
            out[hit] = self.rank[at[hit]]
            todo = todo[(here != keys[todo]) & (here != -1)]
            at[todo] = (at[todo] + 1) % self.SLOTS
        return out

    def __call__(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has; a word is the first of its
        `lengths` bytes (1 at least) of a row of `raw`."""
        counts, parts = np.zeros(len(raw), np.int64), []
        by_length = np.argsort(lengths, kind="stable")
        for rows in np.array_split(by_length, max(1, len(raw) // 20_000)):
            if len(rows):
                ids, counts[rows] = self.block(raw[rows], lengths[rows])
                parts.append(ids)
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        # back from the order of lengths
        at = np.empty(len(raw), np.int64)
        at[by_length] = np.cumsum(counts[by_length]) - counts[by_length]
        return flat[spread(at, counts)], counts

    def block(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, w = len(raw), int(lengths.max())
        raw = raw[:, :w]
        live = np.arange(w) < lengths[:, None]
        ids = np.where(live, self.inner[raw], -1)
        rows = np.arange(n)
        ids[rows, lengths - 1] = self.last[raw[rows, lengths - 1]]
        # one column of -1 on either side stands for "no neighbour"
        ids = np.pad(ids, ((0, 0), (1, 1)), constant_values=-1)
        after, before = np.tile(np.arange(1, w + 3, dtype=np.int16), (n, 1)), np.tile(np.arange(-1, w + 1, dtype=np.int16), (n, 1))
        rank = np.full((n, w + 2), self.NONE, np.int32)
        rank[:, 1 : w + 1] = self.ranks(ids[:, 1 : w + 1].ravel(), ids[:, 2:].ravel()).reshape(n, w)
        active = rows
        while len(active):
            at = rank[active].argmin(1)
            best = rank[active, at]
            keep = best != self.NONE
            active, at, best = active[keep], at[keep], best[keep]
            gone = after[active, at]
            ids[active, at] = self.made[best]
            ids[active, gone], rank[active, gone] = -1, self.NONE
            follow, lead = after[active, gone], before[active, at]
            after[active, at], before[active, follow] = follow, at
            rank[active, at] = self.ranks(ids[active, at], ids[active, follow])
            rank[active, lead] = self.ranks(ids[active, lead], ids[active, at])
        keep = ids >= 0
        return ids[keep].astype(np.uint32), keep.sum(1)

    def words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        w = int(lengths.max())
        ids, counts = self(np.frombuffer(b"".join(x.ljust(w, b"\0") for x in words), np.uint8).reshape(-1, w), lengths)
        flat, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each of `counts`, one after another."""
    return np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


class WordTable:
    """The ids of words of up to 24 bytes, by their bytes: an open-addressing table in arrays."""

    SLOTS, MOST, BYTES = 1 << 22, 1_200_000, 24

    def __init__(self, merge: Merger):
        self.merge = merge
        self.clear(0)

    def clear(self, room: int) -> None:
        """Nothing known, and slots for `room` words and more."""
        self.slots = np.full(max(self.SLOTS, 1 << (3 * room).bit_length()), -1, np.int32)
        self.keys = np.zeros((0, 3), np.uint64)
        self.first, self.count, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ keys[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ keys[:, 2] * np.uint64(0x165667B19E3779F9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(24)).astype(np.int64) & (len(self.slots) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each word, -1 if it is not there."""
        out, at, todo = np.full(len(keys), -1, np.int64), self.slot(keys), np.arange(len(keys))
        while len(todo):
            found = self.slots[at[todo]]
            todo, found = todo[found >= 0], found[found >= 0]
            same = (self.keys[found] == keys[todo]).all(1)
            out[todo[same]] = found[same]
            todo = todo[~same]
            at[todo] = (at[todo] + 1) % len(self.slots)
        return out

    def add(self, keys: np.ndarray, lengths: np.ndarray) -> None:
        """Words that are not there yet, each once."""
        ids, counts = self.merge(keys.view(np.uint8).reshape(-1, self.BYTES), lengths)
        number = np.arange(len(self.keys), len(self.keys) + len(keys), dtype=np.int32)
        self.first = np.concatenate((self.first, len(self.pool) + np.cumsum(counts) - counts))
        self.keys, self.count, self.pool = np.concatenate((self.keys, keys)), np.concatenate((self.count, counts)), np.concatenate((self.pool, ids))
        at, todo = self.slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.slots[at[todo]] < 0]
            self.slots[at[free]] = number[free]  # of several for one slot the last stays
            todo = todo[self.slots[at[todo]] != number[todo]]
            at[todo] = (at[todo] + 1) % len(self.slots)

    def numbers(self, keys: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The number of each word, added if need be."""
        out = self.find(keys)
        new = np.flatnonzero(out < 0)
        if len(new):
            each, first = np.unique(keys[new].view("V24").ravel(), return_index=True)
            if len(self.keys) + len(each) > self.MOST and len(self.keys):
                self.clear(0)
                return self.numbers(keys, lengths)
            if 2 * len(each) > len(self.slots):
                self.clear(len(each))
            self.add(np.ascontiguousarray(keys[new[first]]), lengths[new[first]])
            out[new] = self.find(keys[new])
        return out


class CachedTokenizer:
    """A `tokenizers` file whose words are merged many at a time and remembered."""

    LONG = 48

    def __init__(self, name: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        path = tokenizer_path(name)
        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.merge = Merger(json.load(f)["model"])
        self.table = WordTable(self.merge)
        self.kinds, self.lower = np.full(256, OTHER_KIND, np.uint8), np.arange(256, dtype=np.uint8)
        self.kinds[0x21:0x7F], self.kinds[0x80:], self.kinds[0], self.kinds[0x20], self.kinds[0x0A] = MARK, LETTER, NO_KIND, SPACE, LINE
        self.kinds[0x30:0x3A], self.kinds[0x41:0x5B], self.kinds[0x61:0x7B], self.kinds[ord("'")] = DIGIT, LETTER, LETTER, OTHER_KIND
        self.lower[0x41:0x5B] += 0x20
        self.units: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {}
        self.byte_level = self.tok.normalizer is None
        self.find = regex.compile(BYTE_PATTERN if self.byte_level else WORD_PATTERN).findall
        self.unmap = {ord(c): b for b, c in enumerate(byte_alphabet())}
        self.map = dict(enumerate(byte_alphabet()))
        self.added = regex.compile("|".join(regex.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()) or r"(?!)")

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def cut(self, text: str | None) -> list[str] | None:
        """The units of a text, None if only the library can take it.

        Where no two marks or blanks meet, full stops, commas and line ends part tokens too."""
        if not text:
            return []
        if "<|" in text and self.added.search(text):
            return None
        if not self.byte_level:
            text = text.replace("\n", " ")
            return (text if MARKS_MEET.search(text) else text.replace(".", " . ").replace(",", " , ")).split(" ")
        if "\0" in text or blanks_meet(text) or MARK_ALONE.search(text):
            return SAFE_CUT.split(text)
        return text.replace(" ", "\0 ").replace(".", "\0.").replace(",", "\0,").replace("\n", "\0\n\0").split("\0")

    def parts(self, unit: str) -> list[str]:
        """Words of a unit, in UTF-8 read as Latin-1."""
        if PLAIN.fullmatch(unit):
            found = self.find(unit if self.byte_level else unit.lower())
            return found if unit.isascii() else [x.encode().decode("latin-1") for x in found]
        if self.tok.normalizer is not None:
            unit = self.tok.normalizer.normalize_str(unit)
        return [x.translate(self.unmap) for x, _ in self.tok.pre_tokenizer.pre_tokenize_str(unit)]

    def learn(self, units: set[str]) -> None:
        if len(self.units) + len(units) > CACHE_ENTRIES:
            self.units = {"": b""}
        if len(self.words) > CACHE_ENTRIES // 4:
            self.words = {}
        single = [u for u in units if len(u) <= self.LONG // 2 and (u[1:] if u[:1] == " " else u).isalpha() and PLAIN.fullmatch(u)]
        self.units.update(zip(single, self.merge.words([(u if self.byte_level else u.lower()).encode() for u in single]), strict=True))
        of = {u: self.parts(u) for u in units.difference(single)}
        new = list({w for ws in of.values() for w in ws}.difference(self.words))
        short = [w for w in new if len(w) <= self.LONG]
        self.words.update(zip(short, self.merge.words([w.encode("latin-1") for w in short]), strict=True))
        for w in new:
            if len(w) > self.LONG:
                self.words[w] = np.asarray([t.id for t in self.tok.model.tokenize(w.translate(self.map))], "<u4").tobytes()
        word = self.words.__getitem__
        self.units.update((u, b"".join(map(word, ws))) for u, ws in of.items())

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The library's ids of whole texts (null: none), as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        held: list[str] = []
        size = 0
        for text in texts:
            if text and len(text) > 2 * PART:
                out += self.part(held)
                out.append(b"".join(x for piece in stretches(text) for x in self.part([piece])))
                held, size = [], 0
                continue
            held.append(text or "")
            size += len(held[-1])
            if size > PART:
                out += self.part(held)
                held, size = [], 0
        return out + self.part(held)

    def part(self, texts: list[str]) -> list[bytes]:
        """Plain texts by arrays, the others by units."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        starts = np.cumsum(sizes + 1) - sizes  # a zero byte stands before each text
        text = np.frombuffer(b"\0" + b"\0".join(raw) + bytes(WordTable.BYTES + 1), np.uint8)
        kind = self.kinds[text]
        plain = self.plain(text, kind, starts, sizes) if len(raw) else np.zeros(0, bool)
        if not self.byte_level:
            text = self.lower[text]
            text[1:][(text[:-1] == 0xC3) & (text[1:] >= 0x80) & (text[1:] <= 0x9E)] += 0x20
        change = np.append(True, kind[1:] != kind[:-1])
        if self.byte_level:  # a space begins what follows it; each line end stands alone
            change[1:] &= kind[:-1] != SPACE
            change |= (kind == SPACE) | (kind == LINE)
        else:
            change |= kind == DIGIT
        edges = np.flatnonzero(change)
        first, last = edges[:-1], edges[1:]
        token = kind[first] >= (SPACE if self.byte_level else LETTER)
        first, last = first[token], last[token]
        owner = np.searchsorted(starts, first, "right") - 1
        mine = plain[owner] if len(owner) else np.zeros(0, bool)
        first, last, owner = first[mine], last[mine], owner[mine]
        length = last - first
        long = length > WordTable.BYTES
        ids, counts = self.looked_up(text, first, length, long)
        ends = np.cumsum(np.bincount(owner, counts, len(raw)).astype(np.int64)) * 4
        flat = ids.astype("<u4").tobytes()
        out = [flat[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]
        rest = [i for i in np.flatnonzero(~plain).tolist() if texts[i]]
        for i, own in zip(rest, self.flush([(texts[i], self.cut(texts[i])) for i in rest]), strict=True):
            out[i] = own
        return out

    def looked_up(self, text: np.ndarray, first: np.ndarray, length: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after another, and how many each has."""
        words = np.ndarray((len(text) - 7,), "<u8", text.tobytes(), strides=(1,))
        keys = np.zeros((len(first), 3), np.uint64)
        for k in range(3):
            keys[:, k] = words[first + 8 * k] & MASKS[np.clip(length - 8 * k, 0, 8)]
        keys[long] = 0
        keys[long, 0] = 1  # a stand-in; its ids are put in below
        number = self.table.numbers(keys, np.where(long, 1, length))
        counts, begin, pool = self.table.count[number], self.table.first[number], self.table.pool
        if long.any():
            found = [np.frombuffer(self.word(text[a : a + n].tobytes().decode("latin-1")), "<u4") for a, n in zip(first[long].tolist(), length[long].tolist(), strict=True)]
            counts[long] = [len(x) for x in found]
            begin[long] = len(pool) + np.cumsum(counts[long]) - counts[long]
            pool = np.concatenate((pool, *found))
        return pool[spread(begin, counts)], counts

    def word(self, word: str) -> bytes:
        """The ids of one word, in UTF-8 read as Latin-1, as the library's model gives them."""
        return np.asarray([t.id for t in self.tok.model.tokenize(word.translate(self.map))], "<u4").tobytes()

    def plain(self, text: np.ndarray, kind: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which texts hold printable ASCII, Latin-1 letters and line ends only, no apostrophe, no
        beginning of an added token, and for byte-level BPE no blanks side by side or last."""
        lead = text == 0xC3
        bad = (kind == OTHER_KIND) | (kind == NO_KIND)
        high = text >= 0x80
        bad[1:] |= high[1:] & ~lead[1:] & ~lead[:-1]
        bad[1:] |= lead[:-1] & ((text[1:] == 0x97) | (text[1:] == 0xB7))
        bad[1:] |= (text[1:] == ord("|")) & (text[:-1] == ord("<"))
        if self.byte_level:
            blank = (kind == SPACE) | (kind == LINE)
            bad[:-1] |= blank[:-1] & (blank[1:] | (kind[1:] == NO_KIND))
        sums = np.append(0, np.cumsum(bad))
        return sums[starts + sizes] == sums[starts]

    def flush(self, held: list) -> list[bytes]:
        wanted = set(itertools.chain.from_iterable(units or () for _, units in held))
        new = wanted.difference(self.units)
        if len(self.units) + len(new) > CACHE_ENTRIES:
            self.units, new = {"": b""}, wanted
        self.learn(new)
        get = self.units.__getitem__
        return [self.whole(text) if units is None else b"".join(map(get, units)) for text, units in held]


#: A full stop or comma that is not between Latin letters, digits and blanks (word BPE), or not
#: after a letter or digit (byte-level).  The mark comes first: `re` runs through a text fastest then.
LATIN = "A-Za-z0-9À-ÖØ-öø-ÿ"
def stretches(text: str) -> Iterator[str]:
    """A long text cut before spaces between letters, where every tokenizer here begins anew."""
    begin = 0
    for m in iter(lambda: BETWEEN_WORDS.search(text, begin + PART), None):
        yield text[begin : m.start() + 1]
        begin = m.start() + 1
    yield text[begin:]


BETWEEN_WORDS = re.compile("[A-Za-z] (?=[A-Za-z])")
MARKS_MEET = re.compile(rf"[.,](?:(?![ \n{LATIN}]|\Z)|(?<![ \n{LATIN}].))")
MARK_ALONE = re.compile(rf"[.,](?<![{LATIN}].)")
#: White space other than space and line end.
OTHER_BLANKS = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]


def blanks_meet(text: str) -> bool:
    """Whether blanks stand side by side or last, or there are others than space and line end."""
    return "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[-1] in " \n" or any(c in text for c in OTHER_BLANKS)


SAFE_CUT = regex.compile(r"(?= \S)", regex.V1)
_LOADED: dict[str, CachedTokenizer] = {}


def cached(name: str) -> CachedTokenizer:
    """This process's tokenizer of that file."""
    if name not in _LOADED:
        _LOADED[name] = CachedTokenizer(name)
    return _LOADED[name]
