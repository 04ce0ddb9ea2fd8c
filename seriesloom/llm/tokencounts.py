"""Token counts of a SentencePiece BPE model, with a shortcut for whole tokens.

The model writes a space as a mark of its own, and in its vocabulary that mark stands only at the
beginning of a piece.  So no merge reaches across the place before a space, and a text's count is
the sum over its words, each taken with the spaces before it.  `CountTable` proves this when it
loads the vocabulary, finds the line end and the marks which never follow a letter inside a piece
either, and encodes every vocabulary string alone: those that come out as one token are counted
directly, all other words are merged by the library, once for each worker and word.

* null or empty text: 0 bytes, 0 tokens; null ids and repeated rows are counted row by row.
* empty table: no rows; other columns are left out.  Texts are never cut off.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of
from .tokens import CACHE_ENTRIES, LATIN, tokenizer_path

SPACE = "▁"
LIMIT = 4096
MODEL = "piece_bpe_32k.model"


class CountTable:
    def __init__(self, name: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
        ids = range(self.sp.get_piece_size())
        pieces = [self.sp.id_to_piece(i) for i in ids if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i))]
        #: False for a vocabulary with a space inside a piece: then only whole texts are safe
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        inner = {a + b for p in pieces for a, b in itertools.pairwise(p)}
        #: marks that no piece holds after a Latin letter or digit
        self.marks = [m for m in ".," if not any(re.fullmatch(f"[{LATIN}]", x[0]) and x[1] == m for x in inner)]
        self.alone = re.compile(rf"[{''.join(self.marks)}](?<![{LATIN}].)") if self.marks else None
        self.lines = not any("\n" in p for p in pieces)
        whole = [p[1:] for p in pieces if p[0] == SPACE and p[1:] and SPACE not in p[1:]]
        self.single = {w: 1 for w, c in zip(whole, self.merged(whole), strict=True) if c == 1}
        self.single[""] = 1  # a space that nothing follows in its word
        self.table: dict[str, int] = dict(self.single)

    def merged(self, words: list[str]) -> list[int]:
        """Counts as the library's merges give them."""
        return list(map(len, self.sp.encode(words, num_threads=1)))

    def cut(self, text: str) -> list[str] | None:
        """Words that add up to the text; a word stands for itself after one space.

        Words that follow a line end or a mark begin with a line end: the library then gives a space
        and a line end before them, which `learn` takes off."""
        if not self.by_word or SPACE in text or "\0" in text or "  " in text or text[0] == " ":
            return None
        if self.lines:
            text = text.replace("\n", " \n")
        if self.alone is not None and not self.alone.search(text):
            for m in self.marks:
                text = text.replace(m, f" \0{m}")
        return text.split(" ")

    def learn(self, words: set[str]) -> None:
        if len(self.table) + len(words) > CACHE_ENTRIES:
            self.table = dict(self.single)
        words = list(words.difference(self.table))
        # "\n..." and "\0." continue a word: their own leading space (and "\0" put in here) don't count
        sent = [w.replace("\0", "\n", 1) if w[:1] == "\0" else w for w in words]
        off = [2 if w[:1] == "\0" else 1 if w[:1] == "\n" else 0 for w in words]
        self.table.update((w, n - o) for w, n, o in zip(words, self.merged(sent), off, strict=True))

    def counts(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        for begin, end in _parts([len(t) for t in texts], 4_000_000):
            cuts = [self.cut(t) if t else [] for t in texts[begin:end]]
            wanted = set(itertools.chain.from_iterable(c or () for c in cuts))
            new = wanted.difference(self.table)
            if len(self.table) + len(new) > CACHE_ENTRIES:
                new = wanted
            self.learn(new)
            get = self.table.__getitem__
            out += [len(self.sp.encode(t)) if c is None else sum(map(get, c)) for t, c in zip(texts[begin:end], cuts, strict=True)]
        return out


def _parts(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours of about `most` in all, at least one each."""
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        held += n
        if held >= most:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(sizes):
        yield begin, len(sizes)


_LOADED: dict[str, CountTable] = {}


def count_table(name: str) -> CountTable:
    if name not in _LOADED:
        _LOADED[name] = CountTable(name)
    return _LOADED[name]


def token_counts(docs: DataFrame, model: str = MODEL, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, n_bytes, n_tokens, over_limit."""

    @F.pandas_udf("long")
    def counted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(count_table(model).counts(texts.tolist()), dtype="int64")

    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), counted(text).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
