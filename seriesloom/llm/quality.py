"""Quality rules as weak supervision.

Each rule looks at a document's counts and votes good, votes bad or abstains.  Expectation
maximisation over the vote patterns of the corpus estimates how often a rule's votes are right for
good and for bad documents, without labels; a document's posterior probability of being good then
decides, so no single rule is a veto.  Each rule measures something of its own and votes both ways on
real text; what its votes are worth the fit finds out.  Votes depend on counts only, so the corpus enters
the fit as at most 3 ** 10 = 59,049 pattern counts, whatever its size; only those reach the driver.

* null or empty text: no words, all counts 0, and the base rule fails it; null ids and repeated rows
  are judged row by row; empty table: no rows, the model keeps its starting values.
* Ties: a posterior of exactly KEEP_AT is kept.  Very long texts are counted whole.
* Other columns of the input are kept by `accepted`, whatever their names, and left out by `judge`.
* Windows of three words are compared by 64-bit hashes inside one text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, TEXTS, WORD, staged, table, text_of, whole_row

MIN_WORDS = 50
ROUNDS = 60
KEEP_AT = 0.5


def counts(text: Column) -> dict[str, Column]:
    """Counts that need the text alone."""
    only = lambda but: F.length(F.regexp_replace(text, f"[^{but}]+", "")).cast("long")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    return {
        "word_chars": F.length(F.regexp_replace(text, f"{BLANKS}+", "")).cast("long"),
        "n_symbols": only("#*$%&|<>"),
        "n_letters": only(r"\p{L}"),
        "n_capitals": only(r"\p{Lu}"),
        "n_stops": only(".!?"),
        "n_bare": F.regexp_count(text, F.lit(rf"(?<![^\x20\x09-\x0D])[^\p{{L}}\p{{N}}\x20\x09-\x0D]+(?![^\x20\x09-\x0D])")).cast("long"),
        "n_runs": F.regexp_count(text, F.lit(r"([#*$%&|<>=_~^+@/\\-])\1\1+")).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }


def featured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with a struct _f of counts, n_words and n_repeat_words."""
    text = text_of(text_col)
    df = docs.withColumn("_f", F.struct(*(c.alias(k) for k, c in counts(text).items())))
    df = df.withColumn("_h", F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)))
    n = F.size("_h")
    third = lambda i: F.slice("_h", i, n - 2)
    zipped = F.arrays_zip(third(1).alias("a"), third(2).alias("b"), third(3).alias("c"))
    df = df.withColumn("_t", F.when(n >= 3, F.transform(zipped, lambda x: F.xxhash64(x["a"], x["b"], x["c"]))))
    # windows found twice stand side by side once sorted by hash
    some = F.size(F.array_distinct("_t")) < F.size("_t")
    df = df.withColumn("_s", F.when(some, F.sort_array(F.transform("_t", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda x, k: x["h"].eqNullSafe(F.get("_s", k - 1)["h"]) | x["h"].eqNullSafe(F.get("_s", k + 1)["h"])
    df = df.withColumn("_p", F.sort_array(F.transform(F.filter("_s", same), lambda x: x["i"])))
    # a window covers three words, fewer if the next repeated one begins before
    gaps = F.zip_with("_p", F.slice("_p", 2, F.greatest(F.size("_p"), F.lit(1))), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
    covered = F.when(F.size("_p") > 0, F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x)).otherwise(F.lit(0)).cast("long")
    df = df.withColumn("_f", F.struct(F.size("_h").cast("long").alias("n_words"), F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"), "_f.*"))
    return df.drop("_h", "_t", "_s", "_p")


def base_failed() -> Column:
    f = F.col("_f")
    return (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > 50 * f["n_words"])


def _share(a: str, b: str) -> Column:
    return F.col(f"_f.{a}") / F.greatest(F.col(f"_f.{b}"), F.lit(1))


#: name, when a document is good, when it is bad; else the rule abstains
RULES = {
    "symbols": lambda: (_share("n_symbols", "word_chars") < 0.005, _share("n_symbols", "word_chars") > 0.03),
    "runs of one symbol": lambda: (_share("n_runs", "n_words") < 0.005, _share("n_runs", "n_words") > 0.05),
    "words of no letter or digit": lambda: (_share("n_bare", "n_words") < 0.02, _share("n_bare", "n_words") > 0.1),
    "letters": lambda: (_share("n_letters", "word_chars") > 0.93, _share("n_letters", "word_chars") < 0.88),
    "word length": lambda: (_share("word_chars", "n_words").between(4.5, 6.5), ~_share("word_chars", "n_words").between(4.2, 7)),
    "repeated lines": lambda: (_share("n_dup_lines", "n_lines") < 0.05, _share("n_dup_lines", "n_lines") > 0.15),
    "repeated words": lambda: (_share("n_repeat_words", "n_words") < 0.05, _share("n_repeat_words", "n_words") > 0.15),
    "line length": lambda: (_share("n_words", "n_lines") > 20, _share("n_words", "n_lines") < 12),
    "sentences": lambda: (_share("n_stops", "n_words").between(0.05, 0.15), ~_share("n_stops", "n_words").between(0.03, 0.2)),
    "capitals": lambda: (_share("n_capitals", "n_letters").between(0.01, 0.035), ~_share("n_capitals", "n_letters").between(0.006, 0.045)),
}


def vote_code() -> Column:
    """The votes as base-3 digits, first rule lowest: 0 bad, 1 none, 2 good."""
    digits = [F.when(bad, 0).when(good, 2).otherwise(1) * 3**j for j, (good, bad) in enumerate(rule() for rule in RULES.values())]
    return sum(digits[1:], digits[0]).cast("int")


@dataclass(frozen=True)
class LabelModel:
    """Share of good documents; for each rule, how often its votes are right on good and on bad ones."""

    prior: float = 0.8
    right_good: tuple[float, ...] = (0.95,) * len(RULES)
    right_bad: tuple[float, ...] = (0.4,) * len(RULES)

    def weights(self) -> list[tuple[float, float]]:
        """What a bad and a good vote of each rule add to the log-odds of good."""
        return [(math.log((1 - a) / b), math.log(a / (1 - b))) for a, b in zip(self.right_good, self.right_bad, strict=True)]

    def probability(self, votes: list[int]) -> float:
        odds = math.log(self.prior / (1 - self.prior)) + sum(w[v // 2] for v, w in zip(votes, self.weights(), strict=True) if v != 1)
        return 1 / (1 + math.exp(-odds))

    def posterior(self, code: Column) -> Column:
        """The same as a column of `vote_code`."""
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for j, (bad, good) in enumerate(self.weights()):
            vote = F.floor(code / 3**j) % 3
            odds = odds + F.when(vote == 0, F.lit(bad)).when(vote == 2, F.lit(good)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def digits(code: int) -> list[int]:
    return [code // 3**j % 3 for j in range(len(RULES))]


def fit(patterns: list[tuple[int, int]], rounds: int = ROUNDS) -> LabelModel:
    """Expectation maximisation over (vote code, number of documents).

    Pseudo-counts of 20 documents hold each rate near its start where there is little evidence, and a
    rule stays better than chance on good documents, so the two classes can't change places."""
    model, start = LabelModel(), LabelModel()
    patterns = [(digits(code), n) for code, n in sorted(patterns)]
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        good = [(v, n, n * model.probability(v)) for v, n in patterns]
        a, b = [], []
        for j in range(len(RULES)):
            voted = [(v[j], n, p) for v, n, p in good if v[j] != 1]
            a.append((20 * start.right_good[j] + sum(p for x, _, p in voted if x == 2)) / (20 + sum(p for _, _, p in voted)))
            b.append((20 * start.right_bad[j] + sum(n - p for x, n, p in voted if x == 0)) / (20 + sum(n - p for _, n, p in voted)))
        prior = (20 * start.prior + sum(p for _, _, p in good)) / (20 + total)
        model = LabelModel(min(max(prior, 0.05), 0.95), tuple(min(max(x, 0.8), 0.995) for x in a), tuple(min(max(x, 0.05), 0.95) for x in b))
    return model


def fitted(judged: DataFrame) -> LabelModel:
    """The model of the documents in `judged` (_f, _votes) that the base rule leaves."""
    return fit([(r["_votes"], r["n"]) for r in judged.where(~base_failed()).groupBy("_votes").agg(F.count(F.lit(1)).alias("n")).collect()])


def verdict(model: LabelModel) -> Column:
    return ~base_failed() & (model.posterior(F.col("_votes")) >= KEEP_AT)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: its counts, base_failed, quality (the posterior) and kept."""
    rows = featured(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")), "_text").withColumn("_votes", vote_code())
    rows = staged(rows.select("doc_id", "_f", "_votes"), "quality")
    model = fitted(rows)
    return rows.select(
        "doc_id", "_f.n_words", "_f.word_chars", "_f.n_symbols", "_f.n_dup_lines", "_f.n_repeat_words",
        base_failed().alias("base_failed"), verdict(model).alias("kept"), model.posterior(F.col("_votes")).alias("quality"),
    )


def accepted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that are kept, with all their columns."""
    rows = featured(docs.select(whole_row(docs).alias("_row"), F.col(text_col).alias("_text")), "_text").withColumn("_votes", vote_code())
    rows = staged(rows.select("_row", "_f", "_votes"), "accepted", codec=TEXTS)
    return rows.where(verdict(fitted(rows))).select("_row.*")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
