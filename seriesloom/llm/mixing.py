"""Mixing sources to target weights by weighted sampling without replacement.

Targets: sources in code point order (null last) weigh 3, 1, 2, repeating, and share 150 % of all
words; a target stops at twice its source's words and what is over goes to the others by weight.
That ends where target = min(2 * words, level * weight) for one level, which sorted sums find.

Selection: a document's key is -ln(u) / w for a uniform u that its id and text fix and a quality
weight w; the smallest keys of a source are an Efraimidis-Spirakis sample.  A source gives its
complete epochs first; the remaining budget goes to the documents with the smallest keys whose
sizes, summed in key order, fit in it.  What then still is free goes in two further passes, once more
in key order, to documents that fit there.  Documents are never cut.

Sums run over ranges of the key's logarithm for each source; keys are only sorted in the one range of a
source where its budget ends, so a source that holds most rows is not one task's work.

* null text: size 0; null source: a source of its own, last; null id: allowed.
* Ties and repeated rows: rows equal in id and text have equal keys and sizes.  Where the budget ends
  among them as many are taken as fit, whichever they are; they are numbered by many tasks.
* Very long texts: sizes are sums of BIGINT; a document that is larger than what is free isn't taken.
* A source without words has target 0.  Empty table: no rows.  Other columns are kept by `mixed`,
  whatever their names, and left out by `mix`.
* One row for each source goes through one task, which suits sources, not keys of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ranks
from .common import staged, table, text_of, whole_row, word_count

WEIGHTS = (3, 1, 2)
TOTAL_SHARE, LIMIT = 1.5, 2
#: Ranges for each factor e between keys, and all of them; passes over what is free.
FINENESS, RANGES, PASSES = 1024, 65_536, 3
SEED = 17
SYMBOLS = r"[#*$%&|<>]"


def quality_weight(text: Column, size: Column) -> Column:
    """1 for plain prose, less with each symbol a word: 1 / (1 + 10 * symbols / words)."""
    return F.lit(1.0) / (F.lit(1.0) + F.lit(10.0) * F.regexp_count(text, F.lit(SYMBOLS)).cast("double") / F.greatest(size, F.lit(1)).cast("double"))


def uniform(id_col: Column, text: Column, seed: int) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5 of seed, id and text."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(id_col.cast("string"), F.lit("")), F.lit("|"), text).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def keyed(docs: DataFrame, seed: int, id_col: str, text_col: str) -> DataFrame:
    """`docs` with _size and _key (the sampling key); the same for the same row each time."""
    sized = docs.withColumn("_size", word_count(text_of(text_col)))
    return sized.withColumn("_key", -F.ln(uniform(F.col(id_col), text_of(text_col), seed)) / quality_weight(text_of(text_col), F.col("_size")))


def targets(slim: DataFrame) -> DataFrame:
    """A row for each source of (_source, _size): _words, _target, _epochs and _budget (what remains)."""
    sums = slim.groupBy("_source").agg(F.sum("_size").alias("_words"))
    rank = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), rank % len(WEIGHTS) + 1).cast("double")
    t = sums.withColumn("_w", weight).withColumn("_cap", (F.col("_words") * LIMIT).cast("double"))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    free = F.sum("_words").over(Window.partitionBy()) * F.lit(TOTAL_SHARE) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    t = t.withColumn("_level", free / F.sum("_w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))).withColumn("_nth", F.row_number().over(order))
    t = t.withColumn("_capped", F.col("_cap") / F.col("_w") <= F.col("_level"))
    level = F.min_by(F.col("_level"), F.when(~F.col("_capped"), F.col("_nth"))).over(Window.partitionBy())
    t = t.withColumn("_target", F.when(F.col("_capped"), F.col("_cap")).otherwise(level * F.col("_w")))
    t = t.withColumn("_epochs", F.when(F.col("_words") > 0, F.floor(F.col("_target") / F.col("_words"))).otherwise(0).cast("long"))
    return t.select("_source", "_words", "_target", "_epochs", (F.round("_target").cast("long") - F.col("_epochs") * F.col("_words")).alias("_budget"))


def _range(key: Column) -> Column:
    return F.greatest(F.least(F.floor((F.ln(key) + 40) * FINENESS), F.lit(RANGES - 1)), F.lit(0)).cast("int")


def _fitting(rows: DataFrame, budgets: DataFrame, n: int) -> DataFrame:
    """For each source of `budgets` (_source, _budget): _range{n}, _cut{n} and _take{n}.  A row of `rows`
    fits if its range is lower, or the same and its key lower than the cut; of the rows with that
    key _take{n} fit.  _left{n} is what is free then."""
    rows = rows.withColumn("_range", _range(F.col("_key")))
    by_range = rows.groupBy("_source", "_range").agg(F.sum("_size").alias("_sum"))
    upto = F.sum("_sum").over(Window.partitionBy("_source").orderBy("_range"))
    crossing = by_range.withColumn("_upto", upto).join(budgets.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s"))).where("_upto > _budget")
    last = crossing.groupBy("_source").agg(F.min_by(F.struct("_range", (F.col("_budget") - F.col("_upto") + F.col("_sum")).alias("_room")), "_range").alias("_at")).select(F.col("_source").alias("_s"), F.col("_at._range").alias("_r"), F.col("_at._room").alias("_room"))
    inside = rows.join(last, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    keys = inside.groupBy("_s", "_room", "_key").agg(F.sum("_size").alias("_sum"), F.max("_size").alias("_one"))
    running = keys.withColumn("_run", F.sum("_sum").over(Window.partitionBy("_s").orderBy("_key"))).where("_run > _room")
    free = F.col("_room") - F.col("_run") + F.col("_sum")
    fit = F.floor(free / F.greatest("_one", F.lit(1)))
    cuts = running.groupBy(F.col("_s").alias("_c")).agg(F.min_by(F.struct(F.col("_key").alias("key"), fit.alias("take"), (free - fit * F.col("_one")).alias("left")), "_key").alias("_cut"))
    # sources whose rows all fit have no crossing range: everything is below range RANGES
    total = rows.groupBy(F.col("_source").alias("_t")).agg(F.sum("_size").alias("_all"))
    out = budgets.join(last, F.col("_source").eqNullSafe(F.col("_s")), "left").join(cuts, F.col("_source").eqNullSafe(F.col("_c")), "left").join(total, F.col("_source").eqNullSafe(F.col("_t")), "left")
    left = F.when(F.col("_r").isNull(), F.col("_budget") - F.coalesce("_all", F.lit(0))).otherwise(F.col("_cut.left"))
    return out.select("_source", F.coalesce("_r", F.lit(RANGES)).alias(f"_range{n}"), F.coalesce("_cut.key", F.lit(-1.0)).alias(f"_cut{n}"), F.coalesce("_cut.take", F.lit(0)).alias(f"_take{n}"), left.alias(f"_left{n}"))


def _below(n: int) -> Column:
    """Whether the key comes before the one where the budget of pass n ends."""
    at = _range(F.col("_key"))
    return (at < F.col(f"_range{n}")) | ((at == F.col(f"_range{n}")) & (F.col("_key") < F.col(f"_cut{n}")))


def _asked(n: int) -> Column:
    """Whether pass n looks at the row at all: it is small enough, and no earlier pass ended after it."""
    out = F.lit(True)
    for k in range(1, n):
        out = out & ~_below(k) & (F.col("_size") <= F.col(f"_left{k}"))
    return out


def _joined(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """A row of `plan` beside each row; sources are few, and Spark sends them around if they are small."""
    plan = plan.withColumnRenamed("_source", "_p")
    return rows.join(plan, F.col("_source").eqNullSafe(F.col("_p"))).drop("_p")


def mix_plan(slim: DataFrame) -> DataFrame:
    """What each source takes of rows (_source, _size, _key): targets, epochs and a cut for each pass."""
    plan = staged(targets(slim), "mix-targets")
    budgets = plan.select("_source", "_budget")
    for n in range(1, PASSES + 1):
        rows = _joined(slim, plan).where(_asked(n)).select("_source", "_size", "_key") if n > 1 else slim
        plan = staged(_joined(plan, _fitting(rows, budgets, n)), "mix-plan")
        budgets = plan.select("_source", F.col(f"_left{n}").alias("_budget"))
    return plan


def timed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """`rows` (_source, _size, _key and others) beside their plan, with _times: how often each is
    taken, all epochs, and once more if it is selected."""
    passes = range(1, PASSES + 1)
    rows = _joined(rows, plan)
    whole = F.greatest(*(_asked(n) & _below(n) for n in passes))
    some = plan.where(F.greatest(*(F.col(f"_take{n}") for n in passes)) > 0)
    if some.isEmpty():
        return rows.withColumn("_times", F.col("_epochs") + whole.cast("int"))
    # in rows that tie where a budget ends, the first few count
    take = F.greatest(*(F.when(_asked(n) & (F.col("_key") == F.col(f"_cut{n}")), F.col(f"_take{n}")).otherwise(0) for n in passes))
    rows = rows.withColumn("_take", take)
    tied = ranks.numbered(rows.where("_take > 0").withColumn("_spread", F.monotonically_increasing_id()), ["_source", "_key", "_spread"], "_no")
    first = tied.groupBy(F.col("_source").alias("_s"), F.col("_key").alias("_k")).agg(F.min("_no").alias("_first"))
    tied = tied.join(first, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_key") == F.col("_k"))).withColumn("_times", F.col("_epochs") + (F.col("_no") - F.col("_first") < F.col("_take")).cast("int"))
    rest = rows.where("_take = 0").withColumn("_times", F.col("_epochs") + whole.cast("int"))
    return rest.unionByName(tied.select(*rest.columns))


def _slim(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    rows = keyed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), F.col(source_col).alias("_source")), seed, "doc_id", "_text")
    return staged(rows.select("doc_id", "_source", "_size", "_key"), "mix-slim")


def mix(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken, times."""
    slim = _slim(docs, seed, id_col, text_col, source_col)
    return timed(slim, mix_plan(slim)).select(
        "doc_id", F.col("_size").alias("size"), F.col("_words").alias("source_size"), F.col("_target").alias("target"),
        (F.col("_size") * F.col("_times")).alias("taken"), F.col("_times").alias("times"),
    )


def mixed(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixture itself: the rows of `docs` with all their columns, as often as `mix` takes them."""
    plan = mix_plan(_slim(docs, seed, id_col, text_col, source_col))
    packed = docs.select(whole_row(docs).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(source_col).alias("_source"))
    rows = timed(keyed(packed, seed, "_id", "_text"), plan).where("_times > 0")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times").cast("long")))).select("_row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP9_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::DOUBLE AS symbols,
         (('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
keyed AS (
  SELECT doc_id, source, size, -ln(u) / (1.0::DOUBLE / (1.0::DOUBLE + 10.0::DOUBLE * symbols / greatest(size, 1)::DOUBLE)) AS k FROM sized),
sums AS (
  SELECT source, sum(size)::BIGINT AS words,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w
  FROM keyed GROUP BY source),
leveled AS (
  SELECT *, (2 * words)::DOUBLE AS cap,
         (sum(words) OVER () * 1.5::DOUBLE - coalesce(sum((2 * words)::DOUBLE) OVER (ORDER BY (2 * words)::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY (2 * words)::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl,
         row_number() OVER (ORDER BY (2 * words)::DOUBLE / w, source NULLS LAST) AS nth
  FROM sums),
goal AS (
  SELECT source, words, CASE WHEN cap / w <= lvl THEN cap ELSE w * (SELECT arg_min(lvl, nth) FROM leveled WHERE cap / w > lvl) END AS target FROM leveled),
plan AS (
  SELECT *, CASE WHEN words > 0 THEN floor(target / words)::BIGINT ELSE 0 END AS epochs FROM goal),
pass0 AS (
  SELECT row_number() OVER () AS no, k.doc_id, k.source, k.size, k.k, p.words, p.target, p.epochs, false AS taken, round(p.target)::BIGINT - p.epochs * p.words AS free
  FROM keyed k JOIN plan p ON k.source IS NOT DISTINCT FROM p.source)""" + "".join(
    f""",
tried{n} AS (
  SELECT *, NOT taken AND size <= free AND sum(CASE WHEN NOT taken AND size <= free THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY k, no ROWS UNBOUNDED PRECEDING) <= free AS fits FROM pass{n - 1}),
pass{n} AS (
  SELECT * EXCLUDE (taken, free, fits), taken OR fits AS taken, free - coalesce(sum(size) FILTER (fits) OVER (PARTITION BY source), 0) AS free FROM tried{n})"""
    for n in range(1, PASSES + 1)
) + f"""
SELECT doc_id, size, words AS source_size, target, (size * (epochs + taken::INTEGER))::BIGINT AS taken, (epochs + taken::INTEGER)::BIGINT AS times FROM pass{PASSES}
"""
