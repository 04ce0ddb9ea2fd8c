"""License scans: ordered signature rules over the words of a text.

A rule is a regex over words that begins with a given first word and counts only where its
keyword, a word that the regex can't do without, is in the text at all.  A text without any keyword is not looked at further.
At each first word the following words are matched against the rules of that word in their order;
the first that matches is the detection there.  A detection inside the words of an earlier one of at
least its priority is suppressed; a wider detection of lower priority around one of higher stays, as both
name what the text says.  Of rules that tie at a first word the first in their order counts.

* Words are runs of ASCII letters, digits and non-ASCII characters, in lower case; positions count
  words from 0.
* null or empty text: no words, nothing found, score 0.  Null ids and repeated rows are scanned row
  by row; empty table: no rows; other columns are left out.
* A signature spans SPAN words at most, so work grows with a text's length, not with its square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

SPAN = 16
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that always count, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

L = "licen[sc]e"
#: label; keyword; names of the license over words, most telling first ("L" in names: either spelling)
FAMILIES = [
    ("agpl-3.0", "affero", [f"gnu affero general public {L}(?: version)? (?:v)?3", f"affero general public {L}"]),
    ("agpl-3.0", "agpl", ["agpl (?:v)?3(?: 0)?", "gnu agpl"]),
    ("agpl-3.0", "agplv3", ["agplv3"]),
    ("lgpl-3.0", "lesser", [f"gnu lesser general public {L}(?: version)? (?:v)?3"]),
    ("lgpl-2.1", "lesser", [f"gnu lesser general public {L}(?: version)? (?:v)?2 1"]),
    ("lgpl", "lesser", [f"gnu lesser general public {L}", f"lesser general public {L}"]),
    ("lgpl-2.0", "library", [f"gnu library general public {L}"]),
    ("lgpl", "lgpl", ["lgpl (?:v)?3(?: 0)?", "lgpl (?:v)?2 1", "gnu lgpl"]),
    ("lgpl", "lgplv3", ["lgplv3"]),
    ("gpl-3.0", "general", [f"gnu general public {L}(?: version)? (?:v)?3(?: 0)?", f"general public {L}(?: version)? (?:v)?3(?: 0)?"]),
    ("gpl-2.0", "general", [f"gnu general public {L}(?: version)? (?:v)?2(?: 0)?", f"general public {L}(?: version)? (?:v)?2(?: 0)?"]),
    ("gpl-1.0", "general", [f"gnu general public {L}(?: version)? (?:v)?1(?: 0)?"]),
    ("gpl", "general", [f"gnu general public {L}", f"general public {L}"]),
    ("gpl-3.0", "gpl", ["gpl (?:version |v)?3(?: 0)?", "gnu gpl (?:version |v)?3"]),
    ("gpl-2.0", "gpl", ["gpl (?:version |v)?2(?: 0)?", "gnu gpl (?:version |v)?2"]),
    ("gpl-3.0", "gplv3", ["gplv3"]),
    ("gpl-2.0", "gplv2", ["gplv2"]),
    ("gfdl", "documentation", [f"gnu free documentation {L}", f"free documentation {L}"]),
    ("apache-2.0", "apache", [f"apache (?:software )?{L} version 2(?: 0)?", f"apache {L} (?:v)?2(?: 0)?", "apache 2 0"]),
    ("apache-1.1", "apache", [f"apache (?:software )?{L} version 1 1"]),
    ("apache", "apache", [f"apache (?:software )?{L}"]),
    ("mit-0", "mit", [f"mit no attribution(?: {L})?", "mit 0"]),
    ("mit", "mit", [f"mit {L}", f"mit x11 {L}", f"mit style {L}"]),
    ("x11", "x11", [f"x11 {L}"]),
    ("expat", "expat", [f"expat {L}"]),
    ("bsd-3-clause", "bsd", [f"bsd 3 clause(?: {L})?", f"(?:3 clause|three clause|new|modified|revised) bsd(?: {L})?"]),
    ("bsd-2-clause", "bsd", [f"bsd 2 clause(?: {L})?", f"(?:2 clause|two clause|simplified|freebsd) bsd(?: {L})?"]),
    ("bsd-4-clause", "bsd", [f"bsd 4 clause(?: {L})?", f"(?:4 clause|four clause|original) bsd(?: {L})?"]),
    ("0bsd", "0bsd", ["0bsd"]),
    ("0bsd", "zero", [f"zero clause bsd(?: {L})?"]),
    ("bsd", "bsd", [f"bsd {L}", f"bsd style {L}"]),
    ("isc", "isc", [f"isc {L}"]),
    ("mpl-2.0", "mozilla", [f"mozilla public {L}(?: version)? (?:v)?2(?: 0)?"]),
    ("mpl-1.1", "mozilla", [f"mozilla public {L}(?: version)? (?:v)?1 1"]),
    ("mpl", "mozilla", [f"mozilla public {L}"]),
    ("mpl-2.0", "mpl", ["mpl (?:v)?2(?: 0)?", "mpl 2 0"]),
    ("epl-2.0", "eclipse", [f"eclipse public {L}(?: version)? (?:v)?2(?: 0)?"]),
    ("epl", "eclipse", [f"eclipse public {L}", f"eclipse distribution {L}"]),
    ("cddl", "cddl", ["cddl"]),
    ("cddl", "development", [f"common development and distribution {L}"]),
    ("eupl", "eupl", ["eupl"]),
    ("eupl", "european", [f"european union public {L}"]),
    ("cpl", "common", [f"common public {L}"]),
    ("cpl", "ibm", [f"ibm public {L}"]),
    ("artistic-2.0", "artistic", [f"artistic {L}(?: version)? 2(?: 0)?"]),
    ("artistic", "artistic", [f"artistic {L}", f"perl artistic {L}"]),
    ("bsl-1.0", "boost", [f"boost software {L}"]),
    ("busl-1.1", "business", [f"business source {L}"]),
    ("sspl", "sspl", ["sspl"]),
    ("sspl", "server", [f"server side public {L}"]),
    ("elastic-2.0", "elastic", [f"elastic {L}(?: 2 0)?"]),
    ("unlicense", "unlicense", ["unlicense", "the unlicense"]),
    ("wtfpl", "wtfpl", ["wtfpl"]),
    ("zlib", "zlib", [f"zlib {L}", f"zlib libpng {L}"]),
    ("psf", "python", [f"python software foundation {L}", f"python {L}"]),
    ("php", "php", [f"php {L}"]),
    ("ruby", "ruby", [f"ruby {L}"]),
    ("openssl", "openssl", [f"openssl {L}"]),
    ("ofl-1.1", "sil", [f"sil open font {L}"]),
    ("ms-pl", "microsoft", [f"microsoft public {L}"]),
    ("odbl", "database", [f"open database {L}"]),
    ("openrail", "openrail", [f"openrail(?: m)?(?: {L})?"]),
    ("llama", "llama", [f"llama (?:2 |3 )?community {L}"]),
    ("cc0", "cc0", ["cc0 1 0", "cc0"]),
    ("cc-by-nc-nd", "cc", ["cc by nc nd(?: [1-4] 0)?"]),
    ("cc-by-nc-sa", "cc", ["cc by nc sa(?: [1-4] 0)?"]),
    ("cc-by-nc", "cc", ["cc by nc(?: [1-4] 0)?"]),
    ("cc-by-nd", "cc", ["cc by nd(?: [1-4] 0)?"]),
    ("cc-by-sa", "cc", ["cc by sa(?: [1-4] 0)?"]),
    ("cc-by", "cc", ["cc by(?: [1-4] 0)?"]),
    ("cc-by-nc", "creative", ["creative commons attribution non ?commercial"]),
    ("cc-by-sa", "creative", ["creative commons attribution share ?alike"]),
    ("cc-by", "creative", ["creative commons attribution"]),
    ("cc0", "creative", ["creative commons (?:zero|cc0)"]),
    ("cc", "creative", ["creative commons"]),
    ("public-domain", "domain", ["dedicated to the public domain", "in the public domain"]),
    ("proprietary", "reserved", ["all rights reserved"]),
]
#: how a grant of a license begins: its first word, and the words up to the license's name
GRANTS = {
    "licensed": "licensed (?:to you )?under (?:the )?(?:terms of (?:the )?)?",
    "released": "released under (?:the )?(?:terms of (?:the )?)?",
    "distributed": "distributed under (?:the )?(?:terms of (?:the )?)?",
    "available": "available under (?:the )?(?:terms of (?:the )?)?",
    "spdx": f"spdx {L} identifier ",
    "license": f"{L} ",
    "licence": f"{L} ",
}
#: label and identifier as words, for the identifiers that no name above begins with
SPDX = [
    ("mit", "mit"), ("isc", "isc"), ("zlib", "zlib"), ("epl-2.0", "epl 2 0"), ("epl", "epl 1 0"), ("bsl-1.0", "bsl 1 0"), ("busl-1.1", "busl 1 1"), ("apache-1.1", "apache 1 1"),
    ("bsd-3-clause", "bsd 3 clause"), ("mpl-1.1", "mpl 1 1"), ("gpl-1.0", "gpl 1 0"), ("gfdl", "gfdl"), ("psf", "python 2 0"), ("psf", "psf 2 0"), ("php", "php 3 01"), ("ruby", "ruby"), ("openssl", "openssl"),
    ("ofl-1.1", "ofl 1 1"), ("ms-pl", "ms pl"), ("odbl", "odbl 1 0"), ("artistic-2.0", "artistic 2 0"), ("artistic", "artistic 1 0"), ("cpl", "cpl 1 0"), ("cpl", "ipl 1 0"), ("x11", "x11"), ("elastic-2.0", "elastic 2 0"),
]


def rules() -> list[tuple[str, str, str, str, int, float]]:
    """(first word, keyword, regex, label, priority, confidence) in order: grants before bare names."""
    out = []
    for first, lead in GRANTS.items():
        out += [(first, keyword, f"^{lead}{name} ", label, 2, 1.0) for label, keyword, names in FAMILIES for name in names]
    out += [("spdx", name.split(" ")[0], f"^{GRANTS['spdx']}{name} ", label, 2, 1.0) for label, name in SPDX]
    for label, keyword, names in FAMILIES:
        for name in names:
            firsts = name[3 : name.index(")")].split("|") if name.startswith("(?:") else [name]
            out += [(x.split(" ")[0].split("(")[0], keyword, f"^{name} ", label, 1, 0.8) for x in firsts]
    return out


def _rule_map() -> Column:
    """first word -> its rules in order, as a constant."""
    by_first: dict[str, list] = {}
    for first, *rule in rules():
        by_first.setdefault(first, []).append(rule)
    entry = lambda keyword, regex, label, priority, confidence: F.struct(F.lit(keyword).alias("keyword"), F.lit(regex).alias("regex"), F.lit(label).alias("label"), F.lit(priority).alias("priority"), F.lit(confidence).alias("confidence"))
    return F.map_from_arrays(F.array(*map(F.lit, by_first)), F.array(*(F.array(*(entry(*r) for r in rs)) for rs in by_first.values())))


def detections(words: Column, present: Column, rule_map: Column) -> Column:
    """array<struct<start, end, label, priority, confidence>>: unsuppressed detections in text order."""
    firsts = sorted({r[0] for r in rules()})
    numbered = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains(F.array(*map(F.lit, firsts)), x["w"]))

    def at(x: Column) -> Column:
        ahead = F.concat(F.array_join(F.slice(words, x["i"] + 1, SPAN), " "), F.lit(" "))
        fits = F.filter(F.try_element_at(rule_map, x["w"]), lambda r: F.array_contains(present, r["keyword"]) & F.regexp_like(ahead, r["regex"]))
        first = F.get(fits, F.lit(0))
        length = F.size(F.split(F.call_function("regexp_extract", ahead, first["regex"], F.lit(0)), " ")) - 1
        return F.struct(x["i"].alias("start"), (x["i"] + length).alias("end"), first["label"].alias("label"), first["priority"].alias("priority"), first["confidence"].alias("confidence"))

    found = F.filter(F.transform(numbered, at), lambda d: d["label"].isNotNull())
    return found


def unsuppressed(found: Column) -> Column:
    """Without detections that lie inside an earlier one of at least their priority."""

    def outside(d: Column, k: Column) -> Column:
        near = F.slice(found, F.greatest(k - SPAN + 1, F.lit(1)), F.least(k, F.lit(SPAN)))
        return ~F.exists(near, lambda g: (g["start"] < d["start"]) & (g["end"] >= d["end"]) & (g["priority"] >= d["priority"]))

    return F.filter(found, outside)


def scanned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with _words, _base (places of the base phrases) and _found (detections)."""
    keywords = sorted({r[1] for r in rules()} | {p.split(" ")[0] for p in BASE})
    # lower() maps no other character to a letter of a base phrase, so it stands for A-Z here
    df = docs.withColumn("_words", F.regexp_extract_all(F.lower(text_of(text_col)), F.lit(TOKEN), F.lit(0)))
    df = df.withColumn("_present", F.array_intersect("_words", F.array(*map(F.lit, keywords))))
    words = F.col("_words")
    some = F.size("_present") > 0

    def phrase(x: Column, i: Column) -> Column:
        hit = F.lit(None).cast("string")
        for text, label in BASE.items():
            first, *rest = text.split(" ")
            same = x == first
            for k, w in enumerate(rest, 1):
                same = same & F.get(words, i + k).eqNullSafe(F.lit(w))
            hit = F.when(same, label).otherwise(hit)
        return F.struct(i.cast("long").alias("start"), hit.alias("label"))

    base = F.filter(F.transform(words, phrase), lambda x: x["label"].isNotNull())
    df = df.withColumn("_base", F.when(some, base)).withColumn("_hits", F.when(some, detections(words, F.col("_present"), _rule_map())))
    return df.withColumn("_found", unsuppressed(F.col("_hits"))).drop("_hits", "_present")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: counts, labels, score, and the detections with their spans."""
    df = scanned(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")), "_text")
    starts = F.transform("_base", lambda x: x["start"])
    none = F.array().cast("array<string>")
    base = F.coalesce(F.transform("_base", lambda x: x["label"]), none)
    own = F.coalesce(F.transform("_found", lambda x: x["label"]), none)
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    score = F.coalesce(F.array_max(F.transform("_found", lambda x: x["confidence"])), F.lit(0.0))
    return df.select(
        "doc_id", F.size("_words").cast("long").alias("n_words"), F.coalesce(F.size("_base"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, own)).alias("labels"),
        F.greatest(score, F.when(F.size("_base") > 0, 0.8).otherwise(0.0)).alias("score"),
        F.coalesce("_found", F.array()).alias("detections"),
    )


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    return out.drop("detections")
