"""Tokenizers, licenses, quality counts, pages: against the library or plain Python."""

import random
import re
import unicodedata
from collections import Counter

import pytest

from seriesloom.llm import htmltext, licenses, quality, tokencounts
from seriesloom.llm.tokens import cached
from tests.conftest import DATA

ALPHABET = [*"aabbcdeAS", ".", ",", "'", " ", "  ", "\n", "\n\n", "é", "É", "_", "1", "2", "-", "!", "\t", " ", "ß", "İ", "Σ", "’", "中", "́", "\x1c", "<|endoftext|>", "don't", "'s", "...", "\0", "▁", "ﬁ", "🙂", "<s>"]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET if i % 2 else ALPHABET[:14], k=rng.randint(0, 40))) for i in range(n)] + ["", "x" * 5000, " ", "\n"]


@pytest.fixture(scope="module")
def texts(duck):
    return {r[0]: r[1] for r in duck.sql("SELECT doc_id, text FROM documents").fetchall()}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_library(name, texts):
    k = cached(name)
    every = odd_texts(4000) + list(texts.values())
    assert [x for x, y in zip(every, k.encode(every), strict=True) if y != k.whole(x)] == []
    assert k.encode([None]) == [b""]


def test_small_cache_changes_nothing(monkeypatch, texts):
    from seriesloom.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 50)
    monkeypatch.setattr(tokens, "PART", 2000)
    monkeypatch.setattr(tokens.WordTable, "MOST", 100)
    monkeypatch.setattr(tokens.WordTable, "SLOTS", 64)
    k = tokens.CachedTokenizer("word_bpe_49k.json")
    some = list(texts.values())[:20]
    assert k.encode(some) == cached("word_bpe_49k.json").encode(some)


def test_counts_equal_the_library(texts):
    k = tokencounts.count_table(tokencounts.MODEL)
    every = odd_texts(4000, 2) + list(texts.values())
    assert k.by_word and [x for x, n in zip(every, k.counts(every), strict=True) if n != len(k.sp.encode(x))] == []
    assert all(len(k.sp.encode(w)) == 1 for w in list(k.single)[:500] if w)


def test_token_counts_query(spark, texts):
    k = tokencounts.count_table(tokencounts.MODEL)
    for r in tokencounts.op8_token_counts(spark, DATA).collect():
        n = len(k.sp.encode(texts[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 4096)


UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base_of(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    hits = [(i, label) for i in range(len(words)) for p, label in licenses.BASE.items() if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def rule_detections(text):
    """The method in plain Python: first rule at each first word, then containment."""
    words = re.findall(licenses.TOKEN, (text or "").lower())
    found = []
    for i, w in enumerate(words):
        ahead = " ".join(words[i : i + licenses.SPAN]) + " "
        for first, keyword, regex, label, priority, _ in licenses.rules():
            if first == w and keyword in words and (m := re.match(regex, ahead)):
                found.append((i, i + m[0].count(" "), label, priority))
                break
    return [d for d in found if not any(g[0] < d[0] and g[1] >= d[1] and g[3] >= d[3] for g in found)]


LICENSE_TEXTS = [
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.",
    "mit, license; MIT LICENSE\nmit  license", "SPDX-License-Identifier: LGPL-2.1", "GNU Lesser General Public License version 2.1 and the Mozilla Public License 2.0", "the mitt license", "İmit license", "", None, "All Rights Reserved. " * 50,
    "3-clause BSD license or new BSD", "Müller mit Lizenz", "general public general public license",
]


def test_licenses(spark, texts):
    rows = list(enumerate(LICENSE_TEXTS)) + [(1000 + i, t) for i, t in texts.items()]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base_of(text), text
        assert [(d["start"], d["end"], d["label"], d["priority"]) for d in r["detections"]] == rule_detections(text), text
        labels = sorted({x for x in base_of(text)[4].split(",") if x} | {d[2] for d in rule_detections(text)})
        assert r["labels"] == ",".join(labels) and 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(labels)
    assert got[3]["labels"] == "cc-by-nc" and got[5]["labels"] == "lgpl" and got[6]["labels"] == "gpl,lgpl-2.1,mpl-2.0"
    assert len(licenses.rules()) >= 200 and all(re.compile(r[2]) for r in licenses.rules())


def test_keywords_are_in_their_rules():
    """No rule can match where its keyword is missing."""
    for first, keyword, regex, *_ in licenses.rules():
        needed = re.sub(r"\(\?:[^()]*\)\?", "", regex.strip("^ "))
        while (shorter := re.sub(r"\(\?:[^()]*\)\?", "", needed)) != needed:
            needed = shorter
        assert keyword in re.sub(r"\(\?:[^()]*\)", " ", needed).split(), (first, keyword, regex)


def test_full_names_without_their_short_forms(spark):
    want = {
        "Common Development and Distribution License": "cddl", "European Union Public Licence": "eupl", "IBM Public License": "cpl", "Server Side Public License": "sspl", "zero-clause BSD": "0bsd",
        "SPDX-License-Identifier: MIT": "mit", "SPDX-License-Identifier: ISC": "isc", "SPDX-License-Identifier: EPL-2.0": "epl-2.0", "SPDX-License-Identifier: BSL-1.0": "bsl-1.0", "Licence: Zlib License": "zlib", "AGPLv3": "agpl-3.0",
    }
    got = licenses.scan(spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["labels"] for r in got] == list(want.values())


def counts_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = list(zip(words, words[1:], words[2:], strict=False))
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, texts):
    odd = ["", None, "a b c a b c a b", "a a a a", "a a a", "x\n\n x\nx\nx \n", "  \t\n", "é é é é é", "a|b " * 30, " x  x  x  x"]
    rows = list(enumerate(odd)) + [(1000 + i, t) for i, t in texts.items()]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        r, want = got[i], counts_of(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, text
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_quality_keeps_the_good(spark, duck):
    labels = dict(duck.sql("SELECT doc_id, quality FROM labels").fetchall())
    rows = [r for r in quality.op3_quality(spark, DATA).collect() if r["doc_id"] in labels and not r["base_failed"]]
    good, bad = ([r["kept"] for r in rows if labels[r["doc_id"]] == q] for q in (1, 0))
    assert all(good) and sum(bad) <= 0.2 * len(bad)


def votes_of(text):
    """The rules in plain Python: 0 bad, 1 none, 2 good."""
    n, chars, symbols, dup, again = counts_of(text)
    letters = [c for c in text if c.isalpha() and unicodedata.category(c)[0] == "L"]
    capitals = sum(unicodedata.category(c) == "Lu" for c in letters)
    lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in text.split("\n"))
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    bare = sum(not any(unicodedata.category(c)[0] in "LN" for c in w) for w in words)
    runs = len(re.findall(r"([#*$%&|<>=_~^+@/\\-])\1\1+", text))
    per = lambda a, b: a / max(b, 1)
    pairs = [
        (per(symbols, chars) < 0.005, per(symbols, chars) > 0.03), (per(runs, n) < 0.005, per(runs, n) > 0.05), (per(bare, n) < 0.02, per(bare, n) > 0.1),
        (per(len(letters), chars) > 0.93, per(len(letters), chars) < 0.88), (4.5 <= per(chars, n) <= 6.5, not 4.2 <= per(chars, n) <= 7),
        (per(dup, lines) < 0.05, per(dup, lines) > 0.15), (per(again, n) < 0.05, per(again, n) > 0.15), (per(n, lines) > 20, per(n, lines) < 12),
        (0.05 <= per(sum(text.count(c) for c in ".!?"), n) <= 0.15, not 0.03 <= per(sum(text.count(c) for c in ".!?"), n) <= 0.2),
        (0.01 <= per(capitals, len(letters)) <= 0.035, not 0.006 <= per(capitals, len(letters)) <= 0.045),
    ]
    return [0 if bad else 2 if good else 1 for good, bad in pairs]


def test_quality_verdict(spark):
    """Votes, fit and verdict end to end; every rule votes both ways on real documents."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    votes = {i: votes_of(t) for i, t in text.items() if counts_of(t)[0] >= 50 and 2 * counts_of(t)[4] <= counts_of(t)[0]}
    for j, name in enumerate(quality.RULES):
        assert {0, 2} <= {v[j] for v in votes.values()}, name
    model = quality.fit(list(Counter(sum(x * 3**j for j, x in enumerate(v)) for v in votes.values()).items()))
    want = {i for i, v in votes.items() if model.probability(v) >= quality.KEEP_AT}
    assert {r["doc_id"] for r in quality.judge(docs).collect() if r["kept"]} == want and 0 < len(want) < len(votes)


def test_expectation_maximisation():
    """Votes drawn from known rates give those rates back, and the column is the Python formula."""
    rng, n = random.Random(3), len(quality.RULES)
    drawn = Counter()
    for _ in range(6000):
        good = rng.random() < 0.8
        votes = [1 if rng.random() < 0.3 else 2 if rng.random() < (0.95 if good else 0.45) else 0 for _ in range(n)]
        drawn[sum(v * 3**j for j, v in enumerate(votes))] += 1
    model = quality.fit(list(drawn.items()))
    assert abs(model.prior - 0.8) < 0.05 and all(abs(a - 0.95) < 0.03 for a in model.right_good) and all(abs(b - 0.55) < 0.1 for b in model.right_bad)
    assert quality.fit([]) == quality.LabelModel()


def test_posterior_column(spark):
    from pyspark.sql import functions as F

    model = quality.LabelModel()
    for r in spark.range(0, 3 ** len(quality.RULES), 2999).select("id", model.posterior(F.col("id")).alias("p")).collect():
        assert abs(r["p"] - model.probability(quality.digits(r["id"]))) < 1e-12


LONG = ("running text of an article " * 9).strip()


@pytest.mark.parametrize(
    "page,want",
    [
        ("<html><body><nav><ul><li><a href=x>Home</a></li></ul></nav><div class=\"ad\">Buy</div><article><h1>T &amp; t</h1><p><b>One<br>two.<p>Three</p></article><footer>&copy; x</footer>", "T & t\nOne two.\nThree"),
        ("<article><p>a<script>var t='</p>';</script>b</p><section class='reader-comments'><p>no</p></section><form><p>no</p></form><p>c</p></article>", "ab\nc"),
        ("<body><div id=sidebar><p>" + "side " * 60 + "</p></div><p>" + "long text " * 20 + "</p><p>end.</p><ul class='menu'><li><a href=x>m</a></li></ul><div class='cookie-notice'>ok</div></body>", ("long text " * 20).strip() + "\nend."),
        ("<div class='ad'>unclosed <article><p>kept</p></article>", "kept"),
        ("<article><!-- open comment <p>x</p>", ""),
        ("<article><p>cut <b>off</b> <a hre", "cut off"),
        ("plain", "plain"),
        ("", ""),
        (None, ""),
        ("<article><p>&#233;&nbsp;&lt;b&gt; x</p><p> </p><p>x\n\ty</p></article>", "é <b> x\nx y"),
        (f"<article><p class='ad'>Buy now</p><p>{LONG}</p><li class=promo>x</li><p>a<button>Go</button> b<label>L</label></p></article>", f"{LONG}\na b"),
        (f"<article><section class='market share'><p>{LONG}</p></section><section id='notice-periods'><p>Short.</p></section></article>", f"{LONG}\nShort."),
        (f"<article data-id='related' class='post category-social'><p>{LONG}</p></article>", LONG),
        (f"<body class='has-sidebar cookie consent'><div><p>{LONG}</p><p>end</p></div></body>", f"{LONG}\nend"),
        (f"<article><p>{LONG}</p></article><article class=teaser><p>More to read here.</p></article>", LONG),
        (f"<div><p>{LONG}</p><p>{LONG}</p></div><article><p>Teaser one</p></article><article><p>Teaser two</p></article>", f"{LONG}\n{LONG}"),
        (f"<main><ul>{'<li><a href=x>link to it</a></li>' * 9}</ul><p>{LONG}</p><p>end</p></main>", f"{LONG}\nend"),
        (f"<article><p>{LONG}</p><div class=ad>x</div><div class=ad>x</div><div class=ad>x</div><p>Last words.</p></article><p>Stray words.</p>", f"{LONG}\nLast words."),
        (f"<div class=widget><p>{LONG}</p></div><div class=widget>small</div>", LONG),
    ],
)
def test_main_text(page, want):
    assert htmltext.main_text(page) == want


def test_the_sums_decide_every_page(spark, duck, monkeypatch):
    calls = []
    real = htmltext.between
    monkeypatch.setattr(htmltext, "between", lambda *a: calls.append(a) or real(*a))
    pages = [r[0] for r in duck.sql("SELECT html FROM pages").fetchall()]
    for page in pages:
        htmltext.main_text(page)
    assert len(calls) == len(pages)
    monkeypatch.setattr(htmltext, "between", lambda lengths: [])
    assert not any(map(htmltext.main_text, pages))


def test_long_and_empty_pages(spark):
    long = "<article>" + "".join(f"<p>{LONG} {i}</p>" for i in range(20_000)) + "<p>" + "y" * 2_000_000 + "</p></article>"
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = htmltext.extracted(spark.createDataFrame([(1, "u", long, "t", 0), (1, "u", long, "t", 0)], schema)).collect()
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0]["text"].count("\n") == 20_000 and rows[0]["text"].endswith("y" * 2_000_000)
    assert htmltext.extracted(spark.createDataFrame([], schema)).collect() == []


def test_line_blocks():
    assert htmltext.between([5, 0, 0, 0, 90, 40, 0, 60, 0, 0, 0, 3]) == [(4, 8)]
    assert htmltext.between([3, 2]) == [(0, 2)] and htmltext.between([]) == []


def test_pages_query(spark, duck):
    pages = {r[0]: r[1] for r in duck.sql("SELECT page_id, html FROM pages").fetchall()}
    for r in htmltext.op4_html_text(spark, DATA).collect():
        inside = pages[r["page_id"]].split("<article>")[1].split("</article>")[0]
        import html

        blocks = [html.unescape(re.sub(r"\s+", " ", re.sub(r"</?b>|<br>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", inside)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])
