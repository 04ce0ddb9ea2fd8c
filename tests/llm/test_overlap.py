"""The pipeline's near-duplicates against all pairs in plain Python."""

import time
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from seriesloom.llm import overlap, quality, wordhash
from tests.conftest import DATA


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept_ids(rows):
    """The least id of each class of rows (id, text) of similarity 0.8 or more."""
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    of = {i: i for i in ids}
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if of[a] != of[b] and 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
                lo, hi = sorted((of[a], of[b]))
                of = {i: lo if r == hi else r for i, r in of.items()}
    return sorted(set(of.values()))


def group(n, words, gap):
    """n texts of the same words, each with a few of its own at other places."""
    return [" ".join(f"own{k}x{i}" if i % gap == k % gap and i // gap % 3 == k % 3 else f"w{i}" for i in range(words)) for k in range(n)]


@pytest.mark.parametrize("few, part, held", [(32, 1 << 14, 1 << 26), (2, 1 << 14, 2000), (2, 5, 1 << 26)])
def test_exact_similarity(spark, monkeypatch, few, part, held):
    monkeypatch.setattr(overlap, "FEW", few)
    monkeypatch.setattr(overlap, "PART", part)
    monkeypatch.setattr(overlap, "HELD", held)
    docs = quality.accepted(spark.read.parquet(f"{DATA}/documents.parquet")).select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    line = "this very common line stands in nearly all of the texts here"
    made = group(40, 300, 100) + group(40, 300, 60) + [f"{line} " + " ".join(f"a{k}b{i}" for i in range(40)) for k in range(50)] + ["", " ", "A b", "a B", "a c"]
    rows += [(10_000 + i, t) for i, t in enumerate(made)]
    got = corpus_pipeline.dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in got.collect()) == kept_ids(rows)


def test_dense_groups_give_their_size():
    """Texts of classes of their own, just below and above the least similarity: the pairs given on are links and connect
    the texts as all links do, each joining two classes; also where two parts of a group meet."""
    random, texts = np.random.default_rng(5), group(40, 300, 100)
    for k in range(40):
        own = {298, *(int(x) for x in 5 * random.integers(1, 58, 3))}
        texts.append(" ".join(f"own{k}x{i}" if i in own else f"v{i}" for i in range(300)))
    sets, none = wordhash.sets(texts, 5), (np.empty(0, np.uint64), np.empty(0, np.int64))
    for part in (lambda k: None, lambda k: k % 2):
        of = list(range(80))
        links = [(a, b) for a in range(80) for b in range(a) if (part(a) is None or part(a) != part(b)) and overlap.similar(sets[a], sets[b], 0.8)]
        for a, b in links:
            of = [of[b] if x == of[a] else x for x in of]
        got = overlap.spanning([(len(s), k, 1000 + k, part(k), s) for k, s in enumerate(sets)], none, 0.8)
        found = list(range(80))
        for a, b in got.itertuples(index=False):
            assert (max(a, b), min(a, b)) in links and found[a] != found[b]
            found = [found[b] if x == found[a] else x for x in found]
        assert len(got) < 80 < len(links) and len(got) == 80 - len(set(of)) == 80 - len(set(found))
    assert overlap.spanning([(len(s), k, 0, None, s) for k, s in enumerate(sets)], none, 0.8).empty


def test_odd_rows(spark):
    rows = [(None, "x " * 300), (None, None), (4, ""), (5, "w y z"), (5, "w y z"), (6, "x " * 300)]
    for some, want in ((rows, [4, 5, 6]), ([], [])):
        got = corpus_pipeline.dedup_stage(spark, spark.createDataFrame([(*r, 1) for r in some], "doc_id long, text string, `print` int"), "")
        assert got.columns == ["doc_id", "text", "print"] and sorted(r["doc_id"] for r in got.collect()) == want


def test_word_hashes(monkeypatch, texts=("", None, "a", "A", " a\t", "ab", "a b", "b a", "a b c d e f", "A  b\nc d e\x0bf", "\u00c4 \u00e4", "x " * 3000, "y" * 5000)):
    """Equal words, runs and wholes, and no others, have equal hashes, alone or in a batch, in short stretches too."""
    want = [tuple((t or "").encode().lower().split()) for t in texts]
    for chunk in (1 << 20, 16):
        monkeypatch.setattr(wordhash, "CHUNK", chunk)
        found, at = wordhash.words(texts)
        assert [tuple(found[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)] == [tuple(wordhash.words([t])[0]) for t in texts]
        whole = wordhash.wholes(found, at).tolist()
        assert all((whole[i] == whole[j]) == (want[i] == want[j]) for i in range(len(texts)) for j in range(len(texts)))
        sets = wordhash.sets(texts, 5)
        assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
        runs, bounds = wordhash.shingles(found, at, 5)
        bits = [int(2 * sum((int(h) >> b) & 1 for h in runs[x:y]) > y - x) << b for x, y in zip(bounds[:-1], bounds[1:], strict=True) for b in range(64)]
        assert wordhash.majorities(runs, bounds).tolist() == [sum(bits[64 * i : 64 * i + 64]) for i in range(len(texts))]
    assert wordhash.sets([], 5) == [] and not len(wordhash.words([])[0]) and (np.diff(wordhash.words([])[1]) == 0).all()


def test_texts_stay_where_more_rows_than_one_send_pick_them(spark, monkeypatch):
    """The limit of rows to send is crossed in all joins: no join moves texts, and the result is the same."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").repartition(3)
    want = sorted(r["doc_id"] for r in corpus_pipeline.dedup_stage(spark, docs, "").collect())
    monkeypatch.setattr(overlap, "SENT", 5)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = corpus_pipeline.dedup_stage(spark, docs, "")
        assert sorted(r["doc_id"] for r in got.collect()) == want and len(want) < docs.count()
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_shuffle_files_go_with_their_query(spark, monkeypatch):
    """Also where the JVM doesn't collect."""
    monkeypatch.setattr(overlap, "release", lambda _: None)
    spark._jvm.System.gc()
    time.sleep(2)
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {p.name for d in folders for p in Path(d).rglob("shuffle_*.data")}
    before = files()
    corpus_pipeline.dedup_stage(spark, spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text"), "")
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before
