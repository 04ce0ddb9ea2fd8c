"""Token files, neighbours, near-duplicates, packing, mixing, sharding, the pipeline: brute force."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from seriesloom.llm import htmltext, licenses, mixing, neighbours, packing, quality, rans, sharding, simhash, tokencounts, tokenfiles
from seriesloom.llm.tokens import cached
from seriesloom.shared import own_path
from tests.conftest import DATA, same_rows
from tests.llm.test_overlap import kept_ids


@pytest.fixture(scope="module")
def texts(duck):
    return {r[0]: r[1] for r in duck.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=400), st.integers(0, 3))
def test_rans_round_trip(ids, times):
    ids = np.array(ids * 10**times, "<u4")
    table = rans.Table(np.bincount(ids, minlength=1))
    assert (rans.decode(rans.encode(ids, table), table) == ids).all()


def test_rans_blocks_and_checksums():
    ids = np.minimum(np.random.default_rng(1).zipf(1.3, 3 * rans.BLOCK + 7) - 1, 50_000).astype("<u4")
    table = rans.Table(np.bincount(ids))
    assert (rans.Table.from_bytes(table.to_bytes()).freq == table.freq).all()
    data = bytearray(rans.encode(ids, table))
    assert len(data) < 2 * len(ids) and (rans.decode(bytes(data), table) == ids).all()
    data[-5] ^= 1
    with pytest.raises(ValueError):
        rans.decode(bytes(data), table)
    with pytest.raises(ValueError):
        rans.encode(np.array([60_000], "<u4"), table)


def test_token_files(spark, texts):
    got = {r["doc_id"]: tuple(r)[1:] for r in tokenfiles.op2_token_files(spark, DATA).collect()}
    at = 0
    for i, text in texts.items():
        ids = cached(tokenfiles.MODEL).whole(text) + bytes(4)
        assert got[i] == (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
    assert len(got) == len(texts)


def packed(counts, capacity):
    """Best-fit decreasing, piece by piece: the rooms left."""
    rooms = []
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            fit = [b for b, r in enumerate(rooms) if r >= size]
            if fit:
                rooms[min(fit, key=lambda b: rooms[b])] -= size
            else:
                rooms.append(capacity - size)
    return sorted(rooms)


def test_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(200):
        capacity = rng.randint(1, 40)
        counts = {rng.randint(1, capacity): rng.randint(1, 30) for _ in range(rng.randint(0, 8))}
        plan, fill = packing.best_fit_decreasing(counts, capacity).tolist(), {}
        for size, n in counts.items():
            rows = sorted(r for r in plan if r[0] == size)
            for k in range(n):
                r = [x for x in rows if x[1] <= k][-1]
                fill.setdefault(r[2] + (k - r[1]) // r[3], []).append((r[4] + (k - r[1]) % r[3] * size, size))
        for held in fill.values():
            for (a, n), (b, _) in itertools.pairwise(sorted(held)):
                assert a + n == b
        assert sorted(capacity - sum(n for _, n in held) for held in fill.values()) == packed(counts, capacity)


def check_packed(rows, texts, rounds=None):
    """Pieces are those of the texts and lie in their sequences without gap or overlap."""
    want = Counter()
    for i, text in texts.items():
        ids = cached(packing.MODEL).whole(text or "") + bytes(4)
        for p, at in enumerate(range(0, len(ids), 4 * 2048)):
            own = ids[at : at + 4 * 2048]
            want[i, p, at // 4, len(own) // 4, zlib.crc32(own)] += rounds[i] if rounds else 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == +want
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in sequences.values():
        held.sort()
        assert held[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(held)) and sum(held[-1]) <= 2048
    assert len(sequences) == len(packed(Counter(r["length"] for r in rows), 2048))


def test_packing(spark, texts):
    check_packed(packing.op7_packing(spark, DATA).collect(), texts)


@pytest.mark.parametrize("scale, blocks", [(None, (65_536, 65_536)), (1.0, (97, 7)), (1e6, (200, 25))])
def test_neighbours(spark, duck, monkeypatch, scale, blocks):
    monkeypatch.setattr(neighbours, "INDEX_BLOCK", blocks[0])
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", blocks[1])
    rows = duck.sql("SELECT vec_id, embedding FROM embeddings").fetchall()
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x * (scale or f))) for x in v]) for (i, v), f in zip(rows, rng.uniform(0.2, 3, len(rows)), strict=True)]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    got = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = total = 0
    for q in ids[ids % 20 == 0].tolist():
        found = sorted(got[q])
        own = x[ids == q][0]
        score = dict(zip(ids.tolist(), neighbours.scores_of(x, np.broadcast_to(own, x.shape)), strict=True))
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(score[i] == s for _, i, s in found)
        assert found == [(n + 1, i, s) for n, (i, s) in enumerate(sorted(((i, s) for _, i, s in found), key=lambda y: (-y[1], y[0])))]
        best = sorted((i for i in score if i != q), key=lambda i: (-score[i], i))[:20]
        hit, total = hit + len(set(best) & {i for _, i, _ in found}), total + 20
    assert hit / total >= 0.9


def test_neighbours_edges(spark):
    nan = float("nan")
    v = [(20, [1.0, 2.0]), (40, [1.0, 2.0]), (None, [0.5, 0.5]), (1, [1.0, 2.0]), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, None), (5, [1.0]), (6, [None, 1.0]), (7, [float("inf"), 0.0])]
    got = [tuple(r) for r in neighbours.nearest(spark.createDataFrame(v, "vec_id long, embedding array<float>"), 20).orderBy("query_id", "rank").collect()]
    assert got == [(20, 1, 1, 5.0), (20, 2, 40, 5.0), (20, 3, None, 1.5), (40, 1, 1, 5.0), (40, 2, 20, 5.0), (40, 3, None, 1.5)]
    odd = spark.createDataFrame([(*r, 1, 2, "x", True) for r in v], "vec_id long, embedding array<float>, row int, part int, v string, asks boolean")
    assert sorted(tuple(r) for r in neighbours.nearest(odd, 20).collect()) == sorted(got, key=lambda r: r[:2])
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), 20).count() == 0


def classes(prints, bits):
    links = simhash.Links(len(prints))
    links.join(*np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= bits))
    return links.of


@pytest.mark.parametrize("bits", [0, 2, 4, 6])
def test_tries(bits):
    rng = np.random.default_rng(bits)
    for _ in range(6):
        values = []
        for base in rng.integers(0, 1 << 63, 40, dtype=np.uint64):
            for _ in range(rng.integers(1, 25)):
                x = int(base)
                for p in rng.integers(0, 64, rng.integers(0, bits + 4)):
                    x ^= 1 << int(p)
                values.append(x)
        v, links = np.unique(np.array(values, np.uint64)), None
        links, masks = simhash.Links(len(v)), simhash.block_masks(bits)
        for a, b in itertools.combinations(masks, 2):
            mask = a | b
            key, code = simhash.squeezed(v, mask), simhash.squeezed(v, ~mask & (1 << 64) - 1)
            o = np.lexsort((code, key))
            simhash.trie_links(key[o], code[o], np.arange(len(v))[o], 64 - mask.bit_count(), bits, links)
        assert (links.of == classes(v, bits)).all()


def plain_fingerprint(text):
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    runs = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(texts):
    for t in [None, "", " \t", "A b", "a B c d", "É x y z Ü", *list(texts.values())[:20]]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_near_duplicates(spark, texts):
    rows = [(i, t) for i, t in texts.items()] + [(10_000 + i, f"{t} z{i % 3}") for i, t in list(texts.items())[:60]] + [(20_000, None), (20_001, "")]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ids = sorted(i for i, _ in rows)
    text = dict(rows)
    prints = np.array([simhash.fingerprint(text[i]) for i in ids], np.uint64)
    root = classes(prints, 4)
    assert [(got[i]["fingerprint"], got[i]["component_id"]) for i in ids] == [(f"{p:016x}", ids[r]) for p, r in zip(prints.tolist(), root, strict=True)]


def test_connected(spark):
    rng = random.Random(5)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    want = simhash.Links(2000)
    want.join(*map(np.array, zip(*pairs, strict=True)))
    got = {r["node"]: r["root"] for r in simhash.connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: int(want.of[i]) for i in range(2000) if want.of[i] != i}


def test_mixing(spark, duck):
    same_rows(mixing.op9_mixing(spark, DATA).toPandas(), duck.sql(mixing.OP9_SQL).df())


def test_mixing_meets_targets(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["a", "a", "a", "a", "b", "c", None])) for i in range(600)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas().merge(__import__("pandas").DataFrame(rows, columns=["doc_id", "text", "source"]))
    total = got["size"].sum()
    for _, g in got.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= max(10, 0.01 * g.target.iloc[0]) and g.target.iloc[0] <= 2 * g.source_size.iloc[0]
    assert (got.taken <= 2 * got["size"]).all() and abs(got.groupby("source", dropna=False).target.first().sum() - 1.5 * total) < 1e-6


def test_mixing_splits_ties(spark):
    """Equal rows are taken as often as they fit: a source of copies comes within one of them."""
    rows = [(1, "w " * 10, "a", i) for i in range(300)] + [(2 + i, "v " * 7, "b", i) for i in range(50)] + [(1, "w " * 10, "c", i) for i in range(40)] + [(None, None, "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mine long").repartition(5)
    got = mixing.mix(docs).toPandas()
    for size, g in got[got["size"] > 0].groupby("source_size"):
        assert 0 <= round(g.target.iloc[0]) - g.taken.sum() < g["size"].max() and (g.taken <= 2 * g["size"]).all(), size
    taken = got.groupby("source_size").times.sum().to_dict()
    mixed = Counter(r["source"] for r in mixing.mixed(docs).collect() if r["text"])
    assert mixed == {"a": taken[3000], "b": mixed["b"], "c": taken[400]} and 0 < taken[3000] % 300


def test_permutation(spark):
    for n in (1, 2, 3, 7, 64, 65, 1000):
        size = F.lit(n).cast("long")
        rows = spark.range(n).select("id", sharding.permuted(F.col("id"), size).alias("y")).withColumn("x", sharding.unpermuted(F.col("y"), size)).collect()
        assert sorted(r["y"] for r in rows) == list(range(n)) and all(r["id"] == r["x"] for r in rows)


def test_sharding(spark, texts):
    rows = sharding.op10_sharding(spark, DATA).collect()
    for r in rows:
        t = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 1, zlib.crc32(t), "rows", None)
    assert sorted((r["shard"], r["slot"]) for r in rows) == sorted((i % 8, i // 8) for i in range(len(texts)))
    assert sorted(map(tuple, rows)) == sorted(map(tuple, sharding.op10_sharding(spark, DATA).collect()))


ODD = [
    (1, "hello mit license there. " * 40), (2**60 + 1, None), (None, "x " * 300), (None, None), (4, ""), (5, "w" * 100_000), (5, "w" * 100_000),
    (6, "The quick brown fox. " * 3000), (7, "A b c"),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, `_row` string, `_f` string, `print` string, `a.b` string"


def odd_documents(spark, empty=False):
    rows = [(i, t, "en", None if k % 3 == 0 else "ab"[k % 2], 1, 0, "x", "y", "z", "q") for k, (i, t) in enumerate([] if empty else ODD)]
    return spark.createDataFrame(rows, COLUMNS)


OPERATORS = [licenses.scan, quality.judge, simhash.near_duplicates, packing.pack, tokencounts.token_counts, mixing.mix, sharding.shard]


@pytest.mark.parametrize("operator", OPERATORS, ids=lambda f: f.__name__)
def test_odd_rows(spark, operator):
    rows = operator(odd_documents(spark)).collect()
    ids = Counter(r["doc_id"] for r in rows)
    assert set(ids) == {i for i, _ in ODD} and (operator is packing.pack or ids == Counter(i for i, _ in ODD))
    assert operator(odd_documents(spark, True)).collect() == []


def test_odd_token_files(spark):
    path = own_path(spark, "test")
    tokenfiles.write_tokens(odd_documents(spark), path)
    rows = tokenfiles.read_tokens(spark, path, with_ids=True).orderBy("start").collect()
    order = [r["doc_id"] for r in rows]
    assert order == [None, None, 1, 4, 5, 5, 6, 7, 2**60 + 1] and [r["start"] for r in rows] == [0, *itertools.accumulate(r["n_tokens"] for r in rows)][:-1]
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and r["ids"][-1] == 0 for r in rows)
    tokenfiles.write_tokens(odd_documents(spark, True), path + "-empty")
    assert tokenfiles.read_tokens(spark, path + "-empty").count() == 0


def test_odd_filters_keep_columns(spark):
    for f in (quality.accepted, simhash.deduplicated, mixing.mixed):
        assert f(odd_documents(spark)).columns == odd_documents(spark).columns
        assert f(odd_documents(spark, True)).count() == 0
    kept = [r["doc_id"] for r in simhash.deduplicated(odd_documents(spark)).collect()]
    assert Counter(kept) == Counter([1, None, 4, 5, 6, 7])
    pages = spark.createDataFrame([(None, None, None, "t"), (1, "u", "<p>x</p>", "t")], "page_id long, url string, html string, text string")
    assert [tuple(r) for r in htmltext.extracted(pages).collect()] == [(None, None, "", 0), (1, "u", "x", 1)]


def test_pipeline_against_brute_force(spark):
    """Every stage on all that its predecessor kept, each held against plain Python."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = docs.columns
    (_, rules), (_, dedup), (_, mix), (_, pack) = corpus_pipeline.STAGES
    good = {r["doc_id"] for r in quality.judge(docs).collect() if r["kept"]}
    one = rules(spark, docs, DATA)
    assert one.columns == names and {r["doc_id"] for r in one.collect()} == good and one.count() == len(good)

    two = dedup(spark, one, DATA)
    text = {r["doc_id"]: r["text"] for r in one.collect()}
    assert two.columns == names and sorted(r["doc_id"] for r in two.collect()) == kept_ids(list(text.items()))

    three = mix(spark, two, DATA)
    times = {r["doc_id"]: r["times"] for r in mixing.mix(two).collect()}
    rounds = Counter(r["doc_id"] for r in three.collect())
    assert three.columns == names and rounds == +Counter(times)

    final = corpus_pipeline.run(spark, DATA).collect()
    check_packed(final, {i: text[i] for i in rounds}, rounds)


def test_queries_are_registered():
    names = entry.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()} == set(range(1, 11)) and "pipeline" in names
    assert "op9_mixing" in entry.oracle_sql()
