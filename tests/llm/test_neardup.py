import random

import numpy as np
import pytest

from basket_engine.llm import neardup
from basket_engine.llm.graph import components as graph_components
from basket_engine.llm.neardup import BUCKETS, band_keys, likeness, near_duplicates, registers
from basket_engine.llm.wordhash import WordHasher, shingles, text_buffers

from .data import components, edge_rows, edge_table, kept_texts, near_copies, sentence, spaced_words, table

import pyarrow as pa


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect() if r["kept"] == (r["doc_id"] == r["component_id"])}


@pytest.mark.parametrize("size", [4, 5])
def test_like_all_pairs(spark, size):
    rng = random.Random(size)
    texts = [sentence(rng, rng.randint(3, 90)) for _ in range(30)]
    for base in (sentence(rng, 150), sentence(rng, 60), sentence(rng, 12)):
        texts += near_copies(rng, base, 25, 0.12) + [base, base.upper(), base.replace(" ", "\n")]
    rng.shuffle(texts)
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    expected = components(dict(enumerate(texts)), size)
    assert len({c for _, c in expected.values()}) < 100
    assert found(near_duplicates(table(spark, rows), shingle=size)) == expected


def test_edges_and_empty(spark):
    assert found(near_duplicates(edge_table(spark))) == components(kept_texts(edge_rows()), 5)
    assert found(near_duplicates(table(spark, []))) == {}


def test_words_across_blocks():
    texts = [None, "", "one two", "x" * 700, sentence(random.Random(1), 400), " lead and trail \n", "Ä ß"]
    data, offsets = text_buffers(pa.array(texts))
    whole = WordHasher().words(data, offsets)
    parts = WordHasher(block=64).words(data, offsets)
    assert all((a == b).all() for a, b in zip(whole, parts))
    assert np.bincount(whole[1], minlength=len(texts)).tolist() == [len(spaced_words(t)) for t in texts]
    h, doc = shingles(*whole, 4)
    assert np.bincount(doc, minlength=len(texts)).tolist() == [0, 0, 1, 1, 397, 1, 1]


def test_estimates_follow_similarity():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    errors = []
    for share in (0.2, 0.5, 0.8, 0.95):
        n = int(2000 * share)
        rest = rng.integers(0, 1 << 63, 2 * (2000 - n), dtype=np.uint64)
        a, b = np.r_[common[:n], rest[: 2000 - n]], np.r_[common[:n], rest[2000 - n :]]
        size, _, _, regs = registers(np.r_[a, b], np.repeat([0, 1], 2000), 2)
        errors.append(abs(likeness(regs[:1], regs[1:], size[:1], size[1:])[0] - n / (4000 - n)))
    assert max(errors) < 0.12


def test_registers_keep_leading_zeros_and_bits():
    hashes = np.array([5 << 40, 9 << 50, 9 << 50], np.uint64)
    size, one, two, regs = registers(hashes, np.zeros(3, int), 1)
    assert size.tolist() == [2] and regs.shape == (1, BUCKETS) and (regs > 0).sum() in (1, 2)
    assert (band_keys(regs) == band_keys(regs.copy())).all()


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 3), (20, 21), (21, 20), (5, 5), *[(i, i + 1) for i in range(100, 140)]], "a long, b long")
    got = {r["node"]: r["component"] for r in graph_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 20: 20, 21: 20, **{i: 100 for i in range(100, 141)}}
    assert graph_components(edges.limit(0)).count() == 0


def recorded(monkeypatch):
    """Rows of the stages that hold pairs, by label."""
    rows, plain = {}, neardup.stored

    def stored(df, label="stage"):
        out = plain(df, label)
        if label in ("near", "centre-pairs", "across"):
            rows[label] = out.count()
        return out

    monkeypatch.setattr(neardup, "stored", stored)
    return rows


def test_unlike_documents_of_one_bucket_are_not_paired(spark, monkeypatch):
    """Thousands of documents share a passage, too little to be linked, and so their buckets."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    passage = sentence(rng, 60)
    texts = [passage + " " + " ".join(rng.choice(words) for _ in range(60)) for _ in range(2000)]
    texts += near_copies(rng, texts[7], 20, 0.03) + near_copies(rng, texts[9], 20, 0.03) + [texts[11]] * 30
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    pairs = recorded(monkeypatch)
    got = found(near_duplicates(table(spark, rows)))
    group = {7: [7, *range(2000, 2020)], 9: [9, *range(2020, 2040)], 11: [11, *range(2040, 2070)]}
    for members in group.values():
        assert {c for _, c in components({i: texts[i] for i in members}, 5).values()} == {got[i][1] for i in members}
    alone = set(range(2000)) - set(group)
    assert all(got[i][1] == i for i in alone)
    assert set(pairs) == {"near", "centre-pairs", "across"} and max(pairs.values()) < 3 * len(texts)


@pytest.mark.parametrize("size", [4, 5])
def test_chains_between_centres(spark, monkeypatch, size):
    """Links that only the last step finds: no document counts as near its centre."""
    monkeypatch.setattr(neardup, "CENTRE", 2.0)
    monkeypatch.setattr(neardup, "ROUNDS", 0)
    rng = random.Random(size)
    texts = [sentence(rng, rng.randint(3, 90)) for _ in range(30)]
    for base in (sentence(rng, 150), sentence(rng, 60), sentence(rng, 12)):
        texts += near_copies(rng, base, 25, 0.12)
    pairs = recorded(monkeypatch)
    assert found(near_duplicates(table(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)]), shingle=size)) == components(dict(enumerate(texts)), size)
    assert pairs["near"] == 0 and pairs["across"] > 0


def join_rows(df):
    """Rows that each join of a plan made; runs it."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.collectToPython()
    made, todo = [], [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if "Join" in name:
            made.append(node.metrics().apply("numOutputRows").value())
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(node.plan())
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return made


def test_documents_meet_only_the_centres_of_their_shingles(spark, monkeypatch):
    """Documents of several centres share a passage, and each some phrase with two others only."""
    rng = random.Random(8)
    passage, n = sentence(rng, 100), 200
    own = [[f"u{i}x{j}" for j in range(8)] for i in range(n)]
    for k in range(n):
        phrase = [f"p{k}x{j}" for j in range(14)]
        for i in rng.sample(range(n), 2):
            own[i] += phrase
    texts = [passage + " " + " ".join(words) for words in own]
    texts += near_copies(rng, texts[5], 10, 0.03)
    counted, plain = {}, neardup.stored

    def stored(df, label="stage"):
        if label == "across":
            counted["joins"] = join_rows(df)
        out = plain(df, label)
        if label in ("shared-shingles", "close-centres"):
            counted[label] = out.count()
        return out

    monkeypatch.setattr(neardup, "stored", stored)
    emptied = "spark.sql.adaptive.optimizer.excludedRules"  # a plan without rows would not show its joins
    spark.conf.set(emptied, "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation")
    try:
        got = found(near_duplicates(table(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])))
    finally:
        spark.conf.unset(emptied)
    assert got == components(dict(enumerate(texts)), 5)
    assert counted["close-centres"] > 1 and len(counted["joins"]) >= 2
    assert max(counted["joins"]) <= counted["shared-shingles"], counted


def test_prefixes_hold_a_shared_element():
    rng = np.random.default_rng(6)
    counts = rng.integers(0, 3, neardup.CELLS)
    for _ in range(3000):
        percent = int(rng.choice([60, 80, 95]))
        z, a, o = (np.unique(np.r_[np.arange(60)[rng.random(60) < rng.choice([0.9, 0.97])], rng.integers(100, 400, rng.integers(0, 12))]).astype(np.uint64) for _ in range(3))
        if rng.random() < 0.7:
            o = np.unique(np.r_[a[rng.random(len(a)) < 0.95], rng.integers(500, 600, rng.integers(0, 4)).astype(np.uint64)])
        linked = lambda x, y: neardup._linked(len(np.intersect1d(x, y)), len(x), len(y), percent)
        if not linked(a, o) or linked(a, z) and linked(o, z) or not len(a):
            continue
        heads = []
        for x in (a, o):
            own = np.setxor1d(x, z)
            order = np.lexsort((own, counts[neardup._cells(5, own)]))
            heads.append(set(own[order[: neardup.difference_prefix(len(x), len(own), len(z), linked(x, z), percent)]].tolist()))
        assert heads[0] & heads[1]
        rare = []
        for x in (a, o):
            order = np.lexsort((x, counts[neardup._cells(0, x)]))
            rare.append(set(x[order[: len(x) - -(-percent * len(x) // 100) + 1]].tolist()))
        assert rare[0] & rare[1]
