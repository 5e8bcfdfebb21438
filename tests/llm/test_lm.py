import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basket_engine.llm import ngram_lm
from basket_engine.llm.ngram_lm import MappedTable, Speller, Tokens, language_model_scores
from basket_engine.llm.quality import discounts

from .data import edge_rows, edge_table, kept_texts, sentence, spaced_words, table


def spelled(text, order):
    own = " ".join(spaced_words(text)).encode().translate(bytes([0x1A] * 3 + list(range(3, 256)))) + b"\x02"
    padded = b"\x01" * (order - 1) + own
    return [padded[i : i + order] for i in range(len(own))]


def brute_force_model(texts, order):
    """log10 p(n-gram's last byte) of interpolated modified Kneser-Ney, from its definition."""
    counts = {order: Counter(g for t in texts for g in spelled(t, order))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    d = {k: discounts(Counter(counts[k].values())) for k in counts}
    total, held = defaultdict(int), defaultdict(float)
    for k in counts:
        for g, c in counts[k].items():
            total[k, g[:-1]] += c
            held[k, g[:-1]] += d[k][min(c, 3) - 1]

    def p(g):
        k = len(g)
        if not k:
            return 1 / 256
        below = p(g[1:])
        if (k, g[:-1]) not in total:
            return below
        c = counts[k].get(g, 0)
        return (max(c - d[k][min(c, 3) - 1], 0) if c else 0) / total[k, g[:-1]] + held[k, g[:-1]] / total[k, g[:-1]] * below

    return p


def tokens(text):
    return [*spaced_words(text), None]  # the end


def word_model(train, order):
    """p(token | token before) of interpolated modified Kneser-Ney over pairs, lower orders and spelling."""
    pairs = Counter(p for t in train for p in zip([0, *tokens(t)], tokens(t)))
    follows, before, after = Counter(w for _, w in pairs), Counter(), defaultdict(list)
    for (v, w), c in pairs.items():
        before[v] += c
        after[v].append(c)
    d2, d1 = discounts(Counter(pairs.values())), discounts(Counter(follows.values()))
    letters = brute_force_model([w or "" for t in train for w in tokens(t)], order)
    unseen = sum(d1[min(c, 3) - 1] for c in follows.values()) / len(pairs) if pairs else 1.0

    def low(w):
        spelling = math.prod(letters(g) for g in spelled(w or "", order))
        return (max(follows[w] - d1[min(follows[w], 3) - 1], 0) / len(pairs) if w in follows else 0) + unseen * spelling

    def p(v, w):
        if v not in before:
            return low(w)
        c = pairs.get((v, w), 0)
        gamma = sum(d2[min(x, 3) - 1] for x in after[v]) / before[v]
        return (max(c - d2[min(c, 3) - 1], 0) / before[v] if c else 0) + gamma * low(w)

    return p


def expected(texts, held_out, order):
    train = [t for k, t in texts.items() if not held_out(k)]
    p = word_model(train, order)
    words = Counter(w for t in train for w in tokens(t))
    n, v = sum(words.values()), len(words)
    out = {}
    for k, t in texts.items():
        own = tokens(t)
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in own)
        score = sum(math.log10(p(a, b)) for a, b in zip([0, *own], own))
        out[k] = (len(own), sum(words[w] > 0 for w in own), n, base, score)
    return out


def check(df, want, held_out):
    rows = df.collect()
    assert {r["doc_id"] for r in rows} == set(want) and len(rows) == len(want)
    for r in rows:
        n, known, tokens, base, score = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, tokens, held_out(r["doc_id"]))
        assert math.isclose(r["base_score"], base, rel_tol=1e-9, abs_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-6, abs_tol=1e-6)


@pytest.mark.parametrize("order, gathered, shard, text, many", [(4, 1 << 21, 32 << 20, 2 << 20, 255), (4, 50, 300, 400, 3), (6, 1 << 21, 100, 2 << 20, 1)])
def test_like_definition(spark, monkeypatch, order, gathered, shard, text, many):
    monkeypatch.setattr(ngram_lm, "MANY", many)
    monkeypatch.setattr(ngram_lm, "GATHERED", gathered)
    monkeypatch.setattr(ngram_lm, "SHARD_BYTES", shard)
    monkeypatch.setattr(ngram_lm, "SLICE", text)
    rng = random.Random(2)
    texts = {i: sentence(rng, rng.randint(1, 40)) for i in range(40)}
    texts |= {40: "Unheard w\u00f6rd", 41: "", 42: texts[3], 43: texts[4].upper() + "  of of of of of of of", 47: "nothing of this occurs"}
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    held = lambda k: k % 5 == 2
    check(language_model_scores(table(spark, rows), F.col("doc_id") % 5 == 2, order), expected(texts, held, order), held)


def test_probabilities_of_known_tokens_leave_some_for_others():
    rng = random.Random(5)
    train = [sentence(rng, 12) for _ in range(20)]
    p = word_model(train, 3)
    known = {w for t in train for w in tokens(t)}
    for v in [0, "the", "never"]:
        assert 0.5 < sum(p(v, w) for w in known) < 1


def test_tokens_of_very_many_pairs_are_spread(spark, monkeypatch):
    monkeypatch.setattr(ngram_lm, "SHARD_BYTES", 400)
    rng = random.Random(6)
    texts = {i: " ".join(f"the w{rng.randrange(60)}" for _ in range(20)) for i in range(30)}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    model = ngram_lm.fit(docs, 3)
    (the,) = np.unique(Tokens(3).read(pa.array(["the"]))[1][:1])
    assert model.keys.hot[ngram_lm._cells(np.array([the]))].all() and model.keys.hot.sum() < 1 << model.keys.bits
    sizes = [n for _, n, _ in model.files["pairs"]]
    assert len(sizes) > 4 and max(sizes) < sum(sizes) / 2


def test_shards_share_no_keys(spark, monkeypatch):
    monkeypatch.setattr(ngram_lm, "SHARD_BYTES", 300)
    rng = random.Random(7)
    model = ngram_lm.fit(spark.createDataFrame([(sentence(rng, 30),) for _ in range(30)], "text string"), 4)
    for name, kinds in [("pairs", ["u1"]), ("words", ngram_lm.WORD_COLUMNS), ("p4", ["<f8"]), ("g2", ["<f8"])]:
        mapped = MappedTable(model.folder, model.files[name], kinds)
        keys = np.concatenate([f[0] for f in mapped.files])
        assert len(keys) and (keys[1:] > keys[:-1]).all()
        found, columns = mapped.find(keys)
        assert found.all() and all((c == np.concatenate([f[i] for f in mapped.files])).all() for i, c in enumerate(columns, 1))
        assert not mapped.find(np.setdiff1d(keys + np.uint64(1), keys))[0].any()


def test_files_of_other_storage_are_copied(spark, monkeypatch, tmp_path):
    keys = np.arange(5, dtype=np.uint64) * np.uint64(10)
    (tmp_path / "t").write_bytes(ngram_lm._content(keys, [np.arange(5, dtype="<f8")]))

    class Elsewhere:
        def open_input_stream(self, path, compression):
            return open(path, "rb")

    monkeypatch.setattr(ngram_lm, "place", lambda uri: (Elsewhere(), uri))
    found, (value,) = MappedTable(str(tmp_path), [(0, 5, "t")], ["<f8"]).find(np.array([0, 7, 40, 50], np.uint64))
    assert found.tolist() == [True, False, True, False] and value.tolist() == [0, 0, 4, 0]


def test_edges(spark):
    texts = {k: v for k, v in kept_texts(edge_rows()).items()}
    held = lambda k: k % 2 == 0
    check(language_model_scores(edge_table(spark), F.col("doc_id") % 2 == 0, 3), expected(texts, held, 3), held)


@pytest.mark.parametrize("kind", ["decimal(20,0)", "date", "smallint", "string"])
def test_ids_of_any_type(spark, kind):
    start = "date_add(DATE'2020-01-01', CAST(id AS INT))" if kind == "date" else f"CAST(id AS {kind})"
    docs = spark.range(6).selectExpr(f"{start} AS doc_id", "repeat('word ', 1 + CAST(id % 2 AS INT)) AS text")
    got = language_model_scores(docs, F.lit(False), 3).collect()
    assert len({r["doc_id"] for r in got}) == 6 and len({round(r["score"], 9) for r in got}) == 2


def test_empty_tables(spark):
    assert language_model_scores(table(spark, []), F.lit(False)).count() == 0
    nothing = language_model_scores(edge_table(spark), F.lit(True)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 for r in nothing)


def test_codes_of_texts():
    texts = ["Ab  c", "", None, "\x01x\n"]
    code, doc = Speller(3).codes(pa.array(texts))
    got = [[] for _ in texts]
    for c, d in zip(code, doc):
        got[d].append(int(c).to_bytes(3, "big"))
    assert got == [spelled(t, 3) for t in texts]
