import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from basket_engine.llm import language
from basket_engine.llm.language import PIECE, PieceModel, Segmenter, _hash, fit, identified, read_pieces, sample_ids
from basket_engine.llm.queries import QUERIES, tokenizer
from basket_engine.llm.wordhash import text_buffers

from .data import edge_rows, edge_table, kept_texts, table

PIECES = read_pieces(tokenizer("byte_bpe_multi_50k.tiktoken"))


def toy():
    pieces = [b"a", b"b", b"ab", b"ba", b"aba", *(bytes([c]) for c in b"cde")]
    model = PieceModel.uniform(pieces, ["x", "y"])
    rng = np.random.default_rng(0)
    p = rng.random((len(pieces), 2))
    model.probability = np.vstack([p / p.sum(axis=0), [0, 0]])
    return {q: model.probability[model.find(np.array([_hash(q)], np.uint64))[0]] for q in pieces}, model


def all_cuts(word):
    if not word:
        yield []
    for k in range(1, min(len(word), PIECE) + 1):
        for rest in all_cuts(word[k:]):
            yield [word[:k], *rest]


def probability(word, table):
    return sum(np.prod([table.get(p, np.zeros(2)) for p in cut], axis=0) for cut in all_cuts(word))


def test_sums_over_all_segmentations():
    table_, model = toy()
    words = ["a", "ab", "aba", "babab", "abcabdea", "ABBA"]
    data, offsets = text_buffers(pa.array(words))
    got = Segmenter(model).log_scores(data, offsets[:-1], offsets[1:])
    for w, s in zip(words, got):
        assert np.allclose(np.exp(s), probability(w.lower().encode(), table_))


def test_expected_counts():
    table_, model = toy()
    word, lang = b"ababa", 1
    cuts = [(c, np.prod([table_.get(p, np.zeros(2))[lang] for p in c])) for c in all_cuts(word)]
    whole = sum(p for _, p in cuts)
    data, offsets = text_buffers(pa.array([word.decode()]))
    got = Segmenter(model).expected(data, offsets[:-1], offsets[1:], np.array([3.0]), np.array([lang]))
    for piece in table_:
        want = 3 * sum(p * c.count(piece) for c, p in cuts) / whole
        assert math.isclose(got[model.find(np.array([_hash(piece)], np.uint64))[0], lang], want, abs_tol=1e-9)
    assert got[:, 0].sum() == 0


def whole_sum(word, table, lang):
    """The logarithm of the sum over all segmentations, by exact fractions."""
    p = {q: Fraction(float(v[lang])) for q, v in table.items()}
    sums = [Fraction(1)]
    for e in range(1, len(word) + 1):
        sums.append(sum((sums[e - k] * p.get(word[e - k : e], 0) for k in range(1, min(e, PIECE) + 1)), Fraction(0)))
    n, d = sums[-1].numerator, sums[-1].denominator
    return math.log(n >> max(0, n.bit_length() - 900)) + max(0, n.bit_length() - 900) * math.log(2) - math.log(d >> max(0, d.bit_length() - 900)) - max(0, d.bit_length() - 900) * math.log(2)


@pytest.mark.parametrize("at_once", [1, 300, 1 << 19])
def test_words_of_any_length_are_summed_whole(monkeypatch, at_once):
    monkeypatch.setattr(language, "AT_ONCE", at_once)
    table_, model = toy()
    rng = random.Random(3)
    words = ["".join(rng.choice("abcde") for _ in range(n)) for n in (200, 1, 49, 3, 48, 75, 47, 1500, 200, 2)]
    data, offsets = text_buffers(pa.array(words))
    got = Segmenter(model).log_scores(data, offsets[:-1], offsets[1:])
    for w, s in zip(words, got):
        assert s == pytest.approx([whole_sum(w.encode(), table_, lang) for lang in (0, 1)], rel=1e-9)


@pytest.mark.parametrize("at_once", [1, 300, 1 << 19])
def test_long_words_are_learned_whole(monkeypatch, at_once):
    monkeypatch.setattr(language, "AT_ONCE", at_once)
    table_, model = toy()
    rng = random.Random(4)
    words = ["".join(rng.choice("abcde") for _ in range(n)) for n in (700, 5, 200, 60, 1)]
    langs, weights = np.array([0, 1, 1, 0, 1]), np.array([1.0, 2.0, 3.0, 1.0, 5.0])
    data, offsets = text_buffers(pa.array(words))
    got = Segmenter(model).expected(data, offsets[:-1], offsets[1:], weights, langs)
    # the derivative of the log sum by the log of a piece's probability is its expected count
    for lang in (0, 1):
        for piece in table_:
            up = {q: v * (1 + 1e-6 * (q == piece)) for q, v in table_.items()}
            down = {q: v * (1 - 1e-6 * (q == piece)) for q, v in table_.items()}
            slope = sum(w * (whole_sum(x.encode(), up, lang) - whole_sum(x.encode(), down, lang)) for x, w, of in zip(words, weights, langs) if of == lang) / 2e-6
            assert got[model.find(np.array([_hash(piece)], np.uint64))[0], lang] == pytest.approx(slope, abs=1e-3 * (1 + slope))


def test_sums_too_small_for_a_double():
    pieces = [bytes([c]) for c in b"abcde"]
    model = PieceModel.uniform(pieces, ["x"])
    model.probability = np.array([[1e-30], [1e-12], [0.5], [1e-3], [1e-6], [0]])[np.r_[np.argsort([_hash(q) for q in pieces]).argsort().argsort(), 5]]
    one = {q: model.probability[model.find(np.array([_hash(q)], np.uint64))[0], 0] for q in pieces}
    word = "aabbcde" * 40
    data, offsets = text_buffers(pa.array([word]))
    assert Segmenter(model).log_scores(data, offsets[:-1], offsets[1:])[0, 0] == pytest.approx(sum(math.log(one[c.encode()]) for c in word))
    got = Segmenter(model).expected(data, offsets[:-1], offsets[1:], np.ones(1), np.zeros(1, np.int64))
    assert got[model.find(np.array([_hash(b"a")], np.uint64))[0], 0] == pytest.approx(80)


def test_languages_without_blanks(spark):
    """Sentences that are one word each are learned and told apart."""
    rng = random.Random(8)
    signs = {"ja": "のにはをがでと日本語文字", "zh": "的一是不了人我在有他这中"}
    say = lambda lang: "".join(rng.choice(signs[lang]) for _ in range(rng.randint(30, 120)))
    train = [(lang, say(lang)) for lang in signs for _ in range(40)]
    assert min(len(t.encode()) for _, t in train) > 75
    model = fit(spark.createDataFrame(train, "lang string, text string"), PIECES, 2)
    texts = [(lang, say(lang)) for lang in signs for _ in range(30)]
    got = {r["doc_id"]: r for r in identified(table(spark, [(i, t, None, "s", 1) for i, (_, t) in enumerate(texts)]), model).collect()}
    assert all(got[i]["lang_pred"] == lang and got[i]["score"] > 0.9 for i, (lang, _) in enumerate(texts))


def test_query_learns_from_its_training_rows_alone(spark, tmp_path):
    """A language that only held-out rows have is never predicted; held-out rows are told apart."""
    rng = random.Random(9)
    held_out = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    rows, langs = [], {}
    for i in range(400):
        langs[i] = rng.choice(["en", "de"])
        text = corpus(rng, langs[i], 1)[0]
        rows.append((i, text, "secret" if held_out(i) and i % 2 else langs[i] if i % 7 else None, "s", len(text)))
    rows += [(900, None, "en", "s", 0), (901, "12 !", "en", "s", 4)]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op10_language"](spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rows} and all(got[i]["held_out"] == held_out(i) for i in got)
    assert {r["lang_pred"] for r in got.values()} == {"en", "de", "und"} and {i for i in got if got[i]["lang_pred"] == "und"} == {900, 901}
    unseen = [i for i in langs if held_out(i)]
    assert sum(got[i]["lang_pred"] == langs[i] for i in unseen) >= 0.97 * len(unseen)


def corpus(rng, lang, n):
    parts = {"en": ["th", "ing", "the", "ed", "wh", "er"], "de": ["sch", "ung", "ei", "ver", "keit", "ß"], "fr": ["eau", "ou", "é", "tion", "que", "eux"]}[lang]
    return [" ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(2, 40))) for _ in range(n)]


def fitted(spark):
    rng = random.Random(6)
    train = [(lang, t) for lang in ("en", "de", "fr") for t in corpus(rng, lang, 60)]
    return fit(spark.createDataFrame(train, "lang string, text string"), PIECES, 2), rng


def test_held_out_accuracy_and_edges(spark):
    model, rng = fitted(spark)
    texts = [(lang, t) for lang in ("en", "de", "fr") for t in corpus(rng, lang, 40)]
    rows = [(i, t, None, "s", 1) for i, (_, t) in enumerate(texts)]
    got = {r["doc_id"]: r for r in identified(table(spark, rows), model).collect()}
    right = sum(got[i]["lang_pred"] == lang for i, (lang, _) in enumerate(texts))
    assert right >= 0.97 * len(texts) and all(0 <= r["score"] <= 1 for r in got.values())
    edges = {r["doc_id"]: r for r in identified(edge_table(spark), model).collect()}
    assert set(edges) == set(kept_texts(edge_rows()))
    assert {k for k, r in edges.items() if r["lang_pred"] == "und"} == {1, 2, 3, 10}
    assert all(edges[k]["score"] == 0 for k in (1, 2, 3, 10))
    assert identified(table(spark, []), model).count() == 0


def test_without_training_texts(spark):
    none = fit(spark.createDataFrame([], "lang string, text string"), PIECES)
    assert none is None and {r["lang_pred"] for r in identified(edge_table(spark), none).collect()} == {"und"}


def test_sample_is_bounded_by_language(spark):
    rows = spark.createDataFrame([(i, ["en", "de", None][i % 3]) for i in range(90)], "id long, lang string")
    picked = {r["id"] for r in sample_ids(rows, 7).collect()}
    assert len(picked) == 14 and not any(i % 3 == 2 for i in picked)


def test_sample_is_that_of_the_least_hashes(spark):
    rows = spark.range(20000).selectExpr("id", "CASE WHEN id % 10 < 7 THEN 'en' WHEN id % 10 < 9 THEN 'de' END AS lang")
    picked = {r["id"] for r in sample_ids(rows, 100).collect()}
    hashed = sorted((r["h"], r["id"], r["lang"]) for r in rows.where("lang is not null").selectExpr("id", "lang", "xxhash64(id) AS h").collect())
    assert picked == {i for lang in ("en", "de") for _, i, _ in [x for x in hashed if x[2] == lang][:100]}
    assert sample_ids(rows.limit(0), 5).count() == 0
