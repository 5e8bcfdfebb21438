import math
import random
from collections import Counter, defaultdict
from statistics import NormalDist

import pytest

from basket_engine.llm import quality
from basket_engine.llm.quality import discounts, fit, judge, log_probability

from .data import edge_rows, edge_table, kept_texts, sentence, table


def tokens(text):
    import re

    return [quality.START, *(w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w), quality.END]


def definition(texts):
    """Bigram modified Kneser-Ney from its definition; returns log10 p of a text."""
    pairs = Counter(p for t in texts for p in zip(tokens(t), tokens(t)[1:]))
    uni = Counter(w for _, w in pairs)
    d2, d1 = discounts(Counter(pairs.values())), discounts(Counter(uni.values()))
    total, held = defaultdict(int), defaultdict(float)
    for (v, _), c in pairs.items():
        total[v] += c
        held[v] += d2[min(c, 3) - 1]
    unknown = sum(d1[min(c, 3) - 1] for c in uni.values()) / sum(uni.values()) / (len(uni) + 1)

    def p(v, w):
        low = (max(uni[w] - d1[min(uni[w], 3) - 1], 0) / sum(uni.values()) if w in uni else 0) + unknown
        if v not in total:
            return low
        c = pairs.get((v, w), 0)
        return (max(c - d2[min(c, 3) - 1], 0) / total[v] if c else 0) + held[v] / total[v] * low

    return lambda text: sum(math.log10(p(v, w)) for v, w in zip(tokens(text), tokens(text)[1:]))


@pytest.mark.parametrize("rows", [2_000_000, 30])
def test_like_definition(spark, monkeypatch, rows):
    monkeypatch.setattr(quality, "SHARD_ROWS", rows)
    rng = random.Random(8)
    texts = [sentence(rng, rng.randint(1, 50)) for _ in range(60)]
    train, other = texts[:40], texts[40:] + ["unseen unheard", "", None]
    model = fit(spark.createDataFrame([(t,) for t in train], "text string"))
    score = definition(train)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(train + other)], "id long, text string")
    got = {r["id"]: r for r in log_probability(docs, model).collect()}
    for i, t in enumerate(train + other):
        assert got[i]["n_tokens"] == len(tokens(t)) - 1 and math.isclose(got[i]["log10_prob"], score(t), rel_tol=1e-9)


def test_discounts():
    assert discounts({1: 100, 2: 30, 3: 10, 4: 5}) == pytest.approx((0.625, 1.375, 1.75))
    assert discounts({}) == (0.75, 0.75, 0.75)


def labelled(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        poor = i % 8 == 0
        text = sentence(rng, rng.randint(20, 80))
        text = " ".join(w.upper() + "!!" for w in text.split()) if poor else text
        rows.append((i, text, ["en", "fr", None][i % 3], "s", len(text)))
        if i % 2 == 0:
            labels.append((i, 0 if poor else 1, 0))
    labels += [(0, 1, 0), (None, 1, 0), (2, 1, 1), (4, None, None), (9999, 1, 0)]
    return table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {r[0] for r in rows if r[0] % 8 == 0}


def test_rejects_poor_documents(spark):
    docs, labels, poor = labelled(spark)
    got = {r["doc_id"]: r for r in judge(docs, labels, trusted=80).collect()}
    rejected = {k for k, r in got.items() if not r["kept"]}
    assert len(got) == 400 and len(poor - rejected) == 0 and len(rejected - poor) <= 8
    assert {r["lang"] for r in got.values()} == {"en", "fr", "und"}


def test_edges(spark):
    _, labels, _ = labelled(spark)
    got = {r["doc_id"]: r for r in judge(edge_table(spark), labels).collect()}
    assert set(got) == set(kept_texts(edge_rows())) and not any(got[k]["kept"] for k in (1, 2, 3))
    without = judge(edge_table(spark), labels.limit(0)).collect()
    assert all(r["perplexity"] is None and r["kept"] == (r["n_tokens"] > 1) for r in without)
    assert judge(table(spark, []), labels).count() == 0


def test_language_without_labels_is_kept(spark):
    docs, labels, _ = labelled(spark)
    strange = [(1000 + i, " ".join(f"q{i}x{j}" for j in range(30)), "xx", "s", 1) for i in range(40)]
    got = {r["doc_id"]: r for r in judge(docs.unionByName(table(spark, strange)), labels, trusted=80).collect()}
    assert all(got[k]["kept"] and got[k]["threshold"] is None for k, *_ in strange)


def test_few_labels_make_an_own_threshold(spark):
    docs, labels, _ = labelled(spark)
    strange = [(1000 + i, " ".join(f"q{i}x{j}" for j in range(30)), "xx", "s", 1) for i in range(80)]
    more = spark.createDataFrame([(1000 + i, 1, 0) for i in range(40)], labels.schema)
    got = {r["doc_id"]: r for r in judge(docs.unionByName(table(spark, strange)), labels.unionByName(more), trusted=80).collect()}
    own = {r["lang"]: r["threshold"] for r in got.values()}
    assert own["xx"] > 2 * own["en"] and own["en"] != own["fr"]
    assert sum(not got[k]["kept"] for k, *_ in strange) <= 2


def test_rejects_few_insults_and_runs_in_long_documents(spark):
    rng = random.Random(3)
    rows = [(i, sentence(rng, rng.randint(100, 300)), "en", "s", 1) for i in range(400)]
    insulted, running = range(0, 80), range(80, 120)
    for i in insulted:
        words = rows[i][1].split()
        words[rng.randrange(len(words))] = ["blockhead", "nitwit"][i // 2 % 2]
        rows[i] = (i, " ".join(words), *rows[i][2:])
    for i in running:
        words = rows[i][1].split()
        at = rng.randrange(len(words))
        rows[i] = (i, " ".join([*words[:at], *[words[at]] * 40, *words[at:]]), *rows[i][2:])
    labels = spark.createDataFrame([(i, 1, int(i in insulted)) for i in range(400) if i % 2 and i not in running], "doc_id long, quality int, toxic int")
    rejected = {r["doc_id"] for r in judge(table(spark, rows), labels).where("not kept").collect()}
    assert len(rejected & set(insulted)) >= 72 and set(running) <= rejected
    assert len(rejected - set(insulted) - set(running)) <= 8


def quantile(values, q):
    return sorted(values)[max(0, math.ceil(q * len(values)) - 1)]


def thresholds(rows, q):
    """{lang: {measure: limit}} from the formulas, in plain numbers."""
    by = defaultdict(list)
    for r in rows:
        by[r["lang"]].append(r)
    out, s = defaultdict(dict), quality.SHRINK
    for m in quality.MEASURES:
        mean = {g: sum(r[m] for r in x) / len(x) for g, x in by.items()}
        squares = {g: sum((r[m] - mean[g]) ** 2 for r in x) for g, x in by.items()}
        pooled = sum(squares.values()) / sum(len(x) - 1 for x in by.values())
        sd = {g: math.sqrt((squares[g] + s * pooled) / (len(x) - 1 + s)) for g, x in by.items()}
        far = max(quantile([(r[m] - mean[r["lang"]]) / sd[r["lang"]] for r in rows], q), NormalDist().inv_cdf(q))
        for g, x in by.items():
            n = len(x)
            rest = mean[g] + far * sd[g] * (1 + 1 / math.sqrt(n))
            out[g][m] = n / (n + s) * quantile([r[m] for r in x], q) + s / (n + s) * rest
    return out


@pytest.mark.parametrize("q", [0.9, 0.998])
def test_thresholds_like_their_definition(spark, q):
    rng = random.Random(4)
    rows = [
        {"id": i, "lang": ["en", "en", "en", "fr", "de"][i % 5], "n_tokens": 1 if i % 40 == 0 else 9, **{m: rng.gauss(i % 5, 1 + k) for k, m in enumerate(quality.MEASURES)}}
        for i in range(400)
    ]
    scored = spark.createDataFrame([tuple(r.values()) for r in rows], "id long, lang string, n_tokens long, loss double, worst double, runs double, toxic double")
    scored = scored.unionByName(scored.limit(1).selectExpr("1000L AS id", "'xx' AS lang", "n_tokens", "loss", "worst", "runs", "toxic"))
    good, sample = (spark.createDataFrame([(i,) for i in ids], "id long") for ids in (range(0, 400, 2), range(0, 400, 3)))
    used = [r for r in rows if r["id"] % 2 == 0 and r["id"] % 3 and r["n_tokens"] > 1]
    want = thresholds(used, q)
    got = quality._with_thresholds(scored, good, sample, q).collect()
    assert len(got) == 401
    for r in got:
        for m in quality.MEASURES:
            assert r[f"t_{m}"] == (pytest.approx(want[r["lang"]][m]) if r["lang"] != "xx" else None)


def test_ratio_like_its_definition(spark):
    """The toxic ratio of a text: words mixed from both models over words of the trusted one."""
    rng = random.Random(6)
    good = [sentence(rng, rng.randint(1, 40)) for _ in range(40)]
    bad = [sentence(rng, 10) + " blockhead nitwit" for _ in range(15)]
    model = quality.against(fit(spark.createDataFrame([(t,) for t in good], "text string")), spark.createDataFrame([(t,) for t in bad], "text string"))
    pairs = {p for t in good for p in zip(tokens(t), tokens(t)[1:])}
    uni, other = Counter(w for _, w in pairs), Counter(w for _, w in {p for t in bad for p in zip(tokens(t), tokens(t)[1:])})
    d, e = discounts(Counter(uni.values())), discounts(Counter(other.values()))
    unknown = sum(d[min(c, 3) - 1] for c in uni.values()) / sum(uni.values()) / (len(uni) + 1)
    gamma = sum(e[min(c, 3) - 1] for c in other.values()) / sum(other.values())

    def ratio(w):
        low = (max(uni[w] - d[min(uni[w], 3) - 1], 0) / sum(uni.values()) if w in uni else 0) + unknown
        second = (max(other[w] - e[min(other[w], 3) - 1], 0) / sum(other.values()) if w in other else 0) + gamma * low
        return math.log10(((1 - quality.MIX) * low + quality.MIX * second) / low)

    texts = ["the blockhead of", "nitwit", "never seen", good[0][:40], ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: r["ratio"] for r in quality.passages(docs, model).groupBy("id").sum("ratio").withColumnRenamed("sum(ratio)", "ratio").collect()}
    assert all(got[i] == pytest.approx(sum(ratio(w) for w in tokens(t)[1:])) for i, t in enumerate(texts))


def test_fits_on_every_trusted_document(spark, monkeypatch):
    """More than any bound of some thousand; only a quarter sets thresholds instead."""
    seen = []
    monkeypatch.setattr(quality, "fit", lambda docs, fit=quality.fit: seen.append(docs.count()) or fit(docs))
    n = 6000
    rows = [(i, f"some words of w{i % 50}", "en", "s", 1) for i in range(n)]
    labels = spark.range(n).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    assert judge(table(spark, rows), labels).count() == n
    back = spark.range(n).where(f"pmod(xxhash64(id, 'calibration'), {quality.CALIBRATION}) = 0").count()
    assert seen == [n - back] and n - back > 4000
