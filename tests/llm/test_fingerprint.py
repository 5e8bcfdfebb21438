import hashlib
import random
from collections import Counter

import numpy as np

from pyspark.sql import functions as F

from basket_engine.llm.fingerprint import _sample, edited_likeness, fingerprints

from .data import edge_rows, edge_table, kept_texts, sentence, spaced_words, table


def jaccard(a, b):
    a, b = Counter(spaced_words(a)), Counter(spaced_words(b))
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def edited(texts):
    ids = sorted(texts)
    out = {}
    for i, k in enumerate(ids):
        own, following = texts[k] or "", texts[ids[(i + 1) % len(ids)]] or ""
        quarter = len(own) // 4
        out[k] = (len(own), own[: len(own) - quarter] + following[:quarter], following)
    return out


def test_one_heavy_term_agrees_by_weight(spark):
    rows = spark.range(3000).selectExpr("xxhash64(id) AS term").selectExpr("term", "explode(array(20.0D, 30.0D)) AS w")
    low = F.sum(F.when(F.col("w") == 20, F.col("s")).otherwise(-F.col("s"))).alias("gap")
    sampled = rows.select("term", "w", _sample(F.col("term"), F.log("w"), 5).bitwiseAND(F.lit(0xFFFFFFFF)).alias("s"))
    same = sampled.groupBy("term").agg(low).where("gap = 0").count()
    assert abs(same / 3000 - 20 / 30) < 0.04


def test_edited_texts_and_likeness(spark):
    rng = random.Random(11)
    texts = {i: sentence(rng, rng.randint(1, 150)) for i in range(120)}
    texts[50] = texts[51] = texts[7]
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    got = {r["doc_id"]: r for r in edited_likeness(table(spark, rows)).collect()}
    errors = []
    for k, (n, text, following) in edited(texts).items():
        r = got[k]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(text.encode()).hexdigest())
        errors += [r["near_edited"] - jaccard(texts[k], text), r["near_next"] - jaccard(texts[k], following)]
    assert np.sqrt(np.mean(np.square(errors))) < 0.12 and abs(np.mean(errors)) < 0.04
    assert got[50]["fingerprint"] == got[51]["fingerprint"] == got[7]["fingerprint"] and got[50]["near_next"] == 1
    plain = {r["doc_id"]: r["fingerprint"] for r in fingerprints(table(spark, rows)).collect()}
    assert plain == {k: r["fingerprint"] for k, r in got.items()}


def test_edges(spark):
    texts = kept_texts(edge_rows())
    got = {r["doc_id"]: r for r in edited_likeness(edge_table(spark)).collect()}
    assert set(got) == set(texts)
    for k, (n, text, _) in edited(texts).items():
        assert (got[k]["n_chars"], got[k]["edited_sha256"]) == (n, hashlib.sha256(text.encode()).hexdigest())
    assert got[1]["fingerprint"] == got[2]["fingerprint"] == got[3]["fingerprint"] and got[1]["near_next"] == 1
    assert got[3]["near_next"] == 0
    assert edited_likeness(table(spark, [])).count() == 0
    one = edited_likeness(table(spark, [(3, "alone at last", "en", "s", 13)])).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"alone at lalo").hexdigest()
