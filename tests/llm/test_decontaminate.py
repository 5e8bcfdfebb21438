import hashlib
import random
import re

import pytest

from basket_engine.llm import decontaminate
from basket_engine.llm.decontaminate import contamination

from .data import FOLD, edge_rows, edge_table, kept_texts, sentence, table


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def brute_force(texts, items, window=13):
    out = {}
    for doc, text in texts.items():
        w, hit, held = words(text), set(), set()
        for item, phrase in items:
            p = words(phrase)
            n = min(window, len(p))
            for i in range(len(p) - n + 1 if p else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == p[i : i + n]:
                        hit |= set(range(j, j + n))
                        held.add(item or "")
        ids = ",".join(sorted(held))
        out[doc] = (len(w), len(hit), len(held), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def found(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def fixture():
    rng = random.Random(3)
    items = [(f"q{i}", sentence(rng, rng.choice([13, 14, 20, 30]))) for i in range(12)]
    items += [("q1", sentence(rng, 20)), (None, sentence(rng, 15)), ("one", "stone"), ("two", "river water"), ("none", "?!"), ("null", None), ("q20", items[0][1])]
    rows = []
    for i in range(40):
        text = sentence(rng, rng.randint(1, 120))
        if i % 3 == 0:
            phrase = words(rng.choice(items)[1])
            lo = rng.randint(0, max(0, len(phrase) - 13))
            text += " " + "; ".join(w.upper() if w.isascii() else w for w in phrase[lo : lo + rng.randint(10, 30)]) + " " + sentence(rng, 5)
        rows.append((i, text, "en", "s", len(text)))
    return rows, items


@pytest.mark.parametrize("passes", [1_000_000, 40])
def test_like_brute_force(spark, monkeypatch, passes):
    monkeypatch.setattr(decontaminate, "PASS_SHINGLES", passes)
    rows, items = fixture()
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    expected = brute_force({r[0]: r[1] for r in rows}, items)
    assert sum(e[4] for e in expected.values()) > 5
    assert found(contamination(table(spark, rows), benchmark)) == expected


def test_edges(spark):
    items = [(1, "quick brown"), (2, "same words here again and more"), (3, None)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    expected = brute_force(kept_texts(edge_rows()), [(str(i), t) for i, t in items])
    assert found(contamination(edge_table(spark), benchmark)) == expected


def test_empty_tables(spark):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert found(contamination(table(spark, []), benchmark)) == {}
    clean = found(contamination(edge_table(spark), benchmark))
    assert len(clean) == 11 and not any(v[4] for v in clean.values())
