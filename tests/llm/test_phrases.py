import random
import re
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from basket_engine.llm import phrases
from basket_engine.llm.phrases import Bitmap, collocations, distinct
from basket_engine.llm.queries import ORACLES, QUERIES

from .data import FOLD, edge_rows, table

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def brute(rows, top, least, percent=80):
    """Every phrase of every row counted, scored and compared with all longer ones."""
    count, sizes = {}, Counter()
    for row in rows:
        lang = row[2] or "und" if row[2] is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (row[1] or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f = count.setdefault(lang, Counter())
                    f[tuple(w[i : i + k])] += 1
    out = []
    for lang, f in count.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):  # noqa: E741
            out.append((lang, rank, phrase.decode(), -a, l, r, sizes[lang], -score))
    return sorted(out)


def random_rows(rng, n, langs=("en", "de", None)):
    words = ["a", "B", "c", "d", "é", "The", "of", "x-y", "日本", "zz"]
    fixed = ["the quick brown fox", "of course", "a B c d é zz", "New York City"]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 25)):
            parts.append(rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words))
            parts.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "!", ";x"]))
        rows.append((i, "".join(parts), rng.choice(langs), "s", 1))
    return rows


@pytest.mark.parametrize("top, least, frontier, percent", [(2000, 3, 4, 80), (5, 2, 1, 80), (12, 3, 1, 50), (3, 4, 2, 100)])
def test_phrases(spark, top, least, frontier, percent):
    rows = random_rows(random.Random(top), 150)
    got = collocations(table(spark, rows), top, least, percent, frontier=frontier)
    assert got.columns == list(COLUMNS)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, top, least, percent)


def test_rounds_of_a_small_frontier(spark, monkeypatch):
    """A frontier of a pair or so at first is widened until all languages are settled."""
    monkeypatch.setattr(phrases, "GROWTH", 2)
    seen, plain = [], phrases._thresholds
    monkeypatch.setattr(phrases, "_thresholds", lambda pairs, wanted: seen.append(wanted) or plain(pairs, wanted))
    rows = random_rows(random.Random(1), 200, ("en", "de"))
    got = collocations(table(spark, rows), 4, 2, frontier=1)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 4, 2)
    assert len(seen) > 1


def test_numbers_that_clash_are_drawn_again(spark):
    rows = random_rows(random.Random(4), 60, ("en",))
    got = collocations(table(spark, rows), 50, 2, bits=9)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 50, 2)
    with pytest.raises(RuntimeError):
        collocations(table(spark, rows), 50, 2, bits=1)


def test_full_bitmaps_only_count_more(spark, monkeypatch):
    monkeypatch.setattr(phrases, "MOST_BITS", 64)
    monkeypatch.setattr(phrases, "GATHERED", 100)
    monkeypatch.setattr(Bitmap, "holds", lambda self, *columns: np.ones(len(columns[0]), bool))
    rows = random_rows(random.Random(5), 80)
    got = collocations(table(spark, rows), 10, 3, frontier=1)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 10, 3)


def test_edges(spark):
    rows = edge_rows() * 3
    assert sorted(tuple(r) for r in collocations(table(spark, rows), 100, 30).collect()) == brute(rows, 100, 30)
    assert collocations(table(spark, [])).count() == 0
    assert collocations(table(spark, [(1, None, None, None, None), (2, " . ", "en", "s", 1)])).count() == 0


def test_repeated_words_overlap(spark):
    rows = [(1, "x " * 40, "en", "s", 1), (2, "no no. no no", "en", "s", 1)]
    assert sorted(tuple(r) for r in collocations(table(spark, rows), 10, 2).collect()) == brute(rows, 10, 2)


def test_scores_are_exact(spark):
    rng = random.Random(2)
    rows = [(a, a + rng.randint(0, 10**k), a + rng.randint(0, 10**k)) for k in range(1, 18) for a in (rng.randint(1, 10**k) for _ in range(30))]
    df = spark.createDataFrame(rows, "n long, l long, r long").withColumn("score", phrases._score("n", "l", "r"))
    assert all(r["score"] == 2_000_000 * r["n"] // (r["l"] + r["r"]) for r in df.collect())


def test_distinct_rows():
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 2**64, 6, dtype=np.uint64)[rng.integers(0, 6, (500, 4))]
    own, n = distinct(rows)
    assert Counter(map(tuple, rows.tolist())) == dict(zip(map(tuple, own.tolist()), n.tolist()))


def test_bitmap_holds_its_members(spark):
    df = spark.range(3000).select(F.xxhash64("id").alias("a"), F.xxhash64("id", "id").alias("b"))
    a, b = (np.array(x).view(np.uint64) for x in zip(*((r.a, r.b) for r in df.collect())))
    bitmap = Bitmap.of(df)
    assert bitmap.holds(a, b).all() and bitmap.holds(b, a).mean() < 0.2


def test_query(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    expected = sorted(con.execute(ORACLES["op12_phrases"]).fetchall())
    assert sorted(tuple(r) for r in QUERIES["op12_phrases"](spark, sf).collect()) == expected
    rows = [(d, t, g) for d, t, g in con.execute("SELECT doc_id, text, lang FROM documents").fetchall()]
    assert [tuple(r) for r in expected] == brute(rows, 2000, 30)
