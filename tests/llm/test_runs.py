import hashlib
import random
import zlib

import numpy as np
import pytest

from basket_engine.llm.queries import QUERIES
from basket_engine.llm.runs import EulerTour, SuffixTree, all_runs, periodic_runs, runs_of, stretches

from .data import edge_rows, edge_table, kept_texts, table


def brute_runs(words, least=6, exponent=4):
    n, out = len(words), set()
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            own = words[i : j + q]
            smallest = not any(own[r:] == own[:-r] for r in range(1, q))
            if len(own) >= max(least, exponent * q) and smallest:
                out.add((i, len(own), q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    gone = {i for start, size, q in runs for i in range(start + q, start + size)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def planted(key, words):
    h, n = zlib.crc32(str(key).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


def random_words(rng, n, k):
    words = [rng.choice("abcd"[:k]).encode() for _ in range(n)]
    if words and rng.random() < 0.6:
        a, p = rng.randrange(n), rng.randint(1, 8)
        words = [words[min(a + (i - a) % p, n - 1)] if i >= a else words[i] for i in range(n)]
    return words


@pytest.mark.parametrize("least, exponent", [(6, 4), (1, 2), (4, 3)])
def test_runs_of_short_words(least, exponent):
    rng = random.Random(exponent)
    for _ in range(500):
        words = random_words(rng, rng.randint(0, 60), rng.randint(1, 4))
        assert [tuple(r) for r in runs_of(words, least, exponent).tolist()] == brute_runs(words, least, exponent)


def test_trees_without_the_cutting_find_the_same():
    rng = random.Random(8)
    for _ in range(200):
        words = random_words(rng, rng.randint(6, 80), 3)
        symbols = (np.unique(words, return_inverse=True)[1] + 1).tolist()
        found = all_runs(symbols).tolist()
        assert sorted(map(tuple, found), key=lambda r: (r[0], r[2])) == brute_runs(words)
        inside = stretches(np.array(symbols))
        assert all(any(lo <= s and s + n <= hi for lo, hi in inside) for s, n, _ in found)


def test_common_extensions():
    rng = random.Random(2)
    symbols = [rng.randint(1, 3) for _ in range(300)]
    tree = SuffixTree(symbols)
    a, b = np.array([(rng.randrange(300), rng.randrange(301)) for _ in range(2000)]).T
    a, b = a[a != b], b[a != b]
    for x, y, n in zip(a, b, tree.common(a, b)):
        same = 0
        while max(x, y) + same < 300 and symbols[x + same] == symbols[y + same]:
            same += 1
        assert n == same
    closed = [[*symbols[i:], 0] for i in range(300)]
    assert sorted(range(300), key=closed.__getitem__) == sorted(range(300), key=tree.first.__getitem__)
    flipped = [[-s for s in symbols[i:]] + [-9] for i in range(300)]
    assert sorted(range(300), key=flipped.__getitem__) == sorted(range(300), key=tree.flipped_rank.__getitem__)


def test_tour_minima():
    rng = np.random.default_rng(4)
    for n in (1, 15, 16, 17, 500):
        depths = rng.integers(0, 50, n).astype(np.int32)
        a, b = rng.integers(0, n, 400), rng.integers(0, n, 400)
        expected = [depths[min(x, y) : max(x, y) + 1].min() for x, y in zip(a, b)]
        assert EulerTour(depths).least(a, b).tolist() == expected


def test_known_runs():
    assert runs_of(b"x a b a b a b a b y y y y y y".split()).tolist() == [[1, 8, 2], [9, 6, 1]]
    assert runs_of(b"a a a a a".split()).tolist() == []  # five words are no run
    assert runs_of(b"a b c a b c a b c a b".split()).tolist() == []  # less than four periods
    assert runs_of([b"w"] * 5000).tolist() == [[0, 5000, 1]]


def test_operator(spark):
    rng = random.Random(6)
    texts = {i: " ".join(w.decode() for w in random_words(rng, rng.randint(0, 200), rng.randint(1, 4))) for i in range(40)}
    texts[40], texts[41] = "é é\té  é é\x0bé   end", "A a A a A a A a"
    got = {r["doc_id"]: r for r in periodic_runs(table(spark, [(i, t, "en", "s", 1) for i, t in texts.items()])).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        words = text.encode().split()
        runs = brute_runs(words)
        assert (got[i]["n_words"], [tuple(r) for r in got[i]["runs"]]) == (len(words), runs)
        assert got[i]["collapsed"].encode() == collapse(words, runs)


def test_edges(spark):
    got = {r["doc_id"]: r for r in periodic_runs(edge_table(spark)).collect()}
    texts = kept_texts(edge_rows())
    assert set(got) == set(texts)
    for i, text in texts.items():
        words = (text or "").encode().split()
        assert got[i]["n_words"] == len(words) and got[i]["runs"] == [] and got[i]["collapsed"].encode() == b" ".join(words)
    assert periodic_runs(table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(edge_table(spark), exponent=1)


def expected_row(key, text):
    words = planted(key, (text or "").encode().split())
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (
        len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapse(words, runs)).hexdigest(),
    )


def test_query(spark, tmp_path):
    """Every row of the query against all periods tried one by one."""
    rng = random.Random(7)
    rows = [(i, " \t".join(w.decode() for w in random_words(rng, rng.randint(0, 120), rng.randint(1, 4))), "en", "s", 1) for i in range(300)]
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0), (int(1e12), "", "en", "s", 0)]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op13_runs"](spark, str(tmp_path)).collect()}
    assert any(row[0] for row in got.values())
    assert got == {r[0]: expected_row(r[0], r[1]) for r in rows}
