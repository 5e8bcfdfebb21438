"""Small document tables with the awkward cases, and brute-force helpers."""

import random
import re

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, words string, band long, shard int, a int, b int, pos int"
VOCABULARY = "the of and ly er tion stone water river over Über maße été niño dog cat tree Ä ß run fast slow to at in".split()


def sentence(rng, n):
    return " ".join(rng.choice(VOCABULARY) + rng.choice(["", "", "s", "ing", ",", "."]) for _ in range(n))


def edge_rows():
    long_text = sentence(random.Random(5), 30_000)
    return [
        (1, None, None, None, None), (2, "", "en", "", 0), (3, " \n\t ", "en", "s", 4), (4, "one", "en", "s", 3),
        (5, "The quick brown fox", "en", "s", 19), (6, "the QUICK  brown\nfox", "en", "s", 20), (7, long_text, "en", "s", len(long_text)),
        (8, "same words here again and more", None, "s", 30), (8, "same words here again and more", None, "s", 30),
        (9, "日本語 テキスト 😀", "ja", "s", 11), (None, "a row without an id", "en", "s", 19), (10, "!!! ... 123", "en", "s", 11),
        (11, long_text, "en", "s", len(long_text)), (8, None, "en", "s", None),
    ]


def table(spark, rows):
    return spark.createDataFrame([(*r, 99, "clash", 1, 2, 3, 4, 5) for r in rows], SCHEMA)


def edge_table(spark):
    return table(spark, edge_rows())


def kept_texts(rows):
    """What ``one_per_id`` keeps: the least text of each id, nulls last."""
    out = {}
    for r in rows:
        if r[0] is not None:
            best = out.get(r[0], (True, ""))
            out[r[0]] = min(best, (r[1] is None, r[1] or "")) if r[0] in out else (r[1] is None, r[1] or "")
    return {k: None if missing else text for k, (missing, text) in out.items()}


def spaced_words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(FOLD)) if w]


def shingle_set(text, size):
    w = spaced_words(text)
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)}


def near_copies(rng, base, n, most=0.25):
    """Copies of a text with some of its words changed."""
    words = base.split()
    out = []
    for _ in range(n):
        own = list(words)
        for i in rng.sample(range(len(own)), int(rng.random() * most * len(own))):
            own[i] = rng.choice(VOCABULARY) + str(rng.randint(0, 9))
        out.append(" ".join(own))
    return out


def components(texts, size, percent=80):
    """Smallest id reachable by links of shingle sets, by comparing all pairs."""
    sets = {k: shingle_set(t, size) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in ids}
