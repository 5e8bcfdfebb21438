import json
import math
import os
import random
import zlib
from itertools import combinations, permutations

import numpy as np
import pytest

from basket_engine.llm import packing
from basket_engine.llm.bpe import TokenEncoder
from basket_engine.llm.packing import best_fit, improve, packed
from basket_engine.llm.queries import tokenizer

from .data import edge_rows, edge_table, kept_texts, sentence, table

os.environ["TOKENIZERS_PARALLELISM"] = "false"
PATH = tokenizer("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


ODD = [
    "", " ", "\n", "don't  stop 'S  x", "a  b\n\n c \t d  ", "  lead", "x y z", "日本 語", "I'll we're 12a3 1.5² ½", "trail \n", "''t", "<|endoftext|>",
    "a <|endoftext|> b", "<|endoftext|><|endoftext|>x ", " <|endoftext|", "日本<|endoftext|>  <|endoftext|>\n", "x  <|endoftext|>  y", "<|<|endoftext|>|>", "<|ENDOFTEXT|>",
    "a\r\nb", "­ soft", "Zoë's naïve \u0085 file", "\x00\x01 \x1c", "é", "😀 😀", "!!!??? ...", "ǅ ʰ", "tabs\t\t\tend", "  \n  \n x",
]


def test_ids_are_those_of_the_library(library):
    rng = random.Random(1)
    texts = ODD + [sentence(rng, 60) for _ in range(50)] + ["".join(rng.choice("ab 1'.\n\té²") for _ in range(40)) for _ in range(400)]
    encoder = TokenEncoder(PATH)
    for _ in range(2):
        assert [e.tolist() for e in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        rng.shuffle(texts)


def test_long_texts_in_parts(library, monkeypatch):
    monkeypatch.setattr("basket_engine.llm.bpe.LONG", 60)
    rng = random.Random(9)
    texts = [sentence(rng, 300), "x" * 200 + " ab cd", "!? " * 100, "short", sentence(rng, 50).replace(" ", "  ")]
    assert [e.tolist() for e in TokenEncoder(PATH).encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("low, high, n", [(1, 1024, 400), (300, 700, 300), (341, 600, 200), (1, 60, 500), (1024, 1024, 5), (1, 1, 0)])
def test_bins(low, high, n):
    rng = random.Random(n)
    sizes = [rng.randint(low, high) for _ in range(n)]
    first = best_fit(sizes, 1024)
    bins = improve([list(b) for b in first], sizes, 1024)
    assert sorted(i for b in bins for i in b) == list(range(n)) and all(sum(sizes[i] for i in b) <= 1024 for b in bins)
    assert math.ceil(sum(sizes) / 1024) <= len(bins) <= len(first)


def test_ids_wider_than_two_bytes(tmp_path, library):
    with open(PATH, encoding="utf-8") as file:
        content = json.load(file)
    content["model"]["vocab"] = {t: i + (1 << 16) * (i >= 256) for t, i in content["model"]["vocab"].items()}
    content["added_tokens"] = [t | {"id": t["id"] + (1 << 16)} for t in content["added_tokens"]]
    (tmp_path / "wide.json").write_text(json.dumps(content))
    for t in ["The quick brown fox <|endoftext|> jumps", "日本 語"]:
        ids = TokenEncoder(str(tmp_path / "wide.json")).encode([t])[0].tolist()
        assert ids == [i + (1 << 16) * (i >= 256) for i in library.encode(t, add_special_tokens=False).ids]


@pytest.mark.parametrize("low, high, n, most", [(200, 500, 600, 212), (260, 420, 900, 305)])
def test_the_search_needs_fewer_bins(low, high, n, most):
    rng = random.Random(n)
    sizes = [rng.randint(low, high) for _ in range(n)]
    first = best_fit(sizes, 1024)
    bins = improve(first, sizes, 1024)
    assert math.ceil(sum(sizes) / 1024) <= len(bins) <= most < len(first)
    assert len(improve(bins, sizes, 1024)) == len(bins)


def squared(bins, sizes):
    return sum(sum(sizes[i] for i in b) ** 2 for b in bins)


def neighbours(bins, sizes, capacity):
    """Every packing that one move, or one exchange of up to two for one, leads to."""
    for e, b in permutations(range(len(bins)), 2):
        for k, m in ((1, 0), (1, 1), (2, 1), (2, 0), (1, 2)):
            for out in combinations(bins[e], k):
                for back in combinations(bins[b], m):
                    new = [list(x) for x in bins]
                    new[e] = [i for i in bins[e] if i not in out] + list(back)
                    new[b] = [i for i in bins[b] if i not in back] + list(out)
                    if all(sum(sizes[i] for i in x) <= capacity for x in (new[e], new[b])):
                        yield new


def test_no_step_that_raises_the_squares_is_left():
    rng = random.Random(12)
    for _ in range(150):
        sizes = [rng.randint(2, 12) for _ in range(rng.randint(2, 14))]
        first = best_fit(sizes, 20)
        bins = improve(first, sizes, 20)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert squared(bins, sizes) >= squared(first, sizes) and len(bins) <= len(first)
        if len(bins) > math.ceil(sum(sizes) / 20):
            assert all(squared(new, sizes) <= squared(bins, sizes) for new in neighbours(bins, sizes, 20))


def fewest(sizes, capacity):
    """The least number of bins, by trying all ways to deal the items out."""
    best = len(sizes)

    def deal(i, fills):
        nonlocal best
        if len(fills) >= best:
            return
        if i == len(sizes):
            best = len(fills)
            return
        for k in range(len(fills)):
            if fills[k] + sizes[i] <= capacity:
                deal(i + 1, [*fills[:k], fills[k] + sizes[i], *fills[k + 1 :]])
        deal(i + 1, [*fills, sizes[i]])

    deal(0, [])
    return best


def test_small_cases_beside_the_fewest_bins():
    rng = random.Random(13)
    reached = first_reached = 0
    for _ in range(120):
        sizes = sorted((rng.randint(3, 11) for _ in range(9)), reverse=True)
        least, found = fewest(sizes, 20), len(improve(best_fit(sizes, 20), sizes, 20))
        assert least <= found <= least + 1
        reached += found == least
        first_reached += len(best_fit(sizes, 20)) == least
    assert reached >= 118 and reached >= first_reached


def test_swaps_empty_bins():
    # best fit needs three bins; one exchange makes two of them
    assert len(improve([[0, 1], [2, 3], [4]], [6, 2, 5, 3, 4], 10)) == 2
    # two for one, one for two and a move
    assert len(improve([[0, 1, 2], [3, 4], [5]], [3, 3, 3, 7, 2, 2], 10)) == 2


def check(rows, texts, library, length):
    by, bins = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by) == set(texts)
    for k, pieces in by.items():
        ids, at = library.encode(texts[k] or "", add_special_tokens=False).ids + [2], 0
        for i, r in enumerate(sorted(pieces, key=lambda r: r["piece"])):
            own = np.array(ids[at : at + r["length"]], "<u4")
            assert (r["piece"], r["start"], r["ids_crc32"]) == (i, at, zlib.crc32(own.tobytes()))
            assert r["length"] == length or i == 0
            at += r["length"]
        assert at == len(ids)
    for places in bins.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        assert at <= length
    return len(bins)


@pytest.mark.parametrize("group", [20_000, 10])
def test_documents(spark, library, group):
    rng = random.Random(4)
    rows = [(i, sentence(rng, rng.randint(0, 90)), "en", "s", 1) for i in range(60)]
    got = packed(table(spark, rows), PATH, 64, group=group).collect()
    bins = check(got, {r[0]: r[1] for r in rows}, library, 64)
    assert bins <= math.ceil(sum(r["length"] for r in got) / 64) + math.ceil(len(got) / group) + 1


def test_edges(spark, library):
    texts = kept_texts(edge_rows())
    check(packed(edge_table(spark), PATH).collect(), texts, library, packing.LENGTH)
    assert packed(table(spark, []), PATH).count() == 0
