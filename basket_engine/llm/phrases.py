"""Phrase collocations: the best phrases of each language by a branch-and-bound growth of prefixes.

A phrase's score is that of its lowest-scoring cut, ``2000000 * a / (l + r)`` with ``a`` its
count and ``l`` and ``r`` those of the two parts. No part occurs less often than the phrase,
so no phrase that begins with the words ``u v`` scores above ``2000000 * f(u v) / (f(u) +
f(u v))``, and none that ends with them above the same with ``f(v)``. These bounds order the
frontier of word pairs. A round counts, in one pass over the texts, all longer phrases whose
pairs reach a language's threshold, and those that could hold such a phrase; a language is
settled when as many survivors as are wanted score at least its threshold, as nothing that is
not counted could score more. Otherwise the threshold falls, and the next round counts what
the lower threshold adds.

Words are numbers of 64 bits that stand for the language and the word; no two words share a
number, which is checked, so all counts are exact. Sets of pairs go to the tasks as bitmaps of
a bounded size. A bit that is set for another pair only makes a task count more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.indexing import ordinal_in_group
from ..session import stored
from .wordhash import WordHasher, mix, slices, text_buffers

TOP, LEAST, PERCENT = 2000, 30, 80
SCALE = 2_000_000
NO_LANGUAGE = "und"
#: Where pieces end, and what else parts words.
PIECE_ENDS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
#: Bits of a bitmap at most, and for each member of a smaller set.
MOST_BITS, BITS_EACH = 1 << 26, 16
#: Words that a task gathers before it counts them.
GATHERED = 1 << 19
#: Bytes of text whose words a task numbers at a time.
SLICE = 1 << 20
#: Pairs of a language in the first frontier for each phrase wanted, and how it grows by rounds.
FRONTIER, GROWTH = 4, 4
#: Tries to find numbers that tell all words apart.
TRIES = 20


class Numbers:
    """Words of (language, text) batches as numbers; another seed gives others."""

    def __init__(self, seed: int = 0, bits: int = 64):
        self.hasher = WordHasher(PIECE_ENDS + BLANKS)
        self.hasher.value = mix(self.hasher.value + np.uint64(seed))
        self.mask = np.uint64((1 << bits) - 1)
        self.ends = np.zeros(256, bool)
        self.ends[list(PIECE_ENDS)] = True
        self.salts: dict[str, int] = {}

    def of(self, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """(number, whether the next word follows in the same piece, index of the text, first
        byte, byte behind) of every word."""
        data, offsets = text_buffers(batch.column(1))
        h, doc, start, stop = self.hasher.spans(data, offsets)
        langs = batch.column(0).dictionary_encode()
        for name in langs.dictionary.to_pylist():
            if name not in self.salts:
                self.salts[name] = int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")
        salt = np.array([self.salts[name] for name in langs.dictionary.to_pylist()], np.uint64)
        number = mix(h + salt[langs.indices.to_numpy()][doc]) & self.mask
        follows = np.zeros(len(h), bool)
        if len(h):
            lo = int(offsets[0])
            ended = np.cumsum(self.ends[data[lo : int(offsets[-1])]])
            follows[:-1] = (doc[1:] == doc[:-1]) & (ended[start[1:] - lo] == ended[stop[:-1] - 1 - lo])
        return number, follows, doc, start, stop


def distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of a matrix of numbers, and how often each is there."""
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    values, dense = np.unique(rows, return_inverse=True)
    dense = dense.reshape(rows.shape)
    key = dense[:, 0]
    for c in range(1, rows.shape[1]):  # dense again before each column, so that no key overflows
        if c > 1:
            key = np.unique(key, return_inverse=True)[1]
        key = key * np.int64(len(values)) + dense[:, c]
    _, at, n = np.unique(key, return_index=True, return_counts=True)
    return rows[at], n


class Bitmap:
    """A set of pairs or single words with a bounded size; it may seem to hold more."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def cells(columns: list[np.ndarray], bits: int) -> np.ndarray:
        key = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + c)
        return key & np.uint64(bits - 1)

    def holds(self, *columns: np.ndarray) -> np.ndarray:
        cell = self.cells(list(columns), 64 * len(self.words))
        return (self.words[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63))) & np.uint64(1) > 0

    @staticmethod
    def of(members: DataFrame) -> "Bitmap":
        """Made of the rows of a table of numbers; what comes to the driver has a bounded size."""
        bits = 1 << 10
        n = members.count()
        while bits < MOST_BITS and bits < BITS_EACH * n:
            bits *= 2

        def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = np.unique(Bitmap.cells([c.to_numpy().view(np.uint64) for c in batch.columns], bits))
                if len(cell):
                    word, at = np.unique(cell >> np.uint64(6), return_index=True)
                    bit = np.bitwise_or.reduceat(np.uint64(1) << (cell & np.uint64(63)), at)
                    yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(bit.view(np.int64))], ["word", "bits"])

        found = members.mapInArrow(set_bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        words = np.zeros(bits // 64, np.uint64)
        words[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
        return Bitmap(words)


# What tasks count


def _words(seed: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, other = Numbers(seed, bits), Numbers(seed + TRIES).hasher
        for whole in batches:
            for batch in slices(whole, 1, most_bytes=SLICE):
                number, _, doc, start, stop = numbers.of(batch)
                data, offsets = text_buffers(batch.column(1))
                # words that share a number differ in a second one and stay apart
                again = other.words(data, offsets)[0]
                order = np.lexsort((again, number))
                number, again = number[order], again[order]
                new = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (again[1:] != again[:-1])]) if len(order) else order
                at, n = order[new], np.diff(np.r_[new, len(order)])
                words = [data[s:e].tobytes().lower() for s, e in zip(start[at].tolist(), stop[at].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc[at])), pa.array(number[new].view(np.int64)), pa.array(words, pa.binary()).cast(pa.string()), pa.array(n)],
                    ["lang", "g", "word", "n"],
                )

    return run


def _gathered(batches: Iterator[pa.RecordBatch], numbers: Numbers) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number, follows) of some million words at a time."""
    parts, size = [], 0
    for whole in batches:
        for batch in slices(whole, 1, most_bytes=SLICE):
            parts.append(numbers.of(batch)[:2])
            size += len(parts[-1][0])
            if size >= GATHERED:
                yield tuple(np.concatenate(x) for x in zip(*parts))
                parts, size = [], 0
    if size:
        yield tuple(np.concatenate(x) for x in zip(*parts))


def _counts(rows: np.ndarray, width: int) -> pa.RecordBatch:
    """(g1 ... of ``width`` columns, n) of the different rows; missing columns are null."""
    own, n = distinct(rows)
    columns = [pa.array(np.ascontiguousarray(own[:, c]).view(np.int64)) for c in range(rows.shape[1])]
    columns += [pa.nulls(len(own), pa.int64())] * (width - len(columns))
    return pa.RecordBatch.from_arrays([*columns, pa.array(n)], [*[f"g{c + 1}" for c in range(width)], "n"])


def _pairs(seed: int, bits: int, frequent: Bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, follows in _gathered(batches, Numbers(seed, bits)):
            often = frequent.holds(number)
            at = np.flatnonzero(follows[:-1] & often[:-1] & often[1:])
            yield _counts(np.stack([number[at], number[at + 1]], axis=1), 2)

    return run


def _longer(seed: int, bits: int, frequent: Bitmap, now: tuple[Bitmap, Bitmap], before: tuple[Bitmap, Bitmap] | None):
    """Three and four words in a row that the bitmaps (pairs that begin, and that end, a phrase)
    call for and those of the last round did not. Whether one is counted depends on its own
    words alone, so it is counted wherever it stands."""

    def chosen(a, b):
        three = a[:-1] | b[1:]
        four = (a[:-2] & b[2:]) | (a[1:-1] & b[2:]) | (a[:-2] & b[1:-1])
        return three, four

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, follows in _gathered(batches, Numbers(seed, bits)):
            if len(number) < 3:
                continue
            first, second = number[:-1], number[1:]
            pair = follows[:-1] & frequent.holds(first, second)
            at = np.flatnonzero(pair)

            def marked(bitmap: Bitmap) -> np.ndarray:
                out = np.zeros(len(pair) + 1, bool)  # one more, for the end
                out[at] = bitmap.holds(first[at], second[at])
                return out

            three, four = chosen(*map(marked, now))
            if before is not None:
                old_three, old_four = chosen(*map(marked, before))
                three, four = three & ~old_three, four & ~old_four
            pair = np.r_[pair, False]
            at = np.flatnonzero(three & pair[:-1] & pair[1:])
            yield _counts(np.stack([number[at + i] for i in range(3)], axis=1), 4)
            at = np.flatnonzero(four & pair[:-2] & pair[1:-1] & pair[2:])
            yield _counts(np.stack([number[at + i] for i in range(4)], axis=1), 4)

    return run


# Scores


def _exact(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(19,0)")


def _score(a: str, l: str, r: str) -> Column:  # noqa: E741
    """Whole number below SCALE * a / (l + r), in decimals as the product may pass 64 bits."""
    return F.expr(f"(CAST({SCALE} AS DECIMAL(7,0)) * CAST({a} AS DECIMAL(19,0))) DIV (CAST({l} AS DECIMAL(19,0)) + CAST({r} AS DECIMAL(19,0)))")


def _lowest(cuts: list[tuple[str, str]]) -> Column:
    """(score, k, l, r) of the lowest cut, the first of equal ones."""
    return F.array_min(F.array(*[
        F.struct(_score("n", l, r).alias("score"), F.lit(k + 1).alias("k"), F.col(l).alias("l"), F.col(r).alias("r")) for k, (l, r) in enumerate(cuts)
    ]))


def _with_cut(df: DataFrame, cuts: list[tuple[str, str]]) -> DataFrame:
    return df.withColumn("cut", _lowest(cuts)).select(*df.columns, "cut.score", "cut.l", "cut.r")


def _uncovered(phrases: DataFrame, keys: list[str], longer: DataFrame, percent: int) -> DataFrame:
    """Phrases that no phrase of one word more, before or behind, covers to ``percent``. One of
    two words more would hold one of one word more that is at least as frequent."""
    held = [longer.select(*[F.col(f"g{i + 1 + shift}").alias(k) for i, k in enumerate(keys)], "n") for shift in (0, 1)]
    most = held[0].unionByName(held[1]).groupBy(*keys).agg(F.max("n").alias("most"))
    covered = (_exact("most") * 100 >= _exact("n") * percent) & F.col("most").isNotNull()
    return phrases.join(most, keys, "left").where(~F.coalesce(covered, F.lit(False))).drop("most")


def _thresholds(pairs: DataFrame, wanted: int) -> DataFrame:
    """(lang, least): a score that the bounds of about ``wanted`` pairs of the language reach, 0
    if it has no more. At most a thousand sums a language are ordered."""
    step = SCALE // 2000
    bucket = F.least("ahead", "back").cast("long") / step
    sums = pairs.groupBy("lang", F.floor(bucket).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    upto = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("bucket"))))
    enough = F.max(F.when(F.col("upto") >= wanted, F.col("bucket") * step))
    return upto.groupBy("lang").agg(F.coalesce(enough, F.lit(0)).alias("least"))


def _vocabulary(texts: DataFrame, bits: int) -> tuple[DataFrame, int]:
    """(lang, g, word, n) of all words, and the seed under which no two share a number."""
    for seed in range(TRIES):
        found = texts.mapInArrow(_words(seed, bits), "lang string, g long, word string, n long")
        words = stored(found.groupBy("lang", "g", "word").agg(F.sum("n").alias("n")), "words")
        spelled = F.xxhash64("lang", "word")
        shared = words.groupBy("g").agg(F.min(spelled).alias("a"), F.max(spelled).alias("b")).where("a <> b")
        if not shared.take(1):
            return words, seed
    raise RuntimeError("no numbers tell the words apart")


def collocations(
    docs: DataFrame, top: int = TOP, least: int = LEAST, percent: int = PERCENT, lang_col: str = "lang", text_col: str = "text",
    frontier: int = FRONTIER, bits: int = 64,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    Texts, with A-Z as a-z, end in pieces at ``.,;:!?`` and line ends, and pieces part into words
    at blanks and tabs. A phrase has two to four words of a piece and occurs ``a >= least``
    times in its language, overlaps included; ``n`` counts all words of the language. ``l`` and
    ``r`` are the counts of the two parts at the cut of lowest score, the first of equal ones.
    A phrase is dropped if a longer one of ``least`` occurrences holds it and occurs
    ``percent`` in a hundred times as often or more. Ranks go by score, then ``a``, both
    falling, then the phrase in byte order. A null language is ``und``; a null or empty text
    has no words. Every row counts, repeated rows too, whatever its other columns say.

    ``frontier`` is the size of the first frontier for each phrase wanted; it decides how much
    is counted in how many rounds, not what is found.
    """
    texts = docs.select(F.coalesce(lang_col, F.lit(NO_LANGUAGE)).alias("lang"), F.col(text_col).alias("text")).where("text <> ''")
    words, seed = _vocabulary(texts, bits)
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n_words"))
    often = stored(words.where(F.col("n") >= least), "frequent-words")
    counted = texts.mapInArrow(_pairs(seed, bits, Bitmap.of(often.select("g"))), "g1 long, g2 long, n long")
    counted = counted.groupBy("g1", "g2").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    one = often.select(F.col("g").alias("g1"), F.col("n").alias("f1"), "lang")
    two = often.select(F.col("g").alias("g2"), F.col("n").alias("f2"))
    pairs = stored(counted, "frequent-pairs").join(one, "g1").join(two, "g2")
    pairs = pairs.withColumns({"ahead": _score("n", "f1", "n"), "back": _score("n", "f2", "n")})
    pairs = stored(_with_cut(pairs, [("f1", "f2")]), "pairs")
    frequent = Bitmap.of(pairs.select("g1", "g2"))

    limits, settled, three, four, before, wanted = None, None, None, None, None, frontier * top
    while True:
        lower = _thresholds(pairs, wanted)
        limits = stored(lower if limits is None else _lowered(limits, settled, lower), "thresholds")
        within = pairs.join(limits, "lang")
        now = tuple(Bitmap.of(within.where(F.col(c) >= F.col("least")).select("g1", "g2")) for c in ("ahead", "back"))
        grown = texts.mapInArrow(_longer(seed, bits, frequent, now, before), "g1 long, g2 long, g3 long, g4 long, n long")
        grown = stored(grown.groupBy("g1", "g2", "g3", "g4").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "grown")
        new_three, new_four = grown.where("g4 IS NULL").drop("g4"), grown.where("g4 IS NOT NULL")
        three = new_three if three is None else three.unionByName(new_three)
        four = new_four if four is None else four.unionByName(new_four)
        found = stored(_survivors(pairs, three, four, percent).join(limits, "lang").where("score >= least").drop("least"), "survivors")
        count = found.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).join(limits, "lang", "right")
        settled = stored(count.where((F.col("n") >= top) | (F.col("least") <= 0)).select("lang"), "settled")
        if not limits.join(settled, "lang", "left_anti").take(1):
            return _ranked(found, often, sizes, top)
        before, wanted = now, wanted * GROWTH


def _lowered(limits: DataFrame, settled: DataFrame, lower: DataFrame) -> DataFrame:
    """Lower thresholds for the languages that are not settled yet."""
    done = settled.withColumn("done", F.lit(True))
    both = limits.join(lower.withColumnRenamed("least", "lower"), "lang").join(done, "lang", "left")
    return both.select("lang", F.when(F.col("done"), F.col("least")).otherwise(F.least("least", "lower")).alias("least"))


def _survivors(pairs: DataFrame, three: DataFrame, four: DataFrame, percent: int) -> DataFrame:
    """(lang, g1 ... g4, n, score, l, r) of the phrases counted so far that no longer one covers."""
    first = pairs.select("g1", "g2", "lang", "f1", F.col("n").alias("f12"))
    last = pairs.select(F.col("g1").alias("g2"), F.col("g2").alias("g3"), F.col("n").alias("f23"), F.col("f2").alias("f3"))
    three = stored(three.join(first, ["g1", "g2"]).join(last, ["g2", "g3"]), "three")
    begin = three.select("g1", "g2", "g3", "lang", "f1", "f12", F.col("n").alias("f123"))
    end = three.select(
        F.col("g1").alias("g2"), F.col("g2").alias("g3"), F.col("g3").alias("g4"), F.col("n").alias("f234"), F.col("f23").alias("f34"), F.col("f3").alias("f4")
    )
    whole = four.join(begin, ["g1", "g2", "g3"]).join(end, ["g2", "g3", "g4"])
    shown = lambda df, k: df.select("lang", *[f"g{i + 1}" if i < k else F.lit(None).cast("long").alias(f"g{i + 1}") for i in range(4)], "n", "score", "l", "r")
    parts = [
        shown(_uncovered(pairs, ["g1", "g2"], three, percent), 2),
        shown(_uncovered(_with_cut(three, [("f1", "f23"), ("f12", "f3")]), ["g1", "g2", "g3"], four, percent), 3),
        shown(_with_cut(whole, [("f1", "f234"), ("f12", "f34"), ("f123", "f4")]), 4),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _ranked(found: DataFrame, words: DataFrame, sizes: DataFrame, top: int) -> DataFrame:
    """Numbered in their order over all tasks, as a language may have most of the phrases."""
    for i in range(1, 5):
        found = found.join(words.select(F.col("g").alias(f"g{i}"), F.col("word").alias(f"w{i}")), f"g{i}", "inner" if i < 3 else "left")
    found = found.select("lang", F.concat_ws(" ", *[f"w{i}" for i in range(1, 5)]).alias("phrase"), F.col("n").alias("a"), "l", "r", "score")
    falling = found.withColumns({"_score": -F.col("score"), "_a": -F.col("a")})
    best = ordinal_in_group(falling, ["lang"], ["_score", "_a", "phrase"], "place").where(F.col("place") < top)
    return best.join(sizes, "lang").select("lang", (F.col("place") + 1).alias("rank"), "phrase", "a", "l", "r", F.col("n_words").alias("n"), "score")
