"""Periodic runs of words, found through suffix trees, and texts with their runs collapsed.

A run is a maximal stretch of words with a smallest period. Every run holds a Lyndon word of
its period's length that is the longest Lyndon word where it starts, in one of the two orders
of the alphabet. So two candidates for each word are enough: each is extended to the right by
the longest common extension in the suffix tree of the words, and to the left by that in the
tree of the words read backwards. Trees are built by Ukkonen's algorithm, and an extension is
the depth of a lowest common ancestor, a minimum over the Euler tour in constant time.

Runs of ``exponent`` periods at least hold each of their words that often. A document is
therefore first cut at words that are too rare for that, again and again until nothing is
left to cut; no run crosses a cut, and trees are built for what remains.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .documents import one_per_id
from .wordhash import slices

LENGTH, EXPONENT = 6, 4
_BLOCK = 16


class EulerTour:
    """Least depth between any two places of a tour, in constant time and linear memory."""

    def __init__(self, depths: np.ndarray):
        blocks = -(-len(depths) // _BLOCK)
        padded = np.full(blocks * _BLOCK, np.iinfo(np.int32).max, np.int32)
        padded[: len(depths)] = depths
        self.depths, cells = padded, padded.reshape(blocks, _BLOCK)
        self.upto = np.minimum.accumulate(cells, axis=1).ravel()
        self.since = np.minimum.accumulate(cells[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [cells.min(axis=1)]
        while (step := 1 << (len(self.levels) - 1)) * 2 <= blocks:
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        first, last = lo // _BLOCK, hi // _BLOCK
        out = np.minimum(self.since[lo], self.upto[hi])
        inside = np.flatnonzero(first == last)
        if len(inside):
            at = lo[inside, None] + np.arange(_BLOCK)
            near = self.depths[np.minimum(at, len(self.depths) - 1)]
            out[inside] = np.where(at <= hi[inside, None], near, np.iinfo(np.int32).max).min(axis=1)
        n = last - first - 1
        level = np.frexp(np.maximum(n, 1).astype(np.float64))[1] - 1
        for k in np.unique(level[n > 0]):
            i = np.flatnonzero((n > 0) & (level == k))
            table = self.levels[k]
            out[i] = np.minimum(out[i], np.minimum(table[first[i] + 1], table[last[i] - (1 << int(k))]))
        return out


class SuffixTree:
    """The suffix tree of symbols from 1 on, closed by a 0: ranks of its suffixes and their
    common extensions. The tree itself is dropped once its tour is known."""

    def __init__(self, symbols: list[int]):
        text = [*symbols, 0]
        self._build(text)
        self._walk(len(text))
        del self.child, self.start, self.stop

    def _build(self, text: list[int]) -> None:
        n, width = len(text), max(text) + 1
        start, stop, link, child = [0], [0], [0], {}
        node = edge = length = waiting = 0
        for i, c in enumerate(text):
            waiting, split = waiting + 1, 0
            while waiting:
                if not length:
                    edge = i
                key = node * width + text[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(start)
                    start.append(i), stop.append(n), link.append(0)
                    if split:
                        link[split], split = node, 0
                else:
                    begin = start[below]
                    size = min(stop[below], i + 1) - begin
                    if length >= size:  # go down first
                        node, edge, length = below, edge + size, length - size
                        continue
                    if text[begin + length] == c:
                        length += 1
                        if split:
                            link[split] = node
                        break
                    middle = child[key] = len(start)
                    start.append(begin), stop.append(begin + length), link.append(0)
                    child[middle * width + c] = middle + 1
                    start.append(i), stop.append(n), link.append(0)
                    start[below] = begin + length
                    child[middle * width + text[begin + length]] = below
                    if split:
                        link[split] = middle
                    split = middle
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length, edge = length - 1, i - waiting + 1
        self.child, self.start, self.stop, self.width = child, start, stop, width

    def _walk(self, n: int) -> None:
        keys = np.fromiter(self.child.keys(), np.int64, len(self.child))
        order = np.argsort(keys)
        below = np.fromiter(self.child.values(), np.int64, len(keys))[order]
        above = keys[order] // self.width
        at = np.searchsorted(above, np.arange(len(self.start) + 1)).tolist()
        # the closing 0 is the least symbol in either order of the others
        flipped = below.copy()
        closing = keys[order] % self.width == 0
        group = np.searchsorted(above, above)
        size = np.diff(at)[above]
        place = np.where(closing, group, 2 * group + size - 1 - np.arange(len(above)) + closing[group])
        flipped[place] = below
        start, stop, below, flipped = self.start, self.stop, below.tolist(), flipped.tolist()
        depth, tour, first = [0] * len(start), [], np.zeros(n, np.int64)
        stack = [0]
        while stack:
            v = stack.pop()
            if v < 0:  # back from a child
                tour.append(~v)
                continue
            d, lo, hi = depth[v], at[v], at[v + 1]
            if lo == hi:
                first[n - d] = len(tour)
            tour.append(d)
            for c in below[lo:hi][::-1]:
                depth[c] = d + stop[c] - start[c]
                stack.append(~d)
                stack.append(c)
        leaves, stack = [], [0]
        while stack:
            v = stack.pop()
            lo, hi = at[v], at[v + 1]
            if lo == hi:
                leaves.append(n - depth[v])
            stack += flipped[lo:hi][::-1]
        self.first, self.tour = first, EulerTour(np.array(tour, np.int32))
        self.flipped_rank = np.zeros(n, np.int64)
        self.flipped_rank[leaves] = np.arange(n)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at ``a`` and ``b``, two different places, share."""
        return self.tour.least(self.first[a], self.first[b]).astype(np.int64)


def lyndon_lengths(rank: list[int]) -> np.ndarray:
    """Length of the longest Lyndon word at each place: up to the next smaller suffix."""
    n = len(rank)
    out, stack = np.zeros(n, np.int64), []
    ends = out.tolist()
    for i in range(n - 1, -1, -1):
        r = rank[i]
        while stack and rank[stack[-1]] > r:
            stack.pop()
        ends[i] = stack[-1] if stack else n
        stack.append(i)
    return np.array(ends, np.int64) - np.arange(n)


def all_runs(symbols: list[int], length: int = LENGTH, exponent: int = EXPONENT) -> np.ndarray:
    """(start, length, period) of every run of at least ``length`` symbols and ``exponent``
    (two or more) periods, sorted."""
    n = len(symbols)
    ahead = SuffixTree(symbols)
    lyndon = [lyndon_lengths(rank[:n].tolist()) for rank in (ahead.first, ahead.flipped_rank)]
    at = np.concatenate([np.arange(n)] * 2)
    period = np.concatenate(lyndon)
    at, period = np.unique(np.stack([at, period])[:, exponent * period <= n], axis=1)
    right = ahead.common(at, at + period)
    del ahead
    back = SuffixTree(symbols[::-1])
    left = back.common(n - at, n - at - period)
    found = np.stack([at - left, left + period + right, period])
    return np.unique(found[:, found[1] >= np.maximum(length, exponent * period)], axis=1).T


def stretches(ids: np.ndarray, length: int = LENGTH, exponent: int = EXPONENT) -> list[tuple[int, int]]:
    """Parts (first, behind) of the document outside which no run reaches: each of their words
    occurs ``exponent`` times or more in them, and they have ``length`` words at least."""
    at, size = np.flatnonzero(np.bincount(ids)[ids] >= exponent), -1
    while len(at) and size != len(at):
        size = len(at)
        part = np.cumsum(np.r_[0, np.diff(at) != 1])
        at = at[np.bincount(part)[part] >= length]
        if not len(at):
            break
        part = np.cumsum(np.r_[0, np.diff(at) != 1])
        key = part * (int(ids.max()) + 1) + ids[at]
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        at = at[count[which] >= exponent]
    if not len(at):
        return []
    breaks = np.flatnonzero(np.diff(at) != 1)
    return list(zip(at[np.r_[0, breaks + 1]].tolist(), (at[np.r_[breaks, len(at) - 1]] + 1).tolist()))


def runs_of(words: list[bytes], length: int = LENGTH, exponent: int = EXPONENT) -> np.ndarray:
    """The runs of a document, by start and then period."""
    if len(words) < max(length, exponent):
        return np.zeros((0, 3), np.int64)
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    out = [np.zeros((0, 3), np.int64)]
    for lo, hi in stretches(ids, length, exponent):
        _, symbols = np.unique(ids[lo:hi], return_inverse=True)
        out.append(all_runs((symbols + 1).tolist(), length, exponent) + np.array([lo, 0, 0]))
    found = np.concatenate(out)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _found(length: int, exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                sizes, counts, runs, texts = [], [], [], []
                for text in batch.column(1).cast(pa.binary()).to_pylist():
                    words = (text or b"").split()
                    found = runs_of(words, length, exponent)
                    keep = np.ones(len(words), bool)
                    for start, size, period in found.tolist():
                        keep[start + period : start + size] = False
                    sizes.append(len(words)), counts.append(len(found)), runs.append(found)
                    texts.append(b" ".join(words if keep.all() else compress(words, keep.tolist())))
                flat = np.concatenate(runs)
                fields = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), fields)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int64()), lists, pa.array(texts, pa.binary()).cast(pa.string())],
                    ["id", "n_words", "runs", "collapsed"],
                )

    return run


def periodic_runs(
    docs: DataFrame, length: int = LENGTH, exponent: int = EXPONENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_words, runs, collapsed), one row per document.

    Words are split at ASCII white space and kept as they are. ``runs`` has (start, length,
    period) of every stretch of ``length`` words and ``exponent`` (two or more) smallest
    periods at least that no neighbouring word extends, by start and then period. In
    ``collapsed`` each run keeps its first period only, and words stand one blank apart. A
    null or empty text has no words, no runs and an empty ``collapsed``. Documents are worked
    on one by one where they are, without a shuffle; a task's memory grows with its longest
    text, and most with the longest stretch of that text whose words all repeat. For null and
    repeated ids see ``one_per_id``.
    """
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    kept = one_per_id(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id")
    kind = kept.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return kept.mapInArrow(_found(length, exponent), schema).withColumnRenamed("id", id_col)


def longest(runs: str | Column) -> Column:
    """The longest run of an array; of equally long ones the first, then that of least period."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"], (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    return F.struct((-best["s"]).alias("start"), best["length"].alias("length"), (-best["p"]).alias("period"))


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text), with a run at the end of about every tenth document.

    Where h = crc32 of the decimal id is divisible by ten, the text has n > 0 words and g is
    h // 10, the words from a = g % n on repeat those of the period 1 + (n - a) // (3 + g % 8).
    Other texts stay as they are.
    """
    h = F.crc32(F.col("id").cast("string"))
    g = F.floor(h / 10).cast("long")
    n = F.size("_words").cast("long")
    a = F.pmod(g, F.greatest(n, F.lit(1)))
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("long")
    again = F.flatten(F.array_repeat(F.slice("_words", F.col("_a") + 1, F.col("_p")), F.ceil((F.col("_n") - F.col("_a")) / F.col("_p")).cast("int")))
    repeated = F.concat(F.slice("_words", F.lit(1), F.col("_a")), F.slice(again, F.lit(1), F.col("_n") - F.col("_a")))
    df = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chosen = F.when(F.pmod(h, F.lit(10)) == 0, F.regexp_extract_all("text", F.lit(r"([^ \t-\r]+)"), 1))
    df = df.withColumn("_words", chosen).withColumns({"_n": n.cast("int"), "_a": a.cast("int"), "_p": p.cast("int")})
    text = F.when(F.col("_n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text"))
    return df.select(F.col("id").alias(id_col), text.alias(text_col))
