"""Language-model scoring: an interpolated modified Kneser-Ney model of words and their spelling.

A token is a word, with A-Z as a-z, or the end of a text. The model predicts it from the token
before it. Its lower order tells how likely a token is after any other, from the number of
different tokens that it follows, and below that stands a Kneser-Ney model over the bytes of
single words, which gives every word a probability, unknown ones too.

Pairs are counted in Spark and written by tasks to the shared folder, as sorted arrays of
64-bit hashes with their counts; so are the tables of words and of the spelling. Tasks that score
texts map these files. What reaches the driver is a few totals, a sketch of a bounded size and the
names of files.
"""

from __future__ import annotations

import math
import shutil
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..session import scratch_path, stored
from ..sources.files import place, qualified, write_whole
from .documents import one_per_id
from .kneser_ney import discounts
from .wordhash import SPACES, WordHasher, mix, slices, text_buffers

#: Bytes of a spelled n-gram.
ORDER = 6
#: Symbols that are no bytes of a text; the three lowest bytes of a text count as 0x1A.
PAD, END, OTHER = 1, 2, 0x1A
#: Numbers of the tokens that are no words.
START_TOKEN, END_TOKEN = (np.uint64(int.from_bytes(x, "little")) for x in (b"<start>\x01", b"<ended>\x02"))
#: Pairs that a task gathers before it hands on their counts.
GATHERED = 1 << 20
#: Bytes of training text, about, whose pairs one task merges.
SHARD_BYTES = 8 << 20
#: Counts from this one on stand in a table of their own, all others in one byte.
MANY = 255
#: Cells of the sketch that finds tokens with very many pairs.
CELLS = 1 << 16
#: Bytes of text that a task works on at once.
SLICE = 2 << 20
_FLUSH = 1 << 21


def _masks(k: int) -> np.uint64:
    return np.uint64((1 << (8 * k)) - 1)


class Speller:
    """N-gram codes of texts: the last byte is predicted from those before it."""

    def __init__(self, order: int):
        self.order, self.hasher = order, WordHasher(SPACES)
        self.fold = np.arange(256, dtype=np.uint8)
        self.fold[65:91] += 32
        self.fold[:3] = OTHER

    def codes(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(code, index of the text) of every predicted symbol."""
        n, docs = self.order, len(column)
        data, offsets = text_buffers(column)
        _, doc, start, stop = self.hasher.spans(data, offsets)
        size = stop - start + 1  # with the blank or end behind it
        length = np.bincount(doc, size, docs).astype(np.int64)
        wordless = length == 0
        length[wordless] = 1
        first = np.cumsum(length + n - 1) - length  # of each text's own symbols
        out = np.full(int(first[-1] + length[-1]) if docs else 0, PAD, np.uint8)
        before = np.cumsum(size) - size
        doc_before = np.zeros(docs, np.int64)
        head = np.r_[True, doc[1:] != doc[:-1]] if len(doc) else np.zeros(0, bool)
        doc_before[doc[head]] = before[head]
        to = first[doc] + before - doc_before[doc]
        step = np.arange(int(size.sum())) - np.repeat(before, size)
        where = np.repeat(to, size) + step
        out[where] = self.fold[data[np.minimum(np.repeat(start, size) + step, max(len(data) - 1, 0))]] if len(where) else 0
        out[to + size - 1] = 0x20
        out[first + length - 1] = END
        code = np.zeros(len(out), np.uint64)
        for i in range(n):
            code[n - 1 :] |= out[n - 1 - i : len(out) - i].astype(np.uint64) << np.uint64(8 * i)
        own = np.repeat(first, length) + np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        return code[own], np.repeat(np.arange(docs), length)


class Numbers:
    """The tokens of text columns, as numbers; A-Z count as a-z, or as they stand."""

    def __init__(self, fold: bool = True):
        self.hasher = WordHasher(SPACES, fold)

    def read(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(before, token, text): a row for each token and the text that it is in."""
        return self._pairs(len(column), *self.hasher.words(*text_buffers(column)))

    @staticmethod
    def _pairs(docs: int, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.bincount(doc, minlength=docs)
        at = np.cumsum(n + 2) - (n + 2)
        line = np.empty(len(h) + 2 * docs, np.uint64)
        line[at], line[at + n + 1] = START_TOKEN, END_TOKEN
        line[np.arange(len(h)) + 2 * doc + 1] = h
        goes_on = np.ones(len(line), bool)
        goes_on[at + n + 1] = False
        begin = np.flatnonzero(goes_on)
        return line[begin], line[begin + 1], np.repeat(np.arange(docs), n + 1)


class Tokens(Numbers):
    """The tokens of text columns, as numbers and spelled."""

    def __init__(self, order: int):
        super().__init__()
        self.speller = Speller(order)

    def read(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """(before, token, text, words): a row for each token and the text that it is in. ``words`` has
        the spelling of each different number in ascending order, the end's being empty."""
        data, offsets = text_buffers(column)
        h, doc, first, stop = self.hasher.spans(data, offsets)
        docs = len(column)
        number, where = np.unique(h, return_index=True)
        place_ = np.searchsorted(number, END_TOKEN)
        spelled = [data[a:b].tobytes() for a, b in zip(first[where].tolist(), stop[where].tolist())]
        if docs and (place_ == len(number) or number[place_] != END_TOKEN):
            spelled.insert(int(place_), b"")
        return *self._pairs(docs, h, doc), pa.array(spelled, pa.binary()).view(pa.string())


def _cells(tokens: np.ndarray) -> np.ndarray:
    return (mix(tokens) & np.uint64(CELLS - 1)).astype(np.int64)


def _spelled_words(order: int):
    """Rows (kind, key, c): 0 for the n-grams of spelled words, each as often as its word; 1 for the
    cells of the tokens before others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(order)
        cells = np.zeros(CELLS, np.int64)
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def rows(kind: int, key: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(key), 1 << 16):
                part = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(key[part]), kind, np.int32)), pa.array(key[part].astype(np.int64)), pa.array(c[part])], ["kind", "key", "c"]
                )

        for whole in batches:
            for batch in slices(whole, 0, most_bytes=SLICE):
                before, token, _, words = tokens.read(batch.column(0))
                cells += np.bincount(_cells(before), minlength=CELLS)
                _, times = np.unique(token, return_counts=True)
                code, word = tokens.speller.codes(words)
                keys, where = np.unique(np.r_[keys, code], return_inverse=True)
                counts = np.bincount(where, np.r_[counts, times[word]]).astype(np.int64)
                if len(keys) > _FLUSH:
                    yield from rows(0, keys, counts)
                    keys, counts = keys[:0], counts[:0]
        yield from rows(0, keys, counts)
        used = np.flatnonzero(cells)
        yield from rows(1, used, cells[used])

    return run


def fit_spelling(counted: DataFrame, order: int = ORDER) -> DataFrame:
    """The model of spelled words, from n-gram codes of ``order`` bytes (key, c): rows (level, kind,
    key, value) with the log10 probability (``p``) of the n-grams of each length and the log10
    back-off weight (``g``) of the contexts that they have."""
    tables = {order: stored(counted.groupBy("key").agg(F.sum("c").alias("c")), "ngrams")}
    suffix = lambda k: F.col("key").bitwiseAND(F.lit((1 << (8 * k)) - 1))
    for k in range(order - 1, 0, -1):  # lower orders count what stood before, not occurrences
        tables[k] = stored(tables[k + 1].groupBy(suffix(k).alias("key")).agg(F.count(F.lit(1)).alias("c")), "ngrams")
    parts, lower = [], None
    for k in range(1, order + 1):
        few = tables[k].where("c <= 4").groupBy("c").count().collect()  # four rows
        d = discounts({r["c"]: r["count"] for r in few})
        context = F.shiftrightunsigned("key", 8)
        rows = tables[k].select("key", "c", context.alias("context"), F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2]).alias("d"))
        held = rows.groupBy("context").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("gamma"))
        rows = rows.join(held, "context")
        if lower is None:
            rows = rows.withColumn("below", F.lit(1 / 256))
        else:
            rows = rows.withColumn("short", suffix(k - 1)).join(lower, "short")
        p = F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("gamma") * F.col("below")
        done = stored(rows.select("key", p.alias("p")), "probabilities")
        lower = done.select(F.col("key").alias("short"), F.col("p").alias("below"))
        parts.append(done.select(F.lit(k).alias("level"), F.lit("p").alias("kind"), "key", F.log10("p").alias("value")))
        parts.append(held.select(F.lit(k).alias("level"), F.lit("g").alias("kind"), F.col("context").alias("key"), F.log10("gamma").alias("value")))
    return stored(reduce(DataFrame.unionByName, parts), "model")


# Sorted arrays in files


def _content(keys: np.ndarray, columns: list[np.ndarray]) -> bytes:
    return b"".join([keys.astype("<u8").tobytes(), *(c.tobytes() for c in columns)])


class MappedTable:
    """Sorted keys with their columns, in files that cover the range of keys one after the other.

    Files on a local or mounted file system are mapped as they are; others are copied to a file
    without a name first, which goes with the task.
    """

    def __init__(self, folder: str, files: list[tuple[int, int, str]], kinds: list[str]):
        self.kinds, self.files = kinds, []
        files = sorted((first % (1 << 64), n, name) for first, n, name in files)
        self.first = np.array([first for first, _, _ in files], np.uint64)
        for _, n, name in files:
            system, path = place(f"{folder}/{name}")
            if isinstance(system, pyarrow.fs.LocalFileSystem):
                file = path
            else:
                file = tempfile.TemporaryFile()
                with system.open_input_stream(path, compression=None) as source:
                    shutil.copyfileobj(source, file, 1 << 20)
                file.flush()
            arrays, at = [], 0
            for kind in ["<u8", *kinds]:
                arrays.append(np.memmap(file, kind, "r", at, (n,)))
                at += n * np.dtype(kind).itemsize
            self.files.append(arrays)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(found, columns) of sorted keys; columns are 0 where a key is missing."""
        found, out = np.zeros(len(keys), bool), [np.zeros(len(keys), kind) for kind in self.kinds]
        if not self.files:
            return found, out
        of = np.searchsorted(self.first, keys, "right") - 1
        edges = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True]) if len(keys) else []
        for lo, hi in zip(edges[:-1], edges[1:]):
            if of[lo] < 0:
                continue
            known, *columns = self.files[of[lo]]
            at = np.minimum(np.searchsorted(known, keys[lo:hi]), len(known) - 1)
            hit = known[at] == keys[lo:hi]
            found[lo:hi] = hit
            for own, column in zip(out, columns):
                own[lo:hi][hit] = column[at[hit]]
        return found, out


FILE = "first long, n long, file string"


def _written(folder: str, name: str, kinds: list[str]):
    """Writes the sorted rows (key, columns ...) of a partition to a file of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if parts:
            keys = np.concatenate([b.column(0).to_numpy() for b in parts]).view(np.uint64)
            columns = [np.concatenate([b.column(i).to_numpy() for b in parts]).astype(kind) for i, kind in enumerate(kinds, 1)]
            file = f"{name}-{TaskContext.get().partitionId():06d}"
            system, base = place(folder)
            write_whole(system, f"{base}/{file}", _content(keys, columns))
            yield pa.RecordBatch.from_arrays([pa.array(keys[:1].view(np.int64)), pa.array([len(keys)]), pa.array([file])], ["first", "n", "file"])

    return run


def _listed(files: DataFrame) -> list[tuple[int, int, str]]:
    return [(r["first"], r["n"], r["file"]) for r in files.collect()]


def written_table(table: DataFrame, folder: str, name: str, kinds: list[str], parts: int | None = None) -> list[tuple[int, int, str]]:
    """The rows (key, columns ...) in files by unsigned order of the keys, one for each part at most."""
    unsigned = F.col("key").bitwiseXOR(F.lit(-(1 << 63)))  # the sign bit flipped
    placed = table.repartitionByRange(*([parts] if parts else []), unsigned).sortWithinPartitions(unsigned)
    return _listed(placed.mapInArrow(_written(folder, name, kinds), FILE))


@dataclass
class Spelling:
    """The mapped model of spelled words."""

    order: int
    probability: dict[int, MappedTable]
    backoff: dict[int, MappedTable]

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """Log probability of each n-gram's last byte; codes are sorted and have ``order`` bytes."""
        out, open_ = np.zeros(len(codes)), np.arange(len(codes))

        def found(table: MappedTable | None, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if table is None:
                return np.zeros(len(part), bool), np.zeros(len(part))
            key, where = np.unique(part, return_inverse=True)
            hit, (value,) = table.find(key)
            return hit[where], value[where]

        for k in range(self.order, 0, -1):
            part = codes[open_] & _masks(k)
            hit, value = found(self.probability.get(k), part)
            out[open_[hit]] += value[hit]
            open_, part = open_[~hit], part[~hit]
            out[open_] += found(self.backoff.get(k), part >> np.uint64(8))[1]
        out[open_] += math.log10(1 / 256)
        return out

    def words(self, speller: Speller, words: pa.Array) -> np.ndarray:
        """The probability of each word, bytes and end."""
        code, of = speller.codes(words)
        distinct, where = np.unique(code, return_inverse=True)
        return 10.0 ** np.bincount(of, self.log10(distinct)[where], len(words))


# Pairs of tokens


class PairKeys:
    """Numbers of pairs, dealt to shards by their first bits.

    All pairs of a token have the same shard, so that a task sees what follows it; those of
    tokens in a cell of the sketch with very many pairs are spread.
    """

    def __init__(self, bits: int, hot: np.ndarray):
        self.bits, self.hot = bits, hot

    def shard(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        spread = self.hot[_cells(before)]
        return np.where(spread, mix(token ^ (before * np.uint64(3))), mix(before)) >> np.uint64(64 - self.bits)

    def key(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        both = mix(mix(before) + token * np.uint64(0x9E3779B97F4A7C15))
        return (self.shard(before, token) << np.uint64(64 - self.bits)) | (both >> np.uint64(self.bits))


BLOBS = "shard int, v binary, run binary, w binary, c binary"


def _pair_blobs(keys: PairKeys, fold: bool):
    """The pairs of some million tokens, counted: a row for each shard with the tokens before, how
    many different ones follow each, these and their counts."""

    def counted(v: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
        shard = keys.shard(v, w)
        order_ = np.lexsort((w, v, shard))
        shard, v, w = shard[order_], v[order_], w[order_]
        new = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (w[1:] != w[:-1]) | (shard[1:] != shard[:-1])])
        c = np.diff(np.r_[new, len(v)]).astype(np.uint32)
        shard, v, w = shard[new], v[new], w[new]
        cuts = np.r_[np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]), len(shard)]
        rows = []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            head = np.flatnonzero(np.r_[True, v[lo + 1 : hi] != v[lo : hi - 1]])
            run = np.diff(np.r_[head, hi - lo]).astype(np.uint32)
            rows.append((int(shard[lo]), v[lo:hi][head].tobytes(), run.tobytes(), w[lo:hi].tobytes(), c[lo:hi].tobytes()))
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["shard", "v", "run", "w", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, parts, size = Numbers(fold), [], 0
        for whole in batches:
            for batch in slices(whole, 0, most_bytes=SLICE):
                parts.append(tokens.read(batch.column(0))[:2])
                size += len(parts[-1][0])
                if size >= GATHERED:
                    yield counted(*(np.concatenate(x) for x in zip(*parts)))
                    parts, size = [], 0
        if size:
            yield counted(*(np.concatenate(x) for x in zip(*parts)))

    return run


MERGED = f"kind int, g long, a long, b long, c long, d long, {FILE}"


def _merged(folder: str, keys: PairKeys):
    """The pairs of a shard as a file, and rows by kind: 0 a token before others (how often, and how
    many follow it once, twice and more), 1 a token after others (after how many, and how
    often), 2 the numbers of pairs with counts 1 to 4, 3 the file, 4 that of the high counts."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        read = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in group[name]])
        v, w, c = np.repeat(read("v", np.uint64), read("run", np.uint32)), read("w", np.uint64), read("c", np.uint32)
        order = np.lexsort((w, v))
        v, w, c = v[order], w[order], c[order].astype(np.int64)
        new = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (w[1:] != w[:-1])])
        c = np.add.reduceat(c, new)
        v, w = v[new], w[new]
        key = keys.key(v, w)
        sort = np.argsort(key)
        shard, files = int(group["shard"].iloc[0]), []
        system, base = place(folder)
        high = sort[c[sort] >= MANY]
        for kind, name, rows, count in ((3, "pairs", sort, np.minimum(c, MANY).astype("u1")), (4, "many", high, np.minimum(c, 2**32 - 1).astype("<u4"))):
            if len(rows):
                write_whole(system, f"{base}/{name}-{shard:08d}", _content(key[rows], [count[rows]]))
                files.append({"kind": kind, "first": int(key[rows[0]].view(np.int64)), "n": len(rows), "file": f"{name}-{shard:08d}"})
        head = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        total = [np.add.reduceat(x, head) for x in (c, c == 1, c == 2, c > 2)]
        tokens, of = np.unique(w, return_inverse=True)
        few = np.bincount(np.minimum(c, 5), minlength=6)
        none = lambda n: np.zeros(n, np.int64)
        frames = [
            pd.DataFrame({"kind": 0, "g": v[head].view(np.int64), **dict(zip("abcd", (x.astype(np.int64) for x in total)))}),
            pd.DataFrame({"kind": 1, "g": tokens.view(np.int64), "a": np.bincount(of), "b": np.bincount(of, c).astype(np.int64), "c": none(len(tokens)), "d": none(len(tokens))}),
            pd.DataFrame({"kind": [2], "g": [0], **{x: [int(few[i])] for i, x in enumerate("abcd", 1)}}),
        ]
        for frame in frames:
            frame["first"], frame["n"], frame["file"] = 0, 0, None
        listed = pd.DataFrame(files).assign(**{x: 0 for x in "gabcd"})
        return pd.concat([*frames, listed[frames[0].columns]], ignore_index=True)

    return run


@dataclass
class Counted:
    """The counted pairs of some texts: a row for each token, and the constants of their model."""

    files: dict[str, list[tuple[int, int, str]]]  # pairs and their high counts
    #: ``g``; how often before others (``a``) and how many follow it once, twice and more
    #: (``b``, ``c``, ``d``); after how many different ones (``follows``) and how often (``times``)
    words: DataFrame
    discount: tuple[float, float, float]
    gamma: Column  # the weight of the lower order after a token, 0 if it is never before others
    cut: Column  # what is taken off ``follows``
    pairs: int
    held: float
    tokens: int
    types: int


def count_pairs(texts: DataFrame, folder: str, keys: PairKeys, fold: bool = True) -> Counted:
    """The pairs of the column ``text``, in files of the folder."""
    blobs = texts.select("text").mapInArrow(_pair_blobs(keys, fold), BLOBS)
    merged = stored(blobs.groupBy("shard").applyInPandas(_merged(folder, keys), MERGED), "pairs")
    files = {name: _listed(merged.where(F.col("kind") == kind).select("first", "n", "file")) for kind, name in ((3, "pairs"), (4, "many"))}
    few = merged.where("kind = 2").agg(*[F.sum(x).alias(x) for x in "abcd"]).first()
    d2 = discounts({i: few[x] or 0 for i, x in enumerate("abcd", 1)})
    before = lambda x: F.sum(F.when(F.col("kind") == 0, F.col(x)).otherwise(0)).alias(x)
    after = lambda x, name: F.sum(F.when(F.col("kind") == 1, F.col(x)).otherwise(0)).alias(name)
    words = stored(
        merged.where("kind < 2").groupBy("g").agg(*[before(x) for x in "abcd"], after("a", "follows"), after("b", "times")), "words"
    )
    d1 = discounts({r["follows"]: r["count"] for r in words.where("follows BETWEEN 1 AND 4").groupBy("follows").count().collect()})
    cut = F.when(F.col("follows") == 0, 0.0).when(F.col("follows") == 1, d1[0]).when(F.col("follows") == 2, d1[1]).otherwise(d1[2])
    whole = words.agg(
        F.sum("follows").alias("pairs"), F.sum(cut).alias("held"), F.sum("times").alias("tokens"), F.count(F.when(F.col("times") > 0, 1)).alias("types")
    ).first()
    gamma = (F.col("b") * d2[0] + F.col("c") * d2[1] + F.col("d") * d2[2]) / F.nullif("a", F.lit(0))
    return Counted(
        files, words, d2, F.coalesce(gamma, F.lit(0.0)), cut, whole["pairs"] or 0, whole["held"] or 0.0, whole["tokens"] or 0, whole["types"] or 0
    )


def _counted_cells(fold: bool):
    """Rows (key, c): the cells of the tokens before others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, cells = Numbers(fold), np.zeros(CELLS, np.int64)
        for whole in batches:
            for batch in slices(whole, 0, most_bytes=SLICE):
                cells += np.bincount(_cells(tokens.read(batch.column(0))[0]), minlength=CELLS)
        used = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(cells[used])], ["key", "c"])

    return run


def pair_keys(texts: DataFrame, cells: DataFrame | None = None, fold: bool = True) -> PairKeys:
    """Shards for the pairs of the column ``text``, given the cells (key, c) where they are counted."""
    if cells is None:
        cells = texts.select("text").mapInArrow(_counted_cells(fold), "key long, c long")
    sketch = cells.groupBy("key").agg(F.sum("c").alias("c")).toArrow()  # CELLS rows at most
    sizes = np.zeros(CELLS, np.int64)
    sizes[sketch["key"].to_numpy()] = sketch["c"].to_numpy()
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(2, math.ceil(math.log2(max(1, size / SHARD_BYTES))))
    return PairKeys(bits, sizes > max(1, sizes.sum() / (1 << bits)))


class PairCounts:
    """The mapped counts of pairs; ``many`` stands for those in a table of their own."""

    def __init__(self, folder: str, files: dict[str, list[tuple[int, int, str]]], many: int):
        self.few, self.high, self.many = MappedTable(folder, files["pairs"], ["u1"]), MappedTable(folder, files["many"], ["<u4"]), many

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The counts of keys in any order, 0 for a missing one."""
        key, where = np.unique(keys, return_inverse=True)
        c = self.few.find(key)[1][0].astype(np.float64)
        high = np.flatnonzero(c == self.many)
        c[high] = self.high.find(key[high])[1][0]
        return c[where]


def interpolated(c: np.ndarray, discount: tuple[float, float, float], seen: np.ndarray, gamma: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The probability of tokens after others, from their pairs' counts, how often these stand before
    any token, the weight that they leave to the lower order, and that order's probability."""
    d = np.array([0.0, *discount])
    higher = np.maximum(c - d[np.minimum(c, 3).astype(np.int64)], 0.0) / np.maximum(seen, 1.0)
    return np.where(seen > 0, higher + gamma * low, low)


@dataclass
class WordModel:
    """What a scoring task needs to map the model, and its constants."""

    folder: str
    order: int
    keys: PairKeys
    files: dict[str, list[tuple[int, int, str]]]
    discount: tuple[float, float, float]
    unseen: float  # the weight of the spelling in the lower order
    tokens: int
    types: int


WORD_COLUMNS = ["<f8", "<f8", "<f8", "<f8"]  # count, how often before others, weight of the lower order, its share


def fit(texts: DataFrame, order: int = ORDER) -> WordModel:
    """The model of the texts (column ``text``), its tables in files of the scratch folder."""
    if not 2 <= order <= 7:
        raise ValueError("an n-gram code holds 2 to 7 bytes")
    spark = texts.sparkSession
    folder = qualified(spark, scratch_path(spark, "language-model"))
    texts = texts.select(F.coalesce("text", F.lit("")).alias("text"))
    seen = stored(texts.mapInArrow(_spelled_words(order), "kind int, key long, c long"), "spelled")
    keys = pair_keys(texts, seen.where("kind = 1").select("key", "c"))

    files: dict[str, list] = {}
    spelling = fit_spelling(seen.where("kind = 0").select("key", "c"), order)
    for k in range(1, order + 1):
        for kind in ("p", "g"):
            part = spelling.where((F.col("level") == k) & (F.col("kind") == kind)).select("key", "value")
            part = part.repartitionByRange("key").sortWithinPartitions("key")
            files[f"{kind}{k}"] = _listed(part.mapInArrow(_written(folder, f"spelling-{kind}{k}", ["<f8"]), FILE))

    counted = count_pairs(texts, folder, keys)
    files |= counted.files
    cut, pairs = counted.cut, counted.pairs or 1
    table = counted.words.select(
        F.col("g").alias("key"), F.col("times").cast("double").alias("times"), F.col("a").cast("double").alias("before"),
        counted.gamma.alias("gamma"), (F.greatest(F.col("follows") - cut, F.lit(0.0)) / pairs).alias("low"),
    )
    files["words"] = written_table(table, folder, "words", WORD_COLUMNS)
    unseen = counted.held / pairs if counted.pairs else 1.0
    return WordModel(folder, order, keys, files, counted.discount, unseen, counted.tokens, counted.types)


def _scores(model: WordModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(model.order)
        mapped = lambda name, kinds: MappedTable(model.folder, model.files[name], kinds)
        levels = range(1, model.order + 1)
        spelling = Spelling(model.order, {k: mapped(f"p{k}", ["<f8"]) for k in levels}, {k: mapped(f"g{k}", ["<f8"]) for k in levels})
        words, pairs = mapped("words", WORD_COLUMNS), PairCounts(model.folder, model.files, MANY)
        for whole in batches:
            for batch in slices(whole, 1, most_bytes=SLICE):
                v, w, doc, spelled = tokens.read(batch.column(1))
                number, which = np.unique(w, return_inverse=True)
                _, (times, _, _, low) = words.find(number)
                low = low + model.unseen * spelling.words(tokens.speller, spelled)
                base = np.log10((times + 1) / (model.tokens + model.types + 1))
                first, of = np.unique(v, return_inverse=True)
                _, (_, before, gamma, _) = words.find(first)
                p = interpolated(pairs.find(model.keys.key(v, w)), model.discount, before[of], gamma[of], low[which])
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(np.bincount(doc, minlength=n)), pa.array(np.bincount(doc, (times > 0)[which], n).astype(np.int64)),
                     pa.array(np.bincount(doc, base[which], n)), pa.array(np.bincount(doc, np.log10(p), n))],
                    ["id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )

    return run


def language_model_scores(
    docs: DataFrame, held_out: Column, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity), one row
    per document.

    ``held_out`` is a condition on the id; the model and the base learn from all other
    documents. Tokens are the words between ASCII white space, with A-Z as a-z, and an end. ``score``
    is the text's log10 probability; ``base_score`` that of single words with one added to every
    count. A null text is an empty one, whose only token is the end. Without any training
    document all bytes are equally likely. In the spelling the bytes 0 to 2 count as 0x1A. A
    task's memory grows with its longest text. For null and repeated ids see ``one_per_id``;
    repeated texts count as often as they occur.
    """
    kept = one_per_id(docs.select(id_col, F.col(text_col).alias("text")), id_col)
    kept = kept.select(F.col(id_col).alias("id"), F.coalesce("text", F.lit("")).alias("text"), held_out.alias("held_out"))
    model = fit(kept.where(~F.col("held_out")).select("text"), order)
    kind = kept.schema["id"].dataType.simpleString()
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scores = kept.select("id", "text", "held_out").mapInArrow(_scores(model), schema)
    return scores.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
