"""Best-fit packing of token pieces into sequences, improved by swaps.

Documents are tokenized and cut where they are; only piece lengths are grouped and packed.
Pieces are dealt by hash to groups of a bounded number, and each group is packed on its own,
which leaves one underfull sequence or so for each group.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import stored
from .bpe import TokenEncoder
from .documents import one_per_id
from .wordhash import slices

LENGTH = 1024
END_ID = 2
#: Pieces that one task packs, about.
GROUP = 20_000


def _cut(path: str, length: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TokenEncoder(path)
        for whole in batches:
            for batch in slices(whole, 1, most_bytes=2 << 20):
                rows, piece, start, size, crc = [], [], [], [], []
                texts = [t or "" for t in batch.column(1).to_pylist()]
                for row, ids in enumerate(encoder.encode(texts)):
                    ids = np.append(ids, end_id).astype("<u4")
                    at, k = 0, 0
                    to = (len(ids) - 1) % length + 1
                    while at < len(ids):
                        rows.append(row), piece.append(k), start.append(at), size.append(to - at)
                        crc.append(zlib.crc32(ids[at:to]))
                        at, to, k = to, to + length, k + 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                     *(pa.array(x, pa.int64()) for x in (start, size, crc))],
                    ["id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: largest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fitting = rooms >> sizes[i]
        if fitting:
            room = sizes[i] + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        left = room - sizes[i]
        by_room[left].append(b)
        rooms |= 1 << left
    return bins


def _singles(items: list[int], sizes: list[int]) -> int:
    """The sizes of a bin's items as bits."""
    out = 0
    for i in items:
        out |= 1 << sizes[i]
    return out


def _doubles(items: list[int], sizes: list[int]) -> int:
    """The sums of two items of a bin as bits."""
    out = seen = 0
    for i in items:
        out |= seen << sizes[i]
        seen |= 1 << sizes[i]
    return out


def _bits(mask: int) -> Iterator[int]:
    """Set bits from the highest on."""
    while mask:
        yield (at := mask.bit_length() - 1)
        mask ^= 1 << at


class Underfull:
    """Which underfull bins hold one item, or two, of a total size, the emptiest first."""

    def __init__(self, capacity: int):
        self.heaps = [[[] for _ in range(capacity + 1)] for _ in range(2)]
        self.present = [0, 0]
        self.version: dict[int, int] = {}
        self.fits = (1 << (capacity + 1)) - 1

    def put(self, b: int, fill: int, masks: tuple[int, int]) -> None:
        """The bin as it is now; what was known of it before no longer counts."""
        version = self.version[b] = self.version.get(b, -1) + 1
        for k in range(2):
            for size in _bits(masks[k] & self.fits):
                heappush(self.heaps[k][size], (fill, b, version))
            self.present[k] |= masks[k] & self.fits

    def drop(self, b: int) -> None:
        self.version[b] = self.version.get(b, -1) + 1

    def emptiest(self, k: int, size: int, but: int) -> tuple[int, int] | None:
        """(fill, bin) of another bin than ``but`` with ``k + 1`` items of this size."""
        heap, aside, out = self.heaps[k][size], None, None
        while heap:
            fill, b, version = heap[0]
            if self.version[b] != version:
                heappop(heap)
            elif b == but:
                aside = heappop(heap)
            else:
                out = fill, b
                break
        if aside:
            heappush(heap, aside)
        if not heap:
            self.present[k] &= ~(1 << size)
        return out


def _pick(items: list[int], sizes: list[int], size: int, k: int) -> tuple[int, ...]:
    """One item, or two, of this size."""
    if k == 0:
        return (next(i for i in items if sizes[i] == size),)
    at: dict[int, int] = {}
    for i in items:
        if size - sizes[i] in at:
            return at[size - sizes[i]], i
        at[sizes[i]] = i
    raise AssertionError("no such items")


def improve(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Swap-based local search between underfull bins.

    A move of an item, or an exchange of one for one, two for one or one for two between two
    bins is made if it raises the sum of squared fills; of those that a bin could take the one
    that raises it most. Every underfull bin receives and gives, again and again, until no such
    step is left or as few bins are left as the total size needs. Sums of squares only grow,
    so this ends. Bins that get empty are dropped.
    """
    bins = [list(b) for b in bins]
    fill = [sum(sizes[i] for i in b) for b in bins]
    least, count = math.ceil(sum(fill) / capacity), sum(map(bool, bins))
    masks = {}
    known = Underfull(capacity)

    def placed(b: int) -> None:
        if 0 < fill[b] < capacity:
            masks[b] = _singles(bins[b], sizes), _doubles(bins[b], sizes)
            known.put(b, fill[b], masks[b])
        else:
            known.drop(b)

    def step(b: int) -> tuple | None:
        """(rise, giver, size and kind given, size and kind given back) of the best step into ``b``."""
        room, best = capacity - fill[b], None
        one, two = masks[b]
        for back, kind in chain([(0, -1)], ((t, 0) for t in _bits(one)), ((t, 1) for t in _bits(two & known.fits))):
            for k in (0,) if kind == 1 else (0, 1):
                over = known.present[k] & ((1 << (back + room + 1)) - 1)
                for size in _bits(over >> (back + 1) << (back + 1)):
                    gain = size - back
                    if best and 2 * gain * (fill[b] + gain) <= best[0]:
                        break  # not even an empty giver would do
                    if (found := known.emptiest(k, size, b)) and fill[b] + gain > found[0]:
                        rise = 2 * gain * (fill[b] - found[0] + gain)
                        if not best or rise > best[0]:
                            best = rise, found[1], size, k, back, kind
        return best

    for b in range(len(bins)):
        placed(b)
    changed = True
    while changed and count > least:
        changed = False
        for b in sorted((b for b in range(len(bins)) if 0 < fill[b] < capacity), key=lambda b: (-fill[b], b)):
            while count > least and 0 < fill[b] < capacity and (found := step(b)):
                _, e, size, k, back, kind = found
                out = _pick(bins[e], sizes, size, k)
                returned = _pick(bins[b], sizes, back, kind) if kind >= 0 else ()
                bins[e] = [i for i in bins[e] if i not in out] + list(returned)
                bins[b] = [i for i in bins[b] if i not in returned] + list(out)
                fill[e], fill[b] = fill[e] - size + back, fill[b] + size - back
                count -= not bins[e]
                placed(e), placed(b)
                changed = True
    return [b for b in bins if b]


def pack(sizes: list[int], capacity: int = LENGTH) -> list[list[int]]:
    return improve(best_fit(sizes, capacity), sizes, capacity)


def _packed(capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        sizes = group["length"].tolist()
        number, offset = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
        for k, items in enumerate(pack(sizes, capacity)):
            at = 0
            for i in items:
                number[i], offset[i] = k, at
                at += sizes[i]
        group["sequence_id"] = (group["batch"].to_numpy(np.int64) << 32) + number
        group["offset"] = offset
        return group.drop(columns="batch")

    return run


def pieces(
    docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, piece, start, length, ids_crc32): documents cut from the end, so that only the
    first piece can be short. A null or empty text is the end id alone."""
    kept = one_per_id(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id")
    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(_cut(tokenizer, length, end_id), f"id {kind}, piece int, start long, length long, ids_crc32 long")


def packed(
    docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, group: int = GROUP,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece.

    Every document is in some sequences of ``length`` tokens at most, each piece in one,
    gapless from offset 0. ``tokenizer`` is a file of a public byte-level vocabulary that
    all workers can read. Equal texts are packed one by one. For null and repeated ids see
    ``one_per_id``.
    """
    cut = stored(pieces(docs, tokenizer, length, end_id, id_col, text_col), "pieces")
    groups = max(1, math.ceil(cut.count() / group))
    dealt = cut.withColumn("batch", F.pmod(F.xxhash64("id", "piece"), F.lit(groups)).cast("int"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return dealt.groupBy("batch").applyInPandas(_packed(length), schema).withColumnRenamed("id", id_col)
