"""Words of Arrow text columns as 64-bit hashes, computed for whole blocks of bytes in NumPy.

A word's hash is a polynomial over its bytes, taken from one running sum per block:
``(S[end] - S[start]) / p ** start`` modulo 2**64, where every byte stands for a random
number. Blocks are cut between words, so memory is bounded by the block and not by a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
SPACES = bytes([0x20, *range(0x09, 0x0E)])
BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


class WordHasher:
    """Hashes words that are maximal runs of bytes outside ``breaks``; A-Z count as a-z."""

    def __init__(self, breaks: bytes = SPACES, fold: bool = True, block: int = BLOCK):
        self.is_word = np.ones(256, bool)
        self.is_word[list(breaks)] = False
        byte = np.arange(256, dtype=np.uint64)
        if fold:
            byte[65:91] += np.uint64(32)
        self.value = mix((byte + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
        self.block = block
        self.up = self.down = np.ones(1, np.uint64)

    def _table(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down = _powers(BASE, n), _powers(pow(BASE, -1, 1 << 64), n)

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
        lo, end = int(offsets[0]), int(offsets[-1])
        while lo < end:
            hi, ahead = min(lo + self.block, end), lo + self.block
            while hi < end:  # back to a break or the start of a text; else further on
                edge = int(offsets[np.searchsorted(offsets, hi, "right") - 1])
                gaps = np.flatnonzero(~self.is_word[data[lo:hi]])
                cut = max(edge, lo + int(gaps[-1]) + 1 if len(gaps) else lo)
                if cut > lo:
                    hi = cut
                    break
                ahead += self.block
                hi = min(ahead, end)
            yield lo, hi
            lo = hi

    def blocks(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(hash, index of the text, first byte, byte behind) of every word, block by block."""
        for lo, hi in self._cuts(data, offsets):
            part = data[lo:hi]
            self._table(hi - lo)
            word = self.is_word[part]
            first, last = word.copy(), word.copy()
            first[1:] &= ~word[:-1]
            last[:-1] &= ~word[1:]
            edges = offsets[np.searchsorted(offsets, lo, "right") : np.searchsorted(offsets, hi, "left")] - lo
            first[edges] = word[edges]
            last[edges - 1] = word[edges - 1]
            starts, ends = np.flatnonzero(first), np.flatnonzero(last)
            term = self.value[part] * self.up[: hi - lo]
            upto = np.cumsum(term, dtype=np.uint64)
            total = (upto[ends] - upto[starts] + term[starts]) * self.down[starts]
            yield mix(total), np.searchsorted(offsets, lo + starts, "right") - 1, lo + starts, lo + ends + 1

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.spans(data, offsets)[:2]

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Like ``blocks``, for all blocks."""
        parts = list(self.blocks(data, offsets))
        if not parts:
            return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
        return tuple(np.concatenate(x) for x in zip(*parts))


def shingles(words: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the text) of every run of ``size`` words; a text of fewer words has
    its whole sequence as the only one."""
    m = np.uint64(0xC2B2AE3D27D4EB4F)
    n = len(words)
    out, of = [], []
    if n >= size:
        h = words[: n - size + 1].copy()
        for i in range(1, size):
            h = h * m + words[i : n - size + 1 + i]
        whole = doc[: n - size + 1] == doc[size - 1 :]
        out.append(mix(h[whole]))
        of.append(doc[: n - size + 1][whole])
    if n:
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        count = np.diff(np.r_[first, n])
        for c in range(1, size):
            at = first[count == c]
            if len(at):
                h = words[at].copy()
                for i in range(1, c):
                    h = h * m + words[at + i]
                out.append(mix(h ^ np.uint64(c * BASE % (1 << 64))))
                of.append(doc[at])
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(of)


def slices(batch: pa.RecordBatch, text: int, most_bytes: int = 4 << 20, most_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The batch in parts of a few megabytes of text each."""
    _, offsets = text_buffers(batch.column(text))
    lo = 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(offsets, offsets[lo] + most_bytes, "right")) - 1
        hi = min(max(hi, lo + 1), lo + most_rows, batch.num_rows)
        yield batch.slice(lo, hi - lo)
        lo = hi
