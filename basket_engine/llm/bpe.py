"""Token ids of many texts at once, with the public tokenizer doing each different word once.

The byte-level tokenizer first splits a text into words by a fixed pattern and then encodes
each word alone. Here whole blocks of texts are split in NumPy, and only words that were not
seen lately are encoded. Texts with characters or contractions that the NumPy split does not
cover are encoded whole. The vocabulary file is that of the ``tokenizers`` library; merging
a word's bytes by its ranks gives the same ids many times faster, which the tests hold
against that library.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np

from .wordhash import BASE, _powers, mix

#: Words remembered between blocks, at most.
REMEMBERED = 800_000
#: Code points below this one are split here.
SIMPLE = 0x250
#: Texts of more characters are encoded in parts, cut where a word surely starts.
LONG = 1 << 20
_SURE = re.compile(r"(?<=[a-z]) (?=[a-z])")


#: Fixed value: how the vocabulary's tokenizer splits a text into words.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_characters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, read backwards."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TokenEncoder:
    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        special = {t["content"]: t["id"] for t in content["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in content["added_tokens"]):
            raise ValueError(f"{path} has added tokens that are not plain texts")
        self.special = special
        # added tokens are found before anything else, at each place the longest
        longest = sorted(special, key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if special else None
        byte = _byte_characters()
        ranks = {bytes(byte[c] for c in token): i for token, i in content["model"]["vocab"].items() if token not in special}
        self.encoding = tiktoken.Encoding("byte-level", pat_str=WORD, mergeable_ranks=ranks, special_tokens={})
        self.piece = self.encoding._core_bpe.encode_single_piece
        kinds = np.zeros(SIMPLE, np.int8)
        for cp in range(SIMPLE):
            c = chr(cp)
            kinds[cp] = 0 if regex.match(r"\s", c) else 1 if regex.match(r"\p{L}", c) else 2 if regex.match(r"\p{N}", c) else 3
        self.kinds = kinds
        plain = np.zeros(SIMPLE, bool)
        plain[[0x09, 0x0A, 0x0D, *range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, SIMPLE)]] = True
        self.plain = plain
        self.value = mix((np.arange(SIMPLE, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
        self.up = self.down = np.ones(1, np.uint64)
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted word hashes
        self.first = self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _words(self, cp: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Where words start; ``edges`` are the starts of the texts that are not empty."""
        kind = self.kinds[cp]
        start = np.empty(len(cp), bool)
        start[0] = True
        start[1:] = kind[1:] != kind[:-1]
        start[edges] = True
        ends = np.zeros(len(cp), bool)  # the last character of a text
        ends[edges[1:] - 1] = ends[-1] = True
        # the last white space before something else stands alone or, a blank, joins it
        before = np.flatnonzero((kind[:-1] == 0) & (kind[1:] != 0) & ~ends[:-1])
        start[before] = True
        start[before[cp[before] == 0x20] + 1] = False
        return np.flatnonzero(start)

    def _hashes(self, cp: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        if len(self.up) < len(cp):
            self.up, self.down = _powers(BASE, len(cp)), _powers(pow(BASE, -1, 1 << 64), len(cp))
        term = self.value[cp] * self.up[: len(cp)]
        upto = np.cumsum(term, dtype=np.uint64)
        return mix((upto[stops - 1] - upto[starts] + term[starts]) * self.down[starts])

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        found = [self.piece(w.encode()) for w in words]
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum()))
        first = len(self.ids) + np.cumsum(size) - size
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known)
        self.known = known[order]
        self.first, self.size = np.concatenate([self.first, first])[order], np.concatenate([self.size, size])[order]
        self.ids = np.concatenate([self.ids, flat])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; few megabytes of text at a time.

        The text of an added token has its id, and what stands between such texts is encoded
        on its own.
        """
        if self.added and any(map(self.added.search, texts)):
            parts = [self.added.split(t) if self.added.search(t) else [t] for t in texts]
            plain = iter(self._plain([p for part in parts for p in part[::2]]))
            return [self._joined(part, plain) for part in parts]
        return self._plain(texts)

    def _joined(self, parts: list[str], plain: Iterator[np.ndarray]) -> np.ndarray:
        return np.concatenate([next(plain) if i % 2 == 0 else np.array([self.special[p]], np.uint32) for i, p in enumerate(parts)])

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        if any(len(t) > LONG for t in texts):
            return [self._in_parts(t) if len(t) > LONG else self._plain([t])[0] for t in texts]
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        whole = "".join(texts)
        if not whole:
            return out
        cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        offsets = np.r_[0, np.cumsum(sizes)]
        low = np.minimum(cp, SIMPLE - 1)
        odd = (cp >= SIMPLE) | ~self.plain[low]
        quote = np.flatnonzero(cp[:-1] == 0x27)
        odd[quote] |= self.kinds[low[quote + 1]] == 1
        hard = np.unique(np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1)
        if len(hard):
            for i in hard:
                out[i] = np.array(self.encoding.encode_ordinary(texts[i]), np.uint32)
            easy = np.setdiff1d(np.flatnonzero(sizes), hard)
            for i, ids in zip(easy, self._plain([texts[i] for i in easy])):
                out[i] = ids
            return out
        starts = self._words(cp, offsets[:-1][sizes > 0])
        stops = np.r_[starts[1:], len(cp)]
        distinct, at, which = np.unique(self._hashes(cp, starts, stops), return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > REMEMBERED:
            self._forget()
        place = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        inside = place < len(self.known)
        new[inside] = self.known[place[inside]] != distinct[inside]
        if new.any():
            self._learn(distinct[new], [whole[starts[i] : stops[i]] for i in at[new]])
            place = np.searchsorted(self.known, distinct)
        first, size = self.first[place][which], self.size[place][which]
        upto = np.cumsum(size)
        ids = self.ids[np.repeat(first - (upto - size), size) + np.arange(upto[-1])]
        # each text's words are consecutive
        cut = np.r_[0, upto][np.searchsorted(starts, offsets)]
        for i in np.flatnonzero(sizes):
            out[i] = ids[cut[i] : cut[i + 1]]
        return out

    def _in_parts(self, text: str) -> np.ndarray:
        parts, at = [], 0
        while at < len(text):
            cut = _SURE.search(text, at + LONG // 2)
            if not cut or cut.start() - at > LONG:  # no sure place nearby: the rest goes whole
                parts.append(np.array(self.encoding.encode_ordinary(text[at:]), np.uint32))
                break
            parts += self._plain([text[at : cut.start()]])
            at = cut.start()
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)
