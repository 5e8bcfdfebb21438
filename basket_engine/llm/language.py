"""Language identification by unigram pieces, summed over all segmentations.

Each language gives every piece of a fixed public vocabulary a probability. A word's
probability is the sum over all ways to cut it into pieces, found by the forward algorithm;
the piece probabilities are fitted by expectation maximisation with forward and backward sums.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..session import stored
from .documents import one_per_id
from .wordhash import WordHasher, mix, slices, text_buffers

#: Words are runs of letters a-z and bytes beyond ASCII.
BREAKS = bytes(b for b in range(128) if not chr(b).isalpha())
#: Longest piece, in bytes.
PIECE = 12
#: Bytes of words that are worked on at once; a longer word is worked on alone.
AT_ONCE = 1 << 19
#: Sums below this are scaled up, and the logarithm of the scale is kept.
SMALL = 1e-60
#: Labelled documents of each language that the model is fitted on, at most.
FITTED = 2000
ROUNDS = 3
#: Words whose scores a task remembers, at most.
REMEMBERED = 400_000
UNDETERMINED = "und"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _byte_values() -> np.ndarray:
    byte = np.arange(256, dtype=np.uint64)
    byte[65:91] += np.uint64(32)
    return mix((byte + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))


def _hash(piece: bytes) -> int:
    h, value = 0, _byte_values()
    for b in piece:
        h = (h * int(_STEP) + int(value[b])) % (1 << 64)
    return h


def read_pieces(path: str, longest: int = PIECE) -> list[bytes]:
    """The vocabulary's pieces of lower-case letters and bytes beyond ASCII, and every
    single one of these bytes, so that each word has a segmentation."""
    letters = {b for b in range(256) if b not in BREAKS and not 65 <= b <= 90}
    with open(path, "rb") as file:
        every = {base64.b64decode(line.split()[0]).strip(b" ").lower() for line in file if line.strip()}
    singles = {bytes([b]) for b in letters}
    return sorted({p for p in every if 0 < len(p) <= longest and letters.issuperset(p)} | singles)


@dataclass
class PieceModel:
    languages: list[str]
    keys: np.ndarray  # sorted piece hashes
    probability: np.ndarray  # piece x language, and a last row of zeros

    @staticmethod
    def uniform(pieces: list[bytes], languages: list[str]) -> "PieceModel":
        keys = np.sort(np.array([_hash(p) for p in pieces], np.uint64))
        probability = np.full((len(keys) + 1, len(languages)), 1 / len(keys))
        probability[-1] = 0
        return PieceModel(languages, keys, probability)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        at[self.keys[at] != hashes] = len(self.keys)
        return at


def _groups(size: np.ndarray) -> Iterator[np.ndarray]:
    """Rows by falling size, in groups of a bounded number of bytes."""
    order = np.argsort(-size, kind="stable")
    upto, lo = np.cumsum(size[order]), 0
    while lo < len(order):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + AT_ONCE, "right")))
        yield order[lo:hi]
        lo = hi


class Segmenter:
    """Sums over all segmentations of words, which go forward side by side, byte by byte.

    A word of any length is summed as a whole. Sums get small as words get long: what is
    kept of each is a number near 1 and the logarithm of its scale.
    """

    def __init__(self, model: PieceModel):
        self.model, self.value = model, _byte_values()
        self.power = np.multiply.accumulate(np.r_[np.ones(1, np.uint64), np.full(PIECE, _STEP)])

    def _hashes(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
        """(end, piece numbers by length) for each end; ``size`` falls, so the words that reach an
        end are the first ones."""
        last = [np.zeros(len(start), np.uint64)]
        alive = len(start)
        for e in range(1, int(size[0]) + 1 if len(size) else 1):
            alive = int(np.searchsorted(-size[:alive], -e, "right"))
            h = last[-1][:alive] * _STEP + self.value[data[start[:alive] + (e - 1)]]
            last = [*last[-PIECE:], h]
            yield e, [self.model.find(h - last[-1 - k][:alive] * self.power[k]) for k in range(1, min(e, PIECE) + 1)]

    @staticmethod
    def _step(sums: list[np.ndarray], logs: list[np.ndarray], p: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The next sum and the logarithm of its scale, from those one, two ... bytes before."""
        n = len(p[0])
        log = logs[-1][:n]
        value = sums[-1][:n] * p[0]
        for k in range(2, len(p) + 1):
            far = logs[-k]
            scale = 1.0 if far is logs[-1] else np.exp(far[:n] - log)
            value = value + sums[-k][:n] * scale * p[k - 1]
        if n and value.min() < SMALL:
            small = np.where((value < SMALL) & (value > 0), value, 1.0)
            return value / small, log + np.log(small)
        return value, log if len(log) == len(logs[-1]) else logs[-1]

    def log_scores(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Natural log probability of each word in each language."""
        p, out = self.model.probability, np.zeros((len(start), len(self.model.languages)))
        size = stop - start
        for rows in _groups(size):
            own = size[rows]
            sums, logs = [np.ones((len(rows), p.shape[1]))], [np.zeros((len(rows), p.shape[1]))]
            for e, pieces in self._hashes(data, start[rows], own):
                value, log = self._step(sums, logs, [p[at] for at in pieces])
                sums, logs = [*sums[-PIECE + 1 :], value], [*logs[-PIECE + 1 :], log]
                done = int(np.searchsorted(-own[: len(value)], -e, "left"))  # those before go on
                with np.errstate(divide="ignore"):
                    out[rows[done : len(value)]] = np.log(value[done:]) + log[done : len(value)]
        return out

    def expected(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray, weight: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """Expected piece counts, piece x language, of words with their weights and languages.

        The sums before and behind every byte are kept: some forty bytes for each byte of a
        group, or of a long word.
        """
        p = self.model.probability
        out = np.zeros_like(p)
        width = p.shape[1]
        size = stop - start
        for rows in _groups(size):
            own, of = size[rows], lang[rows]
            at = [pieces for _, pieces in self._hashes(data, start[rows], own)]
            n = len(at)
            sums, logs = [np.ones(len(rows))], [np.zeros(len(rows))]
            for pieces in at:
                value, log = self._step(sums[-PIECE:], logs[-PIECE:], [p[x, of[: len(x)]] for x in pieces])
                sums.append(value), logs.append(log[: len(value)] if len(log) != len(value) else log)
            whole, whole_log = np.ones(len(rows)), np.zeros(len(rows))
            for e in range(n, 0, -1):
                done = int(np.searchsorted(-own[: len(sums[e])], -e, "left"))
                whole[done : len(sums[e])], whole_log[done : len(sums[e])] = sums[e][done:], logs[e][done:]
            # behind: sums from the end of each word back, for the ends that pieces can reach from here
            behind, behind_log = {}, {}
            for e in range(n, -1, -1):
                alive = len(sums[e])
                value, log = np.zeros(alive), np.zeros(alive)
                ends = own[:alive] == e
                reach = range(1, min(PIECE, n - e) + 1)
                if reach:
                    longer = len(sums[e + 1])
                    log[:longer] = behind_log[e + 1]
                    for k in reach:
                        m = len(sums[e + k])
                        q = p[at[e + k - 1][k - 1], of[:m]]
                        value[:m] += q * behind[e + k] * np.exp(behind_log[e + k] - log[:m])
                value[ends], log[ends] = 1.0, 0.0
                small = np.where((value < SMALL) & (value > 0), value, 1.0)
                behind[e], behind_log[e] = value / small, log + np.log(small)
                for k in reach:  # the pieces that begin here
                    m = len(sums[e + k])
                    pieces = at[e + k - 1][k - 1]
                    scale = np.exp(logs[e][:m] + behind_log[e + k] - whole_log[:m])
                    with np.errstate(divide="ignore", invalid="ignore"):
                        count = sums[e][:m] * p[pieces, of[:m]] * behind[e + k] * scale / whole[:m] * weight[rows[:m]]
                    out += np.bincount(pieces * width + of[:m], np.nan_to_num(count), out.size).reshape(out.shape)
                behind.pop(e + PIECE, None), behind_log.pop(e + PIECE, None)
        return out


def _word_table(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of rows (lang, text)."""
    words = F.split(F.coalesce("text", F.lit("")), r"[\x00-\x40\x5B-\x60\x7B-\x7F]+")
    each = docs.select("lang", F.explode(words).alias("word")).where("word <> ''")
    return each.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))


def _expectation(model: PieceModel):
    number = {name: i for i, name in enumerate(model.languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter, total = Segmenter(model), np.zeros_like(model.probability)
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            lang = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            total += segmenter.expected(data, offsets[:-1], offsets[1:], batch.column(2).to_numpy().astype(float), lang)
        piece, of = np.nonzero(total[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(of), pa.array(total[piece, of])], ["piece", "lang", "n"])

    return run


def sample_ids(labelled: DataFrame, most: int = FITTED) -> DataFrame:
    """The ids with the least hashes in each language, of rows (id, lang).

    Languages are counted first, and only ids whose hash is below the share of it that holds
    ``most`` of them, and some more, are ordered: in each language a little over ``most``. Should
    these be too few, all are ordered.
    """
    known = labelled.where("lang is not null").select("id", "lang", F.xxhash64("id").alias("h"))
    counts = [(r["lang"], r["n"]) for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()]  # as many as the model has
    some = [(lang, n, int(-(2**63) + min(1.0, (most + 8 * most**0.5 + 50) / n) * (2**64 - 1))) for lang, n in counts]
    limits = known.sparkSession.createDataFrame([(lang, n, min(limit, 2**63 - 1)) for lang, n, limit in some], "lang string, n long, most_h long")
    near = known.join(F.broadcast(limits), "lang").where(F.col("h") <= F.col("most_h")).select("id", "lang", "h")
    found = dict(near.groupBy("lang").count().collect())
    if any(found.get(lang, 0) < min(most, n) for lang, n in counts):
        near = known
    order = Window.partitionBy("lang").orderBy("h", "id")
    return near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).select("id")


def fit(texts: DataFrame, pieces: list[bytes], rounds: int = ROUNDS) -> PieceModel | None:
    """Piece probabilities of every language in rows (lang, text), in ``rounds`` passes.

    The words are counted once and stay distributed; only expected counts of the fixed
    vocabulary's pieces reach the driver, whatever the number of texts. None without words.
    """
    counted = stored(_word_table(texts), "language-words")
    languages = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
    if not languages:
        return None
    model = PieceModel.uniform(pieces, languages)
    parts = counted.sparkSession.sparkContext.defaultParallelism
    counted = stored(counted.repartition(parts), "language-words")
    for _ in range(rounds):
        found = counted.mapInArrow(_expectation(model), "piece long, lang long, n double")
        total = np.zeros_like(model.probability)
        for r in found.groupBy("piece", "lang").agg(F.sum("n").alias("n")).toLocalIterator():
            total[r["piece"], r["lang"]] = r["n"]
        smooth = total[:-1] + 0.01
        model = PieceModel(languages, model.keys, np.vstack([smooth / smooth.sum(axis=0), np.zeros(len(languages))]))
    return model


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: PieceModel = shared.value
        segmenter, hasher = Segmenter(model), WordHasher(BREAKS)
        known, scores = np.zeros(0, np.uint64), np.zeros((0, len(model.languages)))
        names = np.array([*model.languages, UNDETERMINED], object)
        for whole in batches:
            for batch in slices(whole, 1):
                data, offsets = text_buffers(batch.column(1))
                hashes, doc, start, stop = hasher.spans(data, offsets)
                words, first, which = np.unique(hashes, return_index=True, return_inverse=True)
                if len(known) + len(words) > REMEMBERED:
                    known, scores = known[:0], scores[:0]
                place = np.searchsorted(known, words)
                new = np.ones(len(words), bool)
                new[place < len(known)] = known[place[place < len(known)]] != words[place < len(known)]
                if new.any():
                    at = first[new]
                    more = segmenter.log_scores(data, start[at], stop[at])
                    order = np.argsort(np.r_[known, words[new]])
                    known, scores = np.r_[known, words[new]][order], np.vstack([scores, more])[order]
                    place = np.searchsorted(known, words)
                each = scores[place][which]
                total = np.stack([np.bincount(doc, each[:, i], batch.num_rows) for i in range(each.shape[1])], axis=1)
                best = total.argmax(axis=1)
                share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                letters = pc.fill_null(pc.match_substring_regex(batch.column(1), r"\p{L}"), False).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(names[np.where(letters, best, len(model.languages))], pa.string()),
                     pa.array(np.where(letters, share, 0.0))],
                    ["id", "lang_pred", "score"],
                )

    return run


def identified(docs: DataFrame, model: PieceModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score), one row per document.

    The score is the language's share of the probability of the whole text, all languages
    being as likely beforehand; ties go to the first name. A null text, one without letters,
    and every text if there is no model, are ``und`` with score 0. For null and repeated ids
    see ``one_per_id``.
    """
    kept = one_per_id(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id")
    if model is None:
        return kept.select(F.col("id").alias(id_col), F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as the vocabulary
    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(_scored(shared), f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
