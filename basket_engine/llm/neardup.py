"""MinHash near-duplicates with HyperMinHash registers.

One hash of a shingle picks its bucket, and the least value of a bucket is kept as the
count of its leading zeros and the few bits after them. Bands of these registers give
candidates, a collision-corrected estimate thins them, and full shingle sets confirm them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import stored
from .documents import one_per_id
from .graph import components
from .wordhash import WordHasher, mix, shingles, slices, text_buffers

SHINGLE = 5
PERCENT = 80
BUCKETS, BANDS, ROWS = 160, 32, 5
MANTISSA = 10
#: Estimates this far below the threshold are not confirmed: more than five standard
#: deviations of an estimate from all registers.
MARGIN = 0.18
#: Documents estimated less like the centre of their buckets than this have no centre but
#: themselves: their differences from it would not be few.
CENTRE = 0.35
#: Further rounds of centres among those that are not linked to one. More of them leave fewer
#: pairs to the join of differences; the result is the same.
ROUNDS = 1
#: Longs of the bitmap of a document's differences.
BITMAP = 8
#: Cells of the sketch of counts that puts the rarer elements of sets first.
CELLS = 1 << 20
_NEAR = 1e-9
_BITS = 40


def registers(hashes: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Set sizes, two 64-bit set sums and the registers (0: empty bucket) of up to 4096 texts."""
    key = (doc.astype(np.uint64) << np.uint64(52)) | (hashes >> np.uint64(12))
    key.sort()
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    d, low = (key >> np.uint64(52)).astype(np.int64), key & np.uint64((1 << 52) - 1)
    size = np.bincount(d, minlength=n_docs)
    sums = np.zeros((2, n_docs), np.uint64)
    if len(key):
        at = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        for i in range(2):
            sums[i, d[at]] = np.add.reduceat(mix(low * np.uint64(2) + np.uint64(i)), at)
    scaled = (low >> np.uint64(52 - _BITS)) * np.uint64(BUCKETS)
    cell = d * BUCKETS + (scaled >> np.uint64(_BITS)).astype(np.int64)
    at = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
    least = scaled[at] & np.uint64((1 << _BITS) - 1)
    zeros = (_BITS - np.frexp(least.astype(np.float64))[1]).astype(np.uint64)
    bits = ((least << (zeros + np.uint64(1))) & np.uint64((1 << _BITS) - 1)) >> np.uint64(_BITS - MANTISSA)
    out = np.zeros(n_docs * BUCKETS, np.uint16)
    out[cell[at]] = ((zeros << np.uint64(MANTISSA)) | bits) + np.uint64(1)
    return size, sums[0], sums[1], out.reshape(n_docs, BUCKETS)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band; empty registers borrow from others in a fixed random order."""
    order = np.argsort(np.random.default_rng(7).random((BUCKETS, BUCKETS)), axis=1)
    full = regs.copy()
    row, col = np.nonzero(regs == 0)
    some = regs.any(axis=1)[row]
    row, col = row[some], col[some]
    for step in range(BUCKETS):
        if not len(row):
            break
        found = regs[row, order[col, step]]
        full[row, col] = found
        row, col = row[found == 0], col[found == 0]
    key = np.zeros((len(regs), BANDS), np.uint64)
    for i in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + full[:, i::ROWS].astype(np.uint64))
    return mix(key + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def likeness(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity: equal registers, less those expected to be equal by chance."""
    used = (a > 0) | (b > 0)
    same = ((a == b) & (a > 0)).sum(axis=1)
    ra, rb = size_a / BUCKETS, size_b / BUCKETS
    both = ra + rb
    chance = np.zeros(len(a))
    for i in range(_BITS):
        width = 2.0 ** -(i + 1 + MANTISSA)
        chance += ra * rb * width / both * (np.exp(-both * 2.0 ** -(i + 1)) - np.exp(-both * 2.0**-i))
    n = np.maximum(used.sum(axis=1), 1)
    return np.clip((same - BUCKETS * chance) / n, 0, 1)


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for whole in batches:
            for batch in slices(whole, 1):
                h, doc = shingles(*hasher.words(*text_buffers(batch.column(1))), size)
                n, one, two, regs = registers(h, doc, batch.num_rows)
                for i in np.flatnonzero(n > 1 << 16):  # long texts: count all 64 bits
                    n[i] = len(np.unique(h[doc == i]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                     pa.array([r.tobytes() for r in regs], pa.binary())],
                    ["id", "n", "one", "two", "regs"],
                )

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BUCKETS)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = band_keys(_matrix(batch.column(1)))
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), BANDS)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(keys.ravel().view(np.int64))], ["id", "band"])


def _estimates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            n_a, n_b = (batch.column(i).to_numpy().astype(float) for i in (2, 4))
            e = likeness(_matrix(batch.column(3)), _matrix(batch.column(5)), n_a, n_b)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(e)], ["a", "b", "est"])


def _sets(column: pa.Array, size: int, hasher: WordHasher) -> list[np.ndarray]:
    h, doc = shingles(*hasher.words(*text_buffers(column)), size)
    order = np.argsort(doc, kind="stable")
    ends = np.cumsum(np.bincount(doc, minlength=len(column)))
    return [np.unique(x) for x in np.split(h[order], ends[:-1])]


def _text_pairs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[np.ndarray]]]:
    """Parts of batches (a, b, text_a, text_b) with both shingle sets of each row."""
    hasher = WordHasher()
    for whole in batches:
        for batch in slices(whole, 2, most_rows=1024):
            yield batch, _sets(batch.column(2), size, hasher), _sets(batch.column(3), size, hasher)


def _linked(common: int, n_a: int, n_b: int, percent: int) -> bool:
    return common > 0 and 100 * common >= percent * (n_a + n_b - common)


def _confirmed(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, left, right in _text_pairs(batches, size):
            keep = [
                i for i, (a, b) in enumerate(zip(left, right))
                if _linked(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b), percent)
            ]
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return run


def least_overlap(d_a: float, d_b: float, n_a: float, n_b: float, percent: int) -> float:
    """How many differences from a third set two sets must share to be linked.

    With d differences each from that set, two sets of n elements differ from each other in
    d_a + d_b - 2 * shared elements; a link allows (n_a + n_b) * (100 - p) / (100 + p).
    """
    return (d_a + d_b - (n_a + n_b) * (100 - percent) / (100 + percent)) / 2


def _differences(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, members, centres in _text_pairs(batches, size):
            linked, sizes, centre_sizes, counts, kept, bits = [], [], [], [], [], []
            for a, b in zip(members, centres):
                common = len(np.intersect1d(a, b, assume_unique=True))
                linked.append(_linked(common, len(a), len(b), percent))
                own = np.r_[np.setdiff1d(a, b, assume_unique=True), np.setdiff1d(b, a, assume_unique=True)]
                sizes.append(len(a)), centre_sizes.append(len(b)), counts.append(len(own))
                place = np.unique((own >> np.uint64(20)) % np.uint64(64 * BITMAP))
                bitmap = np.zeros(BITMAP, np.uint64)
                np.bitwise_or.at(bitmap, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
                bits.append(bitmap.view(np.int64))
                kept.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(linked, pa.bool_()), *(pa.array(x, pa.int64()) for x in (sizes, centre_sizes, counts)),
                 pa.array(kept, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
                ["a", "b", "linked", "n", "n_b", "d", "own", "bits"],
            )

    return run


# The rarest elements of sets: any order that all sets agree on gives exact prefixes


def _cells(salt: int, elements: np.ndarray) -> np.ndarray:
    return (mix(elements + np.uint64(salt & ((1 << 64) - 1))) & np.uint64(CELLS - 1)).astype(np.int64)


def _counted(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    cell = np.flatnonzero(counts)
    if len(cell):
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(counts[cell])], ["cell", "n"])


def _sketch(counted: DataFrame) -> np.ndarray:
    """Sums of (cell, n) rows; ``CELLS`` of them at most come to the driver."""
    sums = counted.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CELLS, np.int64)
    out[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    return out


def _difference_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(CELLS, np.int64)
    for batch in batches:
        for salt, own in zip(batch.column(0).to_pylist(), batch.column(1)):
            np.add.at(counts, _cells(salt, own.values.to_numpy().view(np.uint64)), 1)
    yield from _counted(counts)


def difference_prefix(n: int, d: int, n_centre: int, linked: bool, percent: int) -> int:
    """How many of a document's ``d`` differences from its centre, in an order all agree on, hold one
    that it shares with any partner, another document beside this centre.

    A document linked to the centre is looked for by ones that are not, which have more
    differences than a link allows. Else both have at least ``d`` differences, less what a link
    between the two allows, and the partner has at most ``n * 100 / percent`` elements.
    """
    rate = (100 - percent) / (100 + percent)
    if linked:
        needed = (d + (n_centre - n) * rate) / 2
    else:
        needed = d - n * (1 + 100 / percent) * rate
    return max(0, d - max(1, math.floor(needed + _NEAR)) + 1)


def _rare_differences(counts: np.ndarray, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            salts, linked, n, n_b, d = (batch.column(c).to_pylist() for c in ("salt", "linked", "n", "n_b", "d"))
            kept = []
            for i, own in enumerate(batch.column("own")):
                own = own.values.to_numpy().view(np.uint64)
                order = np.lexsort((own, counts[_cells(salts[i], own)]))
                kept.append(own[order[: difference_prefix(n[i], d[i], n_b[i], linked[i], percent)]].view(np.int64))
            names = ["a", "b", "linked", "n", "d", "bits"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(kept, pa.list_(pa.int64()))], [*names, "own"])

    return run


def _set_counts(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, hasher = np.zeros(CELLS, np.int64), WordHasher()
        for whole in batches:
            for batch in slices(whole, 1, most_rows=1024):
                counts += np.bincount(_cells(0, np.concatenate(_sets(batch.column(1), size, hasher))), minlength=CELLS)
        yield from _counted(counts)

    return run


def _rare_shingles(size: int, percent: int, counts: np.ndarray):
    """The prefix of each set that any set linked to it shares an element with its own prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for whole in batches:
            for batch in slices(whole, 1, most_rows=1024):
                kept = []
                for own in _sets(batch.column(1), size, hasher):
                    order = np.lexsort((own, counts[_cells(0, own)]))
                    kept.append(own[order[: len(own) - -(-percent * len(own) // 100) + 1]].view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.list_(pa.int64()))], ["id", "rare"])

    return run


def _distances(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, left, right in _text_pairs(batches, size):
            common = np.array([len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(left, right)], float)
            n = np.array([len(a) + len(b) for a, b in zip(left, right)], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(1 - common / np.maximum(n - common, 1))], ["a", "b", "apart"])

    return run


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_shingles, component_id, kept), one row per document.

    Words are split at ASCII white space, with A-Z as a-z. A document's set holds its
    different runs of ``shingle`` words, or its whole sequence if it has fewer. Documents
    are linked when 100 * common >= percent * united; the component is the smallest id that
    links lead to, and the document with this id is kept. A null text or one without words
    has an empty set and no link. For null and repeated ids see ``one_per_id``.

    Equal sets are one class from the start, so exact copies are never compared. In a band
    bucket, the member that shares most buckets with others is its centre, and every member
    is compared with the most central document of its buckets only. Those linked to it are
    one component; the others get centres among themselves. Then, across components, they
    can be linked to documents of their first centre only if they share enough of their
    differences from it, which a prefix-filtered join of these finds, the rarer first.

    What remains are pairs of different centres that share a bucket and are in different
    components. The members of a bucket are not paired up either. Their shingles are ordered by
    rarity, and linked sets share one of their rarest; these are joined for centres first, not
    for documents. Distances of sets are a metric, so a document and one of another centre
    cannot be linked if the centres are further apart than the two are from them and a link
    allows, and only what is left is joined. So neither a large group of near copies nor one of
    documents that share a passage and nothing else becomes pairs.
    """
    kept = one_per_id(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id")
    kind = kept.schema["id"].dataType.simpleString()
    sigs = stored(
        kept.mapInArrow(_signatures(shingle), f"id {kind}, n long, one long, two long, regs binary"), "signatures"
    )
    same = ["n", "one", "two"]
    classes = stored(sigs.where("n > 0").groupBy(*same).agg(F.min("id").alias("rep")), "classes")
    reps = sigs.join(classes.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "n", "regs")
    bands = _shared(reps.select("id", "regs").mapInArrow(_bands, f"id {kind}, band long"))

    def estimated(pairs: DataFrame, least: float) -> DataFrame:
        side = lambda x: reps.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "regs_a", "n_b", "regs_b")
        return both.mapInArrow(_estimates, f"a {kind}, b {kind}, est double").where(F.col("est") >= least)

    def with_texts(pairs: DataFrame) -> DataFrame:
        side = lambda x: kept.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}"))
        return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")

    def confirmed(pairs: DataFrame) -> DataFrame:
        return stored(with_texts(pairs).mapInArrow(_confirmed(shingle, percent), f"a {kind}, b {kind}"), "confirmed")

    def starred(members: DataFrame, least: float) -> DataFrame:
        central = members.groupBy("id").agg(F.max(F.struct("weight", "leader")).alias("top")).select("id", F.col("top.leader").alias("centre"))
        return estimated(central.where("id <> centre").select(F.col("id").alias("a"), F.col("centre").alias("b")), least)

    # 1: every document beside the most central one of its buckets
    schema = f"a {kind}, b {kind}, linked boolean, n long, n_b long, d long, own array<bigint>, bits array<bigint>"
    compared = stored(with_texts(starred(bands, CENTRE)).mapInArrow(_differences(shingle, percent), schema), "compared")
    links, alone = compared.where("linked").select("a", "b"), compared.where("not linked").select(F.col("a").alias("id"))
    for _ in range(ROUNDS):  # those not linked to it have centres among themselves
        among = _led(bands.select("id", "band").join(alone, "id", "left_semi"))
        more = confirmed(starred(among, percent / 100 - MARGIN))
        links = links.unionByName(more)
        alone = alone.join(more.select(F.col("a").alias("id")), "id", "left_anti")
    found = stored(components(links), "components")
    # 2: what is not linked to its first centre beside others of this centre
    salted = compared.withColumn("salt", F.xxhash64("b"))
    counts = _sketch(salted.select("salt", "own").mapInArrow(_difference_counts, "cell long, n long"))
    schema = f"a {kind}, b {kind}, linked boolean, n long, d long, bits array<bigint>, own array<bigint>"
    rare = salted.select("salt", "a", "b", "linked", "n", "n_b", "d", "own", "bits").mapInArrow(_rare_differences(counts, percent), schema)
    rows = stored(_labelled(rare, found, "a", "c").select("b", "a", "c", "linked", "n", "d", "bits", F.posexplode("own").alias("i", "e")), "differences")
    asking = rows.where("not linked").select("b", "e").distinct()  # linked documents matter only beside others
    left = rows.where("not linked").select("b", "e", "a", *[F.col(c).alias(f"{c}_a") for c in ("c", "n", "d", "i", "bits")])
    right = rows.join(asking, ["b", "e"], "left_semi")
    right = right.select("b", "e", F.col("a").alias("o"), "linked", *[F.col(c).alias(f"{c}_o") for c in ("c", "n", "d", "i", "bits")])
    needed = least_overlap(F.col("d_a"), F.col("d_o"), F.col("n_a"), F.col("n_o"), percent)
    at_most = F.least(F.col("d_a") - F.col("i_a"), F.col("d_o") - F.col("i_o"))  # this one and all behind it
    # each bit that only one of the two has stands for a difference that they do not share
    only = lambda x, y: sum((F.bit_count(F.get(x, F.lit(j)).bitwiseAND(F.bitwise_not(F.get(y, F.lit(j))))) for j in range(BITMAP)), F.lit(0))
    at_most = F.least(at_most, F.col("d_a") - only("bits_a", "bits_o"), F.col("d_o") - only("bits_o", "bits_a"))
    apart = (F.col("c_a") != F.col("c_o")) & (F.col("linked") | (F.col("a") < F.col("o")))
    near = left.join(right, ["b", "e"]).where(apart & (at_most >= needed - 1e-6))
    near = stored(near.select("a", F.col("o").alias("b")).distinct(), "near")
    found = _merged(found, confirmed(estimated(near, percent / 100 - MARGIN)))
    # 3: documents of buckets with several components, through their centres and rarest shingles
    member = _labelled(bands, found, "id", "component")
    mixed = member.groupBy("band").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most")
    member = member.join(mixed.select("band"), "band", "left_semi").select("id", "component").distinct()
    common = (F.col("n") + F.col("n_b") - F.col("d")) / 2
    centre = compared.select(F.col("a").alias("id"), F.col("b").alias("z"), (1 - common / (F.col("n") + F.col("n_b") - common)).alias("s"))
    member = member.join(centre, "id", "left").join(reps.select("id", "n"), "id")
    member = stored(member.select("id", "component", "n", F.coalesce("z", "id").alias("z"), F.coalesce("s", F.lit(0.0)).alias("s")), "mixed")
    texts = kept.join(member.select("id"), "id", "left_semi")
    counts = _sketch(texts.select("id", "text").mapInArrow(_set_counts(shingle), "cell long, n long"))
    rare = texts.select("id", "text").mapInArrow(_rare_shingles(shingle, percent, counts), f"id {kind}, rare array<bigint>")
    rows = stored(rare.join(member, "id").select("id", "component", "n", "z", "s", F.posexplode("rare").alias("i", "e")), "rare-shingles")
    several = rows.groupBy("e").agg(
        F.min("component").alias("c0"), F.max("component").alias("c1"), F.min("z").alias("z0"), F.max("z").alias("z1")
    ).where("c0 <> c1 and z0 <> z1")
    rows = stored(rows.join(several.select("e"), "e", "left_semi"), "shared-shingles")
    allowed = 1 - percent / 100 + _NEAR
    side = rows.groupBy("e", "z").agg(F.max("s").alias("s"))
    meetings = side.select("e", F.col("z").alias("a"), F.col("s").alias("s_a")).join(side.select("e", F.col("z").alias("b"), F.col("s").alias("s_b")), "e")
    meetings = stored(meetings.where("a < b"), "meetings")
    centres = stored(meetings.groupBy("a", "b").agg(F.max(F.col("s_a") + F.col("s_b")).alias("slack")), "centre-pairs")
    apart = with_texts(centres).mapInArrow(_distances(shingle), f"a {kind}, b {kind}, apart double")
    close = stored(centres.join(apart, ["a", "b"]).where(F.col("apart") <= allowed + F.col("slack")).select("a", "b", "apart"), "close-centres")
    both = lambda x, z: rows.select("e", F.col("z").alias(z), F.col("id").alias(f"id_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in ("component", "n", "s", "i")])
    # a document meets the centres at its own elements only, and those whose documents it can be linked to
    meetings = meetings.join(close, ["a", "b"]).select("e", "a", "b", "apart", F.col("s_b").alias("most_b"))
    left = both("a", "a").join(meetings, ["e", "a"]).where(F.col("apart") - F.col("s_a") - F.col("most_b") <= allowed)
    pairs = left.join(both("b", "b"), ["e", "b"])
    within = F.col("apart") - F.col("s_a") - F.col("s_b") <= allowed
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    # for the first element that two sets share, this one and all behind it
    enough = (100 + percent) * F.least(F.col("n_a") - F.col("i_a"), F.col("n_b") - F.col("i_b")) >= percent * (F.col("n_a") + F.col("n_b"))
    pairs = pairs.where(within & fits & enough & (F.col("component_a") != F.col("component_b")))
    across = stored(pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct(), "across")
    found = _merged(found, confirmed(estimated(across, percent / 100 - MARGIN)))

    of_class = _labelled(classes, found, "rep", "component").select(*same, "component")
    return (
        sigs.select("id", *same).join(of_class, same, "left")
        .select(
            F.col("id").alias(id_col),
            F.col("n").alias("n_shingles"),
            F.coalesce("component", "id").alias("component_id"),
            (F.coalesce("component", "id") == F.col("id")).alias("kept"),
        )
    )


def _shared(bands: DataFrame) -> DataFrame:
    return _led(stored(bands, "all-bands"))


def _led(held: DataFrame) -> DataFrame:
    """(id, band, leader, weight) of the buckets with two members or more.

    A document weighs as much as its buckets have members; a bucket's leader is its
    heaviest member.
    """
    sizes = held.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = stored(held.join(sizes, "band"), "bands")
    weight = shared.groupBy("id").agg(F.sum("size").alias("weight"))
    leaders = shared.join(weight, "id").groupBy("band").agg(F.max(F.struct("weight", "id")).alias("top"))
    leaders = leaders.select("band", F.col("top.id").alias("leader"), F.col("top.weight").alias("weight"))
    return stored(shared.select("id", "band").join(leaders, "band"), "led-bands")


def _merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, component) after more links between their nodes."""
    known = _labelled(_labelled(links, found, "a", "ca"), found, "b", "cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    more = components(known)
    grown = more.select(F.col("node").alias("component"), F.col("component").alias("to"))
    moved = found.join(grown, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return stored(moved.unionByName(more.join(found.select("node"), "node", "left_anti")), "components")


def _labelled(rows: DataFrame, found: DataFrame, column: str, name: str) -> DataFrame:
    """The rows with the component of ``column``; what has no link is its own component."""
    tags = found.select(F.col("node").alias(column), F.col("component").alias("_tag"))
    return rows.join(tags, column, "left").withColumn(name, F.coalesce("_tag", column)).drop("_tag")
