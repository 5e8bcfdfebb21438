"""Element-wise means of wide vectors, block by block.

A vector is cut into blocks of neighbouring elements, and the block number joins the key.
Tasks add up Arrow batches block by block before anything is shuffled, so a shuffle moves
one record per task and block and no record per element.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Elements of a block, and elements whose sums a task holds before it hands them on.
BLOCK, HELD = 4096, 1 << 22
_OWN = ("block", "values", "part", "turn", "sums", "counts", "mean", "n")


def in_blocks(df: DataFrame, col: str, keys: Sequence[str] = (), size: int = BLOCK) -> DataFrame:
    """(keys ..., block, values): vectors cut into ``size`` elements. A null or empty one has none."""
    if size < 1:
        raise ValueError("a block has one element at least")
    vector = F.col(col).cast("array<double>")
    last = F.floor((F.size(vector) - 1) / size).cast("int")
    blocks = F.when(F.size(vector) > 0, F.transform(
        F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("block"), F.slice(vector, i * size + 1, F.lit(size)).alias("values"))
    ))
    return df.select(*keys, F.explode(blocks).alias("_b")).select(*keys, "_b.block", "_b.values")


def _added(batch: pa.RecordBatch, n_keys: int) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """(key with block, sums, counts) of a batch; nulls do not count, a short vector ends early."""
    values = batch.column(n_keys)
    sizes = np.diff(values.offsets.to_numpy())
    flat = values.flatten()
    there = flat.is_valid().to_numpy(zero_copy_only=False)
    number = flat.fill_null(0.0).to_numpy()
    groups: dict[tuple, int] = {}
    keys = zip(*(batch.column(i).to_pylist() for i in range(n_keys)))
    own = np.array([groups.setdefault(key, len(groups)) for key in keys], np.int64)
    width = np.zeros(len(groups), np.int64)
    np.maximum.at(width, own, sizes)
    first = np.cumsum(width) - width
    row = np.repeat(np.arange(batch.num_rows), sizes)
    at = first[own[row]] + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    sums = np.bincount(at, number, int(width.sum()))
    counts = np.bincount(at, there, int(width.sum())).astype(np.int64)
    for key, g in groups.items():
        part = slice(first[g], first[g] + width[g])
        yield key, sums[part], counts[part]


def _merge(held: tuple[np.ndarray, np.ndarray] | None, sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if held is None:
        return sums, counts
    long, short = (held, (sums, counts)) if len(held[0]) >= len(sums) else ((sums, counts), held)
    out = long[0].copy(), long[1].copy()
    for a, b in zip(out, short):
        a[: len(b)] += b
    return out


def _partial(n_keys: int, names: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        size, turn, task = 0, 0, TaskContext.get().partitionId()

        def handed() -> pa.RecordBatch:
            rows = [
                dict(zip(names, key)) | {"part": task, "turn": turn, "sums": sums, "counts": counts} for key, (sums, counts) in held.items()
            ]
            return pa.RecordBatch.from_pylist(rows, schema)

        for batch in batches:
            for key, sums, counts in _added(batch, n_keys):
                before = held.get(key)
                held[key] = _merge(before, sums, counts)
                size += len(held[key][0]) - (0 if before is None else len(before[0]))
            if size > HELD:
                yield handed()
                held, size, turn = {}, 0, turn + 1
        if held:
            yield handed()

    return run


def _means(names: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total = None, None

        def mean() -> pa.RecordBatch:
            sums, counts = total
            there = counts > 0
            values = pa.array(sums / np.maximum(counts, 1), mask=~there).to_pylist()
            return pa.RecordBatch.from_pylist([dict(zip(names, current)) | {"mean": values, "n": counts}], schema)

        for batch in batches:
            keys = zip(*(batch.column(name).to_pylist() for name in names))
            for i, key in enumerate(keys):
                if key != current:
                    if total is not None:
                        yield mean()
                    current, total = key, None
                sums, counts = (batch.column(c).slice(i, 1).flatten().to_numpy() for c in ("sums", "counts"))
                total = _merge(total, sums, counts)
        if total is not None:
            yield mean()

    return run


def block_means(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys ..., block, mean, n) of (keys ..., block, values): the mean of each element over the
    rows that have it, and how many these are.

    A block counts the rows that hold it, and blocks may have different numbers of rows; a row
    that ends early has no later elements, and a null element does not count. Sums are added
    up in the order of the tasks, so that equal partitions give equal bits.
    """
    if clash := set(keys) & set(_OWN):
        raise ValueError(f"key columns may not be named {sorted(clash)}")
    names = [*keys, "block"]
    picked = rows.select(*names, F.col("values").cast("array<double>").alias("values")).where(F.col("values").isNotNull())
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.select(*names).schema]
    from pyspark.sql.pandas.types import to_arrow_schema

    def arrow(*more: str) -> tuple[str, pa.Schema]:
        ddl = ", ".join([*types, *more])
        return ddl, to_arrow_schema(rows.sparkSession.createDataFrame([], ddl).schema)

    ddl, schema = arrow("part int", "turn int", "sums array<double>", "counts array<long>")
    partial = picked.mapInArrow(_partial(len(names), names, schema), ddl)
    dealt = partial.repartition(*names).sortWithinPartitions(*names, "part", "turn")
    ddl, schema = arrow("mean array<double>", "n array<long>")
    return dealt.mapInArrow(_means(names, schema), ddl)


def vector_mean(df: DataFrame, col: str, keys: Sequence[str] | None = None, size: int = BLOCK) -> DataFrame:
    """Element-wise mean of an array column as rows (keys, pos, mean)."""
    keys = list(keys or [])
    means = block_means(in_blocks(df, col, keys, size), keys)
    long = means.select(*keys, "block", F.posexplode("mean").alias("pos", "mean"))
    return long.select(*keys, (F.col("block") * size + F.col("pos")).alias("pos"), "mean")
