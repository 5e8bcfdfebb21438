"""Dense numbering over any number of rows without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stored
from .skew import attach_totals


def global_index(df: DataFrame, order: Sequence[str | Column], name: str = "idx") -> DataFrame:
    """0-based position of each row in the total order given by ``order``.

    Rows are range-sorted across tasks and numbered inside each partition; then
    every partition is shifted by the sizes of those before it. Only these sizes,
    one per partition of the sort, pass through the driver. ``order`` should tell
    rows apart, or equal rows end up in one range. The placed rows are stored: the
    sizes and the final numbers must see the same placement.
    """
    placed = stored(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()), "placed")
    part = F.shiftrightunsigned("_place", 33).cast("int")
    within = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dict(placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("size")).collect())
    shifts, before = [], 0
    for i in range(max(sizes, default=0) + 1):
        shifts.append(before)
        before += sizes.get(i, 0)
    shift = F.element_at(F.lit(np.array(shifts, dtype=np.int64)), part + 1)
    return placed.withColumn(name, shift + within).drop("_place")


def ordinal_in_group(
    df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "ordinal"
) -> DataFrame:
    """0-based position inside each group; a group may span many tasks."""
    placed = global_index(df, [*group, *order], "_idx")
    started = attach_totals(placed, group, [F.min("_idx").alias("_start")], row_id=["_idx"])
    return started.withColumn(name, F.col("_idx") - F.col("_start")).drop("_idx", "_start")


def balanced_split(
    df: DataFrame, key: str, n_splits: int, seed: int, name: str = "split"
) -> DataFrame:
    """Seeded random split whose parts differ in size by one row at most."""
    if n_splits < 1:
        raise ValueError("at least one split is needed")
    keyed = df.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed)))
    placed = global_index(keyed, ["_h", key], "_idx")
    return placed.withColumn(name, F.pmod("_idx", F.lit(n_splits)).cast("int")).drop("_h", "_idx")


def fixed_batches(df: DataFrame, order: Sequence[str], batch_size: int, name: str = "batch_id") -> DataFrame:
    """Consecutive batches of exactly ``batch_size`` rows (the last may be short)."""
    placed = global_index(df, order, "_idx")
    return placed.withColumn(name, F.floor(F.col("_idx") / batch_size).cast("long")).drop("_idx")
