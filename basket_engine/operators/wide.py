"""Scoring over catalogs of any width: weights in item blocks, a table like any other.

No row, task or driver holds a score per item of the catalog. Users and item blocks meet in
the cells of a grid: every user goes to one cell of each block, every block to one cell of
each slice of users. A task reads the block of a cell and then streams the users past it.
What comes out for a user and block is the block's part of the log-sum-exp and either the
block's scores or only its best items; the softmax is finished over these parts.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import stored
from .training import HEADS, Model

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of one block's weights, and scores that a task works out at a time.
BLOCK_BYTES, SCORES_AT_ONCE = 4 << 20, 1 << 18


def weight_rows(spark: SparkSession, model: Model, items: DataFrame) -> DataFrame:
    """(item_id, item_idx, weights, bias) of a fitted head whose labels are ``items``; items beyond
    the labels have no row."""
    weights = model.params.reshape(model.n_labels, -1)
    rows = spark.createDataFrame(
        [(i, w[:-1].tolist(), float(w[-1])) for i, w in enumerate(weights)], "item_idx long, weights array<double>, bias double"
    )
    return items.select("item_id", F.col("item_idx").cast("long").alias("item_idx")).join(rows, "item_idx")


def weight_blocks(weights: DataFrame, n_features: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, items, weights): neighbouring items together, as many as fit ``block_bytes``.

    ``weights`` has (item_id, item_idx, weights, bias) with dense indices. ``items`` are in
    ascending order and ``weights`` has their rows of ``n_features`` weights and a bias one
    after the other. A row of another width is an error.
    """
    size = max(1, block_bytes // (8 * (n_features + 1)))
    wrong = F.concat(F.lit("item without "), F.lit(n_features), F.lit(" weights: "), F.col("item_id").cast("string"))
    row = F.when(F.size("weights") == n_features, F.concat("weights", F.array("bias"))).otherwise(F.raise_error(wrong))
    placed = weights.select(F.floor(F.col("item_idx") / size).cast("int").alias("block"), F.struct("item_id", row.alias("w")).alias("item"))
    nested = placed.groupBy("block").agg(F.array_sort(F.collect_list("item")).alias("rows"))
    return nested.select("block", F.col("rows.item_id").alias("items"), F.flatten("rows.w").alias("weights"))


def _parts(n_features: int, softmax: bool, top: int | None):
    def scored(ids: pa.Array, x: np.ndarray, items: pa.Array, weights: np.ndarray) -> pa.RecordBatch:
        z = x @ weights[:, :-1].T + weights[:, -1]
        high = z.max(axis=1)
        total = np.exp(z - high[:, None]).sum(axis=1) if softmax else np.zeros(len(z))
        if top is None or top >= z.shape[1]:
            best = np.broadcast_to(np.arange(z.shape[1]), z.shape)
        else:  # items ascend, and a stable sort keeps the first of equal scores
            best = np.argsort(-z, axis=1, kind="stable")[:, :top]
        pairs = pa.StructArray.from_arrays(
            [items.take(pa.array(best.ravel())), pa.array(np.take_along_axis(z, best, axis=1).ravel())], ["item_id", "z"]
        )
        offsets = pa.array(np.arange(0, best.size + 1, best.shape[1], dtype=np.int32))
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(high), pa.array(total), pa.ListArray.from_arrays(offsets, pairs)], ["row", "high", "total", "scored"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = weights = None
        for batch in batches:
            block = batch.column("is_block").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(block)
            lo = 0
            while lo < batch.num_rows:
                if block[lo]:  # the cell's block comes before its users
                    items = batch.column("items").slice(lo, 1).flatten()
                    weights = batch.column("x").slice(lo, 1).flatten().to_numpy().reshape(len(items), n_features + 1)
                    lo += 1
                    continue
                after = edges[edges > lo]
                hi = min(int(after[0]) if len(after) else batch.num_rows, lo + max(1, SCORES_AT_ONCE // len(items)))
                own = batch.slice(lo, hi - lo)
                x = own.column("x").flatten().to_numpy()
                if len(x) != own.num_rows * n_features:
                    raise ValueError(f"a row has not {n_features} features")
                yield scored(own.column("row"), x.reshape(own.num_rows, n_features), items, weights)
                lo = hi

    return run


def block_scores(rows: DataFrame, blocks: DataFrame, n_features: int, head: str, top: int | None = None) -> DataFrame:
    """(row, high, total, scored): for each ``row`` of (row, x) and block, the greatest score, the
    sum of exponentials below it, and (item_id, z) of the block's items or its ``top`` best."""
    if head not in HEADS:
        raise ValueError(f"head must be one of {HEADS}")
    spark = rows.sparkSession
    n_blocks = blocks.agg(F.coalesce(F.max("block") + 1, F.lit(0))).first()[0]
    kind = blocks.schema["items"].dataType.elementType.simpleString()
    slices = max(1, math.ceil(2 * spark.sparkContext.defaultParallelism / max(1, n_blocks)))
    cell = lambda block, part: (block * F.lit(slices) + part).cast("int").alias("cell")
    none = F.lit(None).cast(f"array<{kind}>").alias("items")
    row_kind = rows.schema["row"].dataType.simpleString()
    left = blocks.select(
        F.col("block"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("part"), "items", "weights"
    ).select(cell(F.col("block"), F.col("part")), F.lit(True).alias("is_block"), F.lit(None).cast(row_kind).alias("row"), F.col("weights").alias("x"), "items")
    spread = F.pmod(F.xxhash64("row"), F.lit(slices))
    every = F.explode(F.sequence(F.lit(0), F.lit(max(n_blocks, 1) - 1))).alias("block")
    right = rows.select("row", "x", spread.alias("part"), every).select(
        cell(F.col("block"), F.col("part")), F.lit(False).alias("is_block"), "row", "x", none
    )
    if not n_blocks:
        right = right.limit(0)
    grid = left.unionByName(right).repartition(max(1, n_blocks * slices), "cell").sortWithinPartitions("cell", F.desc("is_block"))
    schema = f"row {row_kind}, high double, total double, scored array<struct<item_id: {kind}, z: double>>"
    return grid.select("is_block", "row", "x", "items").mapInArrow(_parts(n_features, head == "softmax", top), schema)


def log_totals(parts: DataFrame) -> DataFrame:
    """(row, log_total): log of the sum of exponentials of all scores of a row, in two passes over
    the parts of its blocks: the greatest score, then the sum below it."""
    high = parts.groupBy("row").agg(F.max("high").alias("highest"))
    sums = parts.select("row", "high", "total").join(high, "row").groupBy("row", "highest").agg(
        F.sum(F.col("total") * F.exp(F.col("high") - F.col("highest"))).alias("total")
    )
    return sums.select("row", (F.col("highest") + F.log("total")).alias("log_total"))


def _finished(parts: DataFrame, head: str) -> DataFrame:
    """(row, scored, log_total) with a total of 0 for a linear head, whose scores stand as they are."""
    if head == "linear":
        return parts.select("row", "scored", F.lit(0.0).alias("log_total"))
    parts = stored(parts, "block-scores")
    return parts.select("row", "scored").join(log_totals(parts), "row")


def _value(head: str, z: str) -> Column:
    return F.col(z) if head == "linear" else F.exp(F.col(z) - F.col("log_total"))


def _numbered(users: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Rows with features and a number of their own, so that equal rows stay apart."""
    return stored(users.where(F.col("x").isNotNull()).select(F.monotonically_increasing_id().alias("row"), *keep, "x"), "scored-rows")


def score_wide(
    users: DataFrame, weights: DataFrame, n_features: int, head: str = "softmax", keep: Sequence[str] = ("user_id",), block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(keep ..., item_id, score) of every row of ``users`` and every item of ``weights``.

    ``users`` has the columns ``keep`` and the features ``x``; a row without features has no
    scores, and equal rows are scored each. See ``weight_blocks`` for ``weights``.
    """
    rows = _numbered(users, keep)
    parts = block_scores(rows.select("row", "x"), stored(weight_blocks(weights, n_features, block_bytes), "blocks"), n_features, head)
    done = _finished(parts, head).join(rows.select("row", *keep), "row")
    long = done.select(*keep, "log_total", F.inline("scored"))
    return long.select(*keep, "item_id", _value(head, "z").alias("score"))


def top_wide(
    users: DataFrame, weights: DataFrame, n_features: int, k: int, head: str = "softmax", keep: Sequence[str] = ("user_id",), block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(keep ..., rank, item_id, score): the ``k`` best items of every row, by score and then item.

    A block hands on its ``k`` best items of a row and its part of the softmax, never more.
    """
    if k < 1:
        raise ValueError("k must be positive")
    rows = _numbered(users, keep)
    parts = block_scores(rows.select("row", "x"), stored(weight_blocks(weights, n_features, block_bytes), "blocks"), n_features, head, k)
    long = _finished(parts, head).select("row", "log_total", F.inline("scored"))
    order = Window.partitionBy("row").orderBy(F.desc("z"), "item_id")
    best = long.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(rows.select("row", *keep), "row").select(*keep, "rank", "item_id", _value(head, "z").alias("score"))
