"""Sorted dictionaries and multi-hot labels over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.arrays import multi_hot
from ..session import stored
from .indexing import global_index
from .skew import join_skewed


def dictionary(df: DataFrame, col: str, index: str | None = None) -> DataFrame:
    """Distinct values in ascending order with a dense 0-based index."""
    values = df.select(col).where(F.col(col).isNotNull()).distinct()
    return global_index(values, [col], index or col.removesuffix("_id") + "_idx")


def with_index(
    df: DataFrame,
    values: DataFrame,
    col: str,
    index: str | None = None,
    row_id: Sequence[str] | None = None,
) -> DataFrame:
    """Index of a value in the dictionary, -1 where it has none."""
    index = index or col.removesuffix("_id") + "_idx"
    out = join_skewed(df, values.select(col, index), [col], "left", row_id=row_id)
    return out.withColumn(index, F.coalesce(F.col(index), F.lit(-1)))


def label_indices(tx: DataFrame, keys: Sequence[str], index: str = "item_idx", name: str = "label_idx") -> DataFrame:
    """Sparse label per key: the sorted set of dictionary positions seen.

    The set is built map-side and can never outgrow the dictionary.
    """
    return tx.where(F.col(index) >= 0).groupBy(*keys).agg(F.sort_array(F.collect_set(index)).alias(name))


def running_label_indices(
    tx: DataFrame,
    user: str = "user_id",
    month: str = "year_month",
    index: str = "item_idx",
    name: str = "label_idx",
) -> DataFrame:
    """Sparse label of all items a user has seen up to and including each month.

    Rows are reduced to the first month per user and item, which is at most one
    dictionary per user, and each month of the user keeps those that came in time.
    The input is read once.
    """
    known = stored(tx.where(F.col(index) >= 0).select(user, month, index).distinct(), "seen")
    months = known.select(user, month).distinct()
    firsts = known.groupBy(user, index).agg(F.min(month).alias("since"))
    nested = firsts.groupBy(user).agg(F.array_sort(F.collect_list(F.struct(index, "since"))).alias("_firsts"))
    in_time = F.filter("_firsts", lambda f: f["since"] <= F.col(month))
    return months.join(nested, user).select(user, month, in_time[index].alias(name))


def dense_label(df: DataFrame, n_items: int, sparse: str = "label_idx", name: str = "label") -> DataFrame:
    return df.withColumn(name, multi_hot(F.col(sparse), n_items))
