"""Equi-joins and group totals that stay balanced when one key is hot.

Rows are counted per key first. A key that holds more than ``1 / slices`` of all
rows is called hot. There can be at most ``slices`` such keys, so the list of hot
keys has a proven size: it is fetched, and where it is empty the plain join is used.
What happens to the rows of a hot key depends on what tells them apart:

* With ``row_id`` (columns identifying a row) they are spread over several slices
  by a hash of it, and the other side is repeated once per slice of that key.
* Without it the rows may be exact copies, which no hash can spread. The other
  side must then have one row per key, so its rows for the hot keys are as few as
  the keys, and they are broadcast; hot rows are never shuffled at all.

Every other key joins as usual and nothing is dropped. If the planner's size
estimate of the right side is below its own broadcast threshold there is no shuffle
of the left side to balance: nothing is counted and the join is left to the planner.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stored
from ..settings import skew_min_rows, skew_slices

JOIN_KINDS = ("inner", "left", "left_semi", "left_anti")


def fits_broadcast(df: DataFrame) -> bool:
    """Whether the planner's own estimate allows this side to be broadcast."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return 0 <= int(str(size)) <= int(limit)


def hot_keys(counts: DataFrame, keys: Sequence[str], n_col: str = "_n") -> DataFrame | None:
    """Keys too big for one task, with the number of slices each is cut into.

    None if there are none. At most ``slices`` rows come back, since each of them
    holds more than that part of the total.
    """
    spark = counts.sparkSession
    total = counts.agg(F.sum(n_col).alias("total")).scalar()
    limit = F.greatest(total / F.lit(float(skew_slices(spark))), F.lit(float(skew_min_rows(spark))))
    found = counts.where(F.col(n_col) > limit).select(
        *keys, F.ceil(F.col(n_col) / limit).cast("int").alias("_slices")
    )
    rows = found.collect()
    return spark.createDataFrame(rows, found.schema) if rows else None


def key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))


def _any_null(keys: Sequence[str]) -> Column:
    found = F.lit(False)
    for key in keys:
        found = found | F.col(key).isNull()
    return found


def join_skewed(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    counts: DataFrame | None = None,
    row_id: Sequence[str] | None = None,
) -> DataFrame:
    """``left.join(right, keys, how)`` that stays balanced for hot keys of ``left``.

    Without ``row_id`` the right side should have one row per key. ``counts`` gives
    rows ``_n`` per key, of the left side or of rows including it,
    where that is cheaper than counting the left side here.
    """
    if how not in JOIN_KINDS:
        raise ValueError(f"unsupported join kind {how!r}")
    keys = list(keys)
    if fits_broadcast(right):
        return left.join(right, keys, how)
    hot = hot_keys(counts if counts is not None else key_counts(left, keys), keys)
    if hot is None:
        return left.join(right, keys, how)
    if row_id is None:
        return _join_hot_apart(left, right, keys, how, hot.select(*keys))
    return _join_sliced(left, right, keys, how, hot, row_id)


def _join_sliced(
    left: DataFrame, right: DataFrame, keys: list[str], how: str, hot: DataFrame, row_id: Sequence[str]
) -> DataFrame:
    spread = F.xxhash64(*[F.col(c) for c in row_id])
    # NULL keys never match, so they may sit on any slice: spread them evenly.
    pick = F.when(_any_null(keys), F.pmod(spread, F.lit(skew_slices(left.sparkSession)))).otherwise(
        F.pmod(spread, F.coalesce(F.col("_slices"), F.lit(1)))
    )
    placed = left.join(F.broadcast(hot), keys, "left").withColumn("_slice", pick.cast("int")).drop("_slices")
    slices = F.sequence(F.lit(0), F.coalesce(F.col("_slices"), F.lit(1)) - 1)
    copies = right.join(F.broadcast(hot), keys, "left").withColumn("_slice", F.explode(slices)).drop("_slices")
    return placed.join(copies, keys + ["_slice"], how).drop("_slice")


def _join_hot_apart(left: DataFrame, right: DataFrame, keys: list[str], how: str, hot: DataFrame) -> DataFrame:
    marked = left.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    apart = F.col("_hot").isNotNull() | _any_null(keys)
    hot_right = F.broadcast(right.join(F.broadcast(hot), keys, "left_semi"))
    hot_part = marked.where(apart).drop("_hot").join(hot_right, keys, how)
    rest = marked.where(~apart).drop("_hot").join(right, keys, how)
    return hot_part.unionByName(rest)


def attach_totals(
    df: DataFrame,
    keys: Sequence[str],
    totals: Sequence[Column],
    row_id: Sequence[str] | None = None,
) -> DataFrame:
    """Each row with the aggregates of its group.

    A window would bring a whole group into one task; here the aggregates are
    combined map-side, stored, and joined back.
    """
    grouped = stored(df.groupBy(*keys).agg(*totals, F.count(F.lit(1)).alias("_n")), "totals")
    return join_skewed(
        df, grouped.drop("_n"), keys, "left", counts=grouped.select(*keys, "_n"), row_id=row_id
    )


def group_rows(
    df: DataFrame,
    keys: Sequence[str],
    row_id: Sequence[str] | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Rows nested per key: one record (keys, part, n_rows, rows).

    A hot key is delivered in several parts, so no record outgrows a task; every
    other key has the single part 0. Without ``row_id`` equal rows are nested once
    with their number in the field ``copies``.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    if row_id is None:
        df = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("copies"))
        row_id, rest, weight = rest, rest + ["copies"], F.sum("copies")
    else:
        weight = F.count(F.lit(1))
    hot = hot_keys(counts if counts is not None else key_counts(df, keys), keys)
    if hot is None:
        placed = df.withColumn("part", F.lit(0))
    else:
        spread = F.xxhash64(*[F.col(c) for c in row_id])
        part = F.pmod(spread, F.coalesce(F.col("_slices"), F.lit(1))).cast("int")
        placed = df.join(F.broadcast(hot), keys, "left").withColumn("part", part)
    return placed.groupBy(*keys, "part").agg(
        weight.alias("n_rows"), F.sort_array(F.collect_list(F.struct(*rest))).alias("rows")
    )
