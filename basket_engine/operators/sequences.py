"""Per-user month sequences, recent-row matrices and next-month targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.arrays import without_nan, zeros
from ..functions.scalars import month_axis, month_position
from ..settings import RECENT_ROWS_TRAIN, SEQUENCE_END, SEQUENCE_START
from .skew import join_skewed

OFF_AXIS = ("last", "drop")


def month_sequences(
    rows: DataFrame,
    n_features: int,
    n_labels: int,
    start: int = SEQUENCE_START,
    end: int = SEQUENCE_END,
    off_axis: str = "last",
    user: str = "user_id",
    month: str = "year_month",
) -> DataFrame:
    """One row per user with a step for each month of the axis.

    ``rows``: (user, month, features, label). A step is
    (ym, x, y, x_mask, y_mask); a month without a row has zero vectors and zero
    masks. ``y_mask`` is set on the axis end, or where the user has a single row.
    Months off the axis take the last step unless it is filled (``last``) or are
    left out (``drop``); they count as rows either way.
    """
    if off_axis not in OFF_AXIS:
        raise ValueError(f"off_axis must be one of {OFF_AXIS}")
    axis = month_axis(start, end)
    place = month_position(F.col(month), start)
    valid = (F.pmod(F.col(month), F.lit(100)).between(1, 12)) & place.between(0, len(axis) - 1)
    elsewhere = len(axis) - 1 if off_axis == "last" else -1
    placed = rows.select(
        user,
        F.when(valid, place).otherwise(F.lit(elsewhere)).alias("slot"),
        F.struct(
            (~F.coalesce(valid, F.lit(False))).alias("off"),
            F.col(month).alias("ym"),
            without_nan(F.col("features")).alias("x"),
            without_nan(F.col("label")).alias("y"),
        ).alias("row"),
    )
    # One row per (user, step) first, combined map-side; then at most one per step.
    per_step = placed.groupBy(user, "slot").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("n"))
    per_user = per_step.groupBy(user).agg(
        F.sum("n").alias("n_rows"),
        F.map_from_entries(F.collect_list(F.struct("slot", "row"))).alias("by_slot"),
    )
    axis_col = F.array(*[F.lit(m) for m in axis])

    def step(ym, i):
        row = F.try_element_at("by_slot", i)
        there = row.isNotNull()
        labelled = there & ((row["ym"] == F.lit(end)) | (F.col("n_rows") == 1))
        return F.struct(
            ym.alias("ym"),
            F.coalesce(row["x"], zeros(n_features)).alias("x"),
            F.coalesce(row["y"], zeros(n_labels)).alias("y"),
            there.cast("double").alias("x_mask"),
            labelled.cast("double").alias("y_mask"),
        )

    return per_user.select(user, "n_rows", F.transform(axis_col, step).alias("steps"))


def flatten_sequences(seqs: DataFrame, user: str = "user_id") -> DataFrame:
    """Masked steps side by side as ``x``; the label at the labelled step as ``y``.

    Users without a labelled step keep ``y`` NULL (they can be scored, not fitted).
    """
    masked = F.flatten(F.transform("steps", lambda s: F.transform(s["x"], lambda v: v * s["x_mask"])))
    labelled = F.filter("steps", lambda s: s["y_mask"] > 0)
    return seqs.select(user, masked.alias("x"), F.get(labelled["y"], F.lit(0)).alias("y"))


def recent_rows(
    rows: DataFrame,
    n: int = RECENT_ROWS_TRAIN,
    user: str = "user_id",
    month: str = "year_month",
    tie: Sequence[str] = (),
) -> DataFrame:
    """The newest ``n`` rows per user with their row in the matrix, newest last."""
    newest = Window.partitionBy(user).orderBy(F.col(month).desc(), *[F.col(c).desc() for c in tie])
    kept = rows.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= n)
    return kept.withColumn("matrix_row", F.lit(n) - F.col("_rn")).drop("_rn")


def recent_matrix(
    rows: DataFrame,
    n_features: int,
    n: int = RECENT_ROWS_TRAIN,
    user: str = "user_id",
    month: str = "year_month",
    tie: Sequence[str] = (),
) -> DataFrame:
    """``n`` x features and ``n`` x 1 labels per user, zero rows at the old end."""
    kept = recent_rows(rows, n, user, month, tie)
    nested = kept.groupBy(user).agg(
        F.array_sort(
            F.collect_list(F.struct("matrix_row", F.col("features").alias("x"), F.col("label").cast("double").alias("y")))
        ).alias("_rows")
    )
    missing = F.lit(n) - F.size("_rows")
    return nested.select(
        user,
        F.size("_rows").alias("n_rows"),
        F.concat(F.array_repeat(zeros(n_features), missing), F.col("_rows.x")).alias("features"),
        F.concat(zeros(missing), F.col("_rows.y")).alias("labels"),
    )


def target_split(rows: DataFrame, target: int, month: str = "year_month") -> tuple[DataFrame, DataFrame]:
    """(training rows, prediction rows without their label): split at one month."""
    is_target = F.col(month) == F.lit(target)
    train = rows.where(~F.coalesce(is_target, F.lit(False)))
    predict = rows.where(is_target)
    return train, predict.drop("label") if "label" in rows.columns else predict


def next_target(
    rows: DataFrame,
    col: str = "label",
    name: str = "target",
    user: str = "user_id",
    month: str = "year_month",
) -> DataFrame:
    """Value of ``col`` in the user's following row, NULL on the last one.

    One row per (user, month): a user's rows are bounded by the calendar.
    """
    return rows.withColumn(name, F.lead(col).over(Window.partitionBy(user).orderBy(month)))


def subtract_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left rows equal to no right row; duplicates on the left stay.

    Rows are compared by a digest in which NULL equals NULL. Many copies of one row
    are a hot digest and stay out of the shuffle.
    """
    # Fields are kept apart by the JSON array, NULL from text by the missing field.
    fields = F.array(*[F.to_json(F.struct(F.col(c).alias("v"))) for c in left.columns])
    digest = F.sha2(F.to_json(fields), 256)
    present = right.select(*left.columns).select(digest.alias("_row")).distinct()
    return join_skewed(left.withColumn("_row", digest), present, ["_row"], "left_anti").drop("_row")


def exclude_users(rows: DataFrame, excluded: DataFrame, user: str = "user_id", row_id: Sequence[str] | None = None) -> DataFrame:
    return join_skewed(rows, excluded.select(user).distinct(), [user], "left_anti", row_id=row_id)
