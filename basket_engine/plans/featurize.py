"""Pipeline 1: purchases to training rows per user and month."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import split_by_month
from ..operators import dictionary as D, features as X, vectors as V
from ..operators.skew import join_skewed
from ..session import stored
from ..settings import PACKED_BASKET, SPLIT_CUTOFF


def basket_features(
    tx: DataFrame,
    pairs: DataFrame,
    risk: str,
    variables: Sequence[str],
    row_id: Sequence[str] | None = None,
) -> DataFrame:
    """Complete rows of known users and items with their basket shares.

    Missing numbers enter as -1; the risk score enters as its frequency.
    """
    cols = [risk, *variables]
    complete = X.impute(X.drop_missing(tx), cols)
    # Read three times below: for frequencies, for basket sums and for the result.
    known = stored(X.membership(complete, pairs, row_id=row_id), "known")
    encoded = X.frequency_encode(known, risk, row_id=row_id)
    return X.basket_share(encoded, cols, row_id=row_id)


def training_rows(
    tx: DataFrame,
    pairs: DataFrame,
    item_factors: DataFrame,
    k: int,
    value: str,
    user_factors: DataFrame | None = None,
    correlations: DataFrame | None = None,
    max_basket: int = PACKED_BASKET,
    on_overflow: str = "error",
    cutoff: int = SPLIT_CUTOFF,
    line: Sequence[str] = ("line_key",),
) -> tuple[DataFrame, DataFrame]:
    """(examples, item dictionary). ``value`` is the variable behind the net values.

    The known rows are materialized once: the dictionary, the basket sums and the
    slots all read them. Given ``correlations``, users without one are left out.
    """
    known = X.membership(X.impute(X.drop_missing(tx), [value]), pairs, row_id=line)
    items = D.dictionary(pairs, "item_id")
    placed = stored(
        D.with_index(known.select("user_id", "item_id", "year_month", value, *line), items, "item_id", row_id=line)
    )
    packed = V.packed_vectors(
        placed, item_factors, k, value, user_factors, max_basket, on_overflow, order=("item_idx", *line)
    )
    if correlations is not None:
        users = correlations.select("user_id").distinct()
        packed = join_skewed(packed, users, ["user_id"], "left_semi", row_id=["user_id", "year_month"])
    return packed.withColumn("split", split_by_month(F.col("year_month"), cutoff)), items
