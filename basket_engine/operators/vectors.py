"""Training vectors per (user, month): packed and slot layouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType

from ..functions.arrays import padded, slot_layout
from ..functions.scalars import ratio
from ..session import stored
from ..settings import PACKED_BASKET
from .features import BASKET
from .indexing import ordinal_in_group
from .skew import group_rows, join_skewed, key_counts

OVERFLOW = ("error", "truncate")


def basket_position(
    tx: DataFrame,
    keys: Sequence[str] = BASKET,
    order: Sequence[str] = ("item_idx", "line_key"),
    upto: int | None = None,
    name: str = "position",
) -> DataFrame:
    """0-based position of each row in its basket, by dictionary index then line.

    With ``upto`` only that many first rows of each basket are kept; the planner
    then cuts every basket down before the shuffle. Without it a basket may be of
    any size and is numbered across tasks.
    """
    if upto is None:
        return ordinal_in_group(tx, keys, order, name)
    ranked = tx.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rn") <= upto).withColumn(name, (F.col("_rn") - 1).cast("long")).drop("_rn")


def attach_factors(
    df: DataFrame,
    factors: DataFrame,
    key: str,
    name: str,
    row_id: Sequence[str] | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Inner join with a factor table ``(key, factors)`` on the entity itself.

    Keys are counted on ``counts`` if given: rows including those of ``df``.
    """
    dim = factors.select(key, F.col("factors").alias(name))
    counted = None if counts is None else key_counts(counts, [key])
    return join_skewed(df, dim, [key], "inner", counts=counted, row_id=row_id)


def _check_basket_limit(tx: DataFrame, max_basket: int, on_overflow: str) -> None:
    if on_overflow not in OVERFLOW:
        raise ValueError(f"on_overflow must be one of {OVERFLOW}")
    limit = int(tx.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if not 0 < max_basket < limit:
        raise ValueError(f"max_basket must be between 1 and {limit - 1}")


def packed_vectors(
    tx: DataFrame,
    item_factors: DataFrame,
    k: int,
    value: str,
    user_factors: DataFrame | None = None,
    max_basket: int = PACKED_BASKET,
    on_overflow: str = "error",
    user: str = "user_id",
    month: str = "year_month",
    item: str = "item_id",
    order: Sequence[str] = ("item_idx", "line_key"),
) -> DataFrame:
    """One row per (user, month): basket item factors side by side, nets, label set.

    ``tx`` carries ``item_idx``. Without ``user_factors`` the features are
    ``max_basket`` slots of ``k`` factors and one net value per slot (share of
    ``value`` in the basket over the basket size). With ``user_factors`` these
    come first, then the slots, then the mean share as a single net value.

    A basket above ``max_basket`` rows raises, or keeps its first rows under
    ``truncate``; sums, sizes and labels always cover the whole basket.
    """
    _check_basket_limit(tx, max_basket, on_overflow)
    keys = [user, month]
    # Read for the slots and for the baskets.
    tx = stored(tx.select(*dict.fromkeys([*keys, item, value, "item_idx", *order])), "purchases")
    # One row beyond the limit is enough to notice an overflow.
    kept = basket_position(tx.select(*keys, item, value, *order), keys, order, upto=max_basket + 1)
    with_factors = join_skewed(
        kept.select(*keys, item, value, "position"),
        item_factors.select(item, F.col("factors").alias("_f")),
        [item],
        "left",
        counts=key_counts(tx, [item]),
        row_id=[*keys, "position"],
    )
    known = F.coalesce(F.col("_f"), F.raise_error(F.concat(F.lit("no factors for item "), F.col(item).cast("string"))))
    slots = with_factors.groupBy(*keys).agg(
        F.array_sort(
            F.collect_list(F.struct("position", known.alias("f"), F.abs(F.col(value)).cast("double").alias("v")))
        ).alias("_slots")
    )
    baskets = stored(tx.groupBy(*keys).agg(
        F.sum(value).alias("_sum"),
        F.sum(F.abs(F.col(value))).alias("_abs"),
        F.count(F.lit(1)).alias("basket_size"),
        F.sort_array(F.collect_set("item_idx")).alias("label_idx"),
    ), "baskets")
    out = slots.join(baskets, keys)
    if on_overflow == "error":
        message = F.concat(F.lit(f"basket above {max_basket} rows: "), F.col(user).cast("string"))
        checked = F.when(F.size("_slots") > max_basket, F.raise_error(message)).otherwise(F.col("_slots"))
    else:
        checked = F.slice("_slots", 1, max_basket)
    out = out.withColumn("_slots", checked)
    packed = padded(F.flatten(F.col("_slots.f")), max_basket * k)
    if user_factors is None:
        nets = padded(
            F.transform("_slots", lambda s: ratio(ratio(s["v"], F.col("_sum")), F.col("basket_size"))), max_basket
        )
        out = out.withColumn("features", F.concat(packed, nets))
    else:
        net = ratio(ratio(F.col("_abs"), F.col("_sum")), F.col("basket_size"))
        # Every row of ``out`` is a basket; counting these makes no vector.
        out = attach_factors(out, user_factors, user, "_u", row_id=keys, counts=baskets)
        out = out.withColumn("features", F.concat(F.col("_u"), packed, F.array(net)))
    return out.select(*keys, "basket_size", "features", "label_idx")


def slot_vectors(
    rows: DataFrame,
    item_factors: DataFrame,
    user_factors: DataFrame,
    n_items: int,
    k: int,
    user: str = "user_id",
    item: str = "item_id",
    index: str = "item_idx",
    row_id: Sequence[str] | None = None,
) -> DataFrame:
    """Adds ``features``: user factors and the row's item in its own slot, zeros else.

    Works per input row, so the caller decides between one row per basket item
    and one per item and variable. Rows of users or items without factors drop.
    """
    out = attach_factors(rows, user_factors, user, "_u", row_id=row_id)
    out = attach_factors(out, item_factors, item, "_i", row_id=row_id, counts=rows)
    vector = slot_layout(F.col("_u"), F.col("_i"), F.col(index), n_items, k)
    return out.withColumn("features", vector).drop("_u", "_i")


def item_values(
    long_rows: DataFrame,
    user: str = "user_id",
    item: str = "item_id",
    order: Sequence[str] = ("year_month", "line_key", "variable"),
    value: str = "share",
    counts: DataFrame | None = None,
) -> DataFrame:
    """All values of an item within a user, in a fixed order: (user, item, part, values).

    A row has one value, or an array of its values in their order.
    One part per pair, except for a pair too large for one task, which is
    delivered in several.
    """
    nested = group_rows(long_rows.select(user, item, *order, value), [user, item], row_id=order, counts=counts)
    values = F.col(f"rows.{value}")
    if isinstance(long_rows.schema[value].dataType, ArrayType):
        values = F.flatten(values)
    return nested.select(user, item, "part", values.alias("values"))


def append_values(
    vectors: DataFrame, values: DataFrame, user: str = "user_id", item: str = "item_id"
) -> DataFrame:
    """The slot vector followed by the item's values; one row per part of the values."""
    # A pair may have several parts, so the rows need an identity to be spread by.
    identity = [c for c in vectors.columns if c != "features"]
    joined = join_skewed(vectors, values, [user, item], "inner", row_id=identity)
    return joined.withColumn("features", F.concat("features", "values")).drop("values")
