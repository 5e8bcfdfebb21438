"""Purchase features: filters, frequency encoding, basket shares, softmax."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import imputed, log_odds as log_odds_expr, ratio
from ..session import stored
from ..settings import IMPUTED_VALUE, SHARE_SMOOTHING
from .skew import attach_totals, join_skewed, key_counts

BASKET = ("user_id", "year_month")


def drop_missing(tx: DataFrame, cols: Sequence[str] = ("user_id", "item_id")) -> DataFrame:
    return tx.dropna(subset=list(cols))


def impute(tx: DataFrame, cols: Sequence[str], value: float = IMPUTED_VALUE) -> DataFrame:
    return tx.withColumns({c: imputed(F.col(c), value) for c in cols})


def membership(
    tx: DataFrame,
    pairs: DataFrame,
    keys: Sequence[str] = ("user_id", "item_id"),
    row_id: Sequence[str] | None = None,
) -> DataFrame:
    """Rows whose value of every key column occurs in the training pairs."""
    kept = tx
    for key in keys:
        allowed = stored(pairs.select(key).where(F.col(key).isNotNull()).distinct(), "allowed")
        # Counted on the input: one narrow scan per key, whatever the chain length.
        kept = join_skewed(kept, allowed, [key], "left_semi", counts=key_counts(tx, [key]), row_id=row_id)
    return kept


def value_frequency(tx: DataFrame, col: str, name: str = "freq") -> DataFrame:
    return tx.groupBy(col).agg(F.count(F.lit(1)).alias(name))


def frequency_encode(
    tx: DataFrame,
    col: str,
    name: str | None = None,
    counted: DataFrame | None = None,
    row_id: Sequence[str] | None = None,
) -> DataFrame:
    """Each value replaced by how often it occurs (0 if it was never counted).

    ``counted`` counts another set of rows than the encoded ones.
    """
    if counted is None:
        out = attach_totals(tx, [col], [F.count(F.lit(1)).alias("_freq")], row_id=row_id)
    else:
        out = join_skewed(tx, stored(value_frequency(counted, col, "_freq"), "counted"), [col], "left", row_id=row_id)
    freq = F.coalesce(F.col("_freq"), F.lit(0)).cast("double")
    return out.withColumn(name or col, freq).drop("_freq")


def basket_share(
    tx: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str] = BASKET,
    eps: float = 0.0,
    prefix: str = "share_",
    row_id: Sequence[str] | None = None,
) -> DataFrame:
    """``abs(x) / (sum of x in the basket + eps)`` for each column; NULL if undefined."""
    sums = [F.sum(c).alias(f"_sum_{c}") for c in cols]
    out = attach_totals(tx, keys, sums, row_id=row_id)
    shares = {prefix + c: ratio(F.abs(F.col(c)), F.col(f"_sum_{c}") + F.lit(eps)) for c in cols}
    return out.withColumns(shares).drop(*[f"_sum_{c}" for c in cols])


def smoothed_share(
    tx: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str] = BASKET,
    row_id: Sequence[str] | None = None,
) -> DataFrame:
    """Long form of the smoothed share: one row per input row and variable."""
    wide = basket_share(tx, cols, keys, eps=SHARE_SMOOTHING, row_id=row_id)
    kept = [c for c in tx.columns if c not in cols]
    return wide.unpivot(kept, [F.col("share_" + c).alias(c) for c in cols], "variable", "share")


def net_mean(tx: DataFrame, col: str, keys: Sequence[str] = BASKET) -> DataFrame:
    """Mean share of one variable over the basket, from its sums alone."""
    total = F.sum(F.abs(F.col(col)))
    return tx.groupBy(*keys).agg(
        (ratio(total, F.sum(col)) / F.count(F.lit(1))).alias("net"),
        F.count(F.lit(1)).alias("basket_size"),
    )


def add_log_odds(df: DataFrame, col: str, name: str = "log_odds", form: str = "as_given") -> DataFrame:
    return df.withColumn(name, log_odds_expr(F.col(col), form))


SOFTMAX_STEP = 64.0


def group_softmax(
    df: DataFrame,
    key: str,
    col: str,
    name: str = "softmax",
    row_id: Sequence[str] | None = None,
) -> DataFrame:
    """``exp(s) / sum(exp(s))`` within a group, safe against overflow.

    The group's log-sum-exp is found in one pass over the rows: scores are summed
    per step of width 64 relative to the step, and the few steps of a group are
    then combined relative to its highest step.
    """
    step = F.floor(F.col(col) / SOFTMAX_STEP)
    per_step = df.groupBy(key, step.alias("_step")).agg(
        F.sum(F.exp(F.col(col) - step * SOFTMAX_STEP)).alias("_part"),
        F.count(F.lit(1)).alias("_rows"),
    )
    top = F.max("_step").over(Window.partitionBy(key))
    grouped = stored(
        per_step.withColumn("_top", top)
        .groupBy(key)
        .agg(
            F.max("_top").alias("_top"),
            F.sum(F.col("_part") * F.exp((F.col("_step") - F.col("_top")) * SOFTMAX_STEP)).alias("_mass"),
            F.sum("_rows").alias("_n"),
        )
        .select(key, (F.col("_top") * SOFTMAX_STEP + F.log("_mass")).alias("_lse"), "_n"),
        "softmax",
    )
    out = join_skewed(df, grouped.drop("_n"), [key], "left", counts=grouped.select(key, "_n"), row_id=row_id)
    return out.withColumn(name, F.exp(F.col(col) - F.col("_lse"))).drop("_lse")
