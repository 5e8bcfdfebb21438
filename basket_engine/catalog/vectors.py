"""Queries over training vectors: positions, packed and slot layouts, net values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.arrays import array_total, vector_text
from ..operators import features as X, vectors as P
from ..operators.skew import key_counts
from ..session import stored
from ..settings import SHARE_SMOOTHING
from . import views as V
from .purchases import DIGITS, LINE_SQL
from .registry import query

K = V.FACTOR_WIDTH
BASKET_LIMIT = 16
SHORT_LIMIT = 2

_CODED = f"""WITH {V.TX}, {V.ITEMS}, {V.ITEM_FACTORS}, {V.USER_FACTORS},
coded AS (
  SELECT tx.*, item_idx, row_number() OVER (PARTITION BY user_id, year_month ORDER BY item_idx, {LINE_SQL}) - 1 AS position,
         count(*) OVER (PARTITION BY user_id, year_month) AS basket_size,
         abs(tax) / nullif(sum(tax) OVER (PARTITION BY user_id, year_month), 0) AS share
  FROM tx JOIN items USING (item_id)
)"""


def _order() -> tuple[str, ...]:
    return ("item_idx", *V.LINE)


# A vector is compared by its length and one polynomial of its entries.
BASE = 0.999


def _digest(vectors: DataFrame, *keys: str) -> DataFrame:
    return vectors.select(
        *keys,
        F.size("features").alias("width"),
        F.round(F.aggregate("features", F.lit(0.0), lambda acc, v: acc * BASE + v), DIGITS).alias("digest"),
    )


def _digest_sql(width: str) -> str:
    return f"round(CASE WHEN count(v) = count(*) THEN sum(v * power({BASE}, {width} - 1 - place)) END, {DIGITS}) AS digest"


@query(
    "basket_position",
    f"""{_CODED} SELECT {LINE_SQL}, user_id, year_month, item_idx, position FROM coded""",
)
def basket_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = V.indexed_transactions(spark, sf_dir, V.item_dictionary(spark, sf_dir), line=True)
    out = P.basket_position(tx, order=_order())
    return out.select(*V.LINE, "user_id", "year_month", "item_idx", "position")


@query(
    "net_by_position",
    f"""{_CODED} SELECT user_id, year_month, CAST(position AS INTEGER) AS position,
       round(share / basket_size, {DIGITS}) AS net FROM coded""",
)
def net_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The net part of the packed vector, one row per basket position."""
    packed = _packed(spark, sf_dir, BASKET_LIMIT)
    nets = F.slice("features", BASKET_LIMIT * K + 1, BASKET_LIMIT)
    long = packed.select("user_id", "year_month", "basket_size", F.posexplode(nets).alias("position", "net"))
    return long.where(F.col("position") < F.col("basket_size")).select(
        "user_id", "year_month", "position", F.round("net", DIGITS).alias("net")
    )


def _packed(spark: SparkSession, sf_dir: str, limit: int, on_overflow: str = "error", with_user: bool = False) -> DataFrame:
    items = V.item_dictionary(spark, sf_dir)
    tx = V.indexed_transactions(spark, sf_dir, items, "tax", line=True)
    users = V.user_factors(spark, sf_dir) if with_user else None
    return P.packed_vectors(
        tx, V.item_factors(spark, sf_dir, items), K, "tax", users, limit, on_overflow, order=_order()
    )


def _packed_sql(limit: int, where: str = "") -> str:
    return f"""{_CODED},
entries AS (
  SELECT user_id, year_month, position * {K} + slot AS place, factors[CAST(slot + 1 AS INTEGER)] AS v
  FROM coded JOIN item_factors USING (item_id) CROSS JOIN range({K}) AS r(slot) {where}
  UNION ALL
  SELECT user_id, year_month, {limit * K} + position, share / basket_size FROM coded {where}
)
SELECT user_id, year_month, {limit * (K + 1)} AS width, {_digest_sql(str(limit * (K + 1)))}
FROM entries GROUP BY user_id, year_month"""


@query("packed_vector", _packed_sql(BASKET_LIMIT))
def packed_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(_packed(spark, sf_dir, BASKET_LIMIT), "user_id", "year_month")


@query("packed_vector_truncated", _packed_sql(SHORT_LIMIT, f"WHERE position < {SHORT_LIMIT}"))
def packed_vector_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(_packed(spark, sf_dir, SHORT_LIMIT, "truncate"), "user_id", "year_month")


@query(
    "packed_vector_user",
    f"""{_CODED},
baskets AS (
  SELECT user_id, year_month, sum(abs(tax)) / nullif(sum(tax), 0) / count(*) AS net FROM tx GROUP BY user_id, year_month
),
entries AS (
  SELECT user_id, year_month, (position + 1) * {K} + slot AS place, factors[CAST(slot + 1 AS INTEGER)] AS v
  FROM coded JOIN item_factors USING (item_id) CROSS JOIN range({K}) AS r(slot)
  UNION ALL
  SELECT user_id, year_month, slot, factors[CAST(slot + 1 AS INTEGER)]
  FROM baskets JOIN user_factors USING (user_id) CROSS JOIN range({K}) AS r(slot)
  UNION ALL
  SELECT user_id, year_month, {(BASKET_LIMIT + 1) * K}, net FROM baskets
)
SELECT user_id, year_month, {(BASKET_LIMIT + 1) * K + 1} AS width, {_digest_sql(str((BASKET_LIMIT + 1) * K + 1))}
FROM entries GROUP BY user_id, year_month""",
)
def packed_vector_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(_packed(spark, sf_dir, BASKET_LIMIT, with_user=True), "user_id", "year_month")


@query(
    "basket_labels",
    f"""{_CODED}
SELECT user_id, year_month, CAST(count(*) AS BIGINT) AS basket_size,
       array_to_string(list_sort(list(DISTINCT item_idx)), ',') AS label
FROM coded GROUP BY user_id, year_month""",
)
def basket_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sparse label and size that travel with a packed vector."""
    packed = _packed(spark, sf_dir, BASKET_LIMIT)
    return packed.select("user_id", "year_month", "basket_size", vector_text(F.col("label_idx")).alias("label"))


@query(
    "slot_vector",
    f"""{_CODED}, n AS (SELECT count(*) AS n_items FROM items),
pairs AS (SELECT DISTINCT user_id, year_month, item_id FROM tx),
entries AS (
  SELECT user_id, year_month, item_id, (item_idx + 1) * {K} + slot AS place, factors[CAST(slot + 1 AS INTEGER)] AS v
  FROM pairs JOIN item_factors USING (item_id) CROSS JOIN range({K}) AS r(slot)
  UNION ALL
  SELECT user_id, year_month, item_id, slot, factors[CAST(slot + 1 AS INTEGER)]
  FROM pairs JOIN user_factors USING (user_id) CROSS JOIN range({K}) AS r(slot)
)
SELECT user_id, year_month, item_id, CAST((n_items + 1) * {K} AS INTEGER) AS width,
       {_digest_sql(f"((n_items + 1) * {K})")}
FROM entries, n GROUP BY user_id, year_month, item_id, n_items""",
)
def slot_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = V.item_dictionary(spark, sf_dir)
    # Read for the numbers of a user's rows and for the vectors.
    rows = stored(V.indexed_transactions(spark, sf_dir, items).distinct(), "rows")
    out = P.slot_vectors(
        rows, V.item_factors(spark, sf_dir, items), V.user_factors(spark, sf_dir), items.count(), K,
        row_id=["user_id", "year_month", "item_id"],
    )
    return _digest(out, "user_id", "year_month", "item_id")


@query(
    "item_values",
    f"""WITH {V.TX}, long AS (
  SELECT user_id, item_id, year_month, {LINE_SQL}, 'discount' AS variable,
         abs(discount) / (sum(discount) OVER (PARTITION BY user_id, year_month) + 0.0001) AS share FROM tx
  UNION ALL
  SELECT user_id, item_id, year_month, {LINE_SQL}, 'quantity',
         abs(quantity) / (sum(quantity) OVER (PARTITION BY user_id, year_month) + 0.0001) FROM tx
)
SELECT user_id, item_id, CAST(count(*) AS BIGINT) AS n_values, round(sum(share), {DIGITS}) AS total FROM long
GROUP BY user_id, item_id""",
)
def item_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values per user and item over all their parts."""
    cols = ("discount", "quantity")  # by name, as the values of a line stand
    # Read for the sums, for the rows and for their numbers.
    tx = stored(V.transactions(spark, sf_dir, "user_id", "item_id", "year_month", *cols, line=True), "purchases")
    wide = X.basket_share(tx, cols, eps=SHARE_SMOOTHING, row_id=V.LINE)
    rows = wide.withColumn("shares", F.array(*["share_" + c for c in cols]))
    counts = key_counts(tx, ["user_id", "item_id"])
    parts = P.item_values(rows, order=("year_month", *V.LINE), value="shares", counts=counts)
    per_part = parts.select(
        "user_id", "item_id", F.size("values").cast("long").alias("n"), array_total(F.col("values")).alias("t")
    )
    return per_part.groupBy("user_id", "item_id").agg(
        F.sum("n").alias("n_values"), F.round(F.sum("t"), DIGITS).alias("total")
    )


@query(
    "factor_join",
    f"""WITH {V.TX}, {V.USER_FACTORS}
SELECT user_id, item_id, CAST(count(*) AS BIGINT) AS n, round(sum(factors[1]), {DIGITS}) AS f0
FROM tx JOIN user_factors USING (user_id) GROUP BY user_id, item_id""",
)
def factor_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = V.transactions(spark, sf_dir, "user_id", "item_id", line=True)
    joined = P.attach_factors(tx, V.user_factors(spark, sf_dir), "user_id", "f", row_id=V.LINE)
    return joined.groupBy("user_id", "item_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.get("f", F.lit(0))), DIGITS).alias("f0")
    )


@query(
    "vector_text",
    f"""WITH {V.TX} SELECT user_id, year_month,
       CAST(sum(quantity) AS BIGINT) || '.0,' || count(*) || '.0' AS line FROM tx GROUP BY user_id, year_month""",
)
def vector_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.monthly_rows(spark, sf_dir)
    return rows.select("user_id", "year_month", vector_text(F.col("features")).alias("line"))
