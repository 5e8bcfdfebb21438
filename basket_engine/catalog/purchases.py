"""Queries over purchases: filters, frequencies, shares, softmax, dictionaries, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.arrays import multi_hot, vector_text
from ..functions.scalars import example_key, imputed, missing_to_null, split_by_month
from ..operators import dictionary as D, features as X
from ..plans.featurize import basket_features as featurize
from ..session import stored
from . import views as V
from .registry import query

LINE_SQL = ", ".join(V.LINE)
# Digits kept when comparing results whose float sums depend on the order of rows.
DIGITS = 9


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, DIGITS) for c in cols})


SHARE_COLS = ("quantity", "price", "discount", "tax", "balance")
_SHARE_SQL = ", ".join(
    f"round(abs({c}) / nullif(sum({c}) OVER b, 0), {DIGITS}) AS share_{c}" for c in SHARE_COLS
)


@query(
    "basket_share",
    f"WITH {V.TX} SELECT {LINE_SQL}, user_id, year_month, {_SHARE_SQL} FROM tx "
    "WINDOW b AS (PARTITION BY user_id, year_month)",
)
def basket_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Read for the sums and for the rows.
    tx = stored(V.transactions(spark, sf_dir, "user_id", "year_month", *SHARE_COLS, line=True), "purchases")
    out = X.basket_share(tx, SHARE_COLS, row_id=V.LINE)
    shares = ["share_" + c for c in SHARE_COLS]
    return _rounded(out.select(*V.LINE, "user_id", "year_month", *shares), *shares)


_SMOOTH_COLS = ("quantity", "discount", "balance")
_SMOOTH_SQL = " UNION ALL ".join(
    f"SELECT {LINE_SQL}, user_id, year_month, '{c}' AS variable, "
    f"round(abs({c}) / nullif(sum({c}) OVER (PARTITION BY user_id, year_month) + 0.0001, 0), {DIGITS}) AS share FROM tx"
    for c in _SMOOTH_COLS
)


@query("basket_share_smoothed", f"WITH {V.TX} {_SMOOTH_SQL}")
def basket_share_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = V.transactions(spark, sf_dir, "user_id", "year_month", *_SMOOTH_COLS, line=True)
    return _rounded(X.smoothed_share(tx, _SMOOTH_COLS, row_id=V.LINE), "share")


_FEATURE_COLS = ("risk", *V.VARIABLES)
_FEATURE_SQL = ", ".join(
    f"round(abs({c}) / nullif(sum({c}) OVER b, 0), {DIGITS}) AS share_{c}" for c in V.VARIABLES
)


@query(
    "basket_features",
    f"""WITH {V.TX}, {V.PAIRS},
kept AS (
  SELECT tx.* FROM tx WHERE user_id IN (SELECT user_id FROM pairs) AND item_id IN (SELECT item_id FROM pairs)
),
coded AS (SELECT *, CAST(count(*) OVER (PARTITION BY risk) AS DOUBLE) AS freq FROM kept)
SELECT {LINE_SQL}, user_id, item_id, year_month,
       round(freq / nullif(sum(freq) OVER b, 0), {DIGITS}) AS share_risk, {_FEATURE_SQL}
FROM coded WINDOW b AS (PARTITION BY user_id, year_month)""",
)
def basket_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = V.transactions(spark, sf_dir, "user_id", "item_id", "year_month", *_FEATURE_COLS, line=True)
    out = featurize(tx, V.training_pairs(spark, sf_dir), "risk", V.VARIABLES, row_id=V.LINE)
    shares = {"share_" + c: F.round("share_" + c, DIGITS) for c in _FEATURE_COLS}
    return out.withColumns(shares).select(*V.LINE, "user_id", "item_id", "year_month", *shares)


@query("risk_frequency", f"WITH {V.TX} SELECT risk, count(*) AS freq FROM tx GROUP BY risk")
def risk_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.value_frequency(V.transactions(spark, sf_dir, "risk"), "risk")


@query(
    "risk_encoded",
    f"""WITH {V.TX}, {V.PAIRS},
counted AS (SELECT risk, count(*) AS n FROM tx WHERE user_id IN (SELECT user_id FROM pairs) AND price > 50000 GROUP BY risk)
SELECT {LINE_SQL}, user_id, CAST(coalesce(n, 0) AS DOUBLE) AS risk FROM tx LEFT JOIN counted USING (risk)""",
)
def risk_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies counted on another set of rows than the encoded ones."""
    tx = V.transactions(spark, sf_dir, "user_id", "risk", line=True)
    priced = V.transactions(spark, sf_dir, "user_id", "risk", "price", line=True).where(F.col("price") > 50000)
    counted = X.membership(priced, V.training_pairs(spark, sf_dir), ["user_id"], row_id=V.LINE)
    return X.frequency_encode(tx, "risk", counted=counted, row_id=V.LINE).select(*V.LINE, "user_id", "risk")


@query(
    "membership_filter",
    f"""WITH {V.TX}, {V.PAIRS}
SELECT {LINE_SQL}, user_id, item_id FROM tx
WHERE user_id IN (SELECT user_id FROM pairs) AND item_id IN (SELECT item_id FROM pairs)""",
)
def membership_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = V.transactions(spark, sf_dir, "user_id", "item_id", line=True)
    kept = X.membership(tx, V.training_pairs(spark, sf_dir), row_id=V.LINE)
    return kept.select(*V.LINE, "user_id", "item_id")


def _with_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as text, with discount 0 and tax 0 written as the missing token."""
    tx = V.transactions(spark, sf_dir, "item_id", "discount", "tax", line=True)
    as_text = {
        "discount_text": F.when(F.col("discount") == 0, F.lit("NULL")).otherwise(F.col("discount").cast("string")),
        "item_text": F.when(F.col("tax") == 0, F.lit("NULL")).otherwise(F.col("item_id")),
    }
    return tx.withColumns(as_text).select(*V.LINE, "discount_text", "item_text")


@query(
    "null_impute",
    f"WITH {V.TX} SELECT {LINE_SQL}, CASE WHEN discount = 0 THEN -1.0 ELSE discount END AS discount FROM tx",
)
def null_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _with_missing(spark, sf_dir)
    return raw.select(*V.LINE, imputed(missing_to_null(F.col("discount_text"))).alias("discount"))


@query("drop_missing", f"WITH {V.TX} SELECT {LINE_SQL}, item_id FROM tx WHERE tax <> 0")
def drop_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _with_missing(spark, sf_dir)
    named = raw.select(*V.LINE, missing_to_null(F.col("item_text")).alias("item_id"))
    return X.drop_missing(named, ["item_id"])


@query(
    "log_odds",
    f"""WITH {V.TX}, {V.CORRELATIONS}, odds AS (
  SELECT *, (score - 1) / nullif(score - 2, 0) AS q, score / 10 / nullif(1 - score / 10, 0) AS r FROM corr)
SELECT user_id, item_id, round(CASE WHEN q > 0 THEN ln(q) END, {DIGITS}) AS log_odds,
       round(CASE WHEN r > 0 THEN ln(r) END, {DIGITS}) AS logit FROM odds""",
)
def log_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores 1, 2, ... meet the zero denominator as well."""
    shifted = V.correlations(spark, sf_dir).withColumn("score", F.col("score") - 1)
    out = X.add_log_odds(shifted, "score")
    out = X.add_log_odds(out.withColumn("p", (F.col("score") + 1) / 10), "p", "logit", form="logit")
    return _rounded(out.select("user_id", "item_id", "log_odds", "logit"), "log_odds", "logit")


@query(
    "user_softmax",
    f"""WITH {V.TX}, {V.CORRELATIONS}, odds AS (SELECT *, ln(score / (score - 1)) AS s FROM corr)
SELECT user_id, item_id, round(exp(s) / sum(exp(s)) OVER (PARTITION BY user_id), {DIGITS}) AS softmax,
       round(exp(price - top) / sum(exp(price - top)) OVER (PARTITION BY user_id), {DIGITS}) AS price_softmax
FROM odds JOIN (SELECT user_id, item_id, price, max(price) OVER (PARTITION BY user_id) AS top
                FROM (SELECT user_id, item_id, max(price) AS price FROM tx GROUP BY ALL)) USING (user_id, item_id)""",
)
def user_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over log-odds, and over prices large enough to overflow a plain ``exp``."""
    tx = V.transactions(spark, sf_dir, "user_id", "item_id", "price")
    pairs = tx.groupBy("user_id", "item_id").agg((F.count(F.lit(1)) + F.lit(1.0)).alias("score"), F.max("price").alias("price"))
    # Read again for each group's sum and for its rows.
    odds = stored(X.add_log_odds(pairs, "score"), "odds")
    soft = X.group_softmax(odds, "user_id", "log_odds", row_id=["user_id", "item_id"])
    both = X.group_softmax(soft, "user_id", "price", "price_softmax", row_id=["user_id", "item_id"])
    return _rounded(both.select("user_id", "item_id", "softmax", "price_softmax"), "softmax", "price_softmax")


@query("item_dictionary", f"WITH {V.ITEMS} SELECT item_id, item_idx FROM items")
def item_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.item_dictionary(spark, sf_dir)


@query(
    "user_dictionary",
    f"""WITH {V.TX}, {V.PAIRS}
SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS user_idx FROM (SELECT DISTINCT user_id FROM pairs)""",
)
def user_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.dictionary(V.training_pairs(spark, sf_dir), "user_id")


@query(
    "index_lookup",
    f"""WITH {V.TX}, {V.PAIRS},
users AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS user_idx FROM (SELECT DISTINCT user_id FROM pairs))
SELECT {LINE_SQL}, user_id, coalesce(user_idx, -1) AS user_idx FROM tx LEFT JOIN users USING (user_id)""",
)
def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = V.transactions(spark, sf_dir, "user_id", line=True)
    users = D.dictionary(V.training_pairs(spark, sf_dir), "user_id")
    return D.with_index(tx, users, "user_id", row_id=V.LINE).select(*V.LINE, "user_id", "user_idx")


@query(
    "month_split",
    f"""WITH {V.TX}
SELECT {LINE_SQL}, split, split || '/' || user_id || '_' || year_month AS example FROM (
  SELECT *, CASE WHEN year_month < 199801 THEN 'train' ELSE 'test' END AS split FROM tx)""",
)
def month_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = V.transactions(spark, sf_dir, "user_id", "year_month", line=True)
    placed = tx.withColumn("split", split_by_month(F.col("year_month"), 199801))
    key = example_key(F.col("split"), F.col("user_id"), F.col("year_month"))
    return placed.select(*V.LINE, "split", key.alias("example"))


def _label_sql(keys: str, source: str = "seen") -> str:
    return f"""
SELECT {keys}, array_to_string([CASE WHEN list_contains(label_idx, i) THEN '1.0' ELSE '0.0' END
       for i in range((SELECT count(*) FROM items))], ',') AS label FROM {source}"""


_INDEXED = f"WITH {V.TX}, {V.ITEMS}, coded AS (SELECT tx.*, item_idx FROM tx JOIN items USING (item_id))"


def _label_text(labels: DataFrame, n_items: int, *keys: str) -> DataFrame:
    dense = multi_hot(F.col("label_idx"), n_items)
    return labels.select(*keys, vector_text(dense).alias("label"))


@query(
    "multi_hot_label",
    f"""{_INDEXED}, seen AS (SELECT user_id, year_month, list(DISTINCT item_idx) AS label_idx FROM coded GROUP BY ALL)
{_label_sql('user_id, year_month')}""",
)
def multi_hot_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = V.item_dictionary(spark, sf_dir)
    tx = V.indexed_transactions(spark, sf_dir, items)
    return _label_text(D.label_indices(tx, ["user_id", "year_month"]), items.count(), "user_id", "year_month")


@query(
    "multi_hot_label_all_months",
    f"""{_INDEXED}, seen AS (SELECT user_id, list(DISTINCT item_idx) AS label_idx FROM coded GROUP BY ALL)
{_label_sql('user_id')}""",
)
def multi_hot_label_all_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = V.item_dictionary(spark, sf_dir)
    tx = V.indexed_transactions(spark, sf_dir, items)
    return _label_text(D.label_indices(tx, ["user_id"]), items.count(), "user_id")


@query(
    "multi_hot_label_running",
    f"""{_INDEXED}, months AS (SELECT DISTINCT user_id, year_month FROM coded),
seen AS (SELECT m.user_id, m.year_month, list(DISTINCT item_idx) AS label_idx
  FROM months m JOIN coded c ON c.user_id = m.user_id AND c.year_month <= m.year_month GROUP BY ALL)
{_label_sql('user_id, year_month')}""",
)
def multi_hot_label_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = V.item_dictionary(spark, sf_dir)
    tx = V.indexed_transactions(spark, sf_dir, items)
    return _label_text(D.running_label_indices(tx), items.count(), "user_id", "year_month")


@query(
    "net_mean",
    f"""WITH {V.TX} SELECT user_id, year_month, round(avg(share), {DIGITS}) AS net, count(*) AS basket_size FROM (
  SELECT *, abs(balance) / nullif(sum(balance) OVER (PARTITION BY user_id, year_month), 0) AS share FROM tx)
GROUP BY user_id, year_month""",
)
def net_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = V.transactions(spark, sf_dir, "user_id", "year_month", "balance")
    return _rounded(X.net_mean(tx, "balance"), "net")


@query("training_pairs", f"WITH {V.TX}, {V.PAIRS} SELECT user_id, item_id FROM pairs")
def training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.training_pairs(spark, sf_dir)
