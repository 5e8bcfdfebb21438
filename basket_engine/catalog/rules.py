"""Queries over recommendations: eligibility, purge, top items, scored text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.arrays import zipped
from ..operators import eligibility as E, scoring as S
from ..sources.catalogs import parse_correlations, parse_scored
from . import views as V
from .purchases import DIGITS
from .registry import query

_PURGE = f"""WITH {V.TX}, {V.RECOS}, {V.RULES},
matched AS (
  SELECT r.user_id, r.item_id, r.score, u.rule_key FROM recos r JOIN rules u USING (user_id)
  WHERE u.rule_key NOT IN (SELECT rule_key FROM inclusion)
     OR (u.rule_key, r.item_id) IN (SELECT rule_key, item_id FROM inclusion)
)"""


@query(
    "eligibility",
    f"""WITH {V.RULES} SELECT user_id, rule_key, rule_key IN (SELECT rule_key FROM inclusion) AS restricted FROM rules""",
)
def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.eligibility(V.user_rules(spark, sf_dir), V.item_inclusion(spark, sf_dir))


@query(
    "allowed_items",
    f"""WITH {V.RULES} SELECT user_id, rule_key, coalesce(items, '') AS items FROM rules
LEFT JOIN (SELECT rule_key, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS items FROM inclusion GROUP BY rule_key)
USING (rule_key)""",
)
def allowed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.allowed_items(V.user_rules(spark, sf_dir), V.item_inclusion(spark, sf_dir))
    return out.select("user_id", "rule_key", F.array_join("items", ",").alias("items"))


@query("purge", f"{_PURGE} SELECT DISTINCT user_id, item_id, round(score, {DIGITS}) AS score FROM matched")
def purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = E.purge(V.recommendations(spark, sf_dir), V.user_rules(spark, sf_dir), V.item_inclusion(spark, sf_dir))
    return kept.withColumn("score", F.round("score", DIGITS))


@query("purge_per_rule", f"{_PURGE} SELECT user_id, item_id, round(score, {DIGITS}) AS score FROM matched")
def purge_per_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the final distinct: one row per rule allowing the item."""
    kept = E.purge(
        V.recommendations(spark, sf_dir), V.user_rules(spark, sf_dir), V.item_inclusion(spark, sf_dir), distinct=False
    )
    return kept.withColumn("score", F.round("score", DIGITS))


@query(
    "top_k_items",
    f"""WITH {V.TX}, {V.RECOS} SELECT user_id, item_id, round(score, {DIGITS}) AS score, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM recos) WHERE rank <= 5""",
)
def top_k_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = E.top_k(V.recommendations(spark, sf_dir), 5)
    return best.withColumn("score", F.round("score", DIGITS)).select("user_id", "item_id", "score", "rank")


@query(
    "actual_vs_predicted",
    f"""WITH {V.DAILY}, last AS (SELECT user_id, max(year_month) AS d FROM daily GROUP BY user_id),
mean AS (SELECT user_id, avg(label) AS predicted FROM daily JOIN last USING (user_id) WHERE year_month < d GROUP BY user_id)
SELECT daily.user_id, label AS actual, round(predicted, {DIGITS}) AS predicted, round((label - predicted) * (label - predicted), {DIGITS}) AS loss
FROM daily JOIN last ON last.user_id = daily.user_id AND d = year_month JOIN mean ON mean.user_id = daily.user_id""",
)
def actual_vs_predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last day against the mean of the days before."""
    rows = V.activity_rows(spark, sf_dir).select("user_id", "year_month", "label")
    last = rows.groupBy("user_id").agg(F.max_by("label", "year_month").alias("actual"), F.max("year_month").alias("d"))
    before = rows.join(last, "user_id").where(F.col("year_month") < F.col("d"))
    mean = before.groupBy("user_id").agg(F.avg("label").alias("predicted"))
    both = S.actual_vs_predicted(last.select("user_id", "actual"), mean)
    error = F.col("actual") - F.col("predicted")
    return both.select(
        "user_id", "actual", F.round("predicted", DIGITS).alias("predicted"), F.round(error * error, DIGITS).alias("loss")
    )


@query(
    "scored_text",
    f"""WITH {V.TX}, {V.RECOS} SELECT CAST(user_id AS VARCHAR) AS user_id, item_id, round(score, {DIGITS}) AS score FROM recos
WHERE item_id <> 'Brand#1'""",
)
def scored_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples written as ``(user,(item,score))`` and parsed back; empty items drop."""
    recos = V.recommendations(spark, sf_dir)
    item = F.when(F.col("item_id") == "Brand#1", F.lit("")).otherwise(F.col("item_id"))
    line = F.concat(
        F.lit("("), F.col("user_id").cast("string"), F.lit(",("), item, F.lit(","), F.col("score").cast("string"), F.lit("))")
    )
    return parse_scored(recos.select(line.alias("value"))).withColumn("score", F.round("score", DIGITS))


@query(
    "correlation_text",
    f"""WITH {V.TX}, {V.CORRELATIONS}
SELECT CAST(user_id AS VARCHAR) AS user_id, item_id, score, round(ln(score / (score - 1)), {DIGITS}) AS log_odds FROM corr""",
)
def correlation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines ``(user,item,<unused>,score`` as the correlation reader sees them."""
    corr = V.correlations(spark, sf_dir)
    line = F.concat_ws(
        ",", F.concat(F.lit("("), F.col("user_id").cast("string")), F.col("item_id"), F.lit("x"), F.col("score").cast("string")
    )
    return parse_correlations(corr.select(line.alias("value"))).withColumn("log_odds", F.round("log_odds", DIGITS))


@query(
    "zipped_scores",
    f"""WITH {V.TX}, {V.RECOS}, {V.ITEMS},
best AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM recos)
SELECT user_id, item_id, round(score, {DIGITS}) AS score FROM best WHERE rank <= 4""",
)
def zipped_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best five items beside the best four scores: the shorter list decides."""
    best = E.top_k(V.recommendations(spark, sf_dir), 5)
    nested = best.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id", "score"))).alias("b"))
    pairs = nested.select("user_id", F.inline(zipped(F.col("b.item_id"), F.slice("b.score", 1, 4))))
    return pairs.select("user_id", "item_id", F.round("score", DIGITS).alias("score"))
