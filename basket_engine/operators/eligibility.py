"""Eligibility rules over scored recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import stored
from .skew import join_skewed, key_counts


def drop_empty_items(recos: DataFrame, item: str = "item_id") -> DataFrame:
    return recos.where(F.col(item) != "")


def eligibility(rules: DataFrame, inclusion: DataFrame) -> DataFrame:
    """(user_id, rule_key, restricted): whether the user's rule names any items.

    A rule key without inclusion rows restricts nothing.
    """
    named = inclusion.select("rule_key").distinct().withColumn("restricted", F.lit(True))
    out = join_skewed(rules.select("user_id", "rule_key"), named, ["rule_key"], "left", row_id=["user_id", "rule_key"])
    return out.withColumn("restricted", F.coalesce(F.col("restricted"), F.lit(False)))


def allowed_items(rules: DataFrame, inclusion: DataFrame) -> DataFrame:
    """(user_id, rule_key, items): the items a rule names, empty if it names none.

    A rule's list is a set over the item catalog, built map-side.
    """
    lists = inclusion.groupBy("rule_key").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    out = join_skewed(rules.select("user_id", "rule_key"), lists, ["rule_key"], "left", row_id=["user_id", "rule_key"])
    return out.withColumn("items", F.coalesce(F.col("items"), F.array().cast("array<string>")))


def purge(recos: DataFrame, rules: DataFrame, inclusion: DataFrame, distinct: bool = True) -> DataFrame:
    """Recommendations some rule of the user allows: (user_id, item_id, score).

    Users without any rule are dropped. Inclusion pairs are joined on (rule, item),
    so no user ever carries the item list of a rule. Without ``distinct`` a
    recommendation appears once per rule allowing it.
    """
    offered = drop_empty_items(recos).select("user_id", "item_id", "score")
    if distinct:
        offered, rules = offered.distinct(), rules.select("user_id", "rule_key").distinct()
    # Both rule tables are small beside the recommendations: stored, the planner knows.
    checked = stored(eligibility(rules, inclusion), "rules")
    pairs = stored(inclusion.select("rule_key", "item_id").distinct().withColumn("named", F.lit(True)), "inclusion")
    ruled = join_skewed(
        offered, checked, ["user_id"], "inner", counts=key_counts(recos, ["user_id"]),
        row_id=["user_id", "item_id", "score"],
    )
    matched = join_skewed(
        ruled, pairs, ["rule_key", "item_id"], "left", row_id=["user_id", "item_id", "rule_key", "score"]
    )
    kept = matched.where(~F.col("restricted") | F.col("named")).select("user_id", "item_id", "score")
    return kept.distinct() if distinct else kept


def top_k(recos: DataFrame, k: int, user: str = "user_id", item: str = "item_id", score: str = "score") -> DataFrame:
    """The ``k`` best items per user; the planner cuts each user before the shuffle."""
    best = Window.partitionBy(user).orderBy(F.col(score).desc(), F.col(item))
    ranked = recos.withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k)
