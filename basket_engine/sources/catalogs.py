"""Readers for the pipelines' catalogs: factors, correlations, rules, results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.arrays import text_vector
from ..functions.scalars import log_odds, strip_parens
from ..session import stored
from .delimited import (
    INCLUSION_SCHEMA,
    PAIR_SCHEMA,
    TRANSACTION_SCHEMA,
    USER_RULE_SCHEMA,
    USER_SCHEMA,
    fields,
    read_delimited,
)


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    return read_delimited(spark, path, TRANSACTION_SCHEMA)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return read_delimited(spark, path, PAIR_SCHEMA, null_token=None)


def read_user_rules(spark: SparkSession, path: str) -> DataFrame:
    return read_delimited(spark, path, USER_RULE_SCHEMA, null_token=None)


def read_inclusion(spark: SparkSession, path: str) -> DataFrame:
    return read_delimited(spark, path, INCLUSION_SCHEMA, null_token=None)


def read_exclusions(spark: SparkSession, path: str) -> DataFrame:
    return read_delimited(spark, path, USER_SCHEMA, null_token=None).distinct()


def training_items(pairs: DataFrame) -> DataFrame:
    return pairs.select("item_id").distinct()


def test_users(pairs: DataFrame) -> DataFrame:
    return pairs.select("user_id").distinct()


def parse_factors(lines: DataFrame, indexed: bool = True) -> DataFrame:
    """(entity_idx, factors) of lines ``index,f0,f1,...``, or (factors) of bare lines.

    The entity is an explicit column; a line number is not one, since text lines
    have no global order once read in parallel.
    """
    values = text_vector(F.col("value"))
    if not indexed:
        return lines.select(values.alias("factors"))
    return lines.select(
        F.get(values, F.lit(0)).cast("long").alias("entity_idx"),
        F.slice(values, F.lit(2), F.size(values) - 1).alias("factors"),
    )


def read_factors(spark: SparkSession, path: str, indexed: bool = True) -> DataFrame:
    return parse_factors(spark.read.text(path), indexed)


def check_dense(factors: DataFrame) -> DataFrame:
    """The factors, if their index runs from 0 without gaps, repeats or nulls, and all have one
    width; else an error that says what is wrong. Counts alone are looked at."""
    found = factors.agg(
        F.count(F.lit(1)).alias("n"), F.count("entity_idx").alias("known"), F.count_distinct("entity_idx").alias("different"),
        F.min("entity_idx").alias("least"), F.max("entity_idx").alias("most"),
        F.min(F.size("factors")).alias("narrow"), F.max(F.size("factors")).alias("wide"),
        F.count(F.when(F.exists("factors", F.isnull), 1)).alias("broken"),
    ).first()
    if found["known"] < found["n"]:
        raise ValueError(f"{found['n'] - found['known']} factor lines without an index")
    if found["different"] < found["n"]:
        raise ValueError(f"{found['n'] - found['different']} factor lines repeat an index")
    if found["n"] and (found["least"], found["most"]) != (0, found["n"] - 1):
        raise ValueError(f"indices of {found['n']} factor lines run from {found['least']} to {found['most']}")
    if found["narrow"] != found["wide"]:
        raise ValueError(f"factor lines have {found['narrow']} to {found['wide']} values")
    if found["broken"]:
        raise ValueError(f"{found['broken']} factor lines hold something that is no number")
    return factors


def read_named_factors(spark: SparkSession, path: str, entities: DataFrame, key: str, index: str) -> DataFrame:
    """(key, factors) of a file of ``index,f0,f1,...`` lines, named by a dictionary (key, index).

    The file must be dense, and so must be the dictionary's count: a file with fewer or more
    lines than entities would give some entity no factors, or factors to none.
    """
    factors = check_dense(stored(read_factors(spark, path), "factor-file"))
    n_lines, n_entities = factors.count(), entities.count()
    if n_lines != n_entities:
        raise ValueError(f"{n_lines} factor lines for {n_entities} entities")
    return name_factors(factors, entities, key, index)


def name_factors(factors: DataFrame, entities: DataFrame, key: str, index: str, offset: int = 0) -> DataFrame:
    """Factors keyed by entity id, from a dictionary whose index starts at ``offset``."""
    placed = entities.select(key, (F.col(index) + F.lit(offset)).alias("entity_idx"))
    return factors.join(placed, "entity_idx").select(key, "factors")


def parse_correlations(lines: DataFrame, form: str = "as_given") -> DataFrame:
    """(user_id, item_id, score, log_odds) of lines ``(user,item,<unused>,score``."""
    parts = fields(F.col("value"))
    score = F.get(parts, F.lit(3)).try_cast("double")
    return lines.select(
        F.regexp_replace(F.get(parts, F.lit(0)), r"\(", "").alias("user_id"),
        F.get(parts, F.lit(1)).alias("item_id"),
        score.alias("score"),
        log_odds(score, form).alias("log_odds"),
    )


def read_correlations(spark: SparkSession, path: str, form: str = "as_given") -> DataFrame:
    return parse_correlations(spark.read.text(path), form)


def parse_scored(lines: DataFrame) -> DataFrame:
    """(user_id, item_id, score) of lines ``(user,(item,score))``; empty items dropped."""
    parts = fields(F.col("value"))
    rows = lines.select(
        strip_parens(F.get(parts, F.lit(0))).alias("user_id"),
        strip_parens(F.get(parts, F.lit(1))).alias("item_id"),
        strip_parens(F.get(parts, F.lit(2))).try_cast("double").alias("score"),
    )
    return rows.where(F.col("item_id") != "")


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    return parse_scored(spark.read.text(path))
