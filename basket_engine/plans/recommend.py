"""Pipeline 2: month sequences, fit, scores for every item, eligibility purge."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.arrays import multi_hot
from ..operators import eligibility as E, sequences as Q, training as T, wide as B
from ..operators.training import FitResult, Model
from ..settings import SEQUENCE_END, SEQUENCE_START


def sequence_examples(
    examples: DataFrame,
    n_features: int,
    n_items: int,
    start: int = SEQUENCE_START,
    end: int = SEQUENCE_END,
    off_axis: str = "last",
) -> DataFrame:
    """(user_id, x, y) of packed rows carrying a sparse ``label_idx``.

    The label stays sparse through the grouping; only the one at the labelled step
    becomes a dense vector.
    """
    rows = examples.select(
        "user_id", "year_month", "features", F.col("label_idx").cast("array<double>").alias("label")
    )
    flat = Q.flatten_sequences(Q.month_sequences(rows, n_features, 0, start, end, off_axis))
    dense = multi_hot(F.col("y").cast("array<int>"), n_items)
    return flat.withColumn("y", F.when(F.col("y").isNotNull(), dense))


def fit_recommender(train: DataFrame, n_features: int, n_items: int, test: DataFrame | None = None, **options) -> FitResult:
    return T.fit(train, n_features, n_items, head="softmax", test=test, **options)


def recommend(test: DataFrame, model: Model, items: DataFrame) -> DataFrame:
    """(user_id, item_id, score) for every test user and item."""
    return B.score_wide(test, B.weight_rows(test.sparkSession, model, items), model.n_features, model.head)


def recommend_eligible(test: DataFrame, model: Model, items: DataFrame, rules: DataFrame, inclusion: DataFrame) -> DataFrame:
    return E.purge(recommend(test, model, items), rules, inclusion)

