"""Pipeline 3: recent monthly rows per user, linear fit, at-risk scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..operators import scoring as S, sequences as Q, training as T
from ..operators.training import FitResult, Model
from ..settings import RECENT_ROWS_TRAIN


def churn_examples(
    rows: DataFrame,
    n: int = RECENT_ROWS_TRAIN,
    excluded: DataFrame | None = None,
    tie: Sequence[str] = (),
) -> DataFrame:
    """One example per recent row: (user_id, matrix_row, x, y) of the newest ``n``."""
    if excluded is not None:
        rows = Q.exclude_users(rows, excluded, row_id=["user_id", "year_month"])
    recent = Q.recent_rows(rows, n, tie=tie)
    return recent.select(
        "user_id", "year_month", "matrix_row", F.col("features").alias("x"), F.array(F.col("label").cast("double")).alias("y")
    )


def fit_churn(train: DataFrame, n_features: int, test: DataFrame | None = None, **options) -> FitResult:
    settings = {"epochs": 10, "batch": 10, "learning_rate": 0.003, "l2": 1e-5, **options}
    keyed = train.withColumn("example", F.struct("user_id", "matrix_row"))
    tested = None if test is None else test.withColumn("example", F.struct("user_id", "matrix_row"))
    return T.fit(keyed, n_features, 1, head="linear", key="example", test=tested, **settings)


def churn_predictions(examples: DataFrame, model: Model) -> DataFrame:
    return S.churn_scores(S.score(examples, model, ["user_id", "y"]))
