"""Scoring with a fitted model and the tables made of the scores."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .skew import join_skewed
from .training import Model, cross_entropy, head_output, squared_error

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def score(examples: DataFrame, model: Model, keep: Sequence[str] = ("user_id",)) -> DataFrame:
    """Model output per example as ``scores``, in Arrow batches."""
    head = model.head
    shared = examples.sparkSession.sparkContext.broadcast(model.params.reshape(model.n_labels, -1))
    kept = [examples.schema[c] for c in keep]
    schema = StructType([*kept, StructField("scores", ArrayType(DoubleType()))])
    names = list(keep)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = shared.value
        for frame in frames:
            if len(frame):
                out = head_output(head, weights, np.stack(frame["x"].to_numpy()))
                yield frame[names].assign(scores=list(out))

    columns = names + ([] if "x" in names else ["x"])
    return examples.select(*columns).mapInPandas(run, schema)


def with_loss(scored: DataFrame, head: str) -> DataFrame:
    loss = cross_entropy if head == "softmax" else squared_error
    return scored.withColumn("loss", loss(F.col("scores"), F.col("y")))


def item_scores(scored: DataFrame, items: DataFrame, n_labels: int, user: str = "user_id") -> DataFrame:
    """(user, item_id, score) for every item of the dictionary, from score vectors that rows
    carry already. For catalogs of any width see ``wide.score_wide``."""
    long = scored.select(user, F.posexplode("scores").alias("item_idx", "score"))
    named = items.where((F.col("item_idx") >= 0) & (F.col("item_idx") < n_labels)).select(
        F.col("item_idx").cast("int").alias("item_idx"), "item_id"
    )
    return join_skewed(long, named, ["item_idx"], "inner", row_id=[user]).select(user, "item_id", "score")


def churn_scores(scored: DataFrame, user: str = "user_id") -> DataFrame:
    """(user, label, score) of a one-label model."""
    return scored.select(user, F.get("y", F.lit(0)).alias("label"), F.get("scores", F.lit(0)).alias("score"))


def actual_vs_predicted(
    targets: DataFrame, predictions: DataFrame, keys: Sequence[str] = ("user_id",)
) -> DataFrame:
    """Targets beside predictions on the entity key."""
    return join_skewed(targets, predictions, keys, "inner")
