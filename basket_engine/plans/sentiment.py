"""Pipeline 4: labeled reviews to token sequences in balanced batches, and a fit."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.arrays import zeros
from ..operators import indexing as I, text as X, training as T
from ..operators.skew import join_skewed
from ..operators.training import FitResult
from ..session import stored


def review_batches(
    docs: DataFrame, vocabulary: DataFrame, batch_size: int = 10, max_len: int = 100
) -> DataFrame:
    """(doc_id, label, batch_id, position, tokens, masks) with alternating classes.

    ``docs``: (doc_id, label, text). Reviews without a known token are left out
    before the order is made, so batches stay full.
    """
    sequences = X.text_sequences(docs, vocabulary, max_len)
    labelled = join_skewed(sequences, docs.select("doc_id", "label"), ["doc_id"], "inner", row_id=["doc_id"])
    # Counted, ordered and padded below: the token work is done once.
    ordered = X.balanced_order(stored(labelled, "reviews"))
    batched = ordered.withColumn("batch_id", F.floor(F.col("position") / batch_size).cast("long"))
    return X.text_masks(batched, max_len)


def review_examples(batches: DataFrame, vectors: DataFrame, vector_size: int) -> DataFrame:
    """(doc_id, x, batch_id, position, y): mean word vector over the steps that ``x_mask`` marks
    as real tokens, and the one-hot class where ``y_mask`` marks an output."""
    real = F.filter(F.arrays_zip("tokens", "x_mask"), lambda step: step["x_mask"] > 0)
    # Repeats of a word inside one review are summed up before the lookup.
    words = batches.select("doc_id", F.explode(real["tokens"]).alias("token")).groupBy("doc_id", "token").agg(
        F.count(F.lit(1)).alias("times")
    )
    pairs = join_skewed(words, vectors.select("token", "vector"), ["token"], "inner", row_id=["doc_id", "token"])
    # At most max_len words of one review meet here.
    nested = pairs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("token", "vector", "times"))).alias("_w"))
    total = F.aggregate(
        "_w",
        zeros(vector_size),
        lambda acc, w: F.zip_with(acc, w["vector"], lambda a, v: a + v.cast("double") * w["times"]),
    )
    n_words = F.aggregate("_w", F.lit(0).cast("long"), lambda acc, w: acc + w["times"])
    means = nested.select("doc_id", total.alias("_x"), n_words.alias("_n")).select(
        "doc_id", F.transform("_x", lambda v: v / F.col("_n")).alias("x")
    )
    one_hot = F.array((F.col("label") == 0).cast("double"), (F.col("label") == 1).cast("double"))
    output = F.exists("y_mask", lambda v: v > 0)
    labels = batches.select("doc_id", "batch_id", "position", F.when(output, one_hot).alias("y"))
    return means.join(labels, "doc_id")


def fit_sentiment(examples: DataFrame, vector_size: int, test: DataFrame | None = None, **options) -> FitResult:
    """A fit whose mini-batches are the reviews' balanced ones; ``batch`` is their size."""
    settings = {"key": "doc_id", "batches": "batch_id", "batch": 10, "averaging": 5, "learning_rate": 0.0018, "l2": 1e-5, "epochs": 1, **options}
    return T.fit(examples, vector_size, 2, head="softmax", test=test, **settings)


def fixed_order(docs: DataFrame, batch_size: int) -> DataFrame:
    """Batches in document order, for scoring."""
    return I.fixed_batches(docs, ["doc_id"], batch_size)
