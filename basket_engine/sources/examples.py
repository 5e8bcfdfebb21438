"""Readers for example rows: our Parquet layout and imported per-example text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.arrays import features_and_labels, text_vector, without_nan
from ..functions.scalars import month_of_example, user_of_example

SPLITS = ("train", "test")


def read_examples(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Example rows; the split is a pruned partition."""
    if split is not None and split not in SPLITS:
        raise ValueError(f"split must be one of {SPLITS}")
    rows = spark.read.parquet(path)
    return rows if split is None else rows.where(F.col("split") == split)


def import_example_files(
    spark: SparkSession, root: str, split: str, n_features: int, n_labels: int
) -> DataFrame:
    """Rows of files ``<root>/<split>/.../<user>_<yyyyMM>``, one CSV line each.

    User and month come from the file name, read as metadata and not by listing.
    """
    if split not in SPLITS:
        raise ValueError(f"split must be one of {SPLITS}")
    lines = (
        spark.read.option("recursiveFileLookup", "true")
        .text(f"{root.rstrip('/')}/{split}")
        .select("value", F.col("_metadata.file_name").alias("_file"))
    )
    values = without_nan(text_vector(F.col("value")))
    pair = features_and_labels(values, n_features, n_labels)
    return lines.select(
        F.lit(split).alias("split"),
        user_of_example(F.col("_file")).alias("user_id"),
        month_of_example(F.col("_file")).alias("year_month"),
        pair["features"].alias("features"),
        pair["label"].alias("label"),
    )


def import_example_lines(lines: DataFrame, n_features: int, n_labels: int) -> DataFrame:
    """Rows of the text form of the example sink: ``<split>/<user>_<yyyyMM>``, tab, CSV."""
    key = F.substring_index("value", "\t", 1)
    values = text_vector(F.substring_index("value", "\t", -1))
    pair = features_and_labels(without_nan(values), n_features, n_labels)
    return lines.select(
        F.substring_index(key, "/", 1).alias("split"),
        user_of_example(key).alias("user_id"),
        month_of_example(key).alias("year_month"),
        pair["features"].alias("features"),
        pair["label"].alias("label"),
    )


def read_minibatches(spark: SparkSession, path: str) -> DataFrame:
    """Placed examples exported earlier."""
    return spark.read.parquet(path)


def read_binary_batches(spark: SparkSession, path: str) -> DataFrame:
    """Raw batch files as (path, content), for importing foreign formats."""
    return spark.read.format("binaryFile").load(path).select("path", "content")
