"""Readers for labeled reviews and word vectors."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.arrays import vector_text
from .files import write_files

#: Scan partitions that a task reads one after the other. Of small files a partition holds some 32.
PARTS_OF_TASK = 16


def _literal(sep: str) -> str:
    return re.escape(sep)


def read_reviews(spark: SparkSession, root: str, split: str) -> DataFrame:
    """One whole-file review per row from ``<root>/<split>/{pos,neg}/``.

    Class 0 is positive and 1 negative; the file path identifies the review. Spark packs the
    small files of a folder into tasks of ``spark.sql.files.maxPartitionBytes``, a file counting
    as ``spark.sql.files.openCostInBytes`` at least. For small files these tasks cost more than
    their reading, so ``PARTS_OF_TASK`` of them make one, as long as four are left for each core.
    An empty file has no row: Spark's scans leave it out, and a review without words is dropped
    later anyway.
    """
    base = f"{root.rstrip('/')}/{split}"
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*").load([f"{base}/pos", f"{base}/neg"])
        .select(F.col("content").cast("string").alias("text"), F.col("path").alias("doc_id"))
    )
    parts = files.rdd.getNumPartitions()
    files = files.coalesce(max(-(-parts // PARTS_OF_TASK), min(parts, 4 * spark.sparkContext.defaultParallelism), 1))
    folder = F.regexp_extract("doc_id", r"/(pos|neg)/[^/]*$", 1)
    return files.select(
        "doc_id",
        F.lit(split).alias("split"),
        F.when(folder == "pos", F.lit("positive")).otherwise(F.lit("negative")).alias("label_name"),
        F.when(folder == "pos", F.lit(0)).otherwise(F.lit(1)).alias("label"),
        "text",
    )


def write_reviews(reviews: DataFrame, root: str) -> DataFrame:
    """A file ``<root>/<split>/{pos,neg}/<name>.txt`` for each row of (split, label, name, text)."""
    folder = F.when(F.col("label") == 0, F.lit("pos")).otherwise(F.lit("neg"))
    name = F.concat_ws("/", "split", folder, F.concat(F.col("name").cast("string"), F.lit(".txt")))
    return write_files(reviews.select(name.alias("name"), F.col("text").alias("content")), root)


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(token, vector) from a Parquet table."""
    return spark.read.parquet(path).select("token", F.col("vector").cast("array<float>").alias("vector"))


def write_word_vector_text(vectors: DataFrame, path: str, sep: str = " ") -> None:
    """Text lines ``token v0 v1 ...`` of (token, vector)."""
    vectors.select(F.concat_ws(sep, "token", vector_text(F.col("vector"), sep)).alias("value")).write.text(path)


def read_word_vector_text(spark: SparkSession, path: str, sep: str = " ", width: int | None = None) -> DataFrame:
    """(token, vector) from text lines ``token v0 v1 ...``; a header of two numbers is skipped.

    All vectors must have ``width`` numbers, or else as many as the longest line has; the scan
    that finds this width reads lines only to count their separators. A line of another width,
    one with something that is no number, and a token without a vector are errors that show
    the line.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    parts = F.split("value", _literal(sep), -1)
    rows = lines.where(~F.col("value").rlike(rf"^\d+{_literal(sep)}\d+$"))
    if width is None:
        width = rows.agg(F.max(F.size(parts) - 1)).first()[0] or 0
    numbers = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), lambda p: F.trim(p).try_cast("float"))
    fine = (F.size(parts) == width + 1) & (F.get(parts, F.lit(0)) != "") & ~F.exists(numbers, F.isnull)
    wrong = F.raise_error(F.concat(F.lit(f"no token with {width} numbers: "), F.substring("value", 1, 80)))
    return rows.select(F.get(parts, F.lit(0)).alias("token"), F.when(fine, numbers).otherwise(wrong).alias("vector"))
