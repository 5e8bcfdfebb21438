"""Delimited text tables: N separators make N + 1 fields, nothing is quoted."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DataType, DoubleType, IntegerType, StringType, StructField, StructType

from ..functions.scalars import missing_to_null
from ..operators.skew import group_rows
from ..settings import NULL_TOKEN


def columns(*pairs: tuple[str, DataType]) -> StructType:
    return StructType([StructField(name, kind) for name, kind in pairs])


_TEXT = StringType()
TRANSACTION_SCHEMA = columns(
    ("user_id", _TEXT), ("item_id", _TEXT), *[(f"v{i}", DoubleType()) for i in range(2, 13)], ("year_month", IntegerType())
)
PAIR_SCHEMA = columns(("user_id", _TEXT), ("item_id", _TEXT))
USER_RULE_SCHEMA = columns(("user_id", _TEXT), ("rule_key", _TEXT))
INCLUSION_SCHEMA = columns(("rule_key", _TEXT), ("item_id", _TEXT))
USER_SCHEMA = columns(("user_id", _TEXT))


def fields(line: Column, sep: str = ",") -> Column:
    """All fields of a line; trailing and empty ones are kept."""
    return F.split(line, re.escape(sep), -1)


def parse_lines(
    lines: DataFrame,
    schema: StructType,
    sep: str = ",",
    null_token: str | None = NULL_TOKEN,
    strict: bool = False,
    line: str = "value",
) -> DataFrame:
    """Named, typed columns from text lines, by position.

    Missing text becomes NULL. A field that is absent or has the wrong type is NULL
    too, or raises under ``strict``; further fields are ignored.
    """
    parts = fields(F.col(line), sep)
    others = [c for c in lines.columns if c != line]

    def typed(i: int, field: StructField) -> Column:
        # ANSI element access and casts raise on what the lenient forms make NULL.
        text = F.element_at(parts, i + 1) if strict else F.get(parts, F.lit(i))
        text = missing_to_null(text, null_token) if null_token is not None else text
        if isinstance(field.dataType, StringType):
            return text.alias(field.name)
        cast = text.cast(field.dataType) if strict else text.try_cast(field.dataType)
        return cast.alias(field.name)

    return lines.select(*[typed(i, f) for i, f in enumerate(schema.fields)], *others)


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType,
    sep: str = ",",
    null_token: str | None = NULL_TOKEN,
    strict: bool = False,
) -> DataFrame:
    return parse_lines(spark.read.text(path), schema, sep, null_token, strict)


def read_fields(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """Untyped form: one ``fields`` array per line."""
    return spark.read.text(path).select(fields(F.col("value"), sep).alias("fields"))


def _numbered_children(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Children whose whole name is a number. Only names are listed, no data."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if re.fullmatch(r"[+-]?\d+", name):
            found.append((int(name), status.getPath().toString()))
    return sorted(found)


def _empty(spark: SparkSession, schema: StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_date_range(
    spark: SparkSession, path: str, start: int, end: int, schema: StructType, sep: str = ",",
    null_token: str | None = NULL_TOKEN,
) -> DataFrame:
    """Children named by a number in ``[start, end]``; other names are skipped.

    No match gives an empty table of the schema.
    """
    chosen = [p for n, p in _numbered_children(spark, path) if start <= n <= end]
    if not chosen:
        return _empty(spark, schema)
    return read_delimited(spark, chosen, schema, sep, null_token)


def read_latest(
    spark: SparkSession, path: str, schema: StructType, sep: str = ",", null_token: str | None = NULL_TOKEN
) -> DataFrame:
    """The child with the greatest numeric name; other names are ignored."""
    numbered = _numbered_children(spark, path)
    if not numbered:
        return _empty(spark, schema)
    return read_delimited(spark, numbered[-1][1], schema, sep, null_token)


def partition_range(table: DataFrame, part: str, start: int, end: int) -> DataFrame:
    """Same range over a partitioned table: pruned on the partition column."""
    return table.where(F.col(part).between(start, end))


def latest_partition(table: DataFrame, part: str) -> DataFrame:
    """Rows of the greatest partition value, found by a scalar subquery."""
    return table.where(F.col(part) == table.agg(F.max(part).alias("latest")).scalar())


def grouped_table(df: DataFrame, key: str, row_id: Sequence[str] | None = None) -> DataFrame:
    """Rows nested by one column."""
    return group_rows(df, [key], row_id)


def keyed_table(df: DataFrame, cols: Sequence[str], name: str = "key") -> DataFrame:
    """Each row with its key: the given columns joined by commas."""
    return df.withColumn(name, F.concat_ws(",", *[F.col(c).cast("string") for c in cols]))
