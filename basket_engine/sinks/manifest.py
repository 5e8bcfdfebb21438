"""Exports that know their input: written again when it has changed, and only then.

An export lies in a folder named by a digest of its rows, beside a manifest of its files. The
digest does not depend on the order of rows or on how they are partitioned. A manifest is
written after the files, so an export counts only once it is whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from ..session import delete_path, names_in, path_exists

MANIFEST_SCHEMA = "path string, split int, n_rows long, bytes long"
_DATA, _MANIFEST = "data-", "manifest-"


def _hashed(column: Column, kind: DataType) -> list[Column]:
    """What tells values apart where the hash function alone would not: it skips nulls."""
    if isinstance(kind, StructType):
        inner = [c for f in kind.fields for c in _hashed(column[f.name], f.dataType)]
        return [column.isNull(), *inner]
    if isinstance(kind, ArrayType):
        places = F.transform(column, lambda x: F.struct(*_hashed(x, kind.elementType)))
        return [F.coalesce(F.size(column), F.lit(-1)), places]
    return [column.isNull(), column]


def content_digest(df: DataFrame) -> str:
    """128 bits and a row count that stand for the rows and columns, whatever their order.

    Each row has two 64-bit hashes, summed exactly over all rows; equal rows count as often as
    they are there.
    """
    order = sorted(df.schema.fields, key=lambda f: f.name)
    names = F.lit(",".join(f"{f.name} {f.dataType.simpleString()}" for f in order))
    parts = [c for f in order for c in _hashed(F.col(f"`{f.name}`"), f.dataType)]
    sums = [F.sum(F.xxhash64(F.lit(seed), names, *parts).cast("decimal(20,0)")).alias(f"s{seed}") for seed in (1, 2)]
    row = df.agg(F.count(F.lit(1)).alias("n"), *sums).first()
    halves = [int(row[f"s{seed}"] or Decimal(0)) % (1 << 64) for seed in (1, 2)]
    return f"{row['n']}-{halves[0]:016x}{halves[1]:016x}"


@dataclass(frozen=True)
class Export:
    """Where an export lies, and whether this call wrote it."""

    digest: str
    data: str
    manifest: str
    written: bool


def export_once(df: DataFrame, folder: str, by: str = "split", key: Sequence[str] = (), keep_others: bool = False) -> Export:
    """The rows of ``df`` below ``folder``, in parts by the column ``by``, written unless an export
    of equal rows is there already.

    Once a new export is whole, those of other rows are deleted, unless ``keep_others``. ``df`` is
    read twice, so it should be stored. ``key`` sorts the rows of a file. What the manifest calls
    the split of a file is its part by the column ``by``.
    """
    spark, folder = df.sparkSession, folder.rstrip("/")
    digest = content_digest(df)
    data, manifest = f"{folder}/{_DATA}{digest}", f"{folder}/{_MANIFEST}{digest}"
    if path_exists(spark, f"{manifest}/_SUCCESS"):
        return Export(digest, data, manifest, False)
    laid_out = df.hint("rebalance", by)
    (laid_out.sortWithinPartitions(by, *key) if key else laid_out).write.mode("overwrite").partitionBy(by).parquet(data)
    files = spark.read.schema(df.schema).parquet(data).groupBy(
        F.col("_metadata.file_path").alias("path"), F.col(by).cast("int").alias("split"), F.col("_metadata.file_size").alias("bytes")
    )
    counted = files.agg(F.count(F.lit(1)).alias("n_rows")).select("path", "split", "n_rows", "bytes")
    counted.coalesce(1).write.mode("overwrite").parquet(manifest)
    if not keep_others:
        for name in names_in(spark, folder):
            if name.startswith((_DATA, _MANIFEST)) and not name.endswith(digest):
                delete_path(spark, f"{folder}/{name}")
    return Export(digest, data, manifest, True)


def read_export(df_schema: StructType, export: Export, spark) -> DataFrame:
    return spark.read.schema(df_schema).parquet(export.data)


def read_manifest(spark, export: Export) -> DataFrame:
    """(path, split, n_rows, bytes) of the files of an export."""
    return spark.read.schema(MANIFEST_SCHEMA).parquet(export.manifest)
