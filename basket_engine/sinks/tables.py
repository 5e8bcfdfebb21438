"""Writers. Rows are rebalanced by size, so a hot month becomes several files."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.arrays import vector_text
from ..functions.scalars import example_key
from ..operators.training import FitResult, Model
from ..sources.files import encode_minibatch, qualified, write_files
from .manifest import export_once, read_export

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def write_examples(examples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Training rows by split and month; the user stays a column."""
    laid_out = examples.hint("rebalance", "split", "year_month")
    laid_out.write.mode(mode).partitionBy("split", "year_month").parquet(path)


def write_example_text(
    examples: DataFrame, path: str, user: str = "user_id", month: str = "year_month", mode: str = "errorifexists"
) -> None:
    """Text form: ``<split>/<user>_<yyyyMM>``, a tab, then features and labels as CSV.

    The key is part of the line; one file per user and month would not scale.
    """
    key = example_key(F.col("split"), F.col(user), F.col(month))
    line = F.concat_ws("\t", key, vector_text(F.concat("features", "label")))
    laid_out = examples.select("split", month, line.alias("value")).hint("rebalance", "split", month)
    laid_out.write.mode(mode).partitionBy("split", month).text(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Scored results, purged recommendations or churn predictions."""
    if fmt not in ("parquet", "csv", "orc", "json"):
        raise ValueError(f"unsupported format {fmt!r}")
    df.hint("rebalance").write.mode(mode).format(fmt).save(path)


def write_scored_text(recos: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Triples as text lines ``(user,(item,score))``."""
    line = F.concat(
        F.lit("("), F.col("user_id").cast("string"), F.lit(",("), F.col("item_id").cast("string"),
        F.lit(","), F.col("score").cast("string"), F.lit("))"),
    )
    recos.select(line.alias("value")).hint("rebalance").write.mode(mode).text(path)


def write_split(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Train and test rows of all entities below one folder each."""
    rows.hint("rebalance", "split").write.mode(mode).partitionBy("split").parquet(path)


ENTITY_BUCKET = "bucket"


def entity_bucket(entity: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(entity), F.lit(buckets)).cast("int")


def write_entities(
    rows: DataFrame, path: str, entity: Sequence[str] | str = "user_id", buckets: int = 64, order: Sequence[str] = (), mode: str = "errorifexists"
) -> None:
    """Rows laid out by entity: a folder per split and hash bucket, all rows of an entity in one
    bucket, sorted by entity. However many entities there are, the folders are ``2 * buckets``
    at most for two splits; a bucket that is too big for a file has several."""
    placed = rows.withColumn(ENTITY_BUCKET, entity_bucket(entity, buckets))
    laid_out = placed.hint("rebalance", "split", ENTITY_BUCKET).sortWithinPartitions("split", ENTITY_BUCKET, entity, *order)
    laid_out.write.mode(mode).partitionBy("split", ENTITY_BUCKET).parquet(path)


def read_entity(spark: SparkSession, path: str, value: object, buckets: int = 64, entity: str = "user_id", split: str | None = None) -> DataFrame:
    """The rows of one entity; only its bucket is listed in the scan, and within its files only
    row groups that may hold it are read."""
    table = spark.read.parquet(path)
    kind = table.schema[entity].dataType
    bucket = spark.range(1).select(entity_bucket(F.lit(value).cast(kind), buckets).alias("b")).first()["b"]
    found = table.where((F.col(ENTITY_BUCKET) == bucket) & (F.col(entity) == F.lit(value).cast(kind))).drop(ENTITY_BUCKET)
    return found if split is None else found.where(F.col("split") == split)


#: Examples of a folder of an export: neighbouring splits share one up to so many.
FOLDER_ROWS = 1 << 18


def export_minibatches(placed: DataFrame, path: str, run_id: str, splits: int | None = None) -> DataFrame:
    """Placed examples written once per run id and read back folder by folder.

    A folder holds ``splits`` neighbouring splits, or else as many as have FOLDER_ROWS examples:
    the number of splits grows with the examples, and a folder for each would cost more than
    they do. An export of equal examples of the same run is reused; one of other examples is
    replaced, as is one that was not finished.
    """
    if splits is None:
        n, last = placed.agg(F.count(F.lit(1)), F.max("split")).first()
        splits = max(1, FOLDER_ROWS * (last + 1) // n) if n else 1
    laid_out = placed.withColumn("folder", F.floor(F.col("split") / splits).cast("int"))
    export = export_once(laid_out, f"{path.rstrip('/')}/{run_id}", by="folder", key=["split", "worker", "turn"])
    return read_export(laid_out.schema, export, placed.sparkSession)


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        contents = []
        for rows in batch.column(1):
            x, y = (np.array([r[c] for r in rows.as_py()], np.float64).reshape(len(rows), -1) for c in ("x", "y"))
            contents.append(encode_minibatch(x, y))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(contents, pa.binary())], ["name", "content"])


def export_batch_files(placed: DataFrame, root: str, batch: int) -> DataFrame:
    """Placed examples as binary files of ``batch`` records, and their manifest.

    The manifest (path, split, worker, batch_no, n_rows) is stored below ``root`` too and
    comes last, so a folder that has one is whole.
    """
    spark, root = placed.sparkSession, root.rstrip("/")
    nested = placed.groupBy("split", "worker", F.floor(F.col("turn") / batch).alias("batch_no")).agg(
        F.array_sort(F.collect_list(F.struct("turn", "x", "y"))).alias("rows")
    )
    name = F.concat_ws("/", "split", F.concat_ws("_", "worker", F.concat(F.col("batch_no").cast("string"), F.lit(".bin"))))
    write_files(nested.select(name.alias("name"), "rows").mapInArrow(_encoded, "name string, content binary"), f"{root}/data")
    path = F.concat(F.lit(f"{qualified(spark, root)}/data/"), name)
    counted = placed.groupBy("split", "worker", F.floor(F.col("turn") / batch).alias("batch_no")).agg(F.count(F.lit(1)).alias("n_rows"))
    counted.select(path.alias("path"), "split", "worker", "batch_no", "n_rows").write.mode("overwrite").parquet(f"{root}/paths")
    return spark.read.parquet(f"{root}/paths")


def model_rows(spark: SparkSession, result: FitResult) -> DataFrame:
    """Best and last model as rows; each is one parameter vector."""
    last_epoch = result.history[-1][0] if result.history else -1
    last_loss = result.history[-1][2] if result.history and result.history[-1][2] is not None else (
        result.history[-1][1] if result.history else None
    )
    rows = [
        (kind, m.head, m.n_features, m.n_labels, epoch, loss, m.params.tolist(), m.updater.tolist())
        for kind, m, epoch, loss in (
            ("best", result.best, result.best_epoch, result.best_loss),
            ("last", result.last, last_epoch, last_loss),
        )
    ]
    schema = (
        "kind string, head string, n_features int, n_labels int, epoch int, loss double, "
        "params array<double>, updater array<double>"
    )
    return spark.createDataFrame(rows, schema)


def write_model(spark: SparkSession, result: FitResult, path: str, mode: str = "errorifexists") -> None:
    model_rows(spark, result).coalesce(1).write.mode(mode).parquet(path)


def read_model(spark: SparkSession, path: str, kind: str = "best") -> Model:
    import numpy as np

    row = spark.read.parquet(path).where(F.col("kind") == kind).first()
    if row is None:
        raise ValueError(f"no {kind!r} model at {path}")
    return Model(row["head"], row["n_features"], row["n_labels"], np.array(row["params"]), np.array(row["updater"]))
