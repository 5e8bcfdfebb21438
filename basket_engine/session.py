"""Session helpers: building a local session, shared scratch space, lineage cuts."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cpus: int | str = 8, app: str = "basket-engine", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def configured_root(spark: SparkSession) -> str | None:
    return spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)


@functools.cache
def _local_root(application_id: str) -> str:
    return tempfile.mkdtemp(prefix="basket-engine-")


def scratch_root(spark: SparkSession) -> str:
    """Folder every executor can reach, as the session names it.

    Only a local session without the setting falls back to a temporary folder;
    on a cluster a machine-local folder would be lost with its machine.
    """
    root = configured_root(spark)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
    return _local_root(spark.sparkContext.applicationId)


def _own_scratch(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/basket-engine-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in this application's part of the scratch folder."""
    return f"{_own_scratch(spark)}/{label}-{uuid.uuid4().hex}"


def _storage(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    system, target = _storage(spark, path)
    return system.exists(target)


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder of any storage that Spark reaches; a missing one is fine."""
    system, target = _storage(spark, path)
    system.delete(target, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Sorted names in a folder, none if it is missing. For folders of few entries."""
    system, target = _storage(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(target)) if system.exists(target) else []


def release_scratch(spark: SparkSession) -> None:
    """Drops everything this application stored. Call it once its results are written:
    DataFrames built before still read from there."""
    delete_path(spark, _own_scratch(spark))


def stored(df: DataFrame, label: str = "stage") -> DataFrame:
    """The result written as a table in the shared scratch folder and read back.

    It survives executor loss, ends the lineage, and lets the planner see the true
    size. Used where a stage feeds several others or decides how they are planned.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
