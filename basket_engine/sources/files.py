"""Many small files, and files of fixed-width records, on any storage that Arrow can open.

Spark's writers name their own files and join many records in one. Here a record names its
file, as other programs expect it. Tasks write under another name first and move the whole
file, so that a task may run twice and no reader sees a part of a file.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes before the records of a minibatch file: two widths and the number of records, as int64.
HEADER_BYTES = 24


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its storage, as tasks need it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()


def place(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The storage of a path, and its name there."""
    if uri.startswith(("/", "file:")):
        return pyarrow.fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(uri)


def write_whole(system: pyarrow.fs.FileSystem, path: str, content: bytes) -> None:
    """A file that is there in whole or not at all; an older one of this name is replaced."""
    folder, _, name = path.rpartition("/")
    partial = f"{folder}/_{name}.{uuid.uuid4().hex}"
    system.create_dir(folder, recursive=True)
    with system.open_output_stream(partial, compression=None) as out:
        out.write(content)
    if not isinstance(system, pyarrow.fs.LocalFileSystem) and system.get_file_info(path).type != pyarrow.fs.FileType.NotFound:
        system.delete_file(path)
    system.move(partial, path)


def _written(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = place(root)
        for batch in batches:
            names, sizes = batch.column(0).to_pylist(), []
            for name, content in zip(names, batch.column(1).to_pylist()):
                if name is None or not name.strip("/") or ".." in name.split("/"):
                    raise ValueError(f"{name!r} names no file below {root}")
                write_whole(system, f"{base}/{name.strip('/')}", content or b"")
                sizes.append(len(content or b""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["name", "bytes"])

    return run


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Writes a file below ``root`` for each row of (name, content) and counts them: (files, bytes).

    ``content`` is text in UTF-8 or binary; null is an empty file. Rows that share a name
    replace each other, so names should differ. A name that leads out of ``root`` is an error.
    """
    rows = files.select(F.col("name").cast("string"), F.col("content").cast("binary"))
    done = rows.mapInArrow(_written(qualified(files.sparkSession, root)), "name string, bytes long")
    counted = done.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).collect()
    return files.sparkSession.createDataFrame(counted, "files long, bytes long")


# Minibatch files: fixed-width records of little-endian float64


def encode_minibatch(x: np.ndarray, y: np.ndarray) -> bytes:
    """A header of two widths and a count, then features and labels of each record."""
    head = np.array([x.shape[1], y.shape[1], len(x)], "<i8")
    return head.tobytes() + np.concatenate([x, y], axis=1).astype("<f8").tobytes()


def decode_minibatch(content: bytes, name: str = "") -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of a file; one that is cut off or too long is an error that names it."""
    if len(content) < HEADER_BYTES:
        raise ValueError(f"{name}: no header of a minibatch")
    n_x, n_y, n = (int(v) for v in np.frombuffer(content, "<i8", 3))
    if min(n_x, n_y, n) < 0 or len(content) != HEADER_BYTES + 8 * n * (n_x + n_y):
        raise ValueError(f"{name}: {len(content)} bytes are not {n} records of {n_x} and {n_y} values")
    values = np.frombuffer(content, "<f8", offset=HEADER_BYTES).reshape(n, n_x + n_y)
    return values[:, :n_x], values[:, n_x:]


def _lists(values: np.ndarray) -> pa.ListArray:
    n, width = values.shape
    offsets = pa.array(np.arange(0, n * width + 1, width, dtype=np.int32) if width else np.zeros(n + 1, np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(values).ravel()))


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, name in enumerate(batch.column(0).to_pylist()):
            x, y = decode_minibatch(batch.column(1)[i].as_buffer().to_pybytes(), name)
            if len(x):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(x)), pa.array(np.arange(len(x))), _lists(x), _lists(y)], ["path", "record", "x", "y"]
                )


MINIBATCH_ROWS = "path string, record long, x array<double>, y array<double>"


def read_minibatch_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, record, x, y) of all minibatch files below a folder, by Spark's binary source."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.bin").load(root)
    return files.select("path", "content").mapInArrow(_decoded, MINIBATCH_ROWS)


def _opened(keep: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, path in enumerate(batch.column(0).to_pylist()):
                system, name = place(path)
                with system.open_input_stream(name, compression=None) as file:
                    content = file.read()
                own = [batch.column(c + 1)[i] for c in range(len(keep))]
                for rows in _decoded(iter([pa.RecordBatch.from_arrays([pa.array([path]), pa.array([content], pa.binary())], ["path", "content"])])):
                    repeated = [pa.repeat(v, rows.num_rows) for v in own]
                    yield pa.RecordBatch.from_arrays([*repeated, *rows.columns], [*keep.names, *rows.schema.names])

    return run


def read_listed(paths: DataFrame, keep: Sequence[Column] = ()) -> DataFrame:
    """(keep ..., path, record, x, y) of the minibatch files that a column ``path`` lists, each read by
    the task that holds its row: partitioning and order of the list are those of the result."""
    listed = paths.select("path", *keep)
    kept = listed.drop("path").schema
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), MINIBATCH_ROWS])
    return listed.mapInArrow(_opened(to_arrow_schema(kept)), ddl)
