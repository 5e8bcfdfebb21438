"""WARC archives: written as whole gzip streams, normalised to one gzip member a record with a
sidecar index, and read back by offset.

Spark's own text writer makes the plain archives: each of its gzip files is one stream over
many records. Such a file can only be read from its start. ``normalise`` inflates it once,
chunk by chunk, and writes every record as a member of its own, and beside the archive an
index of JSON lines. ``read_records`` deals out the index, not the files, so that one large
archive is read by many tasks.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.skew import join_skewed
from ..session import delete_path, scratch_path, stored
from .documents import one_per_id

DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes that are read and inflated at a time, and the longest header.
SOURCE_CHUNK, CHUNK, HEADER = 1 << 18, 1 << 16, 1 << 20
#: Bytes of an archive, about, that one task reads back, and of records that it hands on at once.
READ_BYTES, BATCH_BYTES = 32 << 20, 8 << 20
#: Revisits that are broadcast to the pages at most; more are joined by a shuffle of the pages.
BROADCAST_ROWS = 1_000_000
_LINE, _END = "\r\n", b"\r\n\r\n"
INDEX = "archive string, ordinal long, offset long, length long, record_id string, type string, target_uri string, refers_to string, digest string, block_bytes long"
RECORD = INDEX + ", http string, payload binary"


def base32(hexadecimal: str | Column) -> Column:
    """Upper-case base 32 of a SHA-1 in hexadecimal: five digits of one are four of the other."""
    text = F.col(hexadecimal) if isinstance(hexadecimal, str) else hexadecimal
    parts = [F.lpad(F.conv(F.substring(text, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as tasks need it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()


# Writing whole streams


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """(id, refers_to) of the rows of (id, payload) whose payload, of ``least`` bytes or more, a
    smaller id has too. Only digests are grouped, and a payload of very many rows is spread."""
    keys = ["digest", "size", "check"]
    keyed = stored(
        pages.select("id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size"), F.xxhash64("payload").alias("check")),
        "digests",
    ).where(F.col("size") >= least)
    groups = keyed.groupBy(*keys).agg(F.min("id").alias("refers_to"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    groups = stored(groups, "payloads")
    found = join_skewed(keyed, groups.drop("_n"), keys, "inner", counts=groups.select(*keys, "_n"), row_id=["id"])
    return found.where("id <> refers_to").select("id", "refers_to")


def _record_id(column: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.url_encode(column.cast("string")), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_LINE)), F.lit(""))


def write_streams(
    pages: DataFrame, folder: str, least: int = 0, date: str = DATE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> None:
    """WARC/1.1 records of the pages in gzip files of one stream each.

    A page is a response, a small HTTP header and the html in UTF-8, or, if a smaller id has
    the same payload of at least ``least`` bytes, a revisit of that response with the HTTP
    header alone. A null html is empty; a null or blank url has no line, and white space and
    control characters are taken out of others. For null and repeated ids see ``one_per_id``
    (the least html and then url counts).
    """
    kept = one_per_id(pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"), F.col(url_col).alias("url")), "id", ["html", "url"])
    kept = kept.select("id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    found = stored(revisits(kept, least), "revisits")
    page = kept.join(F.broadcast(found) if found.count() <= BROADCAST_ROWS else found, "id", "left")
    again = F.col("refers_to").isNotNull()
    url = F.regexp_replace("url", r"[\x00-\x20\x7f]", "")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(2 * _LINE)
    )
    block = F.concat(http, F.when(again, "").otherwise(F.col("payload")))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _field("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _field("WARC-Record-ID", _record_id(F.col("id"))),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", F.when(url != "", url)),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.sha1("payload")))),
        _field("WARC-Refers-To", _record_id(F.col("refers_to"))),
        _field("WARC-Profile", F.when(again, PROFILE)),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
    )
    record = F.concat(header, _field("Content-Length", F.octet_length("block").cast("string")), F.lit(_LINE), F.col("block"))
    rows = page.withColumn("block", block).select(record.alias("value"))
    rows.write.option("compression", "gzip").option("lineSep", 2 * _LINE).text(folder)


# One member for each record


def _place(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if uri.startswith(("/", "file:")):
        return pyarrow.fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(uri)


class Stream:
    """The inflated bytes of a gzip file of one or more members, read once and in chunks."""

    def __init__(self, source, name: str):
        self.source, self.name = source, name
        self.inflate, self.rest, self.ready, self.begun = zlib.decompressobj(31), b"", b"", False

    def _more(self) -> bool:
        """Whether ``ready`` could be made longer."""
        while True:
            if self.inflate.eof:
                self.rest, self.inflate, self.begun = self.inflate.unused_data, zlib.decompressobj(31), False
            if not self.rest:
                self.rest = self.source.read(SOURCE_CHUNK)
                if not self.rest:
                    if self.begun:
                        raise ValueError(f"{self.name}: the gzip stream ends too early")
                    return False
            self.begun = True
            try:
                found = self.inflate.decompress(self.rest, CHUNK)
            except zlib.error as e:
                raise ValueError(f"{self.name}: {e}") from e
            self.rest = self.inflate.unconsumed_tail
            if found:
                self.ready += found
                return True

    def header(self) -> bytes | None:
        """The next header with its empty line, without line ends before it; None at the end."""
        while True:
            if self.ready[:1] in (b"\r", b"\n"):
                self.ready = self.ready.lstrip(b"\r\n")
            if self.ready or not self._more():
                break
        if not self.ready:
            return None
        while (end := self.ready.find(_END)) < 0:
            if len(self.ready) > HEADER or not self._more():
                raise ValueError(f"{self.name}: a record has no end of its header")
        out, self.ready = self.ready[: end + 4], self.ready[end + 4 :]
        return out

    def block(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.ready and not self._more():
                raise ValueError(f"{self.name}: a record is shorter than its length")
            part, self.ready = self.ready[:n], self.ready[n:]
            n -= len(part)
            yield part


def fields(header: bytes, name: str = "") -> dict[str, str]:
    """The named fields of a header, names in lower case; continued lines are joined."""
    lines = re.sub(rb"\r\n[ \t]+", b" ", header).decode("utf-8", "replace").split(_LINE)
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"{name}: {lines[0][:40]!r} begins no record")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}


def _entry(known: dict[str, str], **more) -> dict:
    digest = known.get("warc-payload-digest")
    return more | {
        "record_id": known.get("warc-record-id"), "type": known.get("warc-type"), "target_uri": known.get("warc-target-uri"),
        "refers_to": known.get("warc-refers-to"), "digest": digest and digest.removeprefix("sha1:"), "block_bytes": int(known["content-length"]),
    }


def rewrite(source, archive, index, name: str, level: int = 6) -> tuple[int, int]:
    """Every record of a gzip stream as a member of its own, and a line of the index for each.

    Returns the number of records and of bytes written. Equal input gives equal bytes.
    """
    stream, at, n = Stream(source, name), 0, 0
    while (header := stream.header()) is not None:
        known = fields(header, name)
        if not known.get("content-length", "").isdigit():
            raise ValueError(f"{name}: a record has no length")
        pack, size = zlib.compressobj(level, zlib.DEFLATED, 31), 0
        for part in chain((header,), stream.block(int(known["content-length"])), (_END,)):
            size += archive.write(pack.compress(part))
        size += archive.write(pack.flush())
        index.write(json.dumps(_entry(known, archive=name, ordinal=n, offset=at, length=size)).encode() + b"\n")
        at, n = at + size, n + 1
    return n, at


def _normalised(folder: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = _place(folder)
        target.create_dir(base, recursive=True)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                name = re.sub(r"(\.txt|\.warc)?\.gz$", "", path.rsplit("/", 1)[-1]) + ".warc.gz"
                final = f"{base}/{name}"
                partial = f"{base}/_{name}.{uuid.uuid4().hex}"
                system, place = _place(path)
                with system.open_input_stream(place, compression=None) as source, \
                        target.open_output_stream(partial, compression=None) as archive, \
                        target.open_output_stream(f"{partial}.idx", compression=None) as index:
                    n, size = rewrite(source, archive, index, name, level)
                for own, to in ((partial, final), (f"{partial}.idx", f"{final}.idx")):
                    # an earlier attempt has written the same bytes
                    if target.get_file_info(to).type == pyarrow.fs.FileType.NotFound:
                        target.move(own, to)
                    else:
                        target.delete_file(own)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["archive", "records", "bytes"])

    return run


def normalise(spark: SparkSession, source: str, folder: str, level: int = 6) -> DataFrame:
    """(archive, records, bytes): the gzip files of ``source`` rewritten to ``folder``.

    Each file, of one gzip stream or several, is inflated once by one task, in chunks, so that
    neither a file nor a record has to fit in memory. Its archive has a gzip member for each
    record, and ``<archive>.idx`` their offsets and headers. Files appear under their names
    only when they are whole, so a task may be run again at any point. Both folders have to be
    on a file system that Arrow can open (local or mounted, HDFS, S3, GCS). A stream that
    breaks off, or that is no WARC file, is an error that names the file; a file without
    records gives an empty archive.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")
    return stored(files.mapInArrow(_normalised(qualified(spark, folder), level), "archive string, records long, bytes long"), "archives")


# Reading by offset


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The entries of all sidecars of a folder."""
    return spark.read.schema(INDEX).option("pathGlobFilter", "*.idx").option("mode", "FAILFAST").json(folder)


def parsed(member: bytes) -> tuple[str, bytes]:
    """(HTTP header, payload) of a record; a block without such a header is all payload."""
    record = zlib.decompress(member, 31)
    header = record.index(_END) + 4
    known = fields(record[:header])
    block = record[header : header + int(known["content-length"])]
    if not known.get("content-type", "").startswith("application/http"):
        return "", block
    http, _, payload = block.partition(_END)
    return http.decode("latin-1"), payload


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _place(folder)
        opened, archive = "", None
        for batch in batches:
            rows, https, payloads, size = [], [], [], 0
            names, offsets, lengths = (batch.column(i).to_pylist() for i in (0, 2, 3))
            for i, (name, offset, length) in enumerate(zip(names, offsets, lengths)):
                if name != opened:
                    opened, archive = name, system.open_input_file(f"{base}/{name}")
                archive.seek(offset)
                http, payload = parsed(archive.read(length))
                rows.append(i), https.append(http), payloads.append(payload)
                size += len(payload)
                if size > BATCH_BYTES or i == batch.num_rows - 1:
                    kept = batch.take(pa.array(rows, pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [*kept.columns, pa.array(https, pa.string()), pa.array(payloads, pa.binary())], [*batch.schema.names, "http", "payload"]
                    )
                    rows, https, payloads, size = [], [], [], 0

    return run


def read_records(spark: SparkSession, folder: str, read_bytes: int = READ_BYTES) -> DataFrame:
    """The index entries of a normalised folder with ``http`` header and ``payload`` of each
    record. The entries are dealt by archive and offset, so that a task reads about
    ``read_bytes`` of neighbouring members, whichever archives hold them."""
    index = read_index(spark, folder)
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    dealt = index.repartitionByRange(max(1, -(-total // read_bytes)), "archive", "offset").sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(_read(qualified(spark, folder)), RECORD)


def archived(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, target_uri, payload_bytes, payload_digest, record_type, refers_to, archive, offset) of
    the pages, as read back from normalised archives in the scratch folder.

    Size and digest are those of the payload in the archive; a revisit has them from the
    response that it refers to. See ``write_streams`` for what is written.
    """
    spark = pages.sparkSession
    kind = pages.schema[id_col].dataType.simpleString()
    streams, folder = scratch_path(spark, "streams"), scratch_path(spark, "warc")
    write_streams(pages, streams, least, id_col=id_col, url_col=url_col, html_col=html_col)
    normalise(spark, streams, folder)
    delete_path(spark, streams)
    key = lambda c: F.url_decode(F.regexp_extract(c, "^<urn:page:(.*)>$", 1)).cast(kind)
    found = read_records(spark, folder).select(
        key("record_id").alias("id"), "target_uri", F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32(F.sha1("payload")).alias("payload_digest"), F.col("type").alias("record_type"), key("refers_to").alias("refers_to"), "archive", "offset",
    )
    found = stored(found, "records")
    sizes = ["payload_bytes", "payload_digest"]
    responses = found.where("record_type = 'response'")
    first = responses.select(F.col("id").alias("refers_to"), *sizes)
    again = join_skewed(found.where("record_type = 'revisit'").drop(*sizes), first, ["refers_to"], "left", row_id=["id"])
    return responses.unionByName(again).withColumnRenamed("id", id_col)
