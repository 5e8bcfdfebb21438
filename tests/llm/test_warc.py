import base64
import glob
import gzip
import hashlib
import io
import json
import os
import random
import zlib

import pytest

from pyspark.sql import functions as F

from basket_engine.llm import warc
from basket_engine.llm.queries import ORACLES, QUERIES

SCHEMA = "page_id {kind}, url string, html string, id long, payload binary, refers_to string, archive int"


def pages(spark, rows, kind="long"):
    return spark.createDataFrame([(*r, 7, b"x", "clash", 1) for r in rows], SCHEMA.format(kind=kind))


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def expected(rows, least=0):
    """{id: (bytes, digest, type, refers_to)} by comparing payloads."""
    best = {}
    for k, url, html in rows:
        if k is not None:
            best[k] = min([html, best[k]], key=lambda x: (x is None, x or "")) if k in best else html
    first, out = {}, {}
    for k in sorted(best):
        payload = (best[k] or "").encode()
        leader = first.setdefault(payload, k) if len(payload) >= least else k
        out[k] = (len(payload), digest(payload), "response" if leader == k else "revisit", None if leader == k else leader)
    return out


def found(df):
    return {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()}


ROWS = [
    (1, "http://a/1", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "", None), (4, " ", ""), (5, "http://a/\r\nX: y\t5", "a\r\n\r\nWARC/1.1\r\n\r\nb\n\n"),
    (6, "http://é/ü", "日本語 😀\x00 \r\n\r\n"), (7, "http://a/7", "x" * 300_000), (8, "http://a/8", "x" * 300_000), (9, "u", "\r\n"), (9, "u", "\r\n"),
    (None, "u", "no id"), (10, "u", "\n\n"), (11, "u", "<p>one</p>"), (9, None, "zzz"), (12, "http://a/12", "one more"),
]


@pytest.mark.parametrize("least", [0, 11])
def test_round_trip(spark, least):
    got = warc.archived(pages(spark, ROWS), least)
    assert found(got) == expected(ROWS, least)
    urls = {r["page_id"]: r["target_uri"] for r in got.collect()}
    assert urls[1] == "http://a/1" and urls[2] is None and urls[3] is None and urls[4] is None and urls[5] == "http://a/X:y5" and urls[6] == "http://é/ü"


@pytest.mark.parametrize("broadcast", [0, 1_000_000])
def test_hot_payload(skewed, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", broadcast)
    rows = [(i, f"http://a/{i}", "same" if i % 3 else f"page {i % 50}") for i in range(400)]
    assert found(warc.archived(pages(skewed, rows))) == expected(rows)


def test_string_ids(spark):
    rows = [("b/ä>1", "u", "x"), ("a b", "u", "x"), ("", "u", "y"), ("%41", "u", "z")]
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.archived(pages(spark, rows, "string")).collect()}
    assert got == {"b/ä>1": ("revisit", "a b"), "a b": ("response", None), "": ("response", None), "%41": ("response", None)}


def test_empty(spark):
    assert warc.archived(pages(spark, [])).count() == 0


def test_members_and_index(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, f"http://a/{i}", "".join(rng.choice("ab<> \n") for _ in range(rng.randint(0, 5000)))) for i in range(200)]
    streams, folder = f"{tmp_path}/streams", f"{tmp_path}/warc"
    warc.write_streams(pages(spark, rows).repartition(3), streams)
    written = warc.normalise(spark, streams, folder).collect()
    plain = {os.path.basename(p).split(".")[0]: p for p in glob.glob(f"{streams}/*.gz")}
    archives = sorted(glob.glob(f"{folder}/*.warc.gz"))
    assert sorted(r["archive"] for r in written) == [os.path.basename(p) for p in archives] and sum(r["records"] for r in written) == 200
    index = {}
    for r in warc.read_index(spark, folder).collect():
        index.setdefault(r["archive"], []).append(r)
    for path in archives:
        raw, at = open(path, "rb").read(), 0
        source = open(plain[os.path.basename(path).split(".")[0]], "rb").read()
        stream = zlib.decompressobj(31)
        assert gzip.decompress(raw) == stream.decompress(source) and not stream.unused_data  # the source is one stream
        for n, r in enumerate(sorted(index[os.path.basename(path)], key=lambda r: r["offset"])):
            assert (r["ordinal"], r["offset"]) == (n, at)
            member = zlib.decompressobj(31)
            record = member.decompress(raw[at : at + r["length"]])
            assert member.eof and not member.unused_data and record.count(b"WARC-Record-ID") == 1
            at += r["length"]
        assert at == len(raw)
    read = {r["record_id"]: r for r in warc.read_records(spark, folder, read_bytes=20_000).collect()}
    for i, _, html in rows:
        assert bytes(read[f"<urn:page:{i}>"]["payload"]) in (html.encode(), b"") and read[f"<urn:page:{i}>"]["http"].startswith("HTTP/1.1 200")
    assert warc.read_records(spark, folder, read_bytes=20_000).rdd.getNumPartitions() > 5
    before = {p: open(p, "rb").read() for p in glob.glob(f"{folder}/*")}
    warc.normalise(spark, streams, folder)  # a second attempt changes nothing
    assert {p: open(p, "rb").read() for p in glob.glob(f"{folder}/*")} == before


def record(body, extra=b""):
    return b"WARC/1.0\r\nWARC-Type: resource\r\n" + extra + b"Content-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"


def rewritten(data):
    archive, index = io.BytesIO(), io.BytesIO()
    n, size = warc.rewrite(io.BytesIO(data), archive, index, "a")
    assert size == len(archive.getvalue())
    return n, gzip.decompress(archive.getvalue()), [json.loads(x) for x in index.getvalue().splitlines()]


def test_streams_of_others(monkeypatch):
    bodies = [b"", b"x", os.urandom(200_000), b"\r\n\r\n\r\n", b"WARC/1.0\r\n\r\n" * 30]
    whole = b"".join(record(b, b"WARC-Target-URI: http://a/\r\n b\r\n") for b in bodies)
    for chunk in (7, 1 << 16):
        monkeypatch.setattr(warc, "CHUNK", chunk)
        for data in (gzip.compress(whole), gzip.compress(whole[:1000]) + gzip.compress(whole[1000:]), b"".join(gzip.compress(record(b)) for b in bodies)):
            n, out, entries = rewritten(data)
            assert n == len(bodies) and [e["block_bytes"] for e in entries] == [len(b) for b in bodies]
            assert out in (whole, b"".join(map(record, bodies)))
    assert rewritten(gzip.compress(whole))[2][0]["target_uri"] == "http://a/ b"
    assert rewritten(b"")[0] == rewritten(gzip.compress(b""))[0] == rewritten(gzip.compress(b"\r\n\r\n"))[0] == 0


@pytest.mark.parametrize("data, why", [
    (gzip.compress(record(os.urandom(5000)))[:-3000], "too early"), (gzip.compress(record(b"abc")[:-6]), "shorter"),
    (gzip.compress(b"HTTP/1.1 200 OK\r\n\r\n"), "begins no record"), (gzip.compress(b"WARC/1.0\r\nA: b\r\n\r\n"), "no length"),
    (b"plain text", "a: "), (gzip.compress(b"WARC/1.0\r\nA: b"), "no end"),
])
def test_broken_streams(data, why):
    with pytest.raises(ValueError, match=why):
        rewritten(data)


def test_base32(spark):
    values = [hashlib.sha1(str(i).encode()).digest() for i in range(200)] + [bytes(20), b"\xff" * 20]
    df = spark.createDataFrame([(v.hex(),) for v in values], "h string")
    assert [r[0] for r in df.select(warc.base32(F.col("h"))).collect()] == [base64.b32encode(v).decode() for v in values]


def test_query(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in QUERIES["op11_warc"](spark, sf).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    assert got == sorted(con.execute(ORACLES["op11_warc"]).fetchall())
