import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from basket_engine.operators import training as T
from basket_engine.sinks import tables as W
from basket_engine.sources import catalogs, corpus, examples, files

from .conftest import rows


def test_files_named_by_records(spark, tmp_path):
    df = spark.createDataFrame([("a/b/1.txt", "é\n"), ("a/2", ""), ("3", None)], "name string, content string")
    for _ in range(2):  # a second attempt replaces the files by equal ones
        assert rows(files.write_files(df, str(tmp_path))) == [(3, 3)]
    found = sorted(os.path.join(d, f) for d, _, names in os.walk(tmp_path) for f in names)
    assert [os.path.relpath(f, tmp_path) for f in found] == ["3", "a/2", "a/b/1.txt"]
    assert (tmp_path / "a/b/1.txt").read_bytes() == "é\n".encode()
    assert rows(files.write_files(df.limit(0), str(tmp_path))) == [(0, 0)]


@pytest.mark.parametrize("name", [None, "", "/", "../x", "a/../../x"])
def test_names_that_lead_elsewhere(spark, tmp_path, name):
    df = spark.createDataFrame([(name, "x")], "name string, content string")
    with pytest.raises(Exception, match="names no file"):
        files.write_files(df, str(tmp_path))


def test_review_corpus_round_trip(spark, tmp_path):
    texts = {i: ["", "two\nlines\r\n", "日本", " x "][i % 4] + str(i % 3) * (i % 2) for i in range(60)}
    df = spark.createDataFrame([("test" if i % 5 == 0 else "train", i % 2, i, t) for i, t in texts.items()], "split string, label int, name int, text string")
    corpus.write_reviews(df, str(tmp_path))
    got = {}
    for split in ("train", "test"):
        read = corpus.read_reviews(spark, str(tmp_path), split)
        assert read.rdd.getNumPartitions() < 20  # small files are packed
        for r in read.collect():
            got[int(os.path.basename(r["doc_id"])[:-4])] = (r["split"], r["label"], r["label_name"], r["text"])
    assert got == {i: ("test" if i % 5 == 0 else "train", i % 2, ["positive", "negative"][i % 2], t) for i, t in texts.items() if t}


def test_many_small_reviews_are_read_by_few_tasks(spark, tmp_path):
    n = 2000
    for label in ("pos", "neg"):
        (tmp_path / "train" / label).mkdir(parents=True)
    for i in range(n):
        (tmp_path / "train" / ("neg" if i % 2 else "pos") / f"{i}.txt").write_text(f"text {i}")
    read = corpus.read_reviews(spark, str(tmp_path), "train")
    assert read.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert rows(read, "text", "label") == sorted(((f"text {i}", i % 2) for i in range(n)), key=repr)


def test_example_files_in_nested_folders(spark, tmp_path):
    df = spark.createDataFrame([(f"train/{i % 3}/x/u_{i}_20160{i % 9 + 1}", f"{i},1.5,{-i}") for i in range(12)], "name string, content string")
    files.write_files(df, str(tmp_path))
    got = rows(examples.import_example_files(spark, str(tmp_path), "train", 2, 1))
    assert got == sorted((("train", f"u_{i}", 201601 + i % 9, [float(i), 1.5], [-float(i)]) for i in range(12)), key=repr)


def batch(n, n_x=2, n_y=1, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, n_x)), rng.normal(size=(n, n_y))


@pytest.mark.parametrize("n, n_x, n_y", [(5, 2, 1), (0, 3, 2), (1, 0, 1), (4, 3, 0)])
def test_minibatch_bytes(n, n_x, n_y):
    x, y = batch(n, n_x, n_y)
    content = files.encode_minibatch(x, y)
    assert len(content) == 24 + 8 * n * (n_x + n_y)
    a, b = files.decode_minibatch(content)
    assert np.array_equal(a, x) and np.array_equal(b, y) and a.shape == (n, n_x) and b.shape == (n, n_y)


def test_broken_minibatches(spark, tmp_path):
    content = files.encode_minibatch(*batch(3))
    for bad in (content[:-1], content + b"x", content[:20], b""):
        with pytest.raises(ValueError, match="f.bin"):
            files.decode_minibatch(bad, "f.bin")
    (tmp_path / "f.bin").write_bytes(content[:-8])
    with pytest.raises(Exception, match="are not 3 records"):
        files.read_minibatch_files(spark, str(tmp_path)).collect()


@pytest.fixture
def points(spark):
    rng = np.random.default_rng(1)
    data = [(i, rng.normal(size=2).tolist(), [1.0, 0.0] if rng.random() < 0.5 else [0.0, 1.0]) for i in range(120)]
    return spark.createDataFrame(data, "user_id int, x array<double>, y array<double>")


def test_minibatch_files(spark, points, tmp_path):
    placed, n_splits, _ = T.place_examples(points, "user_id", 2, 10, 2)
    manifest = W.export_batch_files(placed, str(tmp_path / "m"), 7)
    listed = manifest.collect()
    assert sum(r["n_rows"] for r in listed) == 120 and max(r["n_rows"] for r in listed) == 7 and n_splits == 3
    assert len(listed) == 3 * 2 * 3 == len(list((tmp_path / "m" / "data").rglob("*.bin")))
    want = rows(points, F.struct("x", "y"))
    for read in (files.read_minibatch_files(spark, str(tmp_path / "m")), files.read_listed(manifest)):
        assert rows(read, F.struct("x", "y")) == want
    path = listed[0]["path"]
    own = placed.where((F.col("split") == listed[0]["split"]) & (F.col("worker") == listed[0]["worker"]) & (F.floor(F.col("turn") / 7) == listed[0]["batch_no"]))
    assert rows(files.read_listed(manifest.where(F.col("path") == path)), "record", "x") == [(i, r["x"]) for i, r in enumerate(own.orderBy("turn").collect())]
    assert files.read_listed(manifest.limit(0)).count() == 0


def test_fit_from_listed_files_is_that_from_rows(spark, points, tmp_path):
    whole = T.fit(points, 2, 2, epochs=2, workers=2, batch=10, averaging=2, test=points)
    placed, _, _ = T.place_examples(points, "user_id", 2, 10, 2)
    manifest = W.export_batch_files(placed, str(tmp_path / "m"), 10)
    listed = T.fit_listed(manifest, 2, 2, epochs=2, batch=10, test=points)
    assert np.array_equal(whole.last.params, listed.last.params) and whole.history == listed.history
    parts = [T.fit_listed(manifest, 2, 2, epochs=2, batch=10, test=points, state_dir=str(tmp_path / "s"), stop_after=n) for n in (2, None)]
    assert np.array_equal(parts[1].last.params, whole.last.params) and parts[0].rounds == 2
    with pytest.raises(ValueError):
        T.fit_listed(manifest.where("split < 2"), 2, 2, epochs=2, batch=10, test=points, state_dir=str(tmp_path / "s"))


def test_rows_of_one_entity(spark, tmp_path):
    path = str(tmp_path / "e")
    df = spark.range(300).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).cast("int").alias("user_id"), F.when(F.col("id") % 2 == 0, "train").otherwise("test").alias("split"),
        F.col("id").alias("n"),
    )
    W.write_entities(df, path, "user_id", 8, ["n"])
    folders = [p for p in (tmp_path / "e").glob("split=*/bucket=*")]
    assert len(folders) <= 16
    for user in (7, 8, 49, 1000):
        got = W.read_entity(spark, path, user, 8)
        assert rows(got, "user_id", "split", "n") == rows(df.where(F.col("user_id") == user))
        plan = got._jdf.queryExecution().toString()
        assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(user_id), EqualTo(user_id" in plan
    assert rows(W.read_entity(spark, path, 7, 8, split="test"), "n") == rows(df.where("user_id = 7 AND split = 'test'"), "n")
    assert W.read_entity(spark, path, None, 8).count() == 0


def vector_file(spark, path, text):
    path.write_text(text)
    return rows(corpus.read_word_vector_text(spark, str(path)))


def test_word_vector_files(spark, tmp_path):
    df = spark.createDataFrame([("great", [0.5, 1e-9]), ("日本", [-1.0, 2.0])], "token string, vector array<float>")
    corpus.write_word_vector_text(df, str(tmp_path / "v"))
    assert rows(corpus.read_word_vector_text(spark, str(tmp_path / "v"))) == rows(df)
    assert vector_file(spark, tmp_path / "a", "2 2\ngreat 0.5 1\n\nbad -1 2\n") == [("bad", [-1.0, 2.0]), ("great", [0.5, 1.0])]
    assert vector_file(spark, tmp_path / "b", "") == []
    for bad in ("a 1 2\nb 1\n", "a 1 2\nb 1 2 3\n", "a 1 2\nb 1 x\n", "a 1 2\nb 1 \n", "a 1 2\n 1 2\n"):
        with pytest.raises(Exception, match="no token with"):
            vector_file(spark, tmp_path / "c", bad)
    (tmp_path / "d").write_text("a|1|2\nb.c|3|4\n")
    assert rows(corpus.read_word_vector_text(spark, str(tmp_path / "d"), "|", 2)) == [("a", [1.0, 2.0]), ("b.c", [3.0, 4.0])]


def test_factor_files(spark, tmp_path):
    users = spark.createDataFrame([("u1", 0), ("u2", 1)], "user_id string, user_idx int")

    def read(text):
        (tmp_path / "f").write_text(text)
        return rows(catalogs.read_named_factors(spark, str(tmp_path / "f"), users, "user_id", "user_idx"))

    assert read("1,0.3,0.4\n0,0.1,0.2\n") == [("u1", [0.1, 0.2]), ("u2", [0.3, 0.4])]
    for text, why in (
        ("0,1,2\n0,3,4\n", "repeat"), ("0,1,2\n2,3,4\n", "run from 0 to 2"), ("0,1,2\n1,3\n", "1 to 2 values"), ("1,1,2\n2,1,2\n", "run from 1"),
        ("0,1,2\n", "1 factor lines for 2"), (",1,2\n", "."), ("0,1,\n1,1,2\n", "."),
    ):
        with pytest.raises(Exception, match=why):
            read(text)


def test_many_small_files_go_to_few_tasks(spark, tmp_path):
    for i in range(200):
        folder = tmp_path / "train" / ("pos" if i % 2 else "neg")
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{i}.txt").write_text(f"text {i}")
    assert corpus.read_reviews(spark, str(tmp_path), "train").rdd.getNumPartitions() <= 32
