import numpy as np
import pytest
from pyspark.sql import functions as F

from basket_engine.operators import text as X, training as T
from basket_engine.plans.sentiment import fit_sentiment, review_batches, review_examples

from .conftest import rows


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(
        [(1, 0, "Great film!!"), (2, 1, "bad 12"), (3, 1, "xyz"), (4, 0, "film\tFILM  (great)\n3 bad; film"), (5, 0, "great")],
        "doc_id long, label int, text string",
    )


@pytest.fixture
def vectors(spark):
    return spark.createDataFrame(
        [("great", [1.0, 0.0]), ("film", [0.0, 1.0]), ("bad", [-1.0, 0.0])], "token string, vector array<float>"
    )


def test_tokens(docs):
    got = rows(X.tokenize(docs.where("doc_id in (1, 2, 4)")))
    assert got == [(1, 0, "great"), (1, 1, "film"), (2, 0, "bad"), (4, 0, "film"), (4, 1, "film"), (4, 2, "great"),
                   (4, 3, "bad"), (4, 4, "film")]


def test_sequences(either, docs, vectors):
    got = X.text_sequences(docs, vectors, 100)
    assert rows(got, "doc_id", "tokens", "label_pos") == [
        (1, ["great", "film"], 1), (2, ["bad"], 0), (4, ["film", "film", "great", "bad", "film"], 4), (5, ["great"], 0),
    ]
    assert X.empty_documents(docs, got).first()["n_empty"] == 1


def test_small_vocabularies_and_vectors_are_looked_up_in_place(spark, docs, vectors, tmp_path):
    more = vectors.unionAll(spark.createDataFrame([("bad", [5.0, 5.0]), (None, [1.0, 1.0]), ("gone", None)], vectors.schema))
    twice = docs.unionAll(spark.createDataFrame([(4, 0, "bad gone"), (9, 0, None)], docs.schema))
    more.write.parquet(str(tmp_path / "v"))
    small = spark.read.parquet(str(tmp_path / "v"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    sequences, joined = X.text_sequences(twice, small, 4), X.text_sequences(twice, more, 4)
    assert "Join" not in plan(sequences) and plan(sequences).count("Exchange") == 1 and "Join" in plan(joined)
    # the repeated document has ties in its positions, which both order by token only here
    assert rows(sequences.where("doc_id <> 4")) == rows(joined.where("doc_id <> 4"))
    vectors_of = X.embed_tokens(sequences, small)
    assert "Join" not in plan(vectors_of) and plan(vectors_of).count("Exchange") == 1  # no vector is shuffled
    assert rows(vectors_of) == rows(X.embed_tokens(sequences, more))


def test_truncation_counts_known_tokens_only(either, docs, vectors):
    got = X.text_sequences(docs.where("doc_id in (1, 2)"), vectors, 1)
    assert rows(got, "doc_id", "tokens", "label_pos") == [(1, ["great"], 0), (2, ["bad"], 0)]


def test_embedding_keeps_the_order(either, docs, vectors):
    got = X.embed_tokens(X.text_sequences(docs.where("doc_id = 4"), vectors, 3), vectors).first()
    assert got["x"] == [[0.0, 1.0], [0.0, 1.0], [1.0, 0.0]]


@pytest.mark.parametrize(
    "labels, order", [([0, 1, 0, 1], [0, 1, 2, 3]), ([0, 0, 0, 1], [0, 2, 1, 3]), ([1, 1, 0], [1, 2, 0]), ([1, 1], [0, 1])]
)
def test_balanced_order(spark, labels, order):
    df = spark.createDataFrame(list(enumerate(labels)), "doc_id long, label int")
    got = {r["doc_id"]: r["position"] for r in X.balanced_order(df).collect()}
    if labels == [0, 0, 0, 1]:
        assert sorted(got.values()) == [0, 1, 2, 3] and got[3] == 1
    else:
        assert [got[i] for i in range(len(labels))] == order


def test_batches_and_masks(either, docs, vectors):
    got = {r["doc_id"]: r for r in review_batches(docs, vectors, batch_size=2, max_len=3).collect()}
    assert sorted(got) == [1, 2, 4, 5]
    assert got[1]["batch_id"] == got[2]["batch_id"] == 0
    assert got[1]["x_mask"] == [1.0, 1.0] and got[1]["y_mask"] == [0.0, 1.0]
    assert got[2]["x_mask"] == [1.0, 0.0] and got[2]["y_mask"] == [1.0, 0.0]
    assert got[4]["width"] == 3 and got[5]["x_mask"] == [1.0, 0.0, 0.0]


def test_review_examples_average_the_words(either, docs, vectors):
    batches = review_batches(docs, vectors, batch_size=2)
    got = {r["doc_id"]: (r["x"], r["y"]) for r in review_examples(batches, vectors, 2).collect()}
    assert got[1] == ([0.5, 0.5], [1.0, 0.0]) and got[2] == ([-1.0, 0.0], [0.0, 1.0])
    assert got[4] == (pytest.approx([0.0, 0.6]), [1.0, 0.0])


def test_masks_tell_which_words_and_outputs_count(spark, docs, vectors):
    batches = review_batches(docs, vectors, batch_size=2)
    first = F.transform("x_mask", lambda v, i: F.when(i < 1, v).otherwise(0.0))
    none = F.transform("y_mask", lambda v: v * 0)
    got = {r["doc_id"]: (r["x"], r["y"]) for r in review_examples(batches.withColumn("x_mask", first).withColumn("y_mask", none), vectors, 2).collect()}
    assert got == {1: ([1.0, 0.0], None), 2: ([-1.0, 0.0], None), 4: ([0.0, 1.0], None), 5: ([1.0, 0.0], None)}


def test_the_fit_takes_the_balanced_batches(spark, vectors):
    """One worker descends over the batches one after the other, as they were put together."""
    words = [("great", 0), ("bad", 1), ("film", 0), ("great bad", 1), ("bad film", 0)]
    data = [(i, k, f"{w} film") for i in range(9) for w, k in [words[i % 5]]]
    docs = spark.createDataFrame(data, "doc_id long, label int, text string")
    batches = review_batches(docs, vectors, batch_size=2)
    examples = review_examples(batches, vectors, 2)
    inorder = sorted(examples.collect(), key=lambda r: r["position"])
    assert [r["batch_id"] for r in inorder] == [0, 0, 1, 1, 2, 2, 3, 3, 4] and [r["y"][0] for r in inorder[:6]] == [1.0, 0.0] * 3
    parts = [tuple(np.array([r[c] for r in inorder[i : i + 2]]) for c in "xy") for i in range(0, 9, 2)]
    expected = T._descend("softmax", np.zeros((2, 3)), np.zeros((2, 3)), iter(parts), 0.05, 1e-5, 0.95)[0]
    result = fit_sentiment(examples, 2, batch=2, workers=1, learning_rate=0.05)
    assert result.last.params == pytest.approx(expected.ravel(), abs=1e-12)
    with pytest.raises(ValueError, match="batch_id"):
        fit_sentiment(examples, 2, batch=3, workers=1)
