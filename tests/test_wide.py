import numpy as np
import pytest

from basket_engine.operators import wide as B
from basket_engine.operators.training import Model, head_output

from .conftest import rows


def tables(spark, n_items, n_users, n_features=3, seed=1):
    rng = np.random.default_rng(seed)
    w, x = rng.normal(size=(n_items, n_features + 1)), rng.normal(size=(n_users, n_features))
    w[n_items // 2 :: 7] = w[0]  # some items score alike
    items = [(f"i{i:03d}", i, w[i, :-1].tolist(), float(w[i, -1])) for i in range(n_items)]
    users = [(f"u{u % 5}", u, x[u].tolist(), 1.5) for u in range(n_users)]
    weights = spark.createDataFrame(items, "item_id string, item_idx long, weights array<double>, bias double")
    return weights, spark.createDataFrame(users, "user_id string, n int, x array<double>, z double"), w, x


@pytest.mark.parametrize("head", ["softmax", "linear"])
@pytest.mark.parametrize("block_bytes", [1, 4 * 8 * 10, 1 << 20])
def test_scores_in_blocks_are_those_of_the_whole(either, head, block_bytes):
    weights, users, w, x = tables(either, 43, 30)
    expected = head_output(head, w, x)
    got = {(r["n"], r["item_id"]): r["score"] for r in B.score_wide(users, weights, 3, head, ["n"], block_bytes).collect()}
    assert len(got) == 43 * 30
    assert all(got[u, f"i{i:03d}"] == pytest.approx(expected[u, i], rel=1e-12) for u in range(30) for i in range(43))


@pytest.mark.parametrize("k, block_bytes", [(1, 1), (4, 4 * 8 * 10), (4, 1 << 20), (100, 4 * 8 * 10)])
def test_best_items(spark, k, block_bytes):
    weights, users, w, x = tables(spark, 43, 30)
    expected = head_output("softmax", w, x)
    z = x @ w[:, :-1].T + w[:, -1]
    got = {}
    for r in B.top_wide(users, weights, 3, k, keep=["n"], block_bytes=block_bytes).collect():
        got.setdefault(r["n"], {})[r["rank"]] = (r["item_id"], r["score"])
    for u in range(30):
        order = sorted(range(43), key=lambda i: (-z[u, i], i))[:k]
        assert [got[u][rank][0] for rank in range(1, len(order) + 1)] == [f"i{i:03d}" for i in order]
        assert [got[u][rank][1] for rank in range(1, len(order) + 1)] == pytest.approx([expected[u, i] for i in order])


def test_large_scores_do_not_overflow(spark):
    weights = spark.createDataFrame([("a", 0, [1000.0], 0.0), ("b", 1, [999.0], 0.0), ("c", 2, [-1000.0], 0.0)], "item_id string, item_idx long, weights array<double>, bias double")
    users = spark.createDataFrame([("u", [1.0]), ("v", [-1.0])], "user_id string, x array<double>")
    got = {(r["user_id"], r["item_id"]): r["score"] for r in B.score_wide(users, weights, 1, block_bytes=1).collect()}
    assert got["u", "a"] == pytest.approx(1 / (1 + np.exp(-1))) and got["u", "c"] == 0.0 and got["v", "c"] == 1.0


def test_equal_rows_and_rows_without_features(spark):
    weights, _, _, _ = tables(spark, 5, 1)
    users = spark.createDataFrame([("u", [0.0, 0.0, 1.0]), ("u", [0.0, 0.0, 1.0]), ("v", None), (None, [1.0, 0.0, 0.0])], "user_id string, x array<double>")
    got = B.score_wide(users, weights, 3, block_bytes=1)
    assert got.where("user_id = 'u'").count() == 10 and got.where("user_id IS NULL").count() == 5 and got.where("user_id = 'v'").count() == 0
    assert got.groupBy("user_id").sum("score").where("user_id = 'u'").first()[1] == pytest.approx(2.0)


def test_empty_tables(spark):
    weights, users, _, _ = tables(spark, 5, 3)
    assert B.score_wide(users.limit(0), weights, 3).count() == 0
    assert B.score_wide(users, weights.limit(0), 3).count() == 0
    assert B.top_wide(users, weights.limit(0), 3, 2).count() == 0


def test_wrong_widths(spark):
    weights, users, _, _ = tables(spark, 5, 3)
    with pytest.raises(Exception, match="weights"):
        B.score_wide(users, weights, 2).collect()
    short = spark.createDataFrame([("u", [1.0])], "user_id string, x array<double>")
    with pytest.raises(Exception, match="features"):
        B.score_wide(short, weights, 3).collect()
    with pytest.raises(ValueError):
        B.score_wide(users, weights, 3, head="tree")
    with pytest.raises(ValueError):
        B.top_wide(users, weights, 3, 0)


def test_blocks_hold_neighbours_of_bounded_size(spark):
    weights, _, w, _ = tables(spark, 43, 1)
    blocks = {r["block"]: r for r in B.weight_blocks(weights, 3, 4 * 8 * 10).collect()}
    assert [len(blocks[b]["items"]) for b in range(5)] == [10, 10, 10, 10, 3]
    assert blocks[4]["items"] == ["i040", "i041", "i042"] and blocks[4]["weights"] == w[40:].ravel().tolist()


def test_weight_rows_of_a_model(spark):
    items = spark.createDataFrame([("A", 0), ("B", 1), ("C", 2)], "item_id string, item_idx int")
    model = Model("softmax", 1, 2, np.array([1.0, 2.0, 3.0, 4.0]), np.zeros(4))
    assert rows(B.weight_rows(spark, model, items), "item_id", "weights", "bias") == [("A", [1.0], 2.0), ("B", [3.0], 4.0)]
