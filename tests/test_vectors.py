import pytest

from basket_engine.operators import vectors as V
from basket_engine.plans.featurize import training_rows

from .conftest import rows

K = 2


@pytest.fixture
def tx(spark):
    return spark.createDataFrame(
        [("u1", "A", 0, 201605, 1, 10.0), ("u1", "B", 1, 201605, 2, 30.0), ("u1", "A", 0, 201606, 3, 5.0), ("u2", "B", 1, 201605, 4, 8.0)],
        "user_id string, item_id string, item_idx int, year_month int, line_key int, v double",
    )


@pytest.fixture
def items(spark):
    return spark.createDataFrame([("A", [1.0, 2.0]), ("B", [3.0, 4.0])], "item_id string, factors array<double>")


@pytest.fixture
def users(spark):
    return spark.createDataFrame([("u1", [0.1, 0.2]), ("u2", [0.3, 0.4])], "user_id string, factors array<double>")


def by_key(df):
    return {(r["user_id"], r["year_month"]): r["features"] for r in df.collect()}


def test_packed_with_nets_per_slot(either, tx, items):
    got = by_key(V.packed_vectors(tx, items, K, "v", max_basket=3))
    assert got[("u1", 201605)] == [1, 2, 3, 4, 0, 0] + [0.25 / 2, 0.75 / 2, 0]
    assert got[("u1", 201606)] == [1, 2, 0, 0, 0, 0] + [1, 0, 0]
    assert got[("u2", 201605)] == [3, 4, 0, 0, 0, 0] + [1, 0, 0]


def test_packed_with_user_and_mean_net(either, tx, items, users):
    got = by_key(V.packed_vectors(tx, items, K, "v", users, max_basket=3))
    assert got[("u1", 201605)] == [0.1, 0.2, 1, 2, 3, 4, 0, 0, 0.5]
    assert got[("u1", 201606)] == [0.1, 0.2, 1, 2, 0, 0, 0, 0, 1.0]
    assert got[("u2", 201605)] == [0.3, 0.4, 3, 4, 0, 0, 0, 0, 1.0]


def test_overflow(either, tx, items):
    with pytest.raises(Exception, match="basket above 1 rows"):
        V.packed_vectors(tx, items, K, "v", max_basket=1).collect()
    cut = V.packed_vectors(tx, items, K, "v", max_basket=1, on_overflow="truncate")
    assert by_key(cut)[("u1", 201605)] == [1, 2, 0.125]
    labels = {(r["user_id"], r["year_month"]): (r["label_idx"], r["basket_size"]) for r in cut.collect()}
    assert labels[("u1", 201605)] == ([0, 1], 2)


def test_arguments_and_missing_factors(tx, items):
    with pytest.raises(ValueError):
        V.packed_vectors(tx, items, K, "v", on_overflow="drop")
    with pytest.raises(ValueError):
        V.packed_vectors(tx, items, K, "v", max_basket=5000)
    with pytest.raises(Exception, match="no factors for item"):
        V.packed_vectors(tx, items.where("item_id = 'A'"), K, "v").collect()


def test_baskets_are_cut_before_the_shuffle(tx, items):
    plan = V.packed_vectors(tx, items, K, "v", max_basket=3)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2  # partial and final
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_duplicate_items_keep_their_positions(either, tx, items):
    doubled = tx.unionAll(tx.where("line_key = 1").selectExpr("user_id", "item_id", "item_idx", "year_month", "9", "v"))
    got = rows(V.basket_position(doubled, order=("item_idx", "line_key")), "line_key", "position")
    assert got == [(1, 0), (2, 2), (3, 0), (4, 0), (9, 1)]


def test_slot_layout(either, tx, items, users):
    got = V.slot_vectors(tx.where("user_id = 'u2'"), items, users, 2, K, row_id=["line_key"]).first()["features"]
    assert got == [0.3, 0.4, 0, 0, 3, 4]


def test_slot_vector_with_item_values(either, tx, items, users):
    long = tx.selectExpr("user_id", "item_id", "year_month", "line_key", "'v' AS variable", "v AS share")
    values = V.item_values(long)
    flat = sorted((r["user_id"], r["item_id"], v) for r in values.collect() for v in r["values"])
    assert flat == [("u1", "A", 5.0), ("u1", "A", 10.0), ("u1", "B", 30.0), ("u2", "B", 8.0)]
    base = V.slot_vectors(tx.where("user_id = 'u2'"), items, users, 2, K, row_id=["line_key"])
    assert V.append_values(base, values).first()["features"] == [0.3, 0.4, 0, 0, 3, 4, 8.0]


def test_training_rows_pipeline(either, tx, items):
    pairs = either.createDataFrame([("u1", "A"), ("u1", "B"), ("u2", "B")], "user_id string, item_id string")
    corr = either.createDataFrame([("u1", "A", 2.0)], "user_id string, item_id string, score double")
    raw = tx.drop("item_idx")
    out, dictionary = training_rows(raw, pairs, items, K, "v", max_basket=3, cutoff=201606)
    assert rows(dictionary, "item_id", "item_idx") == [("A", 0), ("B", 1)]
    assert rows(out, "user_id", "year_month", "split") == [
        ("u1", 201605, "train"), ("u1", 201606, "test"), ("u2", 201605, "train"),
    ]
    only, _ = training_rows(raw, pairs, items, K, "v", correlations=corr, max_basket=3)
    assert {r["user_id"] for r in only.collect()} == {"u1"}


def test_user_factors_are_joined_without_counting_vectors(spark, either, tx, items, users, monkeypatch):
    """Purchases are read once, and a user's rows are counted on the stored baskets."""
    labels = []
    monkeypatch.setattr(V, "stored", lambda df, label, keep=V.stored: labels.append(label) or keep(df, label))
    counted = []
    monkeypatch.setattr(V, "key_counts", lambda df, keys, count=V.key_counts: counted.append((df.columns, keys)) or count(df, keys))
    out = V.packed_vectors(tx, items, K, "v", users, max_basket=3)
    assert out.count() == 3 and labels == ["purchases", "baskets"]
    assert counted[-1][1] == ["user_id"] and "_slots" not in counted[-1][0]


def test_item_values_of_arrays(spark):
    """A row with an array of values gives what a row for each value does."""
    long = spark.createDataFrame(
        [("u", "A", 1, line, name, line + x) for line in (2, 1, 3) for name, x in (("a", 0.25), ("b", 0.5))],
        "user_id string, item_id string, year_month int, line_key int, variable string, share double",
    )
    wide = spark.createDataFrame(
        [("u", "A", 1, line, [line + 0.25, line + 0.5]) for line in (2, 1, 3)],
        "user_id string, item_id string, year_month int, line_key int, share array<double>",
    )
    a = V.item_values(long).collect()
    b = V.item_values(wide, order=("year_month", "line_key")).collect()
    assert a == b and b[0]["values"] == [1.25, 1.5, 2.25, 2.5, 3.25, 3.5]
