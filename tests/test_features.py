import math

import pytest
from pyspark.sql import functions as F

from basket_engine.functions.scalars import log_odds, month_axis, month_position, split_by_month
from basket_engine.operators import dictionary as D, features as X
from basket_engine.plans.featurize import basket_features

from .conftest import rows

SCHEMA = "line int, user_id string, item_id string, v2 double, v3 double, v4 double, year_month int"


@pytest.fixture
def tx(spark):
    return spark.createDataFrame(
        [
            (1, "u1", "A", 2.0, 10.0, 0.0, 201605),
            (2, "u1", "B", 3.0, 30.0, 0.0, 201605),
            (3, "u1", "A", 2.0, 5.0, None, 201606),
            (4, "u2", "B", None, 8.0, 4.0, 201605),
            (5, None, "A", 2.0, 1.0, 1.0, 201605),
            (6, "u3", "C", 2.0, 1.0, 1.0, 201605),
        ],
        SCHEMA,
    )


@pytest.fixture
def pairs(spark):
    return spark.createDataFrame([("u1", "A"), ("u2", "B")], "user_id string, item_id string")


@pytest.fixture
def known(tx, pairs):
    return X.membership(X.impute(X.drop_missing(tx), ["v2", "v3", "v4"]), pairs, row_id=["line"])


@pytest.mark.parametrize("row_id", [None, ["line"]])
def test_basket_shares_of_the_pipeline(either, tx, pairs, row_id):
    out = basket_features(tx, pairs, "v2", ["v3", "v4"], row_id=row_id)
    got = {r["line"]: (r["share_v2"], r["share_v3"], r["share_v4"]) for r in out.collect()}
    assert set(got) == {1, 2, 3, 4}
    assert got[1] == (pytest.approx(2 / 3), 0.25, None)
    assert got[2] == (pytest.approx(1 / 3), 0.75, None)
    assert got[3] == (1.0, 1.0, -1.0)
    assert got[4] == (1.0, 1.0, 1.0)


def test_risk_frequencies(either, known):
    assert rows(X.value_frequency(known, "v2")) == [(-1.0, 1), (2.0, 2), (3.0, 1)]


def test_frequencies_counted_elsewhere_default_to_zero(either, known):
    encoded = X.frequency_encode(known, "v2", "f", counted=known.where("v2 = 2"), row_id=["line"])
    assert rows(encoded, "line", "f") == [(1, 2.0), (2, 0.0), (3, 2.0), (4, 0.0)]


def test_smoothed_share_is_long(either, known):
    out = X.smoothed_share(known, ["v3"], row_id=["line"])
    got = {r["line"]: r["share"] for r in out.where("variable = 'v3'").collect()}
    want = {1: 10 / 40.0001, 2: 30 / 40.0001, 3: 5 / 5.0001, 4: 8 / 8.0001}
    assert got == pytest.approx(want)


def test_shares_sum_to_one_and_ignore_partitioning(either):
    df = either.range(500).select("id", (F.col("id") % 7).alias("user_id"), (F.rand(1) + 0.1).alias("x"), F.lit(1).alias("year_month"))
    df = either.createDataFrame(df.collect(), df.schema)
    out = X.basket_share(df, ["x"], row_id=["id"])
    for r in out.groupBy("user_id").agg(F.sum("share_x").alias("s")).collect():
        assert r["s"] == pytest.approx(1.0)
    again = X.basket_share(df.repartition(13), ["x"], row_id=["id"])
    a, b = (dict(rows(o, "id", "share_x")) for o in (out, again))
    assert a == pytest.approx(b)


def test_net_mean(known):
    got = {(r["user_id"], r["year_month"]): (r["net"], r["basket_size"]) for r in X.net_mean(known, "v3").collect()}
    assert got[("u1", 201605)] == (0.5, 2) and got[("u2", 201605)] == (1.0, 1)


@pytest.mark.parametrize("x, want", [(2.0, math.log(2)), (3.0, math.log(1.5)), (0.5, None), (1.0, None), (None, None)])
def test_log_odds(spark, x, want):
    got = spark.createDataFrame([(x,)], "x double").select(log_odds(F.col("x"))).first()[0]
    assert got is None if want is None else got == pytest.approx(want)


def test_logit(spark):
    df = spark.createDataFrame([(0.75,), (1.0,), (2.0,)], "x double")
    got = [r[0] for r in df.select(log_odds(F.col("x"), "logit")).collect()]
    assert got == [pytest.approx(math.log(3)), None, None]
    with pytest.raises(ValueError):
        log_odds(F.col("x"), "other")


def test_softmax(either):
    df = either.createDataFrame(
        [("u1", math.log(2)), ("u1", math.log(1.5)), ("u2", None), ("u3", 1000.0), ("u3", 1001.0), ("u3", -1000.0)],
        "user_id string, s double",
    )
    out = X.group_softmax(df, "user_id", "s", row_id=["user_id", "s"]).collect()
    got = {(r["user_id"], r["s"]): r["softmax"] for r in out}
    assert got[("u1", math.log(2))] == pytest.approx(2 / 3.5)
    assert got[("u1", math.log(1.5))] == pytest.approx(1.5 / 3.5)
    assert got[("u2", None)] is None
    e = math.exp(-1)
    assert got[("u3", 1001.0)] == pytest.approx(1 / (1 + e)) and got[("u3", 1000.0)] == pytest.approx(e / (1 + e))
    assert got[("u3", -1000.0)] == 0.0


def test_dictionary_and_lookup(either, known):
    items = D.dictionary(known, "item_id")
    assert rows(items, "item_id", "item_idx") == [("A", 0), ("B", 1)]
    other = either.createDataFrame([("B",), ("Z",), (None,)], "item_id string")
    assert rows(D.with_index(other, items, "item_id"), "item_id", "item_idx") == [("B", 1), ("Z", -1), (None, -1)]


def test_labels(either, known):
    items = D.dictionary(known, "item_id")
    coded = D.with_index(known, items, "item_id", row_id=["line"])
    monthly = D.dense_label(D.label_indices(coded, ["user_id", "year_month"]), 2)
    assert rows(monthly, "user_id", "year_month", "label") == [
        ("u1", 201605, [1.0, 1.0]), ("u1", 201606, [1.0, 0.0]), ("u2", 201605, [0.0, 1.0]),
    ]
    overall = D.dense_label(D.label_indices(coded, ["user_id"]), 2)
    assert rows(overall, "user_id", "label") == [("u1", [1.0, 1.0]), ("u2", [0.0, 1.0])]
    running = D.running_label_indices(coded)
    assert rows(running, "user_id", "year_month", "label_idx") == [
        ("u1", 201605, [0, 1]), ("u1", 201606, [0, 1]), ("u2", 201605, [1]),
    ]


@pytest.mark.parametrize("indices, want", [([], [0, 0, 0, 0]), ([0], [1, 0, 0, 0]), ([1, 3], [0, 1, 0, 1]), ([0, 1, 2, 3], [1] * 4)])
def test_multi_hot(spark, indices, want):
    df = spark.createDataFrame([(indices,)], "label_idx array<int>")
    assert D.dense_label(df, 4).first()["label"] == want


def test_months(spark):
    assert month_axis(201611, 201702) == [201611, 201612, 201701, 201702]
    with pytest.raises(ValueError):
        month_axis(201702, 201611)
    with pytest.raises(ValueError):
        month_axis(201613, 201702)
    df = spark.createDataFrame([(201611,), (201702,), (201510,)], "m int")
    assert [r[0] for r in df.select(month_position(F.col("m"), 201611)).collect()] == [0, 3, -13]
    split = df.select(split_by_month(F.col("m"), 201702))
    assert [r[0] for r in split.collect()] == ["train", "test", "train"]
