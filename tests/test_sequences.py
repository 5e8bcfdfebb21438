import pytest
from pyspark.sql import functions as F

from basket_engine.functions import arrays as A
from basket_engine.operators import sequences as Q

from .conftest import rows

SCHEMA = "user_id string, year_month int, features array<double>, label array<double>"


def masks(spark, months, start=201605, end=201608, policy="last"):
    df = spark.createDataFrame([("u", m, [float(m % 100)], [1.0]) for m in months], SCHEMA)
    seq = Q.month_sequences(df, 1, 1, start, end, policy).first()
    return [s["x_mask"] for s in seq["steps"]], [s["y_mask"] for s in seq["steps"]], [s["x"][0] for s in seq["steps"]]


@pytest.mark.parametrize(
    "months, policy, x_mask, y_mask",
    [
        ([201605, 201608], "last", [1, 0, 0, 1], [0, 0, 0, 1]),
        ([201606], "last", [0, 1, 0, 0], [0, 1, 0, 0]),
        ([201605, 201609], "last", [1, 0, 0, 1], [0, 0, 0, 0]),
        ([201605, 201609], "drop", [1, 0, 0, 0], [0, 0, 0, 0]),
    ],
)
def test_masks(spark, months, policy, x_mask, y_mask):
    assert masks(spark, months, policy=policy)[:2] == (x_mask, y_mask)


def test_axis_crosses_the_year(spark):
    x_mask, y_mask, _ = masks(spark, [201612, 201702], 201611, 201702)
    assert x_mask == [0, 1, 0, 1] and y_mask == [0, 0, 0, 1]


def test_filled_last_step_is_not_taken_over(spark):
    x_mask, y_mask, x = masks(spark, [201604, 201608, 201609])
    assert x_mask == [0, 0, 0, 1] and y_mask == [0, 0, 0, 1] and x == [0, 0, 0, 8]
    assert masks(spark, [201604, 201609])[2] == [0, 0, 0, 4]


def test_flattened_sequence_and_nan(either):
    df = either.createDataFrame(
        [("u1", 201605, [1.0, float("nan")], [0.0]), ("u1", 201606, [2.0, 3.0], [1.0]), ("u2", 201605, [4.0, 5.0], [1.0]),
         ("u2", 201604, [9.0, 9.0], [1.0])],
        SCHEMA,
    )
    flat = Q.flatten_sequences(Q.month_sequences(df, 2, 1, 201605, 201606, "drop"))
    assert rows(flat) == [("u1", [1.0, 0.0, 2.0, 3.0], [1.0]), ("u2", [4.0, 5.0, 0.0, 0.0], None)]


def test_sequences_reject_bad_arguments(spark):
    df = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError):
        Q.month_sequences(df, 1, 1, off_axis="first")
    with pytest.raises(ValueError):
        Q.month_sequences(df, 1, 1, 201608, 201605)


def churn(spark, n):
    return spark.createDataFrame([("u", 201500 + i, [float(i)], float(i)) for i in range(1, n + 1)],
                                 "user_id string, year_month int, features array<double>, label double")


def test_recent_matrix_keeps_the_newest_rows_last(either):
    got = Q.recent_matrix(churn(either, 18), 1, 16).first()
    assert [x[0] for x in got["features"]] == [float(i) for i in range(3, 19)]
    assert got["labels"][-1] == 18.0 and got["n_rows"] == 16
    one = Q.recent_matrix(churn(either, 18), 1, 1).first()
    assert one["features"] == [[18.0]]


def test_recent_matrix_pads_the_old_end(spark):
    got = Q.recent_matrix(churn(spark, 2), 1, 4).first()
    assert got["features"] == [[0.0], [0.0], [1.0], [2.0]] and got["labels"] == [0, 0, 1.0, 2.0]


def test_recent_rows_are_cut_before_the_shuffle(spark):
    plan = Q.recent_rows(churn(spark, 3), 2)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_subtract_keeps_duplicates_and_compares_nulls(either):
    left = either.createDataFrame([("a", 1), ("a", 1), ("b", None), ("c", 3), (None, 3)] + [("d", 4)] * 9, "k string, v int")
    right = either.createDataFrame([("b", None), ("c", 3), ("x", 9), ("c", 3)], "k string, v int")
    assert rows(Q.subtract_rows(left, right)) == sorted([("a", 1)] * 2 + [("d", 4)] * 9 + [(None, 3)], key=repr)


def test_subtract_does_not_confuse_null_with_text(spark):
    left = spark.createDataFrame([("null",), (None,), ("",)], "k string")
    right = spark.createDataFrame([(None,)], "k string")
    assert rows(Q.subtract_rows(left, right)) == [("",), ("null",)]


def test_exclude_target_and_lead(either):
    df = churn(either, 3)
    gone = either.createDataFrame([("u",), ("u",)], "user_id string")
    assert Q.exclude_users(df, gone).count() == 0
    train, predict = Q.target_split(df, 201503)
    assert train.count() == 2 and "label" not in predict.columns and predict.count() == 1
    assert rows(Q.next_target(df), "year_month", "target") == [(201501, 2.0), (201502, 3.0), (201503, None)]


def test_record_steps_and_labels(spark):
    df = spark.createDataFrame([([1.0, 2.0, float("nan"), 4.0, 5.0, 6.0],), ([1.0],)], "v array<double>")
    got = [r[0] for r in df.select(A.record_steps(F.col("v"), 2, 1)).collect()]
    assert [(s["features"], s["label"]) for s in got[0]] == [([1.0, 2.0], [0.0]), ([4.0, 5.0], [6.0])] and got[1] == []
    pair = df.select(A.features_and_labels(F.col("v"), 3, 2).alias("p")).first()["p"]
    assert pair["features"][:2] == [1.0, 2.0] and pair["label"] == [4.0, 5.0]
    short = spark.createDataFrame([([7.0, 8.0],)], "v array<double>").select(A.features_and_labels(F.col("v"), 71, 1)).first()[0]
    assert short["features"] == [7.0] and short["label"] == [8.0]


def test_zipped_stops_at_the_shorter(spark):
    df = spark.createDataFrame([(["A", "B", "C"], [0.1, 0.2])], "i array<string>, s array<double>")
    got = df.select(A.zipped(F.col("i"), F.col("s"))).first()[0]
    assert [tuple(r) for r in got] == [("A", 0.1), ("B", 0.2)]
