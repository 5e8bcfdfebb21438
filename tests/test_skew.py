import pytest
from pyspark.sql import Window, functions as F

from basket_engine.operators import indexing, skew

from .conftest import rows


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture
def facts(spark):
    data = [(i, "hot") for i in range(30)] + [(i, "cold") for i in range(30, 32)] + [(40, "other"), (50, None), (51, None)]
    return spark.createDataFrame(data, "id int, k string")


@pytest.fixture
def dims(spark):
    return spark.createDataFrame([("hot", 1), ("cold", 2), ("spare", 3)], "k string, d int")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("row_id", [None, ["id"]])
def test_join_equals_the_plain_join(skewed, facts, dims, how, row_id):
    want = facts.join(dims, ["k"], how)
    got = skew.join_skewed(facts, dims, ["k"], how, row_id=row_id)
    assert got.columns == want.columns
    assert rows(got) == rows(want)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_of_exact_copies(skewed, dims, how):
    copies = skewed.createDataFrame([("hot",)] * 40 + [("none",)] * 30 + [(None,)] * 3, "k string")
    assert rows(skew.join_skewed(copies, dims, ["k"], how)) == rows(copies.join(dims, ["k"], how))


def test_sliced_join_allows_several_right_rows_per_key(skewed, facts):
    many = skewed.createDataFrame([("hot", 1), ("hot", 2), ("cold", 3)], "k string, d int")
    assert rows(skew.join_skewed(facts, many, ["k"], row_id=["id"])) == rows(facts.join(many, ["k"]))


def test_two_key_join(skewed):
    left = skewed.createDataFrame([(i, i % 2, "a") for i in range(20)] + [(99, None, "a")], "id int, x int, y string")
    right = skewed.createDataFrame([(0, "a", 1.0), (1, "b", 2.0)], "x int, y string, v double")
    for how in ("inner", "left", "left_anti"):
        assert rows(skew.join_skewed(left, right, ["x", "y"], how, row_id=["id"])) == rows(left.join(right, ["x", "y"], how))


def test_hot_keys_are_few_and_sliced_in_proportion(skewed, facts):
    found = {r["k"]: r["_slices"] for r in skew.hot_keys(skew.key_counts(facts, ["k"]), ["k"]).collect()}
    assert "hot" in found and "other" not in found
    assert found["hot"] == 15  # 30 rows in slices of two


def test_hot_rows_are_spread_over_slices(skewed, facts, dims):
    assert "_slice" in plan(skew.join_skewed(facts, dims, ["k"], row_id=["id"]))


def test_no_hot_key_keeps_the_plain_join(spark, facts, dims):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "_slice" not in plan(skew.join_skewed(facts, dims, ["k"], row_id=["id"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_small_side_is_left_to_the_planner(spark, facts, dims, tmp_path):
    dims.write.parquet(str(tmp_path / "d"))
    dims = spark.read.parquet(str(tmp_path / "d"))
    assert "BroadcastHashJoin" in plan(skew.join_skewed(facts, dims, ["k"], row_id=["id"]))


def test_unknown_join_kind(spark, facts, dims):
    with pytest.raises(ValueError):
        skew.join_skewed(facts, dims, ["k"], "full")


def test_totals_equal_a_window(either, facts):
    totals = skew.attach_totals(facts, ["k"], [F.sum("id").alias("s")], row_id=["id"])
    want = facts.where("k is not null").withColumn("s", F.sum("id").over(Window.partitionBy("k")))
    assert rows(totals.where("k is not null"), "id", "k", "s") == rows(want, "id", "k", "s")
    assert totals.count() == facts.count()


def test_hot_group_is_nested_in_parts(skewed, facts):
    nested = skew.group_rows(facts, ["k"], row_id=["id"])
    parts = {r["k"]: r["n"] for r in nested.groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert parts["hot"] > 1 and parts["other"] == 1
    assert max(r["n_rows"] for r in nested.collect()) < 30


def test_global_index_is_dense_and_ordered(either):
    df = either.range(1000).select((F.col("id") * 7919 % 1009).alias("v")).repartition(5)
    got = indexing.global_index(df, ["v"]).orderBy("idx").collect()
    assert [r["idx"] for r in got] == list(range(1000))
    assert [r["v"] for r in got] == sorted(r["v"] for r in got)


def test_ordinal_in_group(either, facts):
    got = indexing.ordinal_in_group(facts.where("k is not null"), ["k"], ["id"])
    want = facts.where("k is not null").withColumn(
        "ordinal", F.row_number().over(Window.partitionBy("k").orderBy("id")) - 1
    )
    assert rows(got, "id", "k", "ordinal") == rows(want, "id", "k", "ordinal")


@pytest.mark.parametrize("n_splits", [1, 3, 7])
def test_balanced_split_sizes_and_seed(spark, n_splits):
    df = spark.range(100)
    first = rows(indexing.balanced_split(df, "id", n_splits, 1))
    assert first == rows(indexing.balanced_split(df.repartition(9), "id", n_splits, 1))
    sizes = [sum(1 for _, s in first if s == i) for i in range(n_splits)]
    assert sum(sizes) == 100 and max(sizes) - min(sizes) <= 1
    if n_splits > 1:
        assert first != rows(indexing.balanced_split(df, "id", n_splits, 2))


def test_fixed_batches(spark):
    got = indexing.fixed_batches(spark.range(10), ["id"], 4)
    assert rows(got, "id", "batch_id") == [(i, i // 4) for i in range(10)]


def test_scratch_paths_are_new_and_below_the_shared_folder(spark):
    from basket_engine import session

    root = session.scratch_root(spark)
    assert session.scratch_path(spark, "x").startswith(root)
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")


def test_stored_keeps_schema_and_rows(spark):
    from basket_engine.session import stored

    df = spark.createDataFrame([(1, ["a"], None)], "i int, a array<string>, n double")
    back = stored(df)
    assert back.schema == df.schema and rows(back) == rows(df)


def test_scratch_folder_choice_and_release(spark, monkeypatch, tmp_path):
    from basket_engine import session

    monkeypatch.setattr(session, "configured_root", lambda _: str(tmp_path) + "/")
    back = session.stored(spark.range(3))
    assert back.count() == 3 and len(list(tmp_path.iterdir())) == 1
    session.release_scratch(spark)
    assert list(tmp_path.iterdir()) == []
    monkeypatch.setattr(session, "configured_root", lambda _: None)
    assert session.scratch_root(spark) == session.scratch_root(spark)

    class Remote:
        class sparkContext:
            master = "yarn"

    with pytest.raises(RuntimeError):
        session.scratch_root(Remote)
