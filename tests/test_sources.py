import pytest
from pyspark.sql import functions as F

from basket_engine.sinks import tables as W
from basket_engine.sources import catalogs, corpus, delimited, examples

from .conftest import rows


def text(spark, lines):
    return spark.createDataFrame([(line,) for line in lines], "value string")


@pytest.mark.parametrize(
    "line, want", [("a,b,,", ["a", "b", "", ""]), ("", [""]), ("a", ["a"]), (",", ["", ""])]
)
def test_fields_keep_every_separator(spark, line, want):
    assert text(spark, [line]).select(delimited.fields(F.col("value"))).first()[0] == want


def test_separator_is_taken_literally(spark):
    assert text(spark, ["a|b|"]).select(delimited.fields(F.col("value"), "|")).first()[0] == ["a", "b", ""]


def test_transactions_are_typed_and_missing_text_is_null(spark, tmp_path):
    ones = ",".join(["1"] * 8)
    (tmp_path / "tx").write_text(f"u1,A,2,10,0,{ones},201605\nNULL,A,2,1,1,{ones},201605\nu1,A,2,5,NULL,{ones},201606\n")
    df = catalogs.read_transactions(spark, str(tmp_path / "tx"))
    assert rows(df, "user_id", "v4", "v12", "year_month") == [
        ("u1", 0.0, 1.0, 201605), ("u1", None, 1.0, 201606), (None, 1.0, 1.0, 201605),
    ]


def test_short_and_malformed_lines(spark):
    schema = delimited.TRANSACTION_SCHEMA
    lines = text(spark, ["u1,A,x"])
    got = delimited.parse_lines(lines, schema).first()
    assert got["user_id"] == "u1" and got["v2"] is None and got["year_month"] is None
    with pytest.raises(Exception):
        delimited.parse_lines(lines, schema, strict=True).collect()


@pytest.fixture
def dated(tmp_path):
    for name in ("20160501", "20160601", "tmp"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part").write_text(f"{name},A\n")
    return str(tmp_path)


def test_date_range_and_latest_directories(spark, dated):
    schema = delimited.PAIR_SCHEMA
    assert rows(delimited.read_date_range(spark, dated, 20160515, 20160630, schema)) == [("20160601", "A")]
    assert rows(delimited.read_date_range(spark, dated, 20160501, 20160601, schema), "user_id") == [
        ("20160501",), ("20160601",),
    ]
    none = delimited.read_date_range(spark, dated, 1, 2, schema)
    assert none.count() == 0 and none.schema == schema
    assert rows(delimited.read_latest(spark, dated, schema), "user_id") == [("20160601",)]


def test_partition_filters_prune(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(40).withColumn("day", (F.col("id") % 4).cast("int")).write.partitionBy("day").parquet(path)
    table = spark.read.parquet(path)
    ranged = delimited.partition_range(table, "day", 1, 2)
    assert ranged.count() == 20
    assert "PartitionFilters: [isnotnull(day" in ranged._jdf.queryExecution().toString()
    assert {r["day"] for r in delimited.latest_partition(table, "day").collect()} == {3}


def test_keyed_table(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "x string, y int")
    assert rows(delimited.keyed_table(df, ["x", "y"]), "key") == [("a,1",), ("b,2",)]


def test_grouped_table_nests_all_rows(either):
    df = either.createDataFrame([("a", i) for i in range(9)] + [("b", 1)], "k string, v int")
    nested = delimited.grouped_table(df, "k", row_id=["v"])
    flat = nested.select("k", F.inline("rows"))
    assert rows(flat, "k", "v") == rows(df)
    assert rows(nested.groupBy("k").agg(F.sum("n_rows"))) == [("a", 9), ("b", 1)]


def test_grouped_table_counts_copies(either):
    df = either.createDataFrame([("a", 1)] * 9 + [("a", 2)], "k string, v int")
    nested = delimited.grouped_table(df, "k")
    assert rows(nested.select("k", F.inline("rows"))) == [("a", 1, 9), ("a", 2, 1)]


def test_catalog_lines(spark):
    corr = catalogs.parse_correlations(text(spark, ["(u1,A,x,2", "(u2,B,x,0.5", "(u2,A,x,1"]))
    got = {(r["user_id"], r["item_id"]): r["log_odds"] for r in corr.collect()}
    assert got[("u1", "A")] == pytest.approx(0.6931471805599453)
    assert got[("u2", "B")] is None and got[("u2", "A")] is None
    scored = catalogs.parse_scored(text(spark, ["(u1,(A,0.6))", "(u1,(,0.4))"]))
    assert rows(scored) == [("u1", "A", 0.6)]
    factors = catalogs.parse_factors(text(spark, ["0,0.1,0.2", "1,0.3,0.4"]))
    assert rows(factors) == [(0, [0.1, 0.2]), (1, [0.3, 0.4])]
    users = spark.createDataFrame([("u1", 0), ("u2", 1)], "user_id string, user_idx int")
    assert rows(catalogs.name_factors(factors, users, "user_id", "user_idx")) == [("u1", [0.1, 0.2]), ("u2", [0.3, 0.4])]


def test_example_files_carry_user_and_month_in_their_name(spark, tmp_path):
    folder = tmp_path / "train" / "deep"
    folder.mkdir(parents=True)
    (folder / "u_1_201605").write_text('1.0,"2.0",NaN,1\n')
    got = examples.import_example_files(spark, str(tmp_path), "train", 3, 1)
    assert rows(got) == [("train", "u_1", 201605, [1.0, 2.0, 0.0], [1.0])]
    with pytest.raises(ValueError):
        examples.import_example_files(spark, str(tmp_path), "other", 3, 1)


def test_examples_survive_parquet_and_text(spark, tmp_path):
    df = spark.createDataFrame(
        [("train", "u1", 201605, [1.0, 2.5], [1.0]), ("test", "u2", 201609, [0.0, 1e-9], [0.0])],
        "split string, user_id string, year_month int, features array<double>, label array<double>",
    )
    W.write_examples(df, str(tmp_path / "p"))
    assert rows(examples.read_examples(spark, str(tmp_path / "p"), "train"), *df.columns) == rows(df.where("split = 'train'"))
    assert (tmp_path / "p" / "split=train" / "year_month=201605").is_dir()
    W.write_example_text(df, str(tmp_path / "t"))
    back = examples.import_example_lines(spark.read.text(str(tmp_path / "t")).select("value"), 2, 1)
    assert rows(back, *df.columns) == rows(df)


def test_scored_text_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("u1", "A", 0.25)], "user_id string, item_id string, score double")
    W.write_scored_text(df, str(tmp_path / "s"))
    assert rows(catalogs.read_scored(spark, str(tmp_path / "s"))) == [("u1", "A", 0.25)]
    W.write_table(df, str(tmp_path / "c"), "csv")
    assert spark.read.csv(str(tmp_path / "c")).count() == 1
    with pytest.raises(ValueError):
        W.write_table(df, str(tmp_path / "d"), "xml")


def test_write_split(spark, tmp_path):
    df = spark.createDataFrame([("train", "u1"), ("test", "u1")], "split string, user_id string")
    W.write_split(df, str(tmp_path / "s"))
    assert sorted(p.name for p in (tmp_path / "s").iterdir() if p.is_dir()) == ["split=test", "split=train"]


def test_reviews_and_word_vectors(spark, tmp_path):
    for name, body in (("pos", "Great\nfilm!!"), ("neg", "bad 12")):
        folder = tmp_path / "train" / name
        folder.mkdir(parents=True)
        (folder / "0_1.txt").write_text(body)
    got = corpus.read_reviews(spark, str(tmp_path), "train")
    assert rows(got, "label_name", "label", "text") == [("negative", 1, "bad 12"), ("positive", 0, "Great\nfilm!!")]
    (tmp_path / "vec.txt").write_text("2 2\ngreat 0.5 1\nbad -1 2\n")
    vectors = corpus.read_word_vector_text(spark, str(tmp_path / "vec.txt"))
    assert rows(vectors) == [("bad", [-1.0, 2.0]), ("great", [0.5, 1.0])]


def test_binary_batches_and_rules(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "batch_0.bin").write_bytes(b"\x01\x02")
    got = examples.read_binary_batches(spark, str(tmp_path / "b")).first()
    assert got["path"].endswith("batch_0.bin") and bytes(got["content"]) == b"\x01\x02"
    (tmp_path / "r").write_text("u1,k1\nu2,k2\n")
    assert rows(catalogs.read_user_rules(spark, str(tmp_path / "r"))) == [("u1", "k1"), ("u2", "k2")]
    (tmp_path / "i").write_text("k1,A\n")
    assert rows(catalogs.read_inclusion(spark, str(tmp_path / "i"))) == [("k1", "A")]
    (tmp_path / "x").write_text("u1\nu1\nu3\n")
    assert rows(catalogs.read_exclusions(spark, str(tmp_path / "x"))) == [("u1",), ("u3",)]
    pairs = catalogs.read_pairs(spark, str(tmp_path / "r"))
    assert rows(catalogs.training_items(pairs)) == [("k1",), ("k2",)] and catalogs.test_users(pairs).count() == 2
