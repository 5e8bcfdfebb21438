import os

import duckdb
import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from basket_engine.llm.pii import DEMO_KEY, pseudonymised
from basket_engine.llm.queries import ORACLES, QUERIES
from tools.check_queries import TABLES, compare

from .data import components, edge_table, table
from .test_decontaminate import brute_force

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_stages_like_brute_force(spark):
    """Each stage on what its predecessor kept; quality is held against its own operator's tests."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, steps = zip(*corpus_pipeline.STAGES)
    assert names == ("quality", "near_dedup", "decontaminate", "pseudonyms", "packing")
    kept = steps[0](spark, docs, SF)
    assert kept.columns == docs.columns
    before = texts(kept)
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = {k for k, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0}
    assert len(clean - set(before)) <= 0.02 * len(clean)
    poor = {k for k, r in labels.items() if r["quality"] == 0}
    assert len(poor & set(before)) <= 0.5 * len(poor)

    kept = steps[1](spark, kept, SF)
    after = texts(kept)
    assert set(after) == {k for k, (_, c) in components(before, 5).items() if k == c} and kept.columns == docs.columns

    kept = steps[2](spark, kept, SF)
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = brute_force(after, items)
    before, after = after, texts(kept)
    assert set(after) == {k for k in before if not hit[k][4]} and kept.columns == docs.columns

    kept = steps[3](spark, kept, SF)
    assert texts(kept) == {k: pseudonymised(t, DEMO_KEY)[0] for k, t in after.items()} and kept.columns == docs.columns
    assert kept.where("n_chars <> char_length(text)").count() == 0

    packed = steps[4](spark, kept, SF)
    assert {r["doc_id"] for r in packed.collect()} == set(after)


def test_the_key_is_a_setting(spark, monkeypatch):
    docs = table(spark, [(1, "mail jane@mail.example.com now", "en", "s", 30)])
    demo = texts(corpus_pipeline.replace_personal_values(spark, docs, SF))
    spark.conf.set(corpus_pipeline.PSEUDONYM_KEY, "a secret")
    try:
        own = texts(corpus_pipeline.replace_personal_values(spark, docs, SF))
    finally:
        spark.conf.unset(corpus_pipeline.PSEUDONYM_KEY)
    assert len({demo[1], own[1], "mail jane@mail.example.com now"}) == 3

    class Cluster:
        conf = spark.conf
        sparkContext = type("Context", (), {"master": "yarn", "getConf": spark.sparkContext.getConf})

    with pytest.raises(RuntimeError, match="secret"):
        corpus_pipeline.pseudonym_key(Cluster)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


def test_stages_on_edge_rows(spark):
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, edge_table(spark), SF)
        assert out.columns == edge_table(spark).columns and out.count() > 0
        assert stage(spark, edge_table(spark).limit(0), SF).count() == 0


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_beside_sql(spark, duck, monkeypatch, name):
    import tools.check_queries as tool

    monkeypatch.setattr(tool, "QUERIES", QUERIES)
    monkeypatch.setattr(tool, "ORACLES", ORACLES)
    message, _, fine = compare(spark, duck, name, SF)
    assert fine, message


def test_registered():
    names = entry_point.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14)) and "pipeline" in names
