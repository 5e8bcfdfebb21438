import pytest

from basket_engine.operators import eligibility as E, scoring as S

from .conftest import rows

RULES = "user_id string, rule_key string"
INCLUSION = "rule_key string, item_id string"
RECOS = [("u1", "A", 0.6), ("u1", "B", 0.4), ("u2", "B", 0.7), ("u2", "", 0.1), ("u3", "A", 0.9)]


@pytest.fixture
def recos(spark):
    return spark.createDataFrame(RECOS, "user_id string, item_id string, score double")


@pytest.fixture
def inclusion(spark):
    return spark.createDataFrame([("k1", "A")], INCLUSION)


def test_purge(either, recos, inclusion):
    rules = either.createDataFrame([("u1", "k1"), ("u2", "k2")], RULES)
    assert rows(E.purge(recos, rules, inclusion)) == [("u1", "A", 0.6), ("u2", "B", 0.7)]


def test_one_open_rule_allows_everything_once(either, recos, inclusion):
    rules = either.createDataFrame([("u1", "k1"), ("u1", "k2")], RULES)
    assert rows(E.purge(recos, rules, inclusion)) == [("u1", "A", 0.6), ("u1", "B", 0.4)]
    assert rows(E.purge(recos, rules, inclusion, distinct=False)) == [("u1", "A", 0.6)] * 2 + [("u1", "B", 0.4)]


def test_purge_is_idempotent_and_a_subset(either, recos, inclusion):
    rules = either.createDataFrame([("u1", "k1"), ("u2", "k2"), ("u2", "k2")], RULES)
    once = E.purge(recos, rules, inclusion)
    assert rows(E.purge(once, rules, inclusion)) == rows(once)
    assert set(rows(once)) <= set(RECOS)


def test_allowed_items(either, inclusion):
    rules = either.createDataFrame([("u1", "k1"), ("u2", "k2")], RULES)
    assert rows(E.allowed_items(rules, inclusion), "user_id", "rule_key", "items") == [("u1", "k1", ["A"]), ("u2", "k2", [])]
    assert rows(E.eligibility(rules, inclusion), "user_id", "rule_key", "restricted") == [("u1", "k1", True), ("u2", "k2", False)]


def test_top_k_is_cut_before_the_shuffle(spark, recos):
    best = E.top_k(recos, 1)
    assert rows(best, "user_id", "item_id") == [("u1", "A"), ("u2", "B"), ("u3", "A")]
    assert best._jdf.queryExecution().toString().count("WindowGroupLimit") >= 2


def test_actual_vs_predicted(either, recos):
    predicted = either.createDataFrame([("u1", 0.5)], "user_id string, predicted double")
    got = S.actual_vs_predicted(recos, predicted)
    assert rows(got, "user_id", "item_id", "predicted") == [("u1", "A", 0.5), ("u1", "B", 0.5)]
