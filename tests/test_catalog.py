"""Every registered query beside its SQL, on the planner's and the balanced joins."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_point

from basket_engine.catalog import ORACLES, QUERIES
from tools.check_queries import TABLES, compare

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
BALANCED = [
    "basket_features", "basket_share", "membership_filter", "risk_encoded", "user_softmax", "index_lookup", "purge",
    "packed_vector_user", "slot_vector", "item_values", "subtract_rows", "exclude_users", "vocabulary_filter", "text_masks",
    "embed_tokens", "grouped_table", "score_items", "top_scored_items", "factor_file", "worker_block_means", "grouped_copies", "allowed_items", "balanced_order",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    message, _, fine = compare(spark, duck, name, SF)
    assert fine, message


@pytest.mark.parametrize("name", BALANCED)
def test_query_with_hot_keys(skewed, duck, name):
    message, _, fine = compare(skewed, duck, name, SF)
    assert fine, message


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.count() > 0


def test_names():
    assert set(ORACLES) <= set(QUERIES)
    assert QUERIES.items() <= entry_point.queries().items() and ORACLES.items() <= entry_point.oracle_sql().items()
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    assert set(QUERIES) - set(ORACLES) == {"fit_linear", "fit_softmax", "fit_sentiment", "early_stopping"}


def test_customers_join_the_orders_before_the_lines(spark):
    """Orders are fewer than lines, so the lines move once less."""
    from basket_engine.catalog import views

    tx = views.transactions(spark, "/root/testdata/sf0.001", "user_id", "balance", line=True)
    joins = [x for x in tx._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]
    assert len(joins) == 2 and "l_orderkey" in joins[0] and "c_custkey" in joins[1]
