"""Queries over sources and sinks: text tables, nesting, partitions, round trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, LongType, StringType

from ..functions.scalars import split_by_month
from ..session import scratch_path
from ..sinks import tables as W
from ..sources import catalogs, delimited as T
from ..sources.examples import import_example_lines, read_examples
from . import views as V
from .registry import query

ORDER_SCHEMA = T.columns(
    ("o_orderkey", LongType()), ("o_custkey", LongType()), ("o_totalprice", DoubleType()),
    ("o_orderpriority", StringType()), ("extra", StringType()),
)
CUTOFF = 199801


@query(
    "delimited_table",
    """SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS o_orderpriority,
       '' AS extra FROM orders""",
)
def delimited_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as text with ``|``, missing text and a trailing empty field, read back."""
    orders = V.table(spark, sf_dir, "orders")
    priority = F.when(F.col("o_orderstatus") == "P", F.lit("NULL")).otherwise(F.col("o_orderpriority"))
    line = F.concat_ws("|", *[F.col(c).cast("string") for c in ("o_orderkey", "o_custkey", "o_totalprice")], priority, F.lit(""))
    path = scratch_path(spark, "orders-text")
    orders.select(line.alias("value")).write.text(path)
    return T.read_delimited(spark, path, ORDER_SCHEMA, sep="|")


@query(
    "field_count",
    """SELECT lang, source, CAST(sum(1 + length(text) - length(replace(text, ',', ''))) AS BIGINT) AS n_fields,
       count(*) FILTER (text LIKE '%,') AS ends_empty FROM documents GROUP BY lang, source""",
)
def field_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N separators make N + 1 fields, over whole texts."""
    docs = V.table(spark, sf_dir, "documents").select("lang", "source", T.fields(F.col("text")).alias("f"))
    return docs.groupBy("lang", "source").agg(
        F.sum(F.size("f")).alias("n_fields"), F.count(F.when((F.size("f") > 1) & (F.element_at("f", -1) == ""), 1)).alias("ends_empty")
    )


@query(
    "grouped_table",
    """SELECT event_type, count(*) AS n_rows, min(event_id) AS first_id, max(event_id) AS last_id,
       CAST(sum(event_id) AS BIGINT) AS id_total FROM events GROUP BY event_type""",
)
def grouped_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events nested by type, read back from the nested rows of all parts."""
    events = V.table(spark, sf_dir, "events").select("event_type", "event_id", "user_id")
    nested = T.grouped_table(events, "event_type", row_id=["event_id"])
    ids = F.col("rows.event_id")
    per_part = nested.select(
        "event_type", "n_rows", F.array_min(ids).alias("a"), F.array_max(ids).alias("b"),
        F.aggregate(ids, F.lit(0).cast("long"), lambda acc, v: acc + v).alias("s"),
    )
    return per_part.groupBy("event_type").agg(
        F.sum("n_rows").alias("n_rows"), F.min("a").alias("first_id"), F.max("b").alias("last_id"), F.sum("s").alias("id_total")
    )


@query("grouped_copies", "SELECT user_id, event_type, count(*) AS n_rows FROM events GROUP BY user_id, event_type")
def grouped_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without identity: equal rows are nested once with their number."""
    events = V.table(spark, sf_dir, "events").select("user_id", "event_type")
    nested = T.grouped_table(events, "user_id")
    long = nested.select("user_id", F.inline("rows"))
    return long.groupBy("user_id", "event_type").agg(F.sum("copies").alias("n_rows"))


@query(
    "keyed_table",
    "SELECT event_id, CAST(user_id AS VARCHAR) || ',' || event_type AS key FROM events",
)
def keyed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.keyed_table(V.table(spark, sf_dir, "events"), ["user_id", "event_type"]).select("event_id", "key")


def _by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = V.table(spark, sf_dir, "events")
    day = (F.year("ts") * 10000 + F.month("ts") * 100 + F.dayofmonth("ts")).cast("int")
    path = scratch_path(spark, "events-by-day")
    rows = events.select("event_id", "user_id", "value", day.alias("day"))
    rows.hint("rebalance", "day").write.partitionBy("day").parquet(path)
    return spark.read.parquet(path)


_DAY = "CAST(strftime(ts, '%Y%m%d') AS INTEGER)"


@query(
    "range_partition",
    f"SELECT event_id, user_id, value, {_DAY} AS day FROM events WHERE {_DAY} BETWEEN 20240110 AND 20240115",
)
def range_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.partition_range(_by_day(spark, sf_dir), "day", 20240110, 20240115)


@query(
    "latest_partition",
    f"SELECT event_id, user_id, value, {_DAY} AS day FROM events WHERE {_DAY} = (SELECT max({_DAY}) FROM events)",
)
def latest_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.latest_partition(_by_day(spark, sf_dir), "day")


@query(
    "examples_round_trip",
    f"""WITH {V.TX}, {V.BASKET_ROWS} SELECT user_id, year_month, q, CAST(n AS DOUBLE) AS n, d FROM monthly WHERE year_month < {CUTOFF}""",
)
def examples_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Example rows written by split and month; the training split read back."""
    rows = V.monthly_rows(spark, sf_dir).withColumn("split", split_by_month(F.col("year_month"), CUTOFF))
    path = scratch_path(spark, "examples")
    W.write_examples(rows, path)
    back = read_examples(spark, path, "train")
    return back.select(
        "user_id", "year_month", F.get("features", F.lit(0)).alias("q"), F.get("features", F.lit(1)).alias("n"),
        F.get("label", F.lit(0)).alias("d"),
    )


@query(
    "example_text_round_trip",
    f"""WITH {V.TX}, {V.BASKET_ROWS} SELECT CASE WHEN year_month < {CUTOFF} THEN 'train' ELSE 'test' END AS split,
       CAST(user_id AS VARCHAR) AS user_id, year_month, q, CAST(n AS DOUBLE) AS n, d FROM monthly""",
)
def example_text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed text lines written and imported again."""
    rows = V.monthly_rows(spark, sf_dir).withColumn("split", split_by_month(F.col("year_month"), CUTOFF))
    path = scratch_path(spark, "examples-text")
    W.write_example_text(rows, path)
    back = import_example_lines(spark.read.text(path).select("value"), 2, 1)
    return back.select(
        "split", "user_id", "year_month", F.get("features", F.lit(0)).alias("q"),
        F.get("features", F.lit(1)).alias("n"), F.get("label", F.lit(0)).alias("d"),
    )


@query("scored_text_file", f"WITH {V.TX}, {V.RECOS} SELECT CAST(user_id AS VARCHAR) AS user_id, item_id, score FROM recos")
def scored_text_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendations written as lines of triples and read back."""
    path = scratch_path(spark, "scored-text")
    W.write_scored_text(V.recommendations(spark, sf_dir), path)
    return catalogs.read_scored(spark, path)


FORMATS = ("parquet", "csv", "orc", "json")


@query(
    "result_tables",
    f"""WITH {V.TX}, {V.RECOS} SELECT format, user_id, item_id, score
FROM recos CROSS JOIN (SELECT unnest({list(FORMATS)}) AS format) WHERE user_id % 4 = list_position({list(FORMATS)}, format) - 1""",
)
def result_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendations written in every format, a quarter of the users each, and read back."""
    recos = V.recommendations(spark, sf_dir)
    out = None
    for i, fmt in enumerate(FORMATS):
        path = scratch_path(spark, f"results-{fmt}")
        W.write_table(recos.where(F.col("user_id") % 4 == i), path, fmt)
        back = spark.read.schema(recos.schema).format(fmt).load(path).select(F.lit(fmt).alias("format"), *recos.columns)
        out = back if out is None else out.unionByName(back)
    return out


@query(
    "split_table",
    f"""WITH {V.DAILY} SELECT CASE WHEN year_month < 20240125 THEN 'train' ELSE 'test' END AS split, user_id, year_month, n, clicks, top, label
FROM daily WHERE year_month >= 20240125""",
)
def split_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of all users written by split; the test split read back from its folder."""
    rows = V.activity_rows(spark, sf_dir).withColumn("split", split_by_month(F.col("year_month"), 20240125))
    path = scratch_path(spark, "split")
    W.write_split(rows, path)
    back = spark.read.option("basePath", path).parquet(f"{path}/split=test")
    values = [F.get("features", F.lit(i)).alias(c) for i, c in enumerate(("n", "clicks", "top"))]
    return back.select("split", "user_id", "year_month", *values, "label")
