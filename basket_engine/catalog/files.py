"""Queries over files that records name themselves: reviews, examples, minibatches, factors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.arrays import vector_text
from ..functions.scalars import split_by_month
from ..operators import training as T, vectors as P
from ..session import scratch_path, stored
from ..sinks import tables as W
from ..sources import catalogs, corpus, examples, files
from . import views as V
from .registry import query

CUTOFF = 199801


@query(
    "review_corpus",
    """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'test' ELSE 'train' END AS split,
  CASE quality WHEN 1 THEN 'positive' ELSE 'negative' END AS label_name, CAST(1 - quality AS INTEGER) AS label,
  CAST(length(coalesce(text, '')) AS INTEGER) AS n_chars, sha256(coalesce(text, '')) AS digest
FROM documents JOIN labels USING (doc_id) WHERE text <> ''""",
)
def review_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as a corpus of one file each, read back with split and label from the
    folders alone; empty files have no row."""
    split = F.when(F.col("doc_id") % 4 == 0, F.lit("test")).otherwise(F.lit("train"))
    docs = V.labelled_documents(spark, sf_dir).select(split.alias("split"), "label", F.col("doc_id").alias("name"), "text")
    root = scratch_path(spark, "reviews")
    corpus.write_reviews(docs, root)
    read = corpus.read_reviews(spark, root, "train").unionByName(corpus.read_reviews(spark, root, "test"))
    return read.select(
        F.regexp_extract("doc_id", r"/(\d+)\.txt$", 1).cast("long").alias("doc_id"), "split", "label_name", "label",
        F.char_length("text").alias("n_chars"), F.sha2("text", 256).alias("digest"),
    )


_SEGMENTS = """segments AS (
  SELECT c_mktsegment AS user_id, CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INTEGER) AS year_month,
         sum(l_quantity) AS quantity, CAST(count(*) AS DOUBLE) AS n, max(l_discount) AS discount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL
)"""


@query(
    "example_files",
    f"""WITH {_SEGMENTS} SELECT CASE WHEN year_month < {CUTOFF} THEN 'train' ELSE 'test' END AS split, user_id, year_month, quantity, n, discount
FROM segments""",
)
def example_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases of market segments by month, a file each in nested folders; split, user and month
    come back from the names of the files."""
    segments = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    tx = V.transactions(spark, sf_dir, "user_id", "year_month", "quantity", "discount").join(segments, "user_id")
    rows = tx.groupBy("segment", "year_month").agg(
        F.array(F.sum("quantity"), F.count(F.lit(1)).cast("double"), F.max("discount")).alias("values")
    )
    split = split_by_month(F.col("year_month"), CUTOFF)
    name = F.concat_ws("/", split, F.floor(F.col("year_month") / 100).cast("string"), F.concat_ws("_", "segment", "year_month"))
    root = scratch_path(spark, "example-files")
    files.write_files(rows.select(name.alias("name"), vector_text(F.col("values")).alias("content")), root)
    read = [examples.import_example_files(spark, root, part, 2, 1) for part in ("train", "test")]
    return read[0].unionByName(read[1]).select(
        "split", "user_id", "year_month", F.get("features", F.lit(0)).alias("quantity"), F.get("features", F.lit(1)).alias("n"),
        F.get("label", F.lit(0)).alias("discount"),
    )


def _placed_events(spark: SparkSession, sf_dir: str, batch: int) -> DataFrame:
    events = V.table(spark, sf_dir, "events").select(
        "event_id", F.array(F.col("value"), (F.col("event_id") % 7).cast("double")).alias("x"), F.array(F.col("event_id").cast("double")).alias("y")
    )
    return T.place_examples(events, "event_id", 2, batch, 10)[0]


@query(
    "minibatch_files",
    "SELECT event_id, value, CAST(event_id % 7 AS DOUBLE) AS rest FROM events",
)
def minibatch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in binary minibatch files, all read back and decoded."""
    root = scratch_path(spark, "minibatch-files")
    W.export_batch_files(_placed_events(spark, sf_dir, 500), root, 500)
    read = files.read_minibatch_files(spark, f"{root}/data")
    return read.select(
        F.get("y", F.lit(0)).cast("long").alias("event_id"), F.get("x", F.lit(0)).alias("value"), F.get("x", F.lit(1)).alias("rest")
    )


@query(
    "listed_fit",
    f"""WITH {V.DAILY}, n AS (SELECT count(*) AS n FROM (
  SELECT row_number() OVER (PARTITION BY user_id ORDER BY year_month DESC) AS rn FROM daily) WHERE rn <= 16),
sizes AS (SELECT n, greatest(1, ceil(n / 20000.0))::BIGINT AS splits FROM n),
shares AS (SELECT i % splits AS split, (i // splits) % 2 AS worker FROM sizes, range(n) AS r(i))
SELECT (SELECT n FROM n) AS n_examples, CAST(sum(ceil(c / 200.0)) AS BIGINT) AS n_files, 8 AS n_values, 8 AS equal_values, TRUE AS same_history
FROM (SELECT count(*) AS c FROM shares GROUP BY split, worker)""",
)
def listed_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fit that workers feed from the binary files a manifest lists, beside one from rows."""
    from ..plans.churn import churn_examples

    rows = churn_examples(V.activity_rows(spark, sf_dir)).select(
        F.struct("user_id", "matrix_row").alias("example"), F.transform("x", lambda v: v / 10).alias("x"), "y"
    )
    rows = stored(rows, "examples")
    options = dict(head="linear", key="example", epochs=2, batch=200, learning_rate=0.05)
    whole = T.fit(rows, 3, 1, workers=2, averaging=50, **options)
    placed, _, n = T.place_examples(rows, "example", 2, 200, 50)
    manifest = W.export_batch_files(placed, scratch_path(spark, "listed"), 200)
    listed = T.fit_listed(manifest, 3, 1, **options)
    a, b = (np.concatenate([r.last.params, r.last.updater]) for r in (whole, listed))
    row = (n, manifest.agg(F.count("path")).first()[0], len(a), int((a == b).sum()), whole.history == listed.history)
    return spark.createDataFrame([row], "n_examples long, n_files long, n_values int, equal_values int, same_history boolean")


@query(
    "entity_layout",
    f"""WITH {V.TX}, {V.BASKET_ROWS}, chosen AS (
  SELECT min(user_id) AS user_id FROM tx UNION SELECT max(user_id) FROM tx
  UNION SELECT user_id FROM (SELECT user_id, count(*) AS n FROM monthly GROUP BY user_id ORDER BY n DESC, user_id LIMIT 1)
)
SELECT CASE WHEN year_month < {CUTOFF} THEN 'train' ELSE 'test' END AS split, user_id, year_month, q, CAST(n AS DOUBLE) AS n, CAST(1 AS BIGINT) AS buckets
FROM monthly WHERE user_id IN (SELECT user_id FROM chosen)""",
)
def entity_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly rows laid out by user; those of the first, the last and the busiest user are read
    back, and each from the files of one bucket."""
    rows = stored(V.monthly_rows(spark, sf_dir).withColumn("split", split_by_month(F.col("year_month"), CUTOFF)), "monthly")
    path = scratch_path(spark, "by-user")
    W.write_entities(rows, path, "user_id", 32, ["year_month"])
    ends = rows.agg(F.min("user_id"), F.max("user_id")).first()
    busiest = rows.groupBy("user_id").count().orderBy(F.desc("count"), "user_id").first()["user_id"]
    out = None
    for user in sorted({*ends, busiest}):
        found = W.read_entity(spark, path, user, 32).select("*", F.regexp_extract("_metadata.file_path", "bucket=([0-9]+)", 1).alias("_bucket"))
        n = found.agg(F.count_distinct("_bucket")).first()[0]
        found = found.select(
            "split", "user_id", "year_month", F.get("features", F.lit(0)).alias("q"), F.get("features", F.lit(1)).alias("n"), F.lit(n).cast("long").alias("buckets")
        )
        out = found if out is None else out.unionByName(found)
    return out


@query(
    "factor_file",
    f"""WITH {V.TX}, {V.ITEMS}, {V.ITEM_FACTORS}
SELECT user_id, item_id, CAST(count(*) AS BIGINT) AS n, round(sum(factors[1]), 6) AS first_sum, round(sum(factors[{V.FACTOR_WIDTH}]), 6) AS last_sum
FROM tx JOIN item_factors USING (item_id) GROUP BY user_id, item_id""",
)
def factor_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item factors as lines with an index, in no order, read back, named by the dictionary and
    joined to the purchases."""
    items = stored(V.item_dictionary(spark, sf_dir), "items")
    factors = V.item_factors(spark, sf_dir, items).join(items, "item_id")
    path = scratch_path(spark, "factor-text")
    line = F.concat_ws(",", "item_idx", vector_text(F.col("factors")))
    factors.select(line.alias("value")).repartition(3, F.xxhash64("value")).write.text(path)
    named = catalogs.read_named_factors(spark, path, items, "item_id", "item_idx")
    tx = V.transactions(spark, sf_dir, "user_id", "item_id", line=True)
    joined = P.attach_factors(tx, named, "item_id", "f", row_id=V.LINE)
    sums = [F.round(F.sum(F.get("f", F.lit(i))), 6).alias(c) for i, c in ((0, "first_sum"), (V.FACTOR_WIDTH - 1, "last_sum"))]
    return joined.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n"), *sums)
