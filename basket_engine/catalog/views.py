"""The star-schema tables seen as purchases, rules, reviews and monthly rows.

Each view reads only the columns it needs and joins only the tables they live in.
The SQL text of a view stands beside it for the queries' reference SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import year_month
from ..operators import dictionary as D, text as X
from ..session import stored

LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
VARIABLES = (
    "quantity", "price", "discount", "tax", "size", "retail", "order_total", "balance", "supplier_balance", "region",
)
FACTOR_WIDTH = 8
# Pairs seen before this month are the training pairs.
TRAINING_UNTIL = 199503

_SOURCE_OF = {
    "item_id": ("part", "p_brand"),
    "size": ("part", "p_size"),
    "retail": ("part", "p_retailprice"),
    "user_id": ("orders", "o_custkey"),
    "order_total": ("orders", "o_totalprice"),
    "balance": ("customer", "c_acctbal"),
    "supplier_balance": ("supplier", "s_acctbal"),
    "region": ("supplier", "n_regionkey"),
    "risk": ("lineitem", "l_linenumber"),
    "quantity": ("lineitem", "l_quantity"),
    "price": ("lineitem", "l_extendedprice"),
    "discount": ("lineitem", "l_discount"),
    "tax": ("lineitem", "l_tax"),
}

TX = """
tx AS (
  SELECT o_custkey AS user_id, p_brand AS item_id,
         CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INTEGER) AS year_month,
         l_orderkey, l_linenumber, l_partkey, l_suppkey,
         l_linenumber AS risk, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount,
         l_tax AS tax, p_size AS size, p_retailprice AS retail, o_totalprice AS order_total,
         c_acctbal AS balance, s_acctbal AS supplier_balance, n_regionkey AS region
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
)"""
PAIRS = f"""
pairs AS (SELECT DISTINCT user_id, item_id FROM tx WHERE year_month < {TRAINING_UNTIL})"""
ITEMS = """
items AS (
  SELECT p_brand AS item_id, row_number() OVER (ORDER BY p_brand) - 1 AS item_idx
  FROM (SELECT DISTINCT p_brand FROM part)
)"""
ITEM_FACTORS = f"""
item_factors AS (
  SELECT item_id, item_idx, CAST(embedding[1:{FACTOR_WIDTH}] AS DOUBLE[]) AS factors
  FROM items JOIN embeddings ON vec_id = item_idx % (SELECT count(*) FROM embeddings)
)"""
USER_FACTORS = f"""
user_factors AS (
  SELECT c_custkey AS user_id, CAST(embedding[1:{FACTOR_WIDTH}] AS DOUBLE[]) AS factors
  FROM customer JOIN embeddings ON vec_id = c_custkey % (SELECT count(*) FROM embeddings)
)"""


# Tables with much work per row.
_WIDE_ROWS = {"documents"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by name. Long texts in too few pieces for the cores are spread first;
    a table in many files, as at scale, is read as it lies."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in _WIDE_ROWS and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def transactions(spark: SparkSession, sf_dir: str, *cols: str, line: bool = False) -> DataFrame:
    """Purchase rows with the named columns (``user_id``, ``item_id``, ``year_month``, ...)."""
    wanted = {c: _SOURCE_OF[c] for c in cols if c != "year_month"}
    tables = {t for t, _ in wanted.values()}
    line_item = table(spark, sf_dir, "lineitem")
    out = line_item.withColumn("year_month", year_month(F.col("l_shipdate")))
    if tables & {"orders", "customer"}:
        orders = table(spark, sf_dir, "orders")
        if "customer" in tables:  # to the orders first: they are fewer than their lines
            orders = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        out = out.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if "part" in tables:
        out = out.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    if "supplier" in tables:
        suppliers = table(spark, sf_dir, "supplier").join(
            table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
        )
        out = out.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    picked = [F.col("year_month") if c == "year_month" else F.col(wanted[c][1]).alias(c) for c in cols]
    return out.select(*picked, *(LINE if line else ()))


def training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    early = transactions(spark, sf_dir, "user_id", "item_id", "year_month").where(F.col("year_month") < TRAINING_UNTIL)
    return stored(early.select("user_id", "item_id").distinct(), "pairs")


def item_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary of the brands in the part catalog."""
    return D.dictionary(table(spark, sf_dir, "part").select(F.col("p_brand").alias("item_id")), "item_id")


def _embeddings(spark: SparkSession, sf_dir: str, width: int | None = None) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    vector = F.col("embedding") if width is None else F.slice("embedding", 1, width).cast("array<double>")
    return rows.select("vec_id", vector.alias("factors"))


def _n_embeddings(spark: SparkSession, sf_dir: str):
    return table(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)).alias("n")).scalar()


def item_factors(spark: SparkSession, sf_dir: str, items: DataFrame) -> DataFrame:
    placed = items.withColumn("vec_id", F.pmod("item_idx", _n_embeddings(spark, sf_dir)))
    return stored(placed.join(_embeddings(spark, sf_dir, FACTOR_WIDTH), "vec_id").select("item_id", "factors"), "factors")


def user_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    placed = users.withColumn("vec_id", F.pmod("user_id", _n_embeddings(spark, sf_dir)))
    return stored(placed.join(_embeddings(spark, sf_dir, FACTOR_WIDTH), "vec_id").select("user_id", "factors"), "factors")


def indexed_transactions(spark: SparkSession, sf_dir: str, items: DataFrame, *cols: str, line: bool = False) -> DataFrame:
    tx = transactions(spark, sf_dir, "user_id", "item_id", "year_month", *cols, line=line)
    return D.with_index(tx, items, "item_id", row_id=LINE if line else None)


CORRELATIONS = """
corr AS (SELECT user_id, item_id, 1.0::DOUBLE + count(*) AS score FROM tx GROUP BY ALL)"""


def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, item_id, score) with scores above 1."""
    tx = transactions(spark, sf_dir, "user_id", "item_id")
    return tx.groupBy("user_id", "item_id").agg((F.count(F.lit(1)) + F.lit(1.0)).alias("score"))


RECOS = """
recos AS (
  SELECT user_id, item_id, n * 1.0::DOUBLE / sum(n) OVER (PARTITION BY user_id) AS score
  FROM (SELECT user_id, item_id, count(*) AS n FROM tx GROUP BY ALL)
)"""


def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored items of a user: the share of the user's purchases."""
    tx = transactions(spark, sf_dir, "user_id", "item_id")
    counted = tx.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n"))
    totals = counted.groupBy("user_id").agg(F.sum("n").alias("total"))
    # One row per user and item: a user has at most as many rows as the catalog.
    return counted.join(totals, "user_id").select(
        "user_id", "item_id", (F.col("n") / F.col("total")).alias("score")
    )


RULES = """
rules AS (
  SELECT c_custkey AS user_id, c_mktsegment AS rule_key FROM customer WHERE c_acctbal >= 0
  UNION ALL
  SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 0
),
inclusion AS (
  SELECT DISTINCT CASE p_type WHEN 'ECONOMY' THEN 'MACHINERY' WHEN 'STANDARD' THEN 'BUILDING'
                              WHEN 'PROMO' THEN 'AUTOMOBILE' ELSE p_type END AS rule_key, p_brand AS item_id
  FROM part WHERE p_size = 1
  UNION
  SELECT DISTINCT n_name, p_brand FROM part JOIN nation ON p_size = n_nationkey WHERE p_type = 'PROMO'
)"""


def user_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, rule_key): market segment of users in credit, nation for one region."""
    customer = table(spark, sf_dir, "customer")
    segment = customer.where(F.col("c_acctbal") >= 0).select(
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("rule_key")
    )
    nation = table(spark, sf_dir, "nation").where(F.col("n_regionkey") == 0)
    by_nation = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("user_id"), F.col("n_name").alias("rule_key")
    )
    return segment.unionAll(by_nation)


def item_inclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rule_key, item_id): some segments and nations name items, others none."""
    part = table(spark, sf_dir, "part")
    kind = (
        F.when(F.col("p_type") == "ECONOMY", "MACHINERY")
        .when(F.col("p_type") == "STANDARD", "BUILDING")
        .when(F.col("p_type") == "PROMO", "AUTOMOBILE")
        .otherwise(F.col("p_type"))
    )
    by_segment = part.where(F.col("p_size") == 1).select(kind.alias("rule_key"), F.col("p_brand").alias("item_id"))
    nation = table(spark, sf_dir, "nation")
    by_nation = (
        part.where(F.col("p_type") == "PROMO")
        .join(nation, F.col("p_size") == F.col("n_nationkey"))
        .select(F.col("n_name").alias("rule_key"), F.col("p_brand").alias("item_id"))
    )
    return by_segment.unionAll(by_nation).distinct()


BASKET_ROWS = """
monthly AS (
  SELECT user_id, year_month, sum(quantity) AS q, count(*) AS n, max(discount) AS d
  FROM tx GROUP BY user_id, year_month
)"""


def monthly_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, year_month, features[2], label[1]) per user and month."""
    tx = transactions(spark, sf_dir, "user_id", "year_month", "quantity", "discount")
    grouped = tx.groupBy("user_id", "year_month").agg(
        F.sum("quantity").alias("q"), F.count(F.lit(1)).alias("n"), F.max("discount").alias("d")
    )
    return grouped.select(
        "user_id", "year_month",
        F.array(F.col("q"), F.col("n").cast("double")).alias("features"),
        F.array("d").alias("label"),
    )


DAILY = """
daily AS (
  SELECT user_id, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS year_month,
         count(*)::DOUBLE AS n, count(*) FILTER (event_type = 'click')::DOUBLE AS clicks,
         max(value) AS top, count(*) FILTER (event_type = 'purchase')::DOUBLE AS label
  FROM events GROUP BY ALL
)"""


def activity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, year_month, features[3], label) with a day as the time step."""
    events = table(spark, sf_dir, "events")
    day = (F.year("ts") * 10000 + F.month("ts") * 100 + F.dayofmonth("ts")).cast("int")
    grouped = events.groupBy("user_id", day.alias("year_month")).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.count(F.when(F.col("event_type") == "click", 1)).cast("double").alias("clicks"),
        F.max("value").alias("top"),
        F.count(F.when(F.col("event_type") == "purchase", 1)).cast("double").alias("label"),
    )
    return grouped.select("user_id", "year_month", F.array("n", "clicks", "top").alias("features"), "label")


TOKENS = r"""
tokens AS (
  SELECT doc_id, CAST(generate_subscripts(words, 1) - 1 AS INTEGER) AS pos, unnest(words) AS token
  FROM (
    SELECT doc_id, [w for w in string_split_regex(
             regexp_replace(lower(text), '[\d\.:,"''\(\)\[\]|/?!;]+', '', 'g'), '[ \t\n\r\f]+') if w <> ''] AS words
    FROM documents
  )
),
vocabulary AS (
  SELECT DISTINCT unnest(string_split_regex(
           regexp_replace(lower(text), '[\d\.:,"''\(\)\[\]|/?!;]+', '', 'g'), '[ \t\n\r\f]+')) AS token
  FROM benchmark
),
known AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS pos, token
  FROM tokens WHERE token <> '' AND token IN (SELECT token FROM vocabulary)
)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct tokens of the benchmark texts."""
    texts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return X.tokenize(texts).select("token").distinct()


def word_vectors(spark: SparkSession, sf_dir: str, width: int | None = None) -> DataFrame:
    """(token, vector): vocabulary tokens in order, paired with the embeddings."""
    indexed = D.dictionary(vocabulary(spark, sf_dir), "token")
    placed = indexed.withColumn("vec_id", F.pmod("token_idx", _n_embeddings(spark, sf_dir)))
    vectors = placed.join(_embeddings(spark, sf_dir), "vec_id")
    vector = F.col("factors") if width is None else F.slice("factors", 1, width)
    return vectors.select("token", vector.alias("vector"))


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, label, text): class 0 for good quality, 1 for poor."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.lit(1) - F.col("quality")).alias("label"))
    return documents(spark, sf_dir).join(labels, "doc_id").select("doc_id", "label", "text")
