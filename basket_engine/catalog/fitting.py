"""Queries over model fitting and scoring."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import averaging as A, scoring as S, training as T, wide as B
from ..operators.training import Model
from ..plans import churn as C, recommend as R, sentiment as N
from ..session import scratch_path, stored
from ..sinks import manifest as M, tables as W
from . import views as V
from .purchases import DIGITS
from .registry import query

K = V.FACTOR_WIDTH
START, END = 199511, 199602
# Items of a block: few, so that the catalog here has several blocks.
ITEMS_A_BLOCK, TOP_ITEMS = 8, 5
CHURN_WEIGHTS = (0.2, 0.5, 0.01, -0.3)  # n, clicks, top, bias


@query(
    "vector_mean",
    f"""SELECT label, CAST(pos - 1 AS INTEGER) AS pos, round(avg(CAST(embedding[pos] AS DOUBLE)), {DIGITS}) AS mean
FROM embeddings CROSS JOIN range(1, 65) AS r(pos) GROUP BY label, pos""",
)
def vector_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = V.table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    return A.vector_mean(vectors, "v", ["label"]).select("label", "pos", F.round("mean", DIGITS).alias("mean"))


@query(
    "worker_block_means",
    f"""SELECT label, CAST((pos - 1) // 16 AS INTEGER) AS block, CAST((pos - 1) % 16 AS INTEGER) AS pos,
       round(avg(CAST(embedding[pos] AS DOUBLE)), {DIGITS}) AS mean, count(*) AS n_workers
FROM embeddings CROSS JOIN range(1, 65) AS r(pos) WHERE pos <= 16 * (1 + vec_id % 4) GROUP BY ALL""",
)
def worker_block_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 16 elements averaged over the rows that report them: one to four a row."""
    vectors = V.table(spark, sf_dir, "embeddings").select(
        "label", F.slice("embedding", F.lit(1), (16 * (1 + F.pmod("vec_id", F.lit(4)))).cast("int")).alias("v")
    )
    means = A.block_means(A.in_blocks(vectors, "v", ["label"], 16), ["label"])
    long = means.select("label", "block", F.posexplode(F.arrays_zip("mean", "n")).alias("pos", "e"))
    return long.select("label", "block", "pos", F.round("e.mean", DIGITS).alias("mean"), F.col("e.n").alias("n_workers"))


@query(
    "mean_loss",
    f"""WITH {V.DAILY}, p AS (SELECT quality, 1.0::DOUBLE / (1 + n_chars / 1000.0::DOUBLE) AS p FROM documents JOIN labels USING (doc_id))
SELECT 'softmax' AS head, round(avg(-ln(CASE WHEN quality = 1 THEN p ELSE 1 - p END)), {DIGITS}) AS loss, count(*) AS n_examples FROM p
UNION ALL
SELECT 'linear', round(avg((label - n / 5) * (label - n / 5)), {DIGITS}), count(*) FROM daily""",
)
def mean_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = V.table(spark, sf_dir, "documents").select("doc_id", (1 / (1 + F.col("n_chars") / 1000)).alias("p"))
    quality = V.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("q"))
    soft = docs.join(quality, "doc_id").select(
        F.array("p", 1 - F.col("p")).alias("scores"), F.array("q", 1 - F.col("q")).alias("y")
    )
    daily = V.activity_rows(spark, sf_dir)
    linear = daily.select(F.array(F.get("features", F.lit(0)) / 5).alias("scores"), F.array("label").alias("y"))
    both = [
        T.mean_loss(S.with_loss(df, head)).select(F.lit(head).alias("head"), F.round("loss", DIGITS).alias("loss"), "n_examples")
        for head, df in (("softmax", soft), ("linear", linear))
    ]
    return both[0].unionByName(both[1])


def _factor_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item factors as the weight rows of a head, bias 0."""
    items = stored(V.item_dictionary(spark, sf_dir), "items")
    factors = V.item_factors(spark, sf_dir, items).join(items, "item_id")
    return factors.select("item_id", "item_idx", F.col("factors").alias("weights"), F.lit(0.0).alias("bias"))


@query(
    "score_items",
    f"""WITH {V.ITEMS}, {V.ITEM_FACTORS}, {V.USER_FACTORS},
dots AS (
  SELECT u.user_id, i.item_id, sum(u.factors[d] * i.factors[d]) AS z
  FROM user_factors u CROSS JOIN item_factors i CROSS JOIN range(1, {K + 1}) AS r(d) GROUP BY u.user_id, i.item_id
)
SELECT user_id, item_id, round(exp(z) / sum(exp(z)) OVER (PARTITION BY user_id), {DIGITS}) AS score FROM dots""",
)
def score_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user against every item, by the first factors of both."""
    users = V.user_factors(spark, sf_dir).select("user_id", F.col("factors").alias("x"))
    scores = B.score_wide(users, _factor_weights(spark, sf_dir), K, block_bytes=8 * (K + 1) * ITEMS_A_BLOCK)
    return scores.withColumn("score", F.round("score", DIGITS))


@query(
    "top_scored_items",
    f"""WITH {V.ITEMS}, {V.ITEM_FACTORS}, {V.USER_FACTORS},
dots AS (
  SELECT u.user_id, i.item_id, sum(u.factors[d] * i.factors[d]) AS z
  FROM user_factors u CROSS JOIN item_factors i CROSS JOIN range(1, {K + 1}) AS r(d) GROUP BY u.user_id, i.item_id
),
scored AS (SELECT user_id, item_id, z, exp(z) / sum(exp(z)) OVER (PARTITION BY user_id) AS score FROM dots)
SELECT user_id, CAST(row_number() OVER w AS INTEGER) AS rank, item_id, round(score, {DIGITS}) AS score FROM scored
WINDOW w AS (PARTITION BY user_id ORDER BY round(z, 12) DESC, item_id) QUALIFY rank <= {TOP_ITEMS}""",
)
def top_scored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best items of every user; a block hands on no more than these."""
    users = V.user_factors(spark, sf_dir).select("user_id", F.col("factors").alias("x"))
    best = B.top_wide(users, _factor_weights(spark, sf_dir), K, TOP_ITEMS, block_bytes=8 * (K + 1) * ITEMS_A_BLOCK)
    return best.withColumn("score", F.round("score", DIGITS))


@query(
    "score_churn",
    f"""WITH {V.DAILY} SELECT user_id, label,
       round({CHURN_WEIGHTS[0]} * n + {CHURN_WEIGHTS[1]} * clicks + {CHURN_WEIGHTS[2]} * top + {CHURN_WEIGHTS[3]}, {DIGITS}) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY year_month DESC) AS rn FROM daily) WHERE rn = 1""",
)
def score_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's newest row under a given linear model."""
    model = Model("linear", 3, 1, np.array(CHURN_WEIGHTS), np.zeros(4))
    newest = C.churn_examples(V.activity_rows(spark, sf_dir), n=1)
    return C.churn_predictions(newest, model).withColumn("score", F.round("score", DIGITS))


def _churn_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = stored(V.activity_rows(spark, sf_dir), "activity")
    scaled = rows.withColumn("features", F.transform("features", lambda v: v / 10))
    held = F.col("year_month") >= 20240125
    return C.churn_examples(scaled.where(~held)), C.churn_examples(scaled.where(held), n=1)


@query("fit_linear")
def fit_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Churn pipeline: fit on recent rows, score the held-out days."""
    train, test = _churn_sets(spark, sf_dir)
    result = C.fit_churn(train, 3, epochs=2, workers=None, batch=50, averaging=20, learning_rate=0.05)
    return C.churn_predictions(test, result.best)


@query("early_stopping")
def early_stopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss per epoch on training and held-out rows."""
    train, test = _churn_sets(spark, sf_dir)
    return C.fit_churn(
        train, 3, test=test, epochs=3, workers=None, batch=50, averaging=20, learning_rate=0.05
    ).history_table(spark)


RECENT = f"""{V.DAILY},
held AS (SELECT user_id, year_month FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY year_month DESC) AS rn FROM daily WHERE year_month < 20240125
) WHERE rn <= 16)"""
# A fit that is short enough to run twice: two workers, whatever the cluster has.
SHORT_FIT = dict(epochs=2, workers=2, batch=50, averaging=8, learning_rate=0.05)
A_ROUND = 2 * 50 * 8


@query(
    "resumed_fit",
    f"""WITH {RECENT}, n AS (SELECT count(*) AS n, CAST(greatest(1, ceil(count(*) / {A_ROUND}.0)) AS INTEGER) AS splits FROM held)
SELECT n AS n_examples, 2 * splits AS rounds, splits + CAST(splits > 1 AS INTEGER) AS stopped_after, 2 AS epochs, 8 AS n_values,
  8 AS equal_values, TRUE AS same_history, TRUE AS same_best FROM n""",
)
def resumed_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fit stopped in its second epoch and taken up again, beside one that ran through."""
    train, test = _churn_sets(spark, sf_dir)
    train, test = stored(train, "train"), stored(test, "test")
    whole = C.fit_churn(train, 3, test=test, **SHORT_FIT)
    state = scratch_path(spark, "fit-state")
    splits = whole.rounds // 2
    stopped = C.fit_churn(train, 3, test=test, state_dir=state, stop_after=splits + (splits > 1), **SHORT_FIT)
    resumed = C.fit_churn(train, 3, test=test, state_dir=state, **SHORT_FIT)
    values = [np.concatenate([r.last.params, r.last.updater]) for r in (whole, resumed)]
    best = [np.concatenate([r.best.params, r.best.updater]) for r in (whole, resumed)]
    row = (
        train.count(), resumed.rounds, stopped.rounds, len(resumed.history), len(values[0]), int((values[0] == values[1]).sum()),
        whole.history == resumed.history, bool((best[0] == best[1]).all()) and whole.best_epoch == resumed.best_epoch,
    )
    schema = "n_examples long, rounds int, stopped_after int, epochs int, n_values int, equal_values int, same_history boolean, same_best boolean"
    return spark.createDataFrame([row], schema)


@query(
    "worker_statistics",
    f"""WITH {RECENT}, n AS (SELECT count(*) AS n, greatest(1, ceil(count(*) / {A_ROUND}.0))::BIGINT AS splits FROM held),
placed AS (SELECT i % splits AS split, (i // splits) % 2 AS worker FROM n, range(n) AS r(i))
SELECT CAST(epoch AS INTEGER) AS epoch, CAST(split AS INTEGER) AS split, 'fit' AS phase, CAST(worker AS INTEGER) AS worker, count(*) AS n,
  CAST(ceil(count(*) / 50.0) AS BIGINT) AS batches, TRUE AS timed
FROM placed CROSS JOIN range(2) AS e(epoch) GROUP BY epoch, split, worker""",
)
def worker_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the workers of a fit report themselves: examples, batches, and that they took time."""
    train, _ = _churn_sets(spark, sf_dir)
    stats = C.fit_churn(train, 3, **SHORT_FIT).worker_table(spark)
    return stats.select("epoch", "split", "phase", "worker", "n", "batches", (F.col("ms") > 0).alias("timed"))


@query(
    "model_table",
    "SELECT unnest(['best', 'last']) AS kind, 'linear' AS head, 3 AS n_features, 1 AS n_labels, 4 AS n_params, TRUE AS same",
)
def model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best and the last model of a fit, written as a table and read back."""
    train, test = _churn_sets(spark, sf_dir)
    result = C.fit_churn(train, 3, test=test, epochs=2, workers=2, batch=200, averaging=50, learning_rate=0.05)
    path = scratch_path(spark, "models")
    W.write_model(spark, result, path)
    rows = []
    for kind, model in (("best", result.best), ("last", result.last)):
        back = W.read_model(spark, path, kind)
        same = bool((back.params == model.params).all() and (back.updater == model.updater).all() and np.abs(model.params).sum() > 0)
        rows.append((kind, back.head, back.n_features, back.n_labels, len(back.params), same))
    return spark.createDataFrame(rows, "kind string, head string, n_features int, n_labels int, n_params int, same boolean")


@query(
    "export_reuse",
    f"""WITH {RECENT}, sizes AS (SELECT count(*) AS n, count(*) FILTER (year_month <> 20240105) AS fewer FROM held)
SELECT unnest([1, 2, 3, 4]) AS step, unnest(['first', 'equal', 'changed', 'equal']) AS input, unnest([TRUE, FALSE, fewer < n, FALSE]) AS written,
  unnest([n, n, fewer, fewer]) AS n_rows, unnest([n, n, fewer, fewer]) AS n_listed FROM sizes""",
)
def export_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minibatches exported four times: anew, from equal rows in another order, from fewer rows,
    and from these again."""
    train, _ = _churn_sets(spark, sf_dir)
    train = stored(train.select(F.struct("user_id", "matrix_row").alias("example"), "year_month", "x", "y"), "train")
    less = train.where("year_month <> 20240105")
    folder, steps = scratch_path(spark, "export"), []
    for name, df in (("first", train), ("equal", train.repartition(5).sortWithinPartitions("x")), ("changed", less), ("equal", less)):
        placed, _, _ = T.place_examples(df, "example", 2, 50, 8)
        export = M.export_once(placed, folder, key=["worker", "turn"])
        listed = M.read_manifest(spark, export).agg(F.sum("n_rows")).first()[0]
        steps.append((len(steps) + 1, name, export.written, M.read_export(placed.schema, export, spark).count(), listed))
    return spark.createDataFrame(steps, "step int, input string, written boolean, n_rows long, n_listed long")


@query("fit_softmax")
def fit_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendation pipeline: month sequences, fit, eligible scores."""
    items = stored(V.item_dictionary(spark, sf_dir), "items")
    n_items = items.count()
    tx = V.indexed_transactions(spark, sf_dir, items, "quantity")
    rows = tx.groupBy("user_id", "year_month").agg(
        F.array(F.sum("quantity") / 50, F.count(F.lit(1)).cast("double")).alias("features"),
        F.sort_array(F.collect_set("item_idx")).alias("label_idx"),
    )
    examples = stored(R.sequence_examples(rows, 2, n_items, START, END), "sequences")
    result = R.fit_recommender(examples, 8, n_items, epochs=2, workers=None, batch=50, averaging=20)
    return R.recommend_eligible(
        examples, result.best, items, V.user_rules(spark, sf_dir), V.item_inclusion(spark, sf_dir)
    )


@query("fit_sentiment")
def fit_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review pipeline: balanced batches, word vectors, fit, class scores."""
    vectors = stored(V.word_vectors(spark, sf_dir, 16), "vectors")
    batches = stored(N.review_batches(V.labelled_documents(spark, sf_dir), vectors), "batches")
    examples = stored(N.review_examples(batches, vectors, 16), "examples")
    result = N.fit_sentiment(examples, 16, epochs=2, workers=None, learning_rate=0.05, test=examples)
    scored = S.score(examples, result.best, ["doc_id"])
    return scored.select("doc_id", F.get("scores", F.lit(0)).alias("positive"), F.get("scores", F.lit(1)).alias("negative"))
