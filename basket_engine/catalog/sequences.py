"""Queries over time steps: month axis, masks, recent rows, targets, row differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.arrays import array_total, features_and_labels, picked, record_steps, without_nan
from ..functions.scalars import month_axis
from ..operators import indexing as I, sequences as Q, training as T
from ..session import scratch_path
from ..sinks.tables import export_minibatches
from . import views as V
from .registry import query

# The axis crosses a year end on purpose.
START, END = 199511, 199602
_AXIS = month_axis(START, END)
_AXIS_SQL = " UNION ALL ".join(f"SELECT {m} AS ym, {i} AS slot" for i, m in enumerate(_AXIS))
TARGET_DAY = 20240120
RECENT = 16


def _steps_sql(off_axis: str) -> str:
    off = len(_AXIS) - 1 if off_axis == "last" else -1
    return f"""WITH {V.TX}, {V.BASKET_ROWS}, axis AS ({_AXIS_SQL}),
placed AS (
  SELECT m.*, coalesce(slot, {off}) AS slot, slot IS NULL AS off,
         count(*) OVER (PARTITION BY user_id) AS n_rows
  FROM monthly m LEFT JOIN axis ON ym = year_month
),
chosen AS (
  SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY user_id, slot ORDER BY off, year_month) = 1
),
users AS (SELECT DISTINCT user_id, n_rows FROM placed)
SELECT u.user_id, CAST(u.n_rows AS BIGINT) AS n_rows, a.ym, coalesce(c.q, 0) AS x0, coalesce(CAST(c.n AS DOUBLE), 0) AS x1,
       coalesce(c.d, 0) AS y0, CAST(c.user_id IS NOT NULL AS DOUBLE) AS x_mask,
       CAST(coalesce(c.user_id IS NOT NULL AND (c.year_month = {END} OR u.n_rows = 1), false) AS DOUBLE) AS y_mask
FROM users u CROSS JOIN axis a LEFT JOIN chosen c ON c.user_id = u.user_id AND c.slot = a.slot"""


def _steps(spark: SparkSession, sf_dir: str, off_axis: str) -> DataFrame:
    seqs = Q.month_sequences(V.monthly_rows(spark, sf_dir), 2, 1, START, END, off_axis)
    long = seqs.select("user_id", "n_rows", F.explode("steps").alias("s"))
    return long.select(
        "user_id", "n_rows", "s.ym",
        F.get("s.x", F.lit(0)).alias("x0"), F.get("s.x", F.lit(1)).alias("x1"), F.get("s.y", F.lit(0)).alias("y0"),
        "s.x_mask", "s.y_mask",
    )


@query("month_axis", _steps_sql("drop"))
def month_axis_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir, "drop")


@query("off_axis_month", _steps_sql("last"))
def off_axis_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir, "last")


@query(
    "sequence_masks",
    f"""SELECT user_id, sum(x_mask) AS months, sum(y_mask) AS labelled, sum(x0 * x_mask) AS x_total
FROM ({_steps_sql('drop')}) GROUP BY user_id""",
)
def sequence_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = Q.month_sequences(V.monthly_rows(spark, sf_dir), 2, 1, START, END, "drop")
    flat = Q.flatten_sequences(seqs).select("user_id", F.filter("x", lambda v, i: i % 2 == 0).alias("q"))
    masks = seqs.select(
        "user_id", array_total(F.col("steps.x_mask")).alias("months"), array_total(F.col("steps.y_mask")).alias("labelled")
    )
    return masks.join(flat.select("user_id", array_total(F.col("q")).alias("x_total")), "user_id")


@query(
    "recent_rows_matrix",
    f"""WITH {V.DAILY}, recent AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY year_month DESC) AS rn FROM daily)
SELECT user_id, CAST({RECENT} - rn AS INTEGER) AS matrix_row, n, clicks, top, label FROM recent WHERE rn <= {RECENT}""",
)
def recent_rows_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filled rows of the matrix, read back from it."""
    matrix = Q.recent_matrix(V.activity_rows(spark, sf_dir), 3, RECENT)
    long = matrix.select("user_id", "n_rows", "labels", F.posexplode("features").alias("matrix_row", "x"))
    return long.where(F.col("matrix_row") >= RECENT - F.col("n_rows")).select(
        "user_id", "matrix_row", *[F.get("x", F.lit(i)).alias(c) for i, c in enumerate(("n", "clicks", "top"))],
        F.get("labels", F.col("matrix_row")).alias("label"),
    )


@query(
    "recent_matrix_padding",
    f"""WITH {V.DAILY}
SELECT user_id, CAST(least(count(*), {RECENT + 14}) AS INTEGER) AS n_rows, CAST({RECENT + 14} AS INTEGER) AS height,
       sum(label) AS label_total FROM daily GROUP BY user_id""",
)
def recent_matrix_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix taller than most histories is padded at the old end."""
    matrix = Q.recent_matrix(V.activity_rows(spark, sf_dir), 3, RECENT + 14)
    return matrix.select(
        "user_id", "n_rows", F.size("features").alias("height"), array_total(F.col("labels")).alias("label_total")
    )


@query(
    "target_split",
    f"""WITH {V.DAILY} SELECT user_id, year_month, n,
       CASE WHEN year_month = {TARGET_DAY} THEN 'predict' ELSE 'train' END AS part,
       CASE WHEN year_month = {TARGET_DAY} THEN NULL ELSE label END AS label FROM daily""",
)
def target_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, predict = Q.target_split(V.activity_rows(spark, sf_dir), TARGET_DAY)
    both = train.withColumn("part", F.lit("train")).unionByName(
        predict.withColumn("part", F.lit("predict")), allowMissingColumns=True
    )
    return both.select("user_id", "year_month", F.get("features", F.lit(0)).alias("n"), "part", "label")


@query(
    "next_target",
    f"""WITH {V.DAILY} SELECT user_id, year_month, label,
       lead(label) OVER (PARTITION BY user_id ORDER BY year_month) AS target FROM daily""",
)
def next_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.next_target(V.activity_rows(spark, sf_dir)).select("user_id", "year_month", "label", "target")


@query(
    "subtract_rows",
    """SELECT user_id, event_type FROM events e WHERE NOT EXISTS (
  SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.value > 60
  AND p.user_id IS NOT DISTINCT FROM e.user_id AND p.event_type IS NOT DISTINCT FROM e.event_type)""",
)
def subtract_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user, type) rows without those equal to a large purchase; duplicates stay."""
    events = V.table(spark, sf_dir, "events")
    large = events.where((F.col("event_type") == "purchase") & (F.col("value") > 60))
    return Q.subtract_rows(events.select("user_id", "event_type"), large.select("user_id", "event_type"))


@query(
    "exclude_users",
    f"""WITH {V.DAILY} SELECT user_id, year_month, label FROM daily
WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 99)""",
)
def exclude_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = V.table(spark, sf_dir, "events")
    bad = events.where((F.col("event_type") == "error") & (F.col("value") > 99))
    rows = V.activity_rows(spark, sf_dir)
    return Q.exclude_users(rows, bad, row_id=["user_id", "year_month"]).select("user_id", "year_month", "label")


@query(
    "record_steps",
    f"""WITH {V.DAILY}, turns AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY year_month) - 1 AS step FROM daily)
SELECT user_id, CAST(step AS INTEGER) AS step, n, CASE WHEN clicks = 0 THEN 0 ELSE n / clicks END AS per_click, label FROM turns""",
)
def record_steps_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat records of all days of a user, with NaN for undefined rates, cut into steps."""
    rows = V.activity_rows(spark, sf_dir)
    n, clicks = F.get("features", F.lit(0)), F.get("features", F.lit(1))
    per_click = F.when(clicks == 0, F.lit(float("nan"))).otherwise(n / F.nullif(clicks, F.lit(0.0)))
    # A user has one row per day, so a record is bounded by the calendar.
    flat = rows.groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("year_month", F.array(n, per_click, "label").alias("v")))).alias("d")
    )
    steps = flat.select("user_id", F.posexplode(record_steps(F.flatten("d.v"), 2, 1)).alias("step", "s"))
    return steps.select(
        "user_id", "step", F.get("s.features", F.lit(0)).alias("n"), F.get("s.features", F.lit(1)).alias("per_click"),
        F.get("s.label", F.lit(0)).alias("label"),
    )


@query(
    "features_and_labels",
    f"""WITH {V.DAILY} SELECT user_id, year_month, CAST(2 AS INTEGER) AS width, n, top AS label FROM daily""",
)
def features_and_labels_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows shorter than the feature width keep their last value as the label."""
    rows = V.activity_rows(spark, sf_dir).select(
        "user_id", "year_month", features_and_labels(F.col("features"), 71, 1).alias("p")
    )
    return rows.select(
        "user_id", "year_month", F.size("p.features").alias("width"),
        F.get("p.features", F.lit(0)).alias("n"), F.get("p.label", F.lit(0)).alias("label"),
    )


@query(
    "nan_to_zero",
    f"""WITH {V.DAILY} SELECT user_id, year_month, CASE WHEN clicks = 0 THEN 0 ELSE n / clicks END AS per_click FROM daily""",
)
def nan_to_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.activity_rows(spark, sf_dir)
    n, clicks = F.get("features", F.lit(0)), F.get("features", F.lit(1))
    rate = F.when(clicks == 0, F.lit(float("nan"))).otherwise(n / F.nullif(clicks, F.lit(0.0)))
    return rows.select("user_id", "year_month", F.get(without_nan(F.array(rate)), F.lit(0)).alias("per_click"))


@query(
    "fixed_batches",
    f"""WITH {V.DAILY}, users AS (SELECT DISTINCT user_id FROM daily)
SELECT user_id, (row_number() OVER (ORDER BY user_id) - 1) // 32 AS batch_id FROM users""",
)
def fixed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stacked batches of 32 users."""
    users = V.activity_rows(spark, sf_dir).select("user_id").distinct()
    return I.fixed_batches(users, ["user_id"], 32)


@query(
    "minibatch_split",
    """SELECT CAST(i AS INTEGER) AS split, n // 7 + CASE WHEN i < n % 7 THEN 1 ELSE 0 END AS n_rows
FROM range(7) AS r(i), (SELECT count(*) AS n FROM events)""",
)
def minibatch_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of a seeded random split into seven equal parts."""
    events = V.table(spark, sf_dir, "events").select("event_id")
    return I.balanced_split(events, "event_id", 7, 12345).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))


_WORKERS, _BATCH, _AVERAGING = 3, 10, 5


@query(
    "minibatch_export",
    f"""SELECT CAST(i % s AS INTEGER) AS split, CAST((i // s) % {_WORKERS} AS INTEGER) AS worker, count(*) AS n_rows
FROM (SELECT unnest(range(n)) AS i, CAST(ceil(n / {_WORKERS * _BATCH * _AVERAGING}.0) AS BIGINT) AS s
      FROM (SELECT count(*) AS n FROM events)) GROUP BY ALL""",
)
def minibatch_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples placed by averaging round and worker, exported, and read back."""
    events = V.table(spark, sf_dir, "events").select("event_id", F.array("value").alias("x"), F.array("value").alias("y"))
    placed, _, _ = T.place_examples(events, "event_id", _WORKERS, _BATCH, _AVERAGING)
    exported = export_minibatches(placed, scratch_path(spark, "minibatches"), "run")
    return exported.groupBy("split", "worker").agg(F.count(F.lit(1)).alias("n_rows"))


@query("picked_features", f"WITH {V.DAILY} SELECT user_id, year_month, top, n FROM daily")
def picked_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of the features by position, in the order asked for."""
    rows = V.activity_rows(spark, sf_dir).select("user_id", "year_month", picked(F.col("features"), [2, 0]).alias("p"))
    return rows.select("user_id", "year_month", F.get("p", F.lit(0)).alias("top"), F.get("p", F.lit(1)).alias("n"))
