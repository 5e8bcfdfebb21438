"""Default settings and fixed values."""

from __future__ import annotations

from pyspark.sql import SparkSession

# They have to equal the published behavior for equal results.
NULL_TOKEN = "NULL"
IMPUTED_VALUE = -1.0
SHARE_SMOOTHING = 0.0001
SEQUENCE_START = 201605
SEQUENCE_END = 201608
SPLIT_CUTOFF = 201609
PACKED_BASKET = 73
PACKED_BASKET_WITH_USER = 64
RECENT_ROWS_TRAIN = 16
RECENT_ROWS_TEST = 1
TOKEN_PUNCTUATION = r"""[\d\.:,"'\(\)\[\]|/?!;]+"""
TOKEN_SEPARATORS = r"[ \t\n\r\f]+"
CLASS_NAMES = ("positive", "negative")
FIT_SEED = 12345
CHURN_FEATURE_COLUMNS = 71
RECOMMENDER_FEATURES = 657
RECOMMENDER_LABELS = 111

# Session settings read by the skew handling; see operators/skew.py.
SKEW_SLICES = "basket.engine.skew.slices"
SKEW_MIN_ROWS = "basket.engine.skew.minRows"


def skew_slices(spark: SparkSession) -> int:
    default = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return int(spark.conf.get(SKEW_SLICES, str(default)))


def skew_min_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(SKEW_MIN_ROWS, "100000"))
