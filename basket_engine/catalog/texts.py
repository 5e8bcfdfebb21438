"""Queries over document texts: tokens, vocabulary, truncation, masks, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.arrays import array_total, vector_text
from ..operators import text as X
from ..plans.sentiment import review_batches
from ..session import scratch_path, stored
from ..sources import corpus
from . import views as V
from .purchases import DIGITS
from .registry import query

MAX_LEN = 100
BATCH = 10


@query("tokens", f"WITH {V.TOKENS} SELECT doc_id, pos, token FROM tokens")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.tokenize(V.documents(spark, sf_dir))


@query(
    "vocabulary_filter",
    f"""WITH {V.TOKENS} SELECT doc_id, pos, token FROM tokens WHERE token IN (SELECT token FROM vocabulary)""",
)
def vocabulary_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = X.keep_vocabulary(X.tokenize(V.documents(spark, sf_dir)), V.vocabulary(spark, sf_dir))
    return known.select("doc_id", "pos", "token")


@query("token_truncate", f"WITH {V.TOKENS} SELECT doc_id, pos, token FROM known WHERE pos < {MAX_LEN}")
def token_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = X.keep_vocabulary(X.tokenize(V.documents(spark, sf_dir)), V.vocabulary(spark, sf_dir))
    return X.truncate_tokens(known, MAX_LEN).select("doc_id", "pos", "token")


@query(
    "text_sequences",
    f"""WITH {V.TOKENS} SELECT doc_id, array_to_string(list(token ORDER BY pos), ' ') AS words,
       CAST(count(*) AS INTEGER) AS n_tokens, CAST(count(*) - 1 AS INTEGER) AS label_pos
FROM known WHERE pos < {MAX_LEN} GROUP BY doc_id""",
)
def text_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.text_sequences(V.documents(spark, sf_dir), V.vocabulary(spark, sf_dir), MAX_LEN)
    return out.select("doc_id", F.array_join("tokens", " ").alias("words"), "n_tokens", "label_pos")


@query(
    "empty_documents",
    f"""WITH {V.TOKENS} SELECT count(*) AS n_empty FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM known)""",
)
def empty_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = V.documents(spark, sf_dir)
    return X.empty_documents(docs, X.text_sequences(docs, V.vocabulary(spark, sf_dir), MAX_LEN))


_ORDERED = """
ranked AS (
  SELECT doc_id, 1 - quality AS label, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS r
  FROM {source}
),
ordered AS (SELECT doc_id, label, row_number() OVER (ORDER BY r, label) - 1 AS position FROM ranked)"""


@query(
    "balanced_order",
    f"""WITH {_ORDERED.format(source='labels')} SELECT doc_id, label, X.label_name, position FROM ordered
JOIN (SELECT 0 AS l, 'positive' AS label_name UNION ALL SELECT 1, 'negative') X ON l = label""",
)
def balanced_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = V.table(spark, sf_dir, "labels").select("doc_id", (F.lit(1) - F.col("quality")).alias("label"))
    out = X.balanced_order(labels)
    return out.select("doc_id", "label", X.label_name(F.col("label")).alias("label_name"), "position")


@query(
    "text_masks",
    f"""WITH {V.TOKENS},
sized AS (SELECT doc_id, least(count(*), {MAX_LEN}) AS n_tokens FROM known GROUP BY doc_id),
{_ORDERED.format(source='labels WHERE doc_id IN (SELECT doc_id FROM known)')},
batched AS (SELECT doc_id, label, position // {BATCH} AS batch_id, n_tokens FROM ordered JOIN sized USING (doc_id))
SELECT doc_id, batch_id, CAST(max(n_tokens) OVER (PARTITION BY batch_id) AS INTEGER) AS width,
       CAST(n_tokens AS DOUBLE) AS real_steps, CAST(n_tokens - 1 AS INTEGER) AS label_at FROM batched""",
)
def text_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced batches of labelled documents, padded to the longest of the batch."""
    batches = review_batches(V.labelled_documents(spark, sf_dir), V.vocabulary(spark, sf_dir), BATCH, MAX_LEN)
    return batches.select(
        "doc_id", "batch_id", F.size("x_mask").alias("width"), array_total(F.col("x_mask")).alias("real_steps"),
        (F.array_position("y_mask", 1.0) - 1).cast("int").alias("label_at"),
    )


_EMBEDDED = f"""WITH {V.TOKENS},
indexed AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS i FROM vocabulary WHERE token <> ''),
vectors AS (SELECT token, embedding FROM indexed JOIN embeddings ON vec_id = i % (SELECT count(*) FROM embeddings))
SELECT doc_id, CAST(count(*) AS INTEGER) AS steps, round(sum(CAST(embedding[1] AS DOUBLE) * (pos + 1)), {DIGITS - 2}) AS first_sum,
       round(sum(CAST(embedding[64] AS DOUBLE)), {DIGITS - 2}) AS last_sum
FROM known JOIN vectors USING (token) WHERE pos < {MAX_LEN} GROUP BY doc_id"""


def _embedded(spark: SparkSession, sf_dir: str, vectors: DataFrame) -> DataFrame:
    sequences = X.text_sequences(V.documents(spark, sf_dir), vectors, MAX_LEN)
    out = X.embed_tokens(sequences, vectors)
    first = F.transform("x", lambda v, i: F.get(v, F.lit(0)).cast("double") * (i + 1))
    last = F.transform("x", lambda v: F.get(v, F.lit(63)).cast("double"))
    return out.select(
        "doc_id", F.size("x").alias("steps"), F.round(array_total(first), DIGITS - 2).alias("first_sum"),
        F.round(array_total(last), DIGITS - 2).alias("last_sum"),
    )


@query("embed_tokens", _EMBEDDED)
def embed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embedded(spark, sf_dir, stored(V.word_vectors(spark, sf_dir), "vectors"))


@query("word_vector_file", _EMBEDDED)
def word_vector_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from vectors that were written as a text file and read back."""
    path = scratch_path(spark, "vector-text")
    corpus.write_word_vector_text(V.word_vectors(spark, sf_dir), path)
    return _embedded(spark, sf_dir, stored(corpus.read_word_vector_text(spark, path), "vectors"))


@query(
    "word_vector_text",
    f"""WITH {V.TOKENS} SELECT token, CAST(row_number() OVER (ORDER BY token) - 1 AS VARCHAR) AS idx
FROM vocabulary WHERE token <> ''""",
)
def word_vector_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary in dictionary order, the index written as vector text."""
    from ..operators.dictionary import dictionary

    indexed = dictionary(V.vocabulary(spark, sf_dir), "token")
    return indexed.select("token", vector_text(F.array("token_idx")).alias("idx"))
