"""Review text to word-vector sequences: tokens, vocabulary, truncation, masks."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.arrays import zeros
from ..settings import CLASS_NAMES, TOKEN_PUNCTUATION, TOKEN_SEPARATORS
from .indexing import ordinal_in_group
from .skew import fits_broadcast, join_skewed

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def token_array(text: Column) -> Column:
    """Lower-cased whitespace tokens without digits and punctuation; empty ones dropped."""
    clean = F.regexp_replace(F.lower(text), TOKEN_PUNCTUATION, "")
    return F.filter(F.split(clean, TOKEN_SEPARATORS), lambda t: t != "")


def tokenize(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per token of the whole text: (doc, pos, token)."""
    return docs.select(doc, F.posexplode(token_array(F.col(text))).alias("pos", "token"))


def keep_vocabulary(tokens: DataFrame, vocabulary: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Tokens the vocabulary knows. Common words are hot keys and are cut as such."""
    return join_skewed(tokens, vocabulary.select("token"), ["token"], "left_semi", row_id=[doc, "pos"])


def truncate_tokens(tokens: DataFrame, max_len: int, doc: str = "doc_id") -> DataFrame:
    """The first ``max_len`` known tokens of each document with new positions."""
    ranked = tokens.withColumn("_rn", F.row_number().over(Window.partitionBy(doc).orderBy("pos")))
    kept = ranked.where(F.col("_rn") <= max_len)
    return kept.withColumn("pos", F.col("_rn") - 1).drop("_rn")


#: A vocabulary of so many tokens at most becomes a set in the expression itself.
IN_PLACE_TOKENS = 20_000


def _as_set(vocabulary: DataFrame) -> list[str] | None:
    """The tokens, if they are few enough for a set that each task holds."""
    if not fits_broadcast(vocabulary.select("token")):
        return None
    few = vocabulary.where(F.col("token").isNotNull()).select("token").distinct().limit(IN_PLACE_TOKENS + 1).collect()
    return [r["token"] for r in few] if len(few) <= IN_PLACE_TOKENS else None


def _embedded(known: pa.Table):
    """Replaces the tokens of (doc, tokens) by the vectors of a table sorted by token."""
    found: dict[str, list[int]] = {}
    for i, token in enumerate(known["token"].to_pylist()):
        found.setdefault(token, []).append(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = known["vector"].combine_chunks()
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                places = [[i for t in tokens or () for i in found.get(t, ())] for tokens in batch.column(1).to_pylist()]
                kept = [k for k, own in enumerate(places) if own]
                offsets = np.cumsum([0, *(len(places[k]) for k in kept)], dtype=np.int32)
                x = pa.ListArray.from_arrays(offsets, vectors.take(pa.array([i for k in kept for i in places[k]], pa.int64())))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), x], [batch.schema.names[0], "x"])

    return run


def text_sequences(
    docs: DataFrame, vocabulary: DataFrame, max_len: int, doc: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc, tokens, n_tokens, label_pos): known tokens, at most ``max_len``.

    The label sits on the last real token. Documents without a known token have
    no row; ``empty_documents`` counts them.
    """
    words = _as_set(vocabulary)
    if words is not None:
        # Each text is cut where it lies; no more than its first known tokens are shuffled.
        places = F.transform(token_array(F.col(text)), lambda t, i: F.struct(i.alias("pos"), t.alias("token")))
        known = F.slice(F.filter(places, lambda p: p["token"].isin(words)), 1, max_len)
        found = docs.select(doc, known.alias("_k"))
        # Rows of one document together have the first known tokens of all.
        first = F.slice(F.array_sort(F.flatten(F.collect_list("_k"))), 1, max_len)
        # Filtered only here: before, the planner would cut each text twice.
        nested = found.groupBy(doc).agg(first.alias("_t")).where(F.size("_t") > 0)
    else:
        kept = truncate_tokens(keep_vocabulary(tokenize(docs, doc, text), vocabulary, doc), max_len, doc)
        nested = kept.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("_t"))
    return nested.select(
        doc,
        F.col("_t.token").alias("tokens"),
        F.size("_t").alias("n_tokens"),
        (F.size("_t") - 1).alias("label_pos"),
    )


def empty_documents(docs: DataFrame, sequences: DataFrame, doc: str = "doc_id") -> DataFrame:
    """How many documents have no known token, as one row."""
    gone = docs.select(doc).join(sequences.select(doc), doc, "left_anti")
    return gone.agg(F.count(F.lit(1)).alias("n_empty"))


def balanced_order(
    docs: DataFrame, label: str = "label", doc: str = "doc_id", name: str = "position"
) -> DataFrame:
    """Positions alternating between class 0 and class 1, starting with class 0.

    Once one class runs out the other continues, so unequal counts are fine.
    """
    ranked = ordinal_in_group(docs, [label], [doc], "_rank")
    sizes = docs.agg(
        F.count(F.when(F.col(label) == 0, 1)).alias("n0"), F.count(F.when(F.col(label) == 1, 1)).alias("n1")
    ).first()
    n0, n1 = F.lit(sizes["n0"]), F.lit(sizes["n1"])
    position = F.when(F.col(label) == 0, F.col("_rank") + F.least(F.col("_rank"), n1)).otherwise(
        F.col("_rank") + F.least(F.col("_rank") + 1, n0)
    )
    return ranked.withColumn(name, position.cast("long")).drop("_rank")


def text_masks(batched: DataFrame, max_len: int, batch: str = "batch_id") -> DataFrame:
    """Pads each sequence to its batch's longest: (``width``, ``x_mask``, ``y_mask``).

    The longest of a batch comes from a map-side aggregate of one number.
    """
    widths = batched.groupBy(batch).agg(F.least(F.max("n_tokens"), F.lit(max_len)).alias("width"))
    out = join_skewed(batched, widths, [batch], "inner", row_id=[batch, "doc_id"] if "doc_id" in batched.columns else None)
    pad = zeros(F.col("width") - F.col("n_tokens"))
    return out.withColumns(
        {
            "x_mask": F.concat(F.array_repeat(F.lit(1.0), F.col("n_tokens")), pad),
            "y_mask": F.concat(zeros(F.col("label_pos")), F.array(F.lit(1.0)), pad),
        }
    )


def embed_tokens(sequences: DataFrame, vectors: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The word vector of every token, in token order: (doc, x array<array<float>>).

    ``sequences`` has one row per document. Vectors that fit a broadcast are looked up in place;
    others are joined and nested again.
    """
    table = vectors.where(F.col("token").isNotNull()).select("token", "vector")
    if fits_broadcast(table):
        known = table.orderBy("token", "vector").toArrow()
        kinds = {f.name: f.dataType.simpleString() for f in [*sequences.select(doc).schema, *table.schema]}
        ddl = f"`{doc}` {kinds[doc]}, x array<{kinds['vector']}>"
        return sequences.select(doc, "tokens").mapInArrow(_embedded(known), ddl)
    long = sequences.select(doc, F.posexplode("tokens").alias("pos", "token"))
    looked_up = join_skewed(long, vectors.select("token", "vector"), ["token"], "inner", row_id=[doc, "pos"])
    nested = looked_up.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("pos", "vector"))).alias("_v"))
    return nested.select(doc, F.col("_v.vector").alias("x"))


def label_name(label: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in CLASS_NAMES]), label)
