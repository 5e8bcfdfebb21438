"""Column expressions and clean-up shared by the document operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: str | Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` would change other letters too."""
    text = F.col(text) if isinstance(text, str) else text
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def has_repeated_ids(docs: DataFrame, id_col: str) -> bool:
    """Reads the id column only."""
    return bool(docs.groupBy(id_col).count().where("count > 1").take(1))


def one_per_id(docs: DataFrame, id_col: str = "doc_id", columns: Sequence[str] = ("text",)) -> DataFrame:
    """The id and the named columns, one row per id.

    Rows without an id are left out, as no result could name them. Of rows that share an
    id the one with the smallest values counts, nulls last. Other columns are never looked
    at, so their names cannot clash with anything.
    """
    df = docs.select(id_col, *columns).where(F.col(id_col).isNotNull())
    if not has_repeated_ids(df, id_col):
        return df
    order = [x for c in columns for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c).alias(f"value_{c}"))]
    best = df.groupBy(id_col).agg(F.min(F.struct(*order)).alias("best"))
    return best.select(id_col, *[F.col(f"best.value_{c}").alias(c) for c in columns])
