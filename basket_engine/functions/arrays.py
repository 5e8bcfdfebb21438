"""Array expressions: padding, slots, multi-hot labels, vector text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def zeros(n: Column | int) -> Column:
    return F.array_repeat(F.lit(0.0), n.cast("int") if isinstance(n, Column) else F.lit(int(n)))


def padded(values: Column, width: int) -> Column:
    """The array followed by zeros up to ``width`` entries."""
    return F.concat(values, zeros(F.lit(width) - F.size(values)))


def slot_layout(user: Column, item: Column, item_idx: Column, n_items: int, k: int) -> Column:
    """User factors, then one ``k``-wide slot per item with only this item's filled."""
    return F.concat(
        user,
        zeros(item_idx * k),
        item,
        zeros((F.lit(n_items - 1) - item_idx) * k),
    )


def multi_hot(indices: Column, n: int) -> Column:
    """Dense 0/1 vector of ``n`` entries from an ascending array of distinct indices.

    Built from the zero run before each index, so the work per row follows the
    number of indices and not the width.
    """
    before = lambda j: F.when(j == 0, F.lit(-1)).otherwise(F.get(indices, j - 1))
    runs = F.transform(indices, lambda v, j: F.concat(zeros(v - before(j) - 1), F.array(F.lit(1.0))))
    return padded(F.flatten(runs), n)


def without_nan(values: Column) -> Column:
    return F.transform(values, lambda v: F.nanvl(v, F.lit(0.0)))


def vector_text(values: Column, sep: str = ",") -> Column:
    return F.array_join(values.cast("array<string>"), sep)


def text_vector(text: Column, sep: str = ",") -> Column:
    """Doubles of a separated line; quotes and blanks around a number are ignored."""
    parts = F.split(F.regexp_replace(text, '"', ""), sep, -1)
    return F.transform(parts, lambda p: F.trim(p).cast("double"))


def features_and_labels(values: Column, n_features: int, n_labels: int) -> Column:
    """First ``min(n_features, size - 1)`` entries are features, the next are labels."""
    width = F.least(F.lit(n_features), F.size(values) - 1)
    return F.struct(
        F.slice(values, F.lit(1), width).alias("features"),
        F.slice(values, width + 1, F.lit(n_labels)).alias("label"),
    )


def record_steps(values: Column, n_features: int, n_labels: int) -> Column:
    """A flat record cut into one (features, label) pair per time step."""
    width = n_features + n_labels
    clean = without_nan(values)
    steps = F.floor(F.size(values) / F.lit(width)).cast("int")
    return F.when(steps > 0, F.transform(
        F.sequence(F.lit(0), steps - 1),
        lambda i: F.struct(
            F.slice(clean, i * width + 1, F.lit(n_features)).alias("features"),
            F.slice(clean, i * width + 1 + n_features, F.lit(n_labels)).alias("label"),
        ),
    )).otherwise(F.array().cast("array<struct<features:array<double>,label:array<double>>>"))


def zipped(items: Column, scores: Column) -> Column:
    """Pairs of (item, score), as long as the shorter of both arrays."""
    n = F.least(F.size(items), F.size(scores))
    return F.arrays_zip(F.slice(items, F.lit(1), n).alias("item_id"), F.slice(scores, F.lit(1), n).alias("score"))


def picked(values: Column, positions: list[int]) -> Column:
    """The entries at the given 0-based positions, NULL outside the array."""
    return F.transform(F.array(*[F.lit(p) for p in positions]), lambda i: F.get(values, i))


def array_total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
