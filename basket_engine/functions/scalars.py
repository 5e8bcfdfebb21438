"""Row-level column expressions: parsing, cleanup, guarded arithmetic, months."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..settings import IMPUTED_VALUE, NULL_TOKEN, SPLIT_CUTOFF


def missing_to_null(col: Column, token: str = NULL_TOKEN) -> Column:
    """The literal missing-value text becomes a real NULL."""
    return F.nullif(col, F.lit(token))


def imputed(col: Column, value: float = IMPUTED_VALUE) -> Column:
    """Numeric value with missing entries replaced, so they enter sums and counts."""
    return F.coalesce(col.try_cast("double"), F.lit(float(value)))


def ratio(num: Column, den: Column) -> Column:
    """Division whose undefined result (zero denominator) is NULL."""
    return num / F.nullif(den, F.lit(0.0))


def log_odds(x: Column, form: str = "as_given") -> Column:
    """``log(x / (x - 1))``, or the logit ``log(x / (1 - x))``; NULL outside the domain."""
    if form == "as_given":
        quotient = ratio(x, x - F.lit(1.0))
    elif form == "logit":
        quotient = ratio(x, F.lit(1.0) - x)
    else:
        raise ValueError(f"unknown log-odds form {form!r}")
    return F.log(F.when(quotient > 0, quotient))


def strip_parens(col: Column) -> Column:
    return F.regexp_replace(col, r"[()]", "")


def unquoted(col: Column) -> Column:
    """Text without double quotes and surrounding blanks, ready for a cast."""
    return F.trim(F.regexp_replace(col, '"', ""))


def split_by_month(month: Column, cutoff: int = SPLIT_CUTOFF) -> Column:
    """``train`` before the cutoff month, ``test`` from it on."""
    return F.when(month < F.lit(cutoff), F.lit("train")).otherwise(F.lit("test"))


def year_month(ts: Column) -> Column:
    """Calendar month of a timestamp as ``yyyyMM`` integer."""
    return (F.year(ts) * 100 + F.month(ts)).cast("int")


def month_position(month: Column, start: int) -> Column:
    """Calendar distance of a ``yyyyMM`` month from ``start``, crossing year ends."""
    first = (start // 100) * 12 + start % 100
    return (F.floor(month / 100) * 12 + month % 100 - F.lit(first)).cast("int")


def example_key(split: Column, user: Column, month: Column) -> Column:
    """``<split>/<user>_<yyyyMM>``, the name of one exported example."""
    return F.concat(split, F.lit("/"), user.cast("string"), F.lit("_"), month.cast("string"))


def user_of_example(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)_(\d+)$", 1)


def month_of_example(path: Column) -> Column:
    return F.regexp_extract(path, r"_(\d+)$", 1).try_cast("int")


def month_axis(start: int, end: int) -> list[int]:
    """All ``yyyyMM`` months of a closed range, by the calendar."""
    if start > end:
        raise ValueError("the first month is after the last")
    for month in (start, end):
        if not 1 <= month % 100 <= 12:
            raise ValueError(f"{month} is not a yyyyMM month")
    first, last = (start // 100) * 12 + start % 100 - 1, (end // 100) * 12 + end % 100 - 1
    return [(m // 12) * 100 + m % 12 + 1 for m in range(first, last + 1)]
