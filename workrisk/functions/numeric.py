"""Null-algebra helpers that reproduce pandas semantics under Spark ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dirty_to_double(c) -> Column:
    """Dirty numeric text (``1,234``, ``*``, ``#``, blanks) -> double or NULL."""
    return F.replace(F.trim(_c(c).cast("string")), F.lit(","), F.lit("")).try_cast("double")


def nan_to_null(c) -> Column:
    c = _c(c)
    return F.when(~F.isnan(c), c)


def safe_div(a, b) -> Column:
    """a / b with NULL on a zero or NULL divisor (pandas ``/ x.replace(0, nan)``)."""
    return F.try_divide(_c(a), _c(b))


def clip(c, lo: float, hi: float) -> Column:
    """``Series.clip(lo, hi)`` keeping NULL as NULL (greatest/least would not)."""
    c = _c(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c)))


def clip_upper(c, hi: float) -> Column:
    c = _c(c)
    return F.when(c.isNotNull(), F.least(F.lit(float(hi)), c))


def null_max(a, b) -> Column:
    """``np.maximum``: NULL if either side is NULL."""
    a, b = _c(a), _c(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def sum0(c) -> Column:
    """``Series.sum()``: an empty or all-NULL sum is 0."""
    return F.coalesce(F.sum(_c(c)), F.lit(0.0))
