"""Banding of scores into ordered categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference's labels and cut points).
RISK_BANDS = [(80.0, "Very High"), (60.0, "High"), (40.0, "Moderate"), (20.0, "Low")]
RISK_LOWEST = "Very Low"
RISK_UNKNOWN = "Unknown"
RISK_ORDER = ["Very High", "High", "Moderate", "Low", "Very Low"]
STRATUM_LOW_MAX = 0.1165
STRATUM_MEDIUM_MAX = 0.1558
STRATA = ["Low-Tech", "Medium-Tech", "High-Tech"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def risk_category(c) -> Column:
    c = _c(c)
    expr = F.when(c.isNull(), F.lit(RISK_UNKNOWN))
    for cut, label in RISK_BANDS:
        expr = expr.when(c >= cut, F.lit(label))
    return expr.otherwise(F.lit(RISK_LOWEST))


def category_order(c, unknown: int = 99) -> Column:
    """Position of a risk category in ``RISK_ORDER`` (0-based), unknown -> 99."""
    pos = F.array_position(F.array(*[F.lit(x) for x in RISK_ORDER]), _c(c))
    return F.when(pos > 0, pos - 1).otherwise(F.lit(unknown))


def tech_stratum(c, low_max: float = STRATUM_LOW_MAX, medium_max: float = STRATUM_MEDIUM_MAX) -> Column:
    c = _c(c)
    return (F.when(c <= low_max, F.lit(STRATA[0]))
             .when(c <= medium_max, F.lit(STRATA[1]))
             .otherwise(F.lit(STRATA[2])))
