"""Occupation-code transformations (SOC ``XX-XXXX`` and O*NET ``XX-XXXX.XX``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_soc_code(c) -> Column:
    """Drop hyphens; a null code becomes the empty string."""
    return F.coalesce(F.replace(_c(c), F.lit("-"), F.lit("")), F.lit(""))


def occ_from_onet(c) -> Column:
    """O*NET code -> SOC code: the part before the first '.'."""
    return F.substring_index(_c(c), ".", 1)


def clean_onet_code(c) -> Column:
    """O*NET code without its ``.xx`` suffix and without hyphens."""
    return F.replace(occ_from_onet(c), F.lit("-"), F.lit(""))


def onet_from_occ(c) -> Column:
    return F.concat(_c(c), F.lit(".00"))


def _prefix(c, n: int) -> Column:
    return F.substring(_c(c), 1, n)


def major_code(c) -> Column:
    return _prefix(c, 2)


def minor_code(c) -> Column:
    return _prefix(c, 3)


def broad_code(c) -> Column:
    return _prefix(c, 4)
