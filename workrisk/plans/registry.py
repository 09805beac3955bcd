"""Registry of named queries: a Spark callable and its DuckDB oracle twin.

Every query reads the driver tables (through ``workrisk.sources.domain``) so
that its work grows with them. Double columns listed in ``rounded`` are
rounded to 6 places identically on both sides; lists are joined to text with
``|`` on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workrisk.plans.sql import with_views

PLACES = 9  # fixed-decimal inputs make ties at 6 places likely (e.g. means over 2^k rows)
MONEY_PLACES = 2  # sums of ~1e12 differ between engines in the last bits


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    rounded: tuple[str, ...] = ()
    group: str = ""
    ops: tuple[str, ...] = field(default_factory=tuple)


REGISTRY: dict[str, Query] = {}


def _places(c: str, money, places: int) -> int:
    return MONEY_PLACES if c in money else places


def round_cols(df: DataFrame, cols, money=(), places: int = PLACES) -> DataFrame:
    cols = set(cols) | set(money)
    # "+ 0.0" turns a rounded -0.0 into 0.0 on both engines.
    return df.select(*[(F.round(F.col(c), _places(c, money, places)) + F.lit(0.0)).alias(c) if c in cols
                       else F.col(c) for c in df.columns])


def sql_round(body: str, cols, money=(), places: int = PLACES) -> str:
    cols = list(dict.fromkeys(list(cols) + list(money)))
    if not cols:
        return body
    rep = ", ".join(f"round({c}, {_places(c, money, places)}) + 0.0 AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM (\n{body}\n) q"


def query(name: str, *, sql: str | None, views: tuple[str, ...] = (), rounded: tuple[str, ...] = (),
          money: tuple[str, ...] = (), places: int = PLACES, group: str = "", ops: tuple[str, ...] = ()):
    """``places``: 9 by default; 6 for outputs of long floating sums (fewer
    rounding-boundary straddles between engines)."""
    def deco(fn):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_cols(fn(spark, sf_dir), rounded, money, places)

        full_sql = None if sql is None else sql_round(with_views(sql, *views), rounded, money, places)
        REGISTRY[name] = Query(name, build, full_sql, tuple(rounded), group, tuple(ops))
        return fn

    return deco
