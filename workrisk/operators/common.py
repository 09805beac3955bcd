"""Shared distributed building blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, tiebreak: list[str],
          rank_col: str = "rank") -> DataFrame:
    """Top-k rows per group.

    The plain ``row_number() <= k`` filter lets the optimizer put a partial
    group limit before the shuffle, so each input task sends at most k rows of
    a group and a hot group stays small; one exchange. ``order`` plus
    ``tiebreak`` must be a total order.
    """
    w = Window.partitionBy(*keys).orderBy(*order, *[F.col(c).asc() for c in tiebreak])
    return (df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)
              .withColumn(rank_col, F.col(rank_col).cast("bigint")))


def multi_top_k(df: DataFrame, keys: list[str], rankings: Column, k: int, order: list[Column], tiebreak: list[str]) -> DataFrame:
    """Several top-k rankings of the same rows in one pass.

    ``rankings`` is an array of structs, one for each ranking that a row takes part in; their fields
    become columns, and those of ``keys`` and ``order`` may be among them. The array is exploded and
    ranked once, so the partial group limit and the one exchange serve all rankings."""
    entries = df.select("*", F.inline(rankings))
    return top_k(entries, keys, order, k, tiebreak)


def with_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Attach the columns of a one-row global aggregate to every row.

    The aggregate becomes one uncorrelated scalar subquery (``DataFrame.scalar``)
    returning a struct: it runs once and its value is inlined into the
    projection - no join is planned. Spark fails if ``scalars`` has more than
    one row.
    """
    cols = scalars.columns
    s = scalars.select(F.struct(*[F.col(c) for c in cols]).alias("_scalars")).scalar()
    return (df.withColumn("_scalars", s)
              .select(*[F.col(c) for c in df.columns], *[F.col("_scalars")[c].alias(c) for c in cols]))


def keyed_positions(df: DataFrame, keys: list[str], order: list[Column], pos_col: str = "pos",
                    partitions: int | None = None) -> DataFrame:
    """1-based position of each row within its key under ``order``, skew-safe.

    Rows are range-partitioned on (keys, order), so a hot key spans several
    partitions; each partition ranks its rows per key, and a key's offset in a
    partition is the number of its rows in earlier partitions (a prefix sum
    over the small (partition, key) count table).
    """
    from workrisk.session import materialize
    n_parts = partitions or 2 * df.sparkSession.sparkContext.defaultParallelism
    # The partition id is materialised with the rows: the counts and the local
    # ranks below must see the same range assignment (two range shuffles of the
    # same input may sample different bounds).
    r = materialize(df.repartitionByRange(n_parts, *[F.col(k) for k in keys], *order)
                      .withColumn("_pid", F.spark_partition_id()))
    counts = r.groupBy("_pid", *keys).agg(F.count(F.lit(1)).alias("_c"))
    prev = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", *keys, F.coalesce(F.sum("_c").over(prev), F.lit(0)).alias("_off"))
    local = F.row_number().over(Window.partitionBy("_pid", *keys).orderBy(*order))
    return (r.withColumn("_rn", local).join(offsets, ["_pid", *keys])
             .withColumn(pos_col, F.col("_off") + F.col("_rn")).drop("_pid", "_rn", "_off"))


def quantiles_by_key(df: DataFrame, keys: list[str], value: str, qs: list[float]) -> DataFrame:
    """Exact quantiles with linear interpolation (as ``percentile``) per key, by a histogram of the values.

    Rows are counted per (key, value) before anything is shuffled, so a value that fills a third of
    the rows is one row. The distinct values are ranged by (keys, value) and written once; a running
    sum within each range and the sums of earlier ranges give the positions that a value covers. One
    pass over them finds both neighbours of every quantile: no group is held in one task.

    Returns (keys..., q, quantile); NULL values are ignored; keys without values are absent (with no
    keys, an empty input gives no rows)."""
    from workrisk.session import write_stage
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    ranged = write_stage(counts.repartitionByRange(*[F.col(k) for k in keys], F.col("_v"))
                         .withColumn("_pid", F.spark_partition_id()))
    # one row for each range and key in it
    spans = ranged.groupBy("_pid", *keys).agg(F.sum("_c").alias("_span"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(F.col("_pid").alias("_p"), *[F.col(k).alias(f"_k_{k}") for k in keys],
                         F.sum("_span").over(whole).alias("_n"), F.coalesce(F.sum("_span").over(before), F.lit(0)).alias("_off"))
    here = (F.col("_pid") == F.col("_p"))
    for k in keys:
        here = here & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    running = Window.partitionBy("_pid", *keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (ranged.withColumn("_to", F.sum("_c").over(running)).join(spans, here)
              .withColumn("_to", F.col("_off") + F.col("_to")).withColumn("_from", F.col("_to") - F.col("_c")))
    wanted = F.transform(F.array(*[F.lit(float(q)) for q in qs]), lambda q: F.struct(
        q.alias("q"), (F.floor((F.col("_n") - 1) * q) + 1).alias("lo"), (F.ceil((F.col("_n") - 1) * q) + 1).alias("hi")))
    covers = lambda at: (F.col("_from") < at) & (at <= F.col("_to"))
    hits = (placed.select(*keys, "_v", "_n", "_from", "_to", F.explode(F.filter(wanted, lambda w: covers(w["lo"]) | covers(w["hi"]))).alias("w"))
            .groupBy(*keys, F.col("w.q").alias("q"))
            .agg(F.max(F.when(covers(F.col("w.lo")), F.col("_v"))).alias("_lo"),
                 F.max(F.when(covers(F.col("w.hi")), F.col("_v"))).alias("_hi"), F.first("_n").alias("_n")))
    part = (F.col("_n") - 1) * F.col("q") - F.floor((F.col("_n") - 1) * F.col("q"))
    return hits.select(*keys, "q", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * part).alias("quantile"))


def scalar_quantiles(df: DataFrame, value: str, names: dict[str, float]) -> DataFrame:
    """One row with the named exact quantiles of a column (nulls without values), see ``quantiles_by_key``."""
    found = quantiles_by_key(df, [], value, sorted(set(names.values())))
    return found.agg(*[F.max(F.when(F.col("q") == float(q), F.col("quantile"))).alias(name) for name, q in names.items()])
