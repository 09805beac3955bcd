"""Distribution profiling (stage G): summaries, histogram, box stats, KDE, ECDF,
correlation, top-n and the label density along a score order.

Order-dependent outputs (ECDF, trailing windows) use global positions computed
without a single-partition window: rows are range-partitioned on the full
sort key, each partition is ranked locally, and partition offsets come from a
prefix sum over the (few) per-partition counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workrisk.operators.common import scalar_quantiles, with_scalars
from workrisk.session import materialize

HIST_BINS = 30
KDE_POINTS = 100
DENSITY_WINDOW = 20


def profile(df: DataFrame, col: str) -> DataFrame:
    """N, mean, sample std, min, p25, median, p75, max, IQR."""
    c = F.col(col)
    rest = df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))
    found = scalar_quantiles(df, col, {"p25": 0.25, "median": 0.5, "p75": 0.75})
    return (with_scalars(rest, found).withColumn("iqr", F.col("p75") - F.col("p25"))
            .select("n", "mean", "std", "min", "p25", "median", "p75", "max", "iqr"))


def histogram(df: DataFrame, col: str, bins: int = HIST_BINS) -> DataFrame:
    """Equal-width bins over [min, max] (last bin closed), count and density."""
    c = F.col(col)
    # a constant column gets a range of 1 around its value
    wide = F.when(F.min(c) == F.max(c), 0.5).otherwise(0.0)
    rng = (df.agg((F.min(c) - wide).alias("_lo"), (F.max(c) + wide).alias("_hi"), F.count(c).alias("_n")))
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.least(F.lit(bins), F.floor((c - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins) + 1)
    counts = with_scalars(df.filter(c.isNotNull()), rng).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = with_scalars(df.sparkSession.range(1, bins + 1).select(F.col("id").alias("bin")), rng)
    return (grid.join(counts, "bin", "left")
                .select("bin", (F.col("_lo") + (F.col("bin") - 1) * width).alias("bin_start"),
                        (F.col("_lo") + F.col("bin") * width).alias("bin_end"),
                        F.coalesce("count", F.lit(0)).alias("count"),
                        (F.coalesce("count", F.lit(0)) / (F.col("_n") * width)).alias("density")))


def box_stats(df: DataFrame, col: str) -> DataFrame:
    """T4: quartiles and 1.5 IQR whiskers (most extreme data inside the fences)."""
    c = F.col(col)
    q = scalar_quantiles(df, col, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    return (with_scalars(df, q).groupBy("q1", "median", "q3")
              .agg(F.min(F.when(c >= lo, c)).alias("whisker_low"), F.max(F.when(c <= hi, c)).alias("whisker_high"),
                   F.count_if((c < lo) | (c > hi)).alias("outliers")))


def kde(df: DataFrame, col: str, points: int = KDE_POINTS) -> DataFrame:
    """T5: Gaussian KDE with Scott's bandwidth (std * n^(-1/5)) on a grid over [min, max].

    Equal values are counted first; each distinct one is expanded to the fixed number of grid
    points (explode, not a join) and the kernel sums are aggregated per grid point.
    """
    c = F.col(col)
    s = (df.agg(F.min(c).alias("_lo"), F.max(c).alias("_hi"), F.count(c).alias("_n"),
                           F.stddev_samp(c).alias("_sd")))
    s = s.where(F.col("_sd") > 0)  # a constant column has no density
    h = F.col("_sd") * F.pow(F.col("_n"), F.lit(-0.2))
    g = F.col("_lo") + F.col("i") * (F.col("_hi") - F.col("_lo")) / (points - 1)
    k = F.exp(-0.5 * F.pow((g - c) / h, 2)) / (h * math.sqrt(2 * math.pi))
    values = df.filter(c.isNotNull()).groupBy(c.alias(col)).agg(F.count(F.lit(1)).alias("_times"))
    return (with_scalars(values, s)
              .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
              .groupBy("i", "_lo", "_hi", "_n")
              .agg(F.sum(k * F.col("_times")).alias("_k"))
              .select(F.col("i").cast("bigint").alias("point"), g.alias("x"), (F.col("_k") / F.col("_n")).alias("density")))


def global_positions(df: DataFrame, order: list[Column], partitions: int | None = None,
                     pos_col: str = "pos") -> DataFrame:
    """1-based position of every row under a total order, without a global window."""
    n_parts = partitions or df.sparkSession.sparkContext.defaultParallelism
    # rows and their range partition id are materialised together, so that the
    # counts and the local ranks see one and the same range assignment
    r = materialize(df.repartitionByRange(n_parts, *order).withColumn("_pid", F.spark_partition_id()))
    counts = r.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"))
    offsets = counts.withColumn("_off", F.coalesce(
        F.sum("_c").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = F.row_number().over(Window.partitionBy("_pid").orderBy(*order))
    # offsets: one row per range partition (bounded by the partition count)
    return (r.withColumn("_rn", local).join(F.broadcast(offsets.select("_pid", "_off")), "_pid")
             .withColumn(pos_col, F.col("_off") + F.col("_rn")).drop("_pid", "_rn", "_off"))


def ecdf(df: DataFrame, col: str, tiebreak: str) -> DataFrame:
    """y = i / n in sort order (ties are not merged)."""
    pos = global_positions(df.filter(F.col(col).isNotNull()), [F.col(col).asc(), F.col(tiebreak).asc()])
    n = (df.agg(F.count(col).alias("_n")))
    return with_scalars(pos, n).select(tiebreak, col, "pos", (F.col("pos") / F.col("_n")).alias("ecdf"))


def label_density(df: DataFrame, score: str, label: str, key: str, window: int = DENSITY_WINDOW) -> DataFrame:
    """Trailing ``window``-row label sum along score descending (NULL until full).

    sum(pos-window+1 .. pos) = prefix(pos) - prefix(pos - window); prefix sums
    come from partition-local running sums plus partition offsets, and the
    lagged prefix is an equi-join on position - no single-partition window.
    """
    order = [F.col(score).desc_nulls_last(), F.col(key).asc()]
    n_parts = df.sparkSession.sparkContext.defaultParallelism
    r = materialize(df.repartitionByRange(n_parts, *order).withColumn("_pid", F.spark_partition_id()))
    w_local = Window.partitionBy("_pid").orderBy(*order)
    r = (r.withColumn("_rn", F.row_number().over(w_local))
          .withColumn("_run", F.sum(F.col(label)).over(w_local.rowsBetween(Window.unboundedPreceding, 0))))
    parts = r.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"), F.sum(label).alias("_s"))
    prev = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_pid", F.coalesce(F.sum("_c").over(prev), F.lit(0)).alias("_off"),
                           F.coalesce(F.sum("_s").over(prev), F.lit(0)).alias("_soff"))
    p = (r.join(F.broadcast(offsets), "_pid")
          .select(key, score, label, (F.col("_off") + F.col("_rn")).alias("pos"),
                  (F.col("_soff") + F.col("_run")).alias("_prefix")))
    lag = p.select((F.col("pos") + window).alias("pos"), F.col("_prefix").alias("_lag"))
    return (p.join(lag, "pos", "left")
             .withColumn("label_sum", F.when(F.col("pos") >= window,
                                             F.col("_prefix") - F.coalesce("_lag", F.lit(0))))
             .select(key, score, label, "pos", "label_sum"))


def n_largest(df: DataFrame, col: str, n: int, tiebreak: str, smallest: bool = False) -> DataFrame:
    """N largest (or smallest) values; ties broken by ``tiebreak``."""
    o = F.col(col).asc_nulls_last() if smallest else F.col(col).desc_nulls_last()
    w = Window.orderBy(o, F.col(tiebreak).asc())
    # limit-based top-n: Spark plans TakeOrderedAndProject (per-partition top-n, then merge).
    return df.orderBy(o, F.col(tiebreak).asc()).limit(n).withColumn("rank", F.row_number().over(w).cast("bigint"))


def correlations(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Pearson correlation of column pairs."""
    return df.agg(*[F.corr(a, b).alias(f"corr_{a}__{b}") for a, b in pairs])
