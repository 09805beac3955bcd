"""Queries of the profiling stage."""

from __future__ import annotations

from pyspark.sql import functions as F

from workrisk.operators import profiling as P
from workrisk.plans.registry import query
from workrisk.sources import domain

COL = "tech_intensity_score"


@query("profile", sql=f"""
  SELECT count({COL}) AS n, avg({COL}) AS mean, stddev_samp({COL}) AS std, min({COL}) AS min,
         quantile_cont({COL}, 0.25) AS p25, median({COL}) AS median, quantile_cont({COL}, 0.75) AS p75,
         max({COL}) AS max, quantile_cont({COL}, 0.75) - quantile_cont({COL}, 0.25) AS iqr FROM all_tech""",
       views=("all_tech",), rounded=("mean", "std", "min", "p25", "median", "p75", "max", "iqr"), group="profile",
       ops=("T2",))
def profile(spark, d):
    return P.profile(domain.all_tech(spark, d), COL)


@query("histogram", sql=f"""
  SELECT b.i AS bin, lo + (b.i - 1) * (hi - lo) / 30 AS bin_start, lo + b.i * (hi - lo) / 30 AS bin_end,
         coalesce(c.cnt, 0) AS count, coalesce(c.cnt, 0) / (n * ((hi - lo) / 30)) AS density
  FROM range(1, 31) b(i)
  CROSS JOIN (SELECT min({COL}) AS lo, max({COL}) AS hi, count({COL}) AS n FROM all_tech) s
  LEFT JOIN (SELECT least(30, CAST(floor((t.{COL} - s2.lo) / (s2.hi - s2.lo) * 30) AS BIGINT) + 1) AS bin,
                    count(*) AS cnt
             FROM all_tech t, (SELECT min({COL}) AS lo, max({COL}) AS hi FROM all_tech) s2
             WHERE t.{COL} IS NOT NULL GROUP BY 1) c ON c.bin = b.i""", views=("all_tech",),
       rounded=("bin_start", "bin_end", "density"), group="profile", ops=("T3",))
def histogram(spark, d):
    return P.histogram(domain.all_tech(spark, d), COL)


@query("box_stats", sql=f"""
  SELECT q1, median, q3, min({COL}) FILTER (WHERE {COL} >= q1 - 1.5 * (q3 - q1)) AS whisker_low,
         max({COL}) FILTER (WHERE {COL} <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
         CAST(count_if({COL} < q1 - 1.5 * (q3 - q1) OR {COL} > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS outliers
  FROM all_tech, (SELECT quantile_cont({COL}, 0.25) AS q1, median({COL}) AS median,
                     quantile_cont({COL}, 0.75) AS q3 FROM all_tech) q
  GROUP BY q1, median, q3""", views=("all_tech",), rounded=("q1", "median", "q3"), group="profile", ops=("T4",))
def box_stats(spark, d):
    return P.box_stats(domain.all_tech(spark, d), COL)


@query("kde", sql=f"""
  SELECT i AS point, lo + i * (hi - lo) / 99 AS x,
         sum(exp(-0.5 * pow(((lo + i * (hi - lo) / 99) - {COL}) / h, 2)) / (h * sqrt(2 * pi()))) / n AS density
  FROM all_tech, range(0, 100) g(i),
       (SELECT min({COL}) AS lo, max({COL}) AS hi, count({COL}) AS n,
               stddev_samp({COL}) * pow(count({COL}), -0.2) AS h FROM all_tech) s
  WHERE {COL} IS NOT NULL GROUP BY i, lo, hi, n""", views=("all_tech",), rounded=("x", "density"), places=6,
       group="profile", ops=("T5",))
def kde(spark, d):
    return P.kde(domain.all_tech(spark, d), COL)


@query("ecdf", sql="""
  SELECT SOC_Code, hot_tech_ratio, row_number() OVER (ORDER BY hot_tech_ratio, SOC_Code) AS pos,
         row_number() OVER (ORDER BY hot_tech_ratio, SOC_Code) / count(*) OVER () AS ecdf
  FROM all_tech WHERE hot_tech_ratio IS NOT NULL""", views=("all_tech",), rounded=("ecdf",), group="profile",
       ops=("T6",))
def ecdf(spark, d):
    return P.ecdf(domain.all_tech(spark, d), "hot_tech_ratio", "SOC_Code")


@query("correlation", sql="""
  SELECT corr(tech_intensity_score, hot_tech_ratio) AS corr_tech_intensity_score__hot_tech_ratio,
         corr(tech_intensity_score, total_technologies) AS corr_tech_intensity_score__total_technologies,
         corr(hot_tech_ratio, hot_technologies) AS corr_hot_tech_ratio__hot_technologies FROM all_tech""",
       views=("all_tech",), rounded=("corr_tech_intensity_score__hot_tech_ratio",
                                  "corr_tech_intensity_score__total_technologies",
                                  "corr_hot_tech_ratio__hot_technologies"), places=6, group="profile", ops=("T7",))
def correlation(spark, d):
    return P.correlations(domain.all_tech(spark, d), [("tech_intensity_score", "hot_tech_ratio"),
                                                  ("tech_intensity_score", "total_technologies"),
                                                  ("hot_tech_ratio", "hot_technologies")])


@query("label_density", sql="""
  SELECT doc_id, score, label, row_number() OVER w AS pos,
         CASE WHEN count(*) OVER w20 = 20 THEN CAST(sum(label) OVER w20 AS BIGINT) END AS label_sum
  FROM score_labels
  WINDOW w AS (ORDER BY score DESC NULLS LAST, doc_id),
         w20 AS (ORDER BY score DESC NULLS LAST, doc_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
       views=("score_labels",), group="profile", ops=("W16", "M17"))
def label_density(spark, d):
    r = P.label_density(domain.score_labels(spark, d), "score", "label", "doc_id")
    return r.withColumn("label_sum", F.col("label_sum").cast("bigint"))


@query("label_count", sql="SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS positives FROM score_labels",
       views=("score_labels",), group="profile", ops=("A18",))
def label_count(spark, d):
    s = domain.score_labels(spark, d)
    return s.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("bigint")).alias("positives"))


@query("n_largest", sql=f"""
  SELECT SOC_Code, {COL}, hot_tech_ratio, row_number() OVER (ORDER BY {COL} DESC NULLS LAST, SOC_Code) AS rank
  FROM all_tech QUALIFY rank <= 10""", views=("all_tech",), group="profile", ops=("W18", "W17"))
def n_largest(spark, d):
    t = domain.all_tech(spark, d).select("SOC_Code", COL, "hot_tech_ratio")
    return P.n_largest(t, COL, 10, "SOC_Code")


@query("n_smallest", sql="""
  SELECT SOC_Code, hot_tech_ratio, row_number() OVER (ORDER BY hot_tech_ratio ASC NULLS LAST, SOC_Code) AS rank
  FROM all_tech QUALIFY rank <= 10""", views=("all_tech",), group="profile", ops=("W18",))
def n_smallest(spark, d):
    t = domain.all_tech(spark, d).select("SOC_Code", "hot_tech_ratio")
    return P.n_largest(t, "hot_tech_ratio", 10, "SOC_Code", smallest=True)
