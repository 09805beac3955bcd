"""Queries of the dashboard stage."""

from __future__ import annotations

from pyspark.sql import functions as F

from workrisk.operators import dashboards as DB
from workrisk.plans.q_exposure import _result, _summary
from workrisk.plans.registry import query

_top = """
  SELECT AREA_TITLE, '{kind}' AS kind, rank, SOC_Code_Cleaned, OCC_TITLE, value, TOT_EMP FROM (
    SELECT *, row_number() OVER (PARTITION BY AREA_TITLE ORDER BY value DESC NULLS LAST, TOT_EMP DESC NULLS LAST,
                                 SOC_Code_Cleaned) AS rank
    FROM (SELECT *, {expr} AS value FROM occupations)) WHERE rank <= 10"""


@query("area_rank", sql="""
  SELECT state, current_ratio, rank, n_areas, printf('%d of %d', rank, n_areas) AS ranking,
         100.0 - rank / n_areas * 100.0 AS percentile
  FROM (SELECT state, current_ratio, row_number() OVER (ORDER BY current_ratio DESC NULLS LAST, state) AS rank,
               count(*) OVER () AS n_areas FROM summary)""", views=("summary",),
       rounded=("current_ratio", "percentile"), group="dashboards", ops=("W4", "D2"))
def area_rank(spark, d):
    return DB.area_rank(_summary(spark, d)).withColumn("rank", F.col("rank").cast("bigint"))


@query("top_occupations", sql=" UNION ALL ".join(
    _top.format(kind=k, expr=e) for k, e in (
        ("potential", "automation_susceptibility"), ("current", "enhanced_automation_risk"),
        ("gap", "automation_susceptibility - enhanced_automation_risk"))),
       views=("occupations",), rounded=("value",), money=("TOT_EMP",), group="dashboards", ops=("W6", "W7", "D4"))
def top_occupations(spark, d):
    return DB.top_occupations(_result(spark, d).occupations)


@query("wage_quartiles", sql="""
  SELECT AREA_TITLE, wage_quartile, total_employment, potential_employment_at_risk, current_employment_at_risk,
         average_wage,
         CASE WHEN total_employment > 0 THEN potential_employment_at_risk / total_employment * 100 ELSE 0.0 END
           AS potential_risk_percentage,
         CASE WHEN total_employment > 0 THEN current_employment_at_risk / total_employment * 100 ELSE 0.0 END
           AS current_risk_percentage,
         CASE WHEN total_employment > 0 THEN wp / total_employment ELSE 0.0 END AS weighted_potential_risk,
         CASE WHEN total_employment > 0 THEN wc / total_employment ELSE 0.0 END AS weighted_current_risk,
         CASE WHEN total_employment > 0 THEN wp / total_employment ELSE 0.0 END
           - CASE WHEN total_employment > 0 THEN wc / total_employment ELSE 0.0 END AS automation_gap
  FROM (SELECT AREA_TITLE, wage_quartile, coalesce(sum(TOT_EMP), 0.0) AS total_employment,
               coalesce(sum(CASE WHEN automation_susceptibility > 60 THEN TOT_EMP END), 0.0)
                 AS potential_employment_at_risk,
               coalesce(sum(CASE WHEN enhanced_automation_risk > 60 THEN TOT_EMP END), 0.0)
                 AS current_employment_at_risk,
               coalesce(sum(automation_susceptibility * TOT_EMP), 0.0) AS wp,
               coalesce(sum(enhanced_automation_risk * TOT_EMP), 0.0) AS wc, avg(A_MEAN) AS average_wage
        FROM (SELECT o.*, CASE WHEN A_MEAN IS NULL THEN NULL WHEN A_MEAN <= e[1] THEN 'Lower Wage'
                               WHEN A_MEAN <= e[2] THEN 'Lower-Middle Wage' WHEN A_MEAN <= e[3] THEN 'Upper-Middle Wage'
                               ELSE 'Higher Wage' END AS wage_quartile
              FROM occupations o JOIN (SELECT AREA_TITLE, quantile_cont(A_MEAN, [0.25, 0.5, 0.75]) AS e
                                       FROM occupations GROUP BY AREA_TITLE) q ON o.AREA_TITLE = q.AREA_TITLE)
        WHERE wage_quartile IS NOT NULL GROUP BY AREA_TITLE, wage_quartile)""", views=("occupations",),
       rounded=("potential_risk_percentage", "current_risk_percentage", "weighted_potential_risk",
                "weighted_current_risk", "automation_gap"),
       money=("total_employment", "potential_employment_at_risk", "current_employment_at_risk", "average_wage"),
       group="dashboards", ops=("A15", "M16"))
def wage_quartiles(spark, d):
    return DB.wage_quartiles(_result(spark, d).occupations)


@query("risk_distribution", sql="""
  SELECT g.*, employment / NULLIF(te, 0) * 100.0 AS employment_share,
         economic_value / NULLIF(tv, 0) * 100.0 AS value_share,
         CAST(coalesce(list_position(['Very High', 'High', 'Moderate', 'Low', 'Very Low'], category) - 1, 99)
              AS BIGINT) AS category_order
  FROM (SELECT AREA_TITLE, kind, category, sum(employment) AS employment, sum(economic_value) AS economic_value FROM (
          SELECT AREA_TITLE, kind, category, coalesce(sum(TOT_EMP), 0.0) AS employment,
                 coalesce(sum(economic_value), 0.0) AS economic_value FROM d GROUP BY ALL
          UNION ALL
          SELECT AREA_TITLE, kind, c, 0.0, 0.0
          FROM (SELECT DISTINCT AREA_TITLE, kind, unnest(['Very High', 'High', 'Moderate', 'Low', 'Very Low']) AS c
                FROM d) z) GROUP BY ALL) g
  JOIN (SELECT AREA_TITLE, kind, coalesce(sum(TOT_EMP), 0.0) AS te, coalesce(sum(economic_value), 0.0) AS tv
        FROM d GROUP BY ALL) t USING (AREA_TITLE, kind)""".replace(
    "FROM d", "FROM (SELECT AREA_TITLE, 'potential' AS kind, automation_risk_category AS category, TOT_EMP, "
              "economic_value FROM occupations UNION ALL SELECT AREA_TITLE, 'current', enhanced_risk_category, "
              "TOT_EMP, economic_value FROM occupations) d"), views=("occupations",),
       rounded=("employment_share", "value_share"), money=("employment", "economic_value"),
       group="dashboards", ops=("A13", "P34", "D3", "U5"))
def risk_distribution(spark, d):
    return DB.risk_distribution(_result(spark, d).occupations)


@query("similar_areas", sql="""
  SELECT state, rank, similar_state, current_index, difference FROM (
    SELECT a.state, b.state AS similar_state, b.current_ratio AS current_index,
           b.current_ratio - a.current_ratio AS difference,
           row_number() OVER (PARTITION BY a.state ORDER BY abs(b.current_ratio - a.current_ratio), b.state) AS rank
    FROM summary a JOIN summary b ON a.state <> b.state AND b.current_ratio >= a.current_ratio * 0.75
                                  AND b.current_ratio <= a.current_ratio * 1.25) WHERE rank <= 5""",
       views=("summary",), rounded=("current_index", "difference"), group="dashboards", ops=("J14", "W14", "D7"))
def similar_areas(spark, d):
    return DB.similar_areas(_summary(spark, d)).withColumn("rank", F.col("rank").cast("bigint"))


@query("projection", sql="""
  SELECT state, h.horizon, h.timeframe, current_ratio + automation_gap * h.closure AS current_index,
         (current_ratio + automation_gap * h.closure) / 100.0 * economic_value_total AS economic_value_at_risk,
         CASE WHEN current_ratio > 0
              THEN (current_ratio + automation_gap * h.closure) / current_ratio * current_employment_at_risk
              ELSE (current_ratio + automation_gap * h.closure) / 100.0 * total_employment END AS employment_at_risk
  FROM summary, (VALUES ('short_term', '12 months', 0.5), ('medium_term', '3 years', 0.75),
                        ('long_term', '5 years', 0.9)) h(horizon, timeframe, closure)""", views=("summary",),
       rounded=("current_index",), money=("economic_value_at_risk", "employment_at_risk"),
       group="dashboards", ops=("P29", "D6", "P27"))
def projection(spark, d):
    return DB.projections(_summary(spark, d))


@query("national_overview", sql="""
  SELECT avg(current_ratio) AS current_index, avg(potential_ratio) AS potential_index,
         avg(automation_gap) AS automation_gap, sum(current_economic_value_at_risk) AS total_economic_value_at_risk,
         sum(current_employment_at_risk) AS total_employment_at_risk, sum(economic_value_total) AS total_economic_value,
         sum(total_employment) AS total_employment,
         CASE WHEN sum(economic_value_total) > 0
              THEN sum(current_economic_value_at_risk) / sum(economic_value_total) * 100 ELSE 0.0 END
           AS percentage_of_economy_at_risk,
         CASE WHEN sum(total_employment) > 0
              THEN sum(current_employment_at_risk) / sum(total_employment) * 100 ELSE 0.0 END
           AS percentage_of_workforce_at_risk,
         count(*) AS n_areas FROM summary""", views=("summary",),
       rounded=("current_index", "potential_index", "automation_gap", "percentage_of_economy_at_risk",
                "percentage_of_workforce_at_risk"),
       money=("total_economic_value_at_risk", "total_employment_at_risk", "total_economic_value", "total_employment"),
       group="dashboards", ops=("A16",))
def national_overview(spark, d):
    return DB.national_overview(_summary(spark, d))


_METRICS = """
  SELECT * EXCLUDE (n), potential_index - current_index AS automation_gap, current_index * 2 AS projected_index FROM (
    SELECT CASE WHEN sum(economic_value_total) > 0
                THEN sum(current_ratio * economic_value_total) / sum(economic_value_total)
                ELSE avg(current_ratio) END AS current_index,
           CASE WHEN sum(economic_value_total) > 0
                THEN sum(potential_ratio * economic_value_total) / sum(economic_value_total)
                ELSE avg(potential_ratio) END AS potential_index,
           sum(current_economic_value_at_risk) / 1e9 AS economic_value_at_risk,
           sum(current_employment_at_risk) / 1e6 AS workers_at_risk, count(*) AS n FROM summary) WHERE n > 0"""


@query("national_metrics", sql=_METRICS, views=("summary",),
       rounded=("current_index", "potential_index", "automation_gap", "projected_index", "economic_value_at_risk",
                "workers_at_risk"), group="dashboards", ops=("A12",))
def national_metrics(spark, d):
    return DB.national_metrics(_summary(spark, d))


@query("national_distribution", sql="""
  SELECT CAST(coalesce(list_position(['Very High', 'High', 'Moderate', 'Low', 'Very Low'], label) - 1, 99)
              AS BIGINT) AS position, label, employment,
         CASE WHEN t > 0 THEN employment / t * 100 ELSE 0.0 END AS percentage
  FROM (SELECT *, sum(employment) OVER () AS t FROM (
          SELECT label, sum(e) AS employment FROM (
            SELECT automation_risk_category AS label, coalesce(TOT_EMP, 0.0) AS e FROM occupations
            UNION ALL SELECT unnest(['Very High', 'High', 'Moderate', 'Low', 'Very Low']), 0.0) GROUP BY label))""",
       views=("occupations",), rounded=("percentage",), money=("employment",), group="dashboards", ops=("A13", "P34"))
def national_distribution(spark, d):
    return DB.national_distribution(_result(spark, d).occupations)


@query("area_extremes", sql="""
  SELECT state, value, rank, list FROM (
    SELECT state, current_ratio AS value, row_number() OVER (ORDER BY current_ratio DESC NULLS LAST, state) AS rank,
           'highest_risk' AS list FROM summary
    UNION ALL SELECT state, current_ratio, row_number() OVER (ORDER BY current_ratio ASC NULLS LAST, state),
           'lowest_risk' FROM summary
    UNION ALL SELECT state, automation_gap, row_number() OVER (ORDER BY automation_gap DESC NULLS LAST, state),
           'largest_gaps' FROM summary) WHERE rank <= 5""", views=("summary",), rounded=("value",),
       group="dashboards", ops=("W13", "W9"))
def area_extremes(spark, d):
    return DB.area_extremes(_summary(spark, d)).withColumn("rank", F.col("rank").cast("bigint"))


@query("group_average", sql="""
  SELECT minor_group, minor_group_name, count(*) AS n_areas, coalesce(sum(TOT_EMP), 0.0) AS TOT_EMP,
         coalesce(sum(economic_value), 0.0) AS economic_value,
         coalesce(sum(potential_econ_value_at_risk), 0.0) AS potential_econ_value_at_risk,
         avg(minor_current_index) AS minor_current_index, avg(minor_potential_index) AS minor_potential_index,
         avg(zapier_apps_per_worker) AS zapier_apps_per_worker, avg(automation_gap) AS automation_gap
  FROM groups GROUP BY minor_group, minor_group_name""", views=("groups",),
       rounded=("minor_current_index", "minor_potential_index", "zapier_apps_per_worker", "automation_gap"),
       money=("TOT_EMP", "economic_value", "potential_econ_value_at_risk"), group="dashboards", ops=("A10",))
def group_average(spark, d):
    return DB.group_averages(_result(spark, d).groups)


@query("occupation_gaps", sql="""
  SELECT * FROM (
    SELECT *, row_number() OVER (ORDER BY automation_gap DESC NULLS LAST, OCC_TITLE) AS rank FROM (
      SELECT OCC_TITLE, avg(automation_susceptibility) AS potential_risk, avg(enhanced_automation_risk) AS current_risk,
             avg(automation_susceptibility - enhanced_automation_risk) AS automation_gap,
             coalesce(sum(TOT_EMP), 0.0) AS employment, coalesce(sum(economic_value), 0.0) AS economic_value
      FROM occupations GROUP BY OCC_TITLE)) WHERE rank <= 10""", views=("occupations",),
       rounded=("potential_risk", "current_risk", "automation_gap"), money=("employment", "economic_value"),
       group="dashboards", ops=("A11", "W11"))
def occupation_gaps(spark, d):
    return DB.occupation_gaps(_result(spark, d).occupations).withColumn("rank", F.col("rank").cast("bigint"))


@query("area_group_chart", sql="""
  SELECT AREA_TITLE, rank, minor_group_name AS label, minor_current_index AS current, minor_potential_index AS potential,
         TOT_EMP AS employment, economic_value FROM (
    SELECT *, row_number() OVER (PARTITION BY AREA_TITLE ORDER BY minor_current_index DESC NULLS LAST, minor_group) AS rank
    FROM groups) WHERE rank <= 10""", views=("groups",), rounded=("current", "potential"), money=("employment", "economic_value"),
       group="dashboards", ops=("W10",))
def area_group_chart(spark, d):
    return DB.area_group_chart(_result(spark, d).groups)


@query("area_occupation_gaps", sql="""
  SELECT AREA_TITLE, rank, SOC_Code_Cleaned, OCC_TITLE, automation_susceptibility AS potential_risk,
         enhanced_automation_risk AS current_risk, automation_gap, TOT_EMP AS employment, economic_value FROM (
    SELECT *, automation_susceptibility - enhanced_automation_risk AS automation_gap,
           row_number() OVER (PARTITION BY AREA_TITLE ORDER BY automation_susceptibility - enhanced_automation_risk DESC NULLS LAST,
                              SOC_Code_Cleaned) AS rank FROM occupations) WHERE rank <= 10""", views=("occupations",),
       rounded=("potential_risk", "current_risk", "automation_gap"), money=("employment", "economic_value"), group="dashboards",
       ops=("W11",))
def area_occupation_gaps(spark, d):
    return DB.area_occupation_gaps(_result(spark, d).occupations)


@query("unpivot_indices", sql="""
  SELECT AREA_TITLE, minor_group_name, rank,
         CASE WHEN metric = 'minor_current_index' THEN 'Current Risk' ELSE 'Potential Risk' END AS metric, score
  FROM (SELECT AREA_TITLE, minor_group_name, rank, minor_current_index, minor_potential_index FROM (
          SELECT *, row_number() OVER (PARTITION BY AREA_TITLE ORDER BY potential_econ_value_at_risk DESC NULLS LAST,
                                       minor_group) AS rank FROM groups) WHERE rank <= 15)
  UNPIVOT INCLUDE NULLS (score FOR metric IN (minor_current_index, minor_potential_index))""", views=("groups",),
       rounded=("score",), group="dashboards", ops=("A20",))
def unpivot_indices(spark, d):
    return DB.unpivot_indices(_result(spark, d).groups)


@query("unpivot_national", sql="""
  SELECT minor_group_name, rank,
         CASE WHEN metric = 'minor_current_index' THEN 'Current Risk' ELSE 'Potential Risk' END AS metric, score
  FROM (SELECT * EXCLUDE (minor_group, v) FROM (
          SELECT *, row_number() OVER (ORDER BY v DESC NULLS LAST, minor_group) AS rank FROM (
            SELECT minor_group, minor_group_name, sum(potential_econ_value_at_risk) AS v,
                   avg(minor_current_index) AS minor_current_index,
                   avg(minor_potential_index) AS minor_potential_index
            FROM groups GROUP BY minor_group, minor_group_name)) WHERE rank <= 15)
  UNPIVOT INCLUDE NULLS (score FOR metric IN (minor_current_index, minor_potential_index))""", views=("groups",),
       rounded=("score",), group="dashboards", ops=("A20", "A10"))
def unpivot_national(spark, d):
    return DB.unpivot_national(_result(spark, d).groups)


@query("gap_groups", sql="""
  SELECT AREA_TITLE, rank, minor_group, minor_group_name, minor_current_index, minor_potential_index, automation_gap,
         TOT_EMP FROM (
    SELECT *, row_number() OVER (PARTITION BY AREA_TITLE ORDER BY automation_gap DESC NULLS LAST,
                                 minor_group) AS rank FROM groups) WHERE rank <= 10""", views=("groups",),
       rounded=("minor_current_index", "minor_potential_index", "automation_gap"), money=("TOT_EMP",),
       group="dashboards", ops=("W7", "D5"))
def gap_groups(spark, d):
    return DB.gap_groups(_result(spark, d).groups)


@query("gap_occupations", sql="""
  SELECT AREA_TITLE, rank, SOC_Code_Cleaned, OCC_TITLE, enhanced_automation_risk, automation_susceptibility,
         econ_potential_index, TOT_EMP, A_MEAN, economic_value FROM (
    SELECT *, row_number() OVER (PARTITION BY AREA_TITLE ORDER BY econ_potential_index DESC NULLS LAST,
                                 economic_value DESC NULLS LAST, SOC_Code_Cleaned) AS rank FROM occupations)
  WHERE rank <= 10""", views=("occupations",),
       rounded=("enhanced_automation_risk", "automation_susceptibility", "econ_potential_index"),
       money=("TOT_EMP", "A_MEAN", "economic_value"), group="dashboards", ops=("W7", "D5"))
def gap_occupations(spark, d):
    return DB.gap_occupations(_result(spark, d).occupations)


@query("area_comparison", sql="""
  SELECT state, current_ratio, ni AS national_current, current_ratio - ni AS current_differential,
         CASE WHEN current_ratio > ni THEN 'above' ELSE 'below' END AS current_comparison,
         potential_ratio, np AS national_potential, potential_ratio - np AS potential_differential,
         CASE WHEN potential_ratio > np THEN 'above' ELSE 'below' END AS potential_comparison,
         automation_gap, ng AS national_gap, automation_gap - ng AS gap_differential,
         CASE WHEN automation_gap > ng THEN 'above' ELSE 'below' END AS gap_comparison
  FROM summary, (SELECT avg(current_ratio) AS ni, avg(potential_ratio) AS np, avg(automation_gap) AS ng
                 FROM summary) n""",
       views=("summary",), rounded=("current_ratio", "national_current", "current_differential", "potential_ratio",
                                    "national_potential", "potential_differential", "automation_gap", "national_gap",
                                    "gap_differential"), group="dashboards", ops=("J15", "P27", "D7"))
def area_comparison(spark, d):
    return DB.comparison(_summary(spark, d))


@query("top_groups", sql="""
  SELECT AREA_TITLE, rank, minor_group, minor_group_name, minor_potential_index, minor_current_index, automation_gap,
         TOT_EMP, economic_value FROM (
    SELECT *, row_number() OVER (PARTITION BY AREA_TITLE ORDER BY minor_potential_index DESC NULLS LAST,
                                 minor_group) AS rank FROM groups) WHERE rank <= 10""", views=("groups",),
       rounded=("minor_potential_index", "minor_current_index", "automation_gap"), money=("TOT_EMP", "economic_value"),
       group="dashboards", ops=("W5", "D3"))
def top_groups(spark, d):
    return DB.top_groups(_result(spark, d).groups)


@query("coverage_opportunity", sql="""
  SELECT AREA_TITLE, rank, SOC_Code_Cleaned, OCC_TITLE, automation_susceptibility, mcp_coverage_norm,
         mcp_opportunity, TOT_EMP, economic_value FROM (
    SELECT *, row_number() OVER (PARTITION BY AREA_TITLE ORDER BY mcp_opportunity DESC NULLS LAST,
                                 SOC_Code_Cleaned) AS rank FROM (
      SELECT *, automation_susceptibility - mcp_coverage_norm AS mcp_opportunity FROM (
        SELECT *, CASE WHEN max(zapier_apps_per_worker) OVER (PARTITION BY AREA_TITLE) > 0
                       THEN zapier_apps_per_worker / max(zapier_apps_per_worker) OVER (PARTITION BY AREA_TITLE) * 100
                       ELSE 0.0 END AS mcp_coverage_norm FROM occupations)))
  WHERE rank <= 10""", views=("occupations",),
       rounded=("automation_susceptibility", "mcp_coverage_norm", "mcp_opportunity"),
       money=("TOT_EMP", "economic_value"), group="dashboards", ops=("P28", "W7", "D5"))
def coverage_opportunity(spark, d):
    return DB.coverage_opportunity(_result(spark, d).occupations)


@query("retraining", sql="""
  SELECT * FROM (
  WITH r AS (SELECT *, row_number() OVER (PARTITION BY AREA_TITLE ORDER BY econ_potential_index DESC NULLS LAST,
                                          SOC_Code_Cleaned) AS rk,
                    count(*) OVER (PARTITION BY AREA_TITLE) AS n,
                    CAST(trunc(count(*) OVER (PARTITION BY AREA_TITLE) * 0.25) AS BIGINT) AS q FROM occupations),
  top AS (SELECT * FROM r WHERE rk <= q AND rk <= 5 AND q > 0),
  low AS (SELECT * FROM r WHERE rk > n - q),
  alts AS (SELECT * FROM (
             SELECT t.AREA_TITLE, t.SOC_Code_Cleaned, l.rk AS lr, l.SOC_Code_Cleaned AS alt_code,
                    l.OCC_TITLE AS alt_title, l.A_MEAN AS alt_wage, l.econ_potential_index AS alt_score,
                    row_number() OVER (PARTITION BY t.AREA_TITLE, t.SOC_Code_Cleaned ORDER BY l.rk) AS alt_rank
             FROM top t JOIN low l ON t.AREA_TITLE = l.AREA_TITLE
              AND l.A_MEAN >= t.A_MEAN * (1 - 0.2) AND l.A_MEAN <= t.A_MEAN * (1 + 0.2)) WHERE alt_rank <= 3)
  SELECT t.AREA_TITLE, t.rk AS risk_rank, t.SOC_Code_Cleaned, t.OCC_TITLE, t.A_MEAN, t.econ_potential_index,
         t.TOT_EMP, a.alt_rank, a.alt_code, a.alt_title, a.alt_wage, a.alt_score
  FROM top t LEFT JOIN alts a ON t.AREA_TITLE = a.AREA_TITLE AND t.SOC_Code_Cleaned = a.SOC_Code_Cleaned)""",
       views=("occupations",), rounded=("econ_potential_index", "alt_score"), money=("A_MEAN", "TOT_EMP", "alt_wage"),
       group="dashboards", ops=("W8", "J13", "D5"))
def retraining(spark, d):
    return DB.retraining(_result(spark, d).occupations)


@query("synthetic_distribution", sql="""
  SELECT CAST(position AS BIGINT) AS position, label, employment, employment / t * 100 AS percentage FROM (
    SELECT p.position, p.label, t,
           CASE p.position WHEN 0 THEN a * 0.12 WHEN 1 THEN a * 0.28 WHEN 2 THEN a * 0.6
                           WHEN 3 THEN (t - a) * 0.65 ELSE (t - a) * 0.35 END AS employment
    FROM (SELECT sum(total_employment) AS t, sum(current_employment_at_risk) AS a FROM summary) s,
         (VALUES (0, 'Very High Risk'), (1, 'High Risk'), (2, 'Moderate Risk'), (3, 'Low Risk'),
                 (4, 'Very Low Risk')) p(position, label))""", views=("summary",), rounded=("percentage",),
       money=("employment",), group="dashboards", ops=("A14", "D9"))
def synthetic_distribution(spark, d):
    return DB.synthetic_distribution(_summary(spark, d))


_FIXED2 = ("(CASE WHEN CAST(round(({x}) * 100.0) AS BIGINT) < 0 THEN '-' ELSE '' END"
           " || CAST(abs(CAST(round(({x}) * 100.0) AS BIGINT)) // 100 AS VARCHAR) || '.'"
           " || lpad(CAST(abs(CAST(round(({x}) * 100.0) AS BIGINT)) % 100 AS VARCHAR), 2, '0'))")


def _fx(x: str) -> str:
    return _FIXED2.format(x=x)


@query("area_dashboard", sql=f"""
  SELECT state, current_ratio AS current_index, potential_ratio AS potential_index,
         potential_ratio - current_ratio AS automation_gap, total_employment,
         economic_value_total / 1e9 AS economic_value_billions,
         CASE WHEN apps IS NOT NULL THEN CAST(trunc(round(apps, 6)) AS BIGINT)
              ELSE CAST(trunc(total_employment * 1000 / 25000) AS BIGINT) END AS mcp_servers,
         current_ratio * 2 AS projected_index,
         'In ' || state || ', ' || {_fx('current_ratio')} || '% of economic value ($'
           || {_fx('economic_value_total / 1e9')} || 'B) is exposed today; potential exposure is '
           || {_fx('potential_ratio')} || '%, a gap of ' || {_fx('potential_ratio - current_ratio')}
           || ' points.' AS headline
  FROM summary s LEFT JOIN (SELECT AREA_TITLE, sum(estimated_zapier_apps) AS apps FROM groups GROUP BY 1) g
    ON s.state = g.AREA_TITLE""", views=("summary", "groups"),
       rounded=("current_index", "potential_index", "automation_gap", "economic_value_billions", "projected_index"),
       money=("total_employment",), group="dashboards", ops=("D10", "P30", "P31", "P32", "P14"))
def area_dashboard(spark, d):
    r = _result(spark, d)
    return DB.area_dashboard(_summary(spark, d), r.groups)


@query("top_risk_areas", sql="""
  SELECT * FROM (
    SELECT state, current_ratio AS current_index, current_economic_value_at_risk AS economic_value_at_risk,
           current_employment_at_risk AS workers_at_risk, potential_ratio AS potential_index,
           row_number() OVER (ORDER BY current_ratio DESC NULLS LAST, state) AS rank,
           potential_ratio - current_ratio AS automation_gap FROM summary) WHERE rank <= 10""", views=("summary",),
       rounded=("current_index", "potential_index", "automation_gap"),
       money=("economic_value_at_risk", "workers_at_risk"), group="dashboards", ops=("W9", "P14"))
def top_risk_areas(spark, d):
    return DB.top_risk_areas(_summary(spark, d))


_CHART = """
  SELECT * FROM (
    SELECT row_number() OVER (ORDER BY current DESC NULLS LAST, minor_group) AS rank, minor_group_name AS label,
           current, potential, employment, economic_value FROM (
      SELECT minor_group, minor_group_name, avg(automation_susceptibility) AS potential,
             avg(enhanced_automation_risk) AS current, coalesce(sum(TOT_EMP), 0.0) AS employment,
             coalesce(sum(economic_value), 0.0) AS economic_value FROM groups GROUP BY 1, 2)) WHERE rank <= 10"""


@query("industry_risk_chart", sql=_CHART, views=("groups",), rounded=("current", "potential"),
       money=("employment", "economic_value"), group="dashboards", ops=("W10", "A10"))
def industry_risk_chart(spark, d):
    return DB.industry_risk_chart(_result(spark, d).groups)


def _fx1(x: str) -> str:
    return ("(CASE WHEN CAST(round(({x}) * 10.0) AS BIGINT) < 0 THEN '-' ELSE '' END"
            " || CAST(abs(CAST(round(({x}) * 10.0) AS BIGINT)) // 10 AS VARCHAR) || '.'"
            " || CAST(abs(CAST(round(({x}) * 10.0) AS BIGINT)) % 10 AS VARCHAR))").format(x=x)


@query("key_insights", sql=f"""
  SELECT * FROM (
  WITH t AS (SELECT state, current_ratio AS v, row_number() OVER (ORDER BY current_ratio DESC NULLS LAST, state) AS rk
             FROM summary),
  c AS ({_CHART}),
  o AS ({_METRICS})
  SELECT 'regional' AS key, 'Areas' AS title, 'Highest current index: '
         || string_agg(state || ' (' || {_fx1('v')} || '%)', '; ' ORDER BY rk) || '.' AS content FROM t WHERE rk <= 3
  UNION ALL
  SELECT 'industry', 'Occupation groups', 'Most exposed groups by mean score, potential in brackets: '
         || string_agg(label || ' (' || {_fx1('potential')} || '%)', '; ' ORDER BY rank) || '.' FROM c WHERE rank <= 3
  UNION ALL
  SELECT 'projection', 'Outlook', 'Current index ' || {_fx('current_index')} || '%, twice that '
         || {_fx('projected_index')} || '%; potential lies ' || {_fx1('automation_gap')}
         || ' points above the current index.' FROM o) WHERE content IS NOT NULL""",
       views=("summary", "groups"), group="dashboards", ops=("P32",))
def key_insights(spark, d):
    r = _result(spark, d)
    s = _summary(spark, d)
    return DB.key_insights(DB.top_risk_areas(s), DB.industry_risk_chart(r.groups), DB.national_metrics(s))


@query("national_dashboard", sql=None, group="dashboards", ops=("D9",))
def national_dashboard(spark, d):
    r = _result(spark, d)
    return DB.national_dashboard(_summary(spark, d), r.groups)


@query("area_documents", sql=None, group="dashboards", ops=("D2", "D3", "D4", "D5", "D6", "D7"))
def area_documents(spark, d):
    r = _result(spark, d)
    return DB.area_documents(_summary(spark, d), r.groups, r.occupations)
