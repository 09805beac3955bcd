"""Oracle CTEs (DuckDB SQL) for opportunity classification and the sector roll-up."""

from __future__ import annotations

from workrisk.plans import oracle_skills  # noqa: F401  (skills_risk CTE)
from workrisk.plans.sql import register

SIX = ["cognitive_skills", "social_skills", "operations_skills", "maintenance_skills", "technical_skills",
       "management_skills"]

register("opp_base", ("skills_risk",), f"""
  SELECT *, technical_skills / NULLIF({' + '.join(SIX)}, 0) AS technical_composition FROM skills_risk""")

_tscore = ("(CASE WHEN cognitive_skills >= 3.0 THEN 2 WHEN cognitive_skills >= 2.8 THEN 1 ELSE 0 END"
           " + CASE WHEN social_skills >= 2.5 AND social_skills <= 3.8 THEN 1 ELSE 0 END"
           " + CASE WHEN operations_skills <= 2.0 THEN 2 WHEN operations_skills <= 2.5 THEN 1 ELSE 0 END"
           " - CASE WHEN operations_skills >= 3.0 THEN 2 ELSE 0 END)")
_ebase = ("(cognitive_skills * 0.25 - operations_skills * 0.3 + technical_composition * 2.0"
          " + technical_skills * 0.15)")

register("opp_v2", ("opp_base",), f"""
  SELECT onet_code, title, technical_composition,
         CASE WHEN technical_composition <= 0.1165 THEN 'Low-Tech' WHEN technical_composition <= 0.1558
              THEN 'Medium-Tech' ELSE 'High-Tech' END AS Tech_Stratum,
         {', '.join(SIX)},
         CASE WHEN technical_composition > 0.1558 THEN 'Not Applicable'
              WHEN {_tscore} >= 4 THEN 'High Transformation Potential'
              WHEN {_tscore} >= 2 THEN 'Moderate Transformation Potential'
              WHEN {_tscore} >= 0 THEN 'Low Transformation Potential'
              ELSE 'Minimal Transformation Potential' END AS AI_Transformation_Classification,
         CASE WHEN technical_composition <= 0.1558 THEN 'Not Applicable'
              WHEN {_ebase} >= 2.0 THEN 'High Enhancement Potential'
              WHEN {_ebase} >= 1.5 THEN 'Moderate Enhancement Potential'
              WHEN {_ebase} >= 1.0 THEN 'Low Enhancement Potential'
              ELSE 'Minimal Enhancement Potential' END AS AI_Enhancement_Classification,
         CASE WHEN technical_composition > 0.13 THEN 0.0 ELSE greatest(0.0,
              (0.13 - technical_composition) * 10 + cognitive_skills * 0.4
              + CASE WHEN social_skills >= 2.5 AND social_skills <= 3.8 THEN social_skills * 0.3 ELSE 0.0 END
              + management_skills * 0.25 - operations_skills * 0.2) END AS transformation_score,
         CASE WHEN technical_composition <= 0.13 THEN 0.0 ELSE greatest(0.0, {_ebase}
              + CASE WHEN management_skills >= 2.5 THEN 0.4 WHEN management_skills >= 2.0 THEN 0.2 ELSE 0.0 END)
              END AS enhancement_score
  FROM opp_base""")

register("opp_hp", ("opp_v2",), """
  SELECT OCC_CODE FROM (
    SELECT *, split_part(onet_code, '.', 1) AS OCC_CODE,
           row_number() OVER (PARTITION BY split_part(onet_code, '.', 1) ORDER BY onet_code) AS rn FROM opp_v2)
  WHERE rn = 1 AND AI_Transformation_Classification = 'High Transformation Potential'
    AND Tech_Stratum IN ('Low-Tech', 'Medium-Tech')""")

register("job_risk", ("skills_risk",), """
  SELECT *, automation_risk_score >= risk_threshold AS perc_ile_thresholded_risk FROM (
    SELECT * EXCLUDE (rn), quantile_cont(automation_risk_score, 0.8) OVER () AS risk_threshold FROM (
      SELECT *, split_part(onet_code, '.', 1) AS OCC_CODE,
             row_number() OVER (PARTITION BY split_part(onet_code, '.', 1) ORDER BY onet_code) AS rn
      FROM skills_risk) WHERE rn = 1)""")

register("sector_d", ("sector",), """
  SELECT OCC_CODE, sector FROM (
    SELECT *, split_part(onet_code, '.', 1) AS OCC_CODE,
           row_number() OVER (PARTITION BY split_part(onet_code, '.', 1) ORDER BY onet_code) AS rn FROM sector)
  WHERE rn = 1""")

register("detailed", ("occupations", "sector_d", "job_risk"), """
  SELECT *, CAST(trunc(coalesce(TOT_EMP * displacement_rate, 0.0)) AS BIGINT) AS RISK_EMP,
         CAST(trunc(coalesce(economic_value * displacement_rate, 0.0)) AS BIGINT) AS AT_RISK_ECONOMIC_VALUE
  FROM (SELECT o.*, s.sector, coalesce(j.automation_risk_score, m.med) AS automation_risk_score,
               coalesce(j.perc_ile_thresholded_risk, false) AS perc_ile_thresholded_risk, j.adoption_rate,
               j.adoption_rate * (coalesce(j.automation_risk_score, m.med) / 100.0) AS displacement_rate
        FROM occupations o LEFT JOIN sector_d s ON o.OCC_CODE = s.OCC_CODE
        LEFT JOIN job_risk j ON o.OCC_CODE = j.OCC_CODE,
        (SELECT quantile_cont(j2.automation_risk_score, 0.5) AS med FROM occupations o2
         LEFT JOIN job_risk j2 ON o2.OCC_CODE = j2.OCC_CODE) m)""")

register("detailed_opp", ("detailed", "opp_hp"), """
  SELECT d.*, (h.OCC_CODE IS NOT NULL) AS is_opp FROM detailed d LEFT JOIN opp_hp h ON d.OCC_CODE = h.OCC_CODE""")

register("sector_roll", ("detailed_opp",), """
  SELECT CASE WHEN grouping(AREA_TITLE) = 0 THEN AREA_TITLE ELSE 'National' END AS area, sector,
         coalesce(sum(TOT_EMP), 0.0) AS employment, coalesce(sum(economic_value), 0.0) AS economic_value,
         CAST(coalesce(sum(CASE WHEN perc_ile_thresholded_risk THEN RISK_EMP END), 0) AS BIGINT) AS risk_employment,
         CAST(coalesce(sum(CASE WHEN perc_ile_thresholded_risk THEN AT_RISK_ECONOMIC_VALUE END), 0) AS BIGINT)
           AS risk_economic_value,
         CAST(count_if(perc_ile_thresholded_risk) AS BIGINT) AS risk_occupations,
         coalesce(sum(CASE WHEN is_opp THEN TOT_EMP END), 0.0) AS opportunity_employment,
         coalesce(sum(CASE WHEN is_opp THEN economic_value END), 0.0) AS opportunity_economic_value,
         CAST(count_if(is_opp) AS BIGINT) AS opportunity_occupations,
         coalesce(coalesce(sum(CASE WHEN perc_ile_thresholded_risk THEN RISK_EMP END), 0)
                  / NULLIF(coalesce(sum(TOT_EMP), 0.0), 0) * 100.0, 0.0) AS risk_impact_pct,
         coalesce(coalesce(sum(CASE WHEN is_opp THEN TOT_EMP END), 0.0)
                  / NULLIF(coalesce(sum(TOT_EMP), 0.0), 0) * 100.0, 0.0) AS opportunity_impact_pct
  FROM detailed_opp WHERE sector IS NOT NULL
  GROUP BY GROUPING SETS ((AREA_TITLE, sector), (sector))""")

register("area_roll", ("detailed_opp",), """
  SELECT *, total_jobs_at_risk / NULLIF(total_jobs, 0) * 100.0 AS total_jobs_at_risk_percentage,
         total_economic_value_at_risk / NULLIF(total_economic_value, 0) * 100.0
           AS total_economic_value_at_risk_percentage,
         total_jobs_opportunity / NULLIF(total_jobs, 0) * 100.0 AS total_jobs_opportunity_percentage,
         total_economic_value_opportunity / NULLIF(total_economic_value, 0) * 100.0
           AS total_economic_value_opportunity_percentage
  FROM (SELECT CASE WHEN grouping(AREA_TITLE) = 0 THEN AREA_TITLE ELSE 'National' END AS state,
               coalesce(sum(TOT_EMP), 0.0) AS total_jobs, coalesce(sum(economic_value), 0.0) AS total_economic_value,
               coalesce(sum(CASE WHEN perc_ile_thresholded_risk THEN TOT_EMP END), 0.0) AS total_jobs_at_risk,
               coalesce(sum(CASE WHEN perc_ile_thresholded_risk THEN economic_value END), 0.0)
                 AS total_economic_value_at_risk,
               coalesce(sum(CASE WHEN is_opp THEN TOT_EMP END), 0.0) AS total_jobs_opportunity,
               coalesce(sum(CASE WHEN is_opp THEN economic_value END), 0.0) AS total_economic_value_opportunity
        FROM detailed_opp GROUP BY GROUPING SETS ((AREA_TITLE), ()))""")


def _top(kind: str, by: str, emp: str, ev: str, cond: str) -> str:
    col = "employment" if by == "employment" else "economic_value"
    return f"""
    SELECT '{kind}' AS kind, '{by}' AS ranked_by, area, sector, rank, OCC_CODE, OCC_TITLE, src_area,
           employment, economic_value FROM (
      SELECT *, row_number() OVER (PARTITION BY area, sector ORDER BY {col} DESC NULLS LAST, OCC_CODE, src_area) AS rank
      FROM (SELECT AREA_TITLE AS src_area, sector, OCC_CODE, OCC_TITLE, CAST({emp} AS DOUBLE) AS employment,
                   CAST({ev} AS DOUBLE) AS economic_value, lvl.area_kind,
                   CASE WHEN lvl.area_kind = 'a' THEN AREA_TITLE ELSE 'National' END AS area
            FROM detailed_opp, (VALUES ('a'), ('n')) lvl(area_kind) WHERE sector IS NOT NULL AND {cond}))
    WHERE rank <= 5"""


register("top5", ("detailed_opp",), " UNION ALL ".join([
    _top("risk", "employment", "RISK_EMP", "AT_RISK_ECONOMIC_VALUE", "perc_ile_thresholded_risk"),
    _top("risk", "economic_value", "RISK_EMP", "AT_RISK_ECONOMIC_VALUE", "perc_ile_thresholded_risk"),
    _top("opportunity", "employment", "TOT_EMP", "economic_value", "is_opp"),
    _top("opportunity", "economic_value", "TOT_EMP", "economic_value", "is_opp")]))
