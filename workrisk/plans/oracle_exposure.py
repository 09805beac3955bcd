"""Oracle CTEs (DuckDB SQL) for the exposure-index chain."""

from __future__ import annotations

from workrisk.plans.sql import register

CLIP100 = "CASE WHEN {x} IS NULL THEN NULL ELSE greatest(0.0, least(100.0, {x})) END"
RISK_CAT = ("CASE WHEN {x} IS NULL THEN 'Unknown' WHEN {x} >= 80 THEN 'Very High' WHEN {x} >= 60 THEN 'High' "
            "WHEN {x} >= 40 THEN 'Moderate' WHEN {x} >= 20 THEN 'Low' ELSE 'Very Low' END")
LEVEL_RANK = ("coalesce(list_position(['detailed', 'broad', 'major', 'minor', 'total'], O_GROUP), 6)")


def clip100(x: str) -> str:
    return CLIP100.format(x=x)


def risk_cat(x: str) -> str:
    return RISK_CAT.format(x=x)


register("emp_clean", ("employment",), """
  SELECT AREA_TITLE, OCC_CODE, OCC_TITLE, O_GROUP,
         coalesce(replace(OCC_CODE, '-', ''), '') AS SOC_Code_Cleaned,
         try_cast(replace(trim(TOT_EMP), ',', '') AS DOUBLE) AS TOT_EMP,
         try_cast(replace(trim(A_MEAN), ',', '') AS DOUBLE) AS A_MEAN
  FROM employment""")

register("states", ("emp_clean",), """
  SELECT DISTINCT AREA_TITLE FROM emp_clean
  WHERE AREA_TITLE IS NOT NULL AND AREA_TITLE <> 'U.S.' AND NOT starts_with(AREA_TITLE, 'Metropolitan')
    AND NOT starts_with(AREA_TITLE, 'Nonmetropolitan') AND NOT contains(AREA_TITLE, ',')""")

register("occ_levels", ("emp_clean", "states"), """
  SELECT e.* FROM (
    SELECT x.*,
           count(*) OVER (PARTITION BY AREA_TITLE) AS n_all,
           count_if(O_GROUP = 'detailed') OVER (PARTITION BY AREA_TITLE) AS n_det,
           count_if(O_GROUP = 'broad') OVER (PARTITION BY AREA_TITLE) AS n_broad,
           count_if(O_GROUP = 'total') OVER (PARTITION BY AREA_TITLE) AS n_total,
           count_if(O_GROUP = 'detailed') OVER (PARTITION BY AREA_TITLE, substring(OCC_CODE, 1, 2)) > 0 AS det_p,
           count_if(O_GROUP = 'major') OVER (PARTITION BY AREA_TITLE, substring(OCC_CODE, 1, 2)) > 0 AS maj_p
    FROM emp_clean x WHERE AREA_TITLE IN (SELECT AREA_TITLE FROM states)) e
  WHERE CASE WHEN n_det > 0 THEN O_GROUP = 'detailed'
                  OR (n_det < n_all * 0.7 AND n_broad > 0 AND O_GROUP = 'broad' AND maj_p AND NOT det_p)
             WHEN n_broad > 0 THEN O_GROUP = 'broad'
             ELSE n_total = 0 OR O_GROUP <> 'total' END""")

register("occ_dedup", ("occ_levels",), f"""
  SELECT AREA_TITLE, OCC_CODE, OCC_TITLE, O_GROUP, SOC_Code_Cleaned, TOT_EMP, A_MEAN FROM (
    SELECT *, row_number() OVER (PARTITION BY AREA_TITLE, SOC_Code_Cleaned
                                 ORDER BY {LEVEL_RANK}, OCC_CODE, OCC_TITLE) AS rn
    FROM occ_levels) WHERE rn = 1""")

for _tech, _scored in (("tech", "tech_s"), ("all_tech", "all_tech_s")):
    register(_scored, (_tech,), f"""
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY SOC_Code_Cleaned
                                 ORDER BY SOC_Code ASC NULLS LAST, tech_intensity_score DESC NULLS LAST) AS rn
    FROM (SELECT t.*, coalesce(replace(SOC_Code, '-', ''), '') AS SOC_Code_Cleaned,
                 {clip100("(tech_intensity_score / NULLIF(m, 0) * 0.8 + hot_tech_ratio * 0.2) * 100.0")}
                   AS automation_susceptibility
          FROM {_tech} t, (SELECT max(tech_intensity_score) AS m FROM {_tech}) mx)) WHERE rn = 1""")

register("occ_tech", ("occ_dedup", "tech_s"), f"""
  SELECT o.*, t.tech_intensity_score,
         coalesce(t.automation_susceptibility, med.m) AS automation_susceptibility,
         {risk_cat("coalesce(t.automation_susceptibility, med.m)")} AS automation_risk_category
  FROM occ_dedup o LEFT JOIN tech_s t ON o.SOC_Code_Cleaned = t.SOC_Code_Cleaned,
       (SELECT quantile_cont(automation_susceptibility, 0.5) AS m FROM tech_s) med""")

register("nat_wage", ("emp_clean",), """
  SELECT SOC_Code_Cleaned, max(A_MEAN) AS nat_wage FROM emp_clean WHERE AREA_TITLE = 'U.S.'
  GROUP BY SOC_Code_Cleaned""")

register("occ_wage1", ("occ_tech", "nat_wage"), """
  SELECT o.* REPLACE (CASE WHEN o.A_MEAN IS NULL OR o.A_MEAN = 0 THEN n.nat_wage ELSE o.A_MEAN END AS A_MEAN)
  FROM occ_tech o LEFT JOIN nat_wage n ON o.SOC_Code_Cleaned = n.SOC_Code_Cleaned""")

register("occ_wage", ("occ_wage1",), """
  SELECT o.* REPLACE (CASE WHEN o.A_MEAN IS NOT NULL AND o.A_MEAN <> 0 THEN o.A_MEAN
                           ELSE coalesce(CASE WHEN m.med <> 0 THEN m.med END, 50000.0) END AS A_MEAN)
  FROM occ_wage1 o LEFT JOIN (
    SELECT AREA_TITLE, quantile_cont(A_MEAN, 0.5) FILTER (WHERE A_MEAN IS NOT NULL AND A_MEAN <> 0) AS med
    FROM occ_wage1 GROUP BY AREA_TITLE) m ON o.AREA_TITLE = m.AREA_TITLE""")

register("apps_major", ("apps",), """
  SELECT substring(coalesce(replace(soc_code, '-', ''), ''), 1, 2) AS major_group,
         CAST(max(estimated_apps) AS DOUBLE) AS apps_major
  FROM apps GROUP BY 1""")

register("occ_apps1", ("occ_wage", "apps_major"), """
  SELECT *, coalesce(apps_major * (TOT_EMP / NULLIF(major_emp, 0)), 0.0) AS estimated_zapier_apps
  FROM (SELECT o.*, substring(o.SOC_Code_Cleaned, 1, 2) AS major_group,
               coalesce(a.apps_major, 0.0) AS apps_major,
               coalesce(sum(o.TOT_EMP) OVER (PARTITION BY o.AREA_TITLE, substring(o.SOC_Code_Cleaned, 1, 2)), 0.0)
                 AS major_emp
        FROM occ_wage o LEFT JOIN apps_major a ON substring(o.SOC_Code_Cleaned, 1, 2) = a.major_group)""")

register("occ_apps", ("occ_apps1",), f"""
  SELECT *, {risk_cat("enhanced_automation_risk")} AS enhanced_risk_category FROM (
    SELECT *, coalesce(estimated_zapier_apps / NULLIF(TOT_EMP, 0), 0.0) AS zapier_apps_per_worker,
           {clip100("(automation_susceptibility / 100.0 * 0.75 + CASE WHEN mx > 0 THEN estimated_zapier_apps / mx ELSE 0.0 END * 0.25) * 100.0")}
             AS enhanced_automation_risk
    FROM (SELECT *, max(estimated_zapier_apps) OVER (PARTITION BY AREA_TITLE) AS mx FROM occ_apps1))""")

register("occ_measure1", ("occ_apps",), """
  SELECT *, CASE WHEN a_tot_ev = 0 THEN TOT_EMP ELSE TOT_EMP * A_MEAN END AS economic_value,
         CASE WHEN a_tot_ev = 0 THEN a_tot_emp ELSE a_tot_ev END AS area_economic_value,
         coalesce(automation_susceptibility > 50, false) AS is_potentially_at_risk,
         coalesce(enhanced_automation_risk > 60, false) AS is_currently_at_risk
  FROM (SELECT *, coalesce(sum(TOT_EMP * A_MEAN) OVER (PARTITION BY AREA_TITLE), 0.0) AS a_tot_ev,
               coalesce(sum(TOT_EMP) OVER (PARTITION BY AREA_TITLE), 0.0) AS a_tot_emp
        FROM occ_apps)""")

register("occupations", ("occ_measure1",), """
  SELECT * EXCLUDE (epi, a_tot_ev, a_tot_emp, mx),
         epi / NULLIF(max(epi) OVER (PARTITION BY AREA_TITLE), 0) AS econ_potential_index,
         substring(SOC_Code_Cleaned, 1, 3) AS minor_group, substring(SOC_Code_Cleaned, 1, 3) AS minor_group_name
  FROM (SELECT *, CASE WHEN is_potentially_at_risk THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS potential_index,
               automation_susceptibility * economic_value / NULLIF(area_economic_value, 0) AS epi
        FROM occ_measure1)
  WHERE SOC_Code_Cleaned IS NOT NULL AND trim(SOC_Code_Cleaned) <> ''""")

register("groups", ("occupations",), """
  SELECT * EXCLUDE (area_ev), potential_econ_value_at_risk / NULLIF(economic_value, 0) * 100.0 AS minor_potential_index,
         current_econ_value_at_risk / NULLIF(economic_value, 0) * 100.0 AS minor_current_index,
         potential_econ_value_at_risk / NULLIF(economic_value, 0) * 100.0
           - current_econ_value_at_risk / NULLIF(economic_value, 0) * 100.0 AS automation_gap,
         current_econ_value_at_risk / NULLIF(economic_value, 0) * 100.0
           * (economic_value / NULLIF(area_ev, 0)) AS weighted_current_index
  FROM (SELECT AREA_TITLE, minor_group, minor_group_name,
               coalesce(sum(TOT_EMP), 0.0) AS TOT_EMP, coalesce(sum(economic_value), 0.0) AS economic_value,
               avg(automation_susceptibility) AS automation_susceptibility,
               avg(enhanced_automation_risk) AS enhanced_automation_risk,
               CAST(count_if(is_potentially_at_risk) AS BIGINT) AS is_potentially_at_risk,
               CAST(count_if(is_currently_at_risk) AS BIGINT) AS is_currently_at_risk,
               coalesce(sum(estimated_zapier_apps), 0.0) AS estimated_zapier_apps,
               avg(zapier_apps_per_worker) AS zapier_apps_per_worker,
               coalesce(string_agg(CASE WHEN is_potentially_at_risk THEN SOC_Code_Cleaned END, ','
                                   ORDER BY SOC_Code_Cleaned), '') AS at_risk_soc_codes,
               coalesce(sum(CASE WHEN is_potentially_at_risk THEN economic_value END), 0.0)
                 AS potential_econ_value_at_risk,
               coalesce(sum(CASE WHEN is_currently_at_risk THEN economic_value END), 0.0)
                 AS current_econ_value_at_risk,
               first(area_economic_value) AS area_ev
        FROM occupations GROUP BY AREA_TITLE, minor_group, minor_group_name)""")

register("summary", ("occupations", "groups"), """
  SELECT o.AREA_TITLE AS state, o.* EXCLUDE (AREA_TITLE), g.potential_economic_value_at_risk,
         g.current_economic_value_at_risk, r.highest_risk_industries, r.lowest_risk_industries,
         CASE WHEN economic_value_total > 0 THEN g.potential_economic_value_at_risk / economic_value_total * 100.0
              ELSE 0.0 END AS potential_ratio,
         CASE WHEN economic_value_total > 0 THEN g.current_economic_value_at_risk / economic_value_total * 100.0
              ELSE 0.0 END AS current_ratio,
         potential_ratio - current_ratio AS automation_gap,
         CAST(50 AS BIGINT) AS risk_threshold_used,
         potential_employment_at_risk / NULLIF(total_employment, 0) * 100.0 AS pct_potential_employment_at_risk,
         current_employment_at_risk / NULLIF(total_employment, 0) * 100.0 AS pct_current_employment_at_risk,
         potential_ratio AS pct_potential_economic_value_at_risk,
         current_ratio AS pct_current_economic_value_at_risk
  FROM (SELECT AREA_TITLE, count(*) AS total_occupations,
               CAST(count_if(is_potentially_at_risk) AS BIGINT) AS occupations_at_potential_risk,
               CAST(count_if(is_currently_at_risk) AS BIGINT) AS occupations_at_current_risk,
               coalesce(sum(TOT_EMP), 0.0) AS total_employment,
               coalesce(sum(CASE WHEN is_potentially_at_risk THEN TOT_EMP END), 0.0) AS potential_employment_at_risk,
               coalesce(sum(CASE WHEN is_currently_at_risk THEN TOT_EMP END), 0.0) AS current_employment_at_risk,
               first(area_economic_value) AS economic_value_total
        FROM occupations GROUP BY AREA_TITLE) o
  LEFT JOIN (SELECT AREA_TITLE, coalesce(sum(potential_econ_value_at_risk), 0.0) AS potential_economic_value_at_risk,
                    coalesce(sum(current_econ_value_at_risk), 0.0) AS current_economic_value_at_risk
             FROM groups GROUP BY AREA_TITLE) g ON o.AREA_TITLE = g.AREA_TITLE
  LEFT JOIN (SELECT AREA_TITLE,
                    list(minor_group_name ORDER BY rn) FILTER (WHERE rn <= 3) AS highest_risk_industries,
                    list(minor_group_name ORDER BY rn) FILTER (WHERE rn > n - 3) AS lowest_risk_industries
             FROM (SELECT *, row_number() OVER (PARTITION BY AREA_TITLE
                                                ORDER BY minor_current_index DESC NULLS LAST, minor_group) AS rn,
                          count(*) OVER (PARTITION BY AREA_TITLE) AS n FROM groups)
             GROUP BY AREA_TITLE) r ON o.AREA_TITLE = r.AREA_TITLE""")
