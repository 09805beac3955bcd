"""Queries of the exposure-index stage."""

from __future__ import annotations

from pyspark.sql import functions as F

from workrisk.operators import exposure as X
from workrisk.operators.quality import employment_quality
from workrisk.plans import oracle_exposure  # noqa: F401  (registers the oracle CTEs)
from workrisk.plans.registry import query
from workrisk.plans.stages import stage
from workrisk.session import materialize
from workrisk.sources import domain


def _result(spark, d) -> X.ExposureResult:
    return stage(spark, d, "exposure", lambda: X.exposure_index(domain.employment(spark, d), domain.tech(spark, d),
                                                                domain.apps(spark, d)))


def _summary(spark, d):
    """One row per area, kept once computed."""
    return stage(spark, d, "summary", lambda: materialize(_result(spark, d).summary))


GROUP_MONEY = ("TOT_EMP", "economic_value", "potential_econ_value_at_risk", "current_econ_value_at_risk")
GROUP_DOUBLES = ("automation_susceptibility", "enhanced_automation_risk",
                 "estimated_zapier_apps", "zapier_apps_per_worker", "minor_potential_index", "minor_current_index",
                 "automation_gap", "weighted_current_index")


@query("exposure_index_by_group", sql="SELECT * FROM groups", views=("groups",), rounded=GROUP_DOUBLES, money=GROUP_MONEY,
       group="exposure", ops=("P1", "P4", "P6", "F1", "F2", "F3", "J1", "J2", "J3", "P7", "P8", "P9",
                              "P10", "P11", "P12", "A1", "A2", "A3", "A4", "W1"))
def exposure_index_by_group(spark, d):
    return _result(spark, d).groups


SUMMARY_MONEY = ("total_employment", "potential_employment_at_risk", "current_employment_at_risk",
                 "economic_value_total", "potential_economic_value_at_risk", "current_economic_value_at_risk")
SUMMARY_DOUBLES = ("potential_ratio", "current_ratio", "automation_gap", "pct_potential_employment_at_risk",
                   "pct_current_employment_at_risk", "pct_potential_economic_value_at_risk",
                   "pct_current_economic_value_at_risk")


@query("area_summary", sql="""
  SELECT * REPLACE (coalesce(array_to_string(highest_risk_industries, '|'), '') AS highest_risk_industries,
                    coalesce(array_to_string(lowest_risk_industries, '|'), '') AS lowest_risk_industries)
  FROM summary""", views=("summary",), rounded=SUMMARY_DOUBLES, money=SUMMARY_MONEY, group="exposure", ops=("A5", "W3", "D1"))
def area_summary(spark, d):
    s = _summary(spark, d)
    return (s.withColumn("highest_risk_industries", F.array_join("highest_risk_industries", "|"))
             .withColumn("lowest_risk_industries", F.array_join("lowest_risk_industries", "|")))


OCC_COLS = ("AREA_TITLE", "minor_group", "minor_group_name", "SOC_Code_Cleaned", "OCC_TITLE", "TOT_EMP", "A_MEAN",
            "economic_value", "automation_susceptibility", "automation_risk_category", "is_potentially_at_risk",
            "potential_index", "enhanced_automation_risk", "enhanced_risk_category", "is_currently_at_risk",
            "estimated_zapier_apps", "zapier_apps_per_worker", "econ_potential_index")
OCC_MONEY = ("TOT_EMP", "A_MEAN", "economic_value")
OCC_DOUBLES = ("automation_susceptibility", "potential_index",
               "enhanced_automation_risk", "estimated_zapier_apps", "zapier_apps_per_worker", "econ_potential_index")


@query("occupation_details", sql=f"SELECT {', '.join(OCC_COLS)} FROM occupations", views=("occupations",),
       rounded=OCC_DOUBLES, money=OCC_MONEY, group="exposure", ops=("P11", "P12", "P13", "P35", "P36"))
def occupation_details(spark, d):
    return _result(spark, d).occupations.select(*OCC_COLS)


@query("clean_numeric", sql="SELECT AREA_TITLE, OCC_CODE, SOC_Code_Cleaned, TOT_EMP, A_MEAN FROM emp_clean",
       views=("emp_clean",), group="exposure", ops=("P1", "P6"))
def clean_numeric(spark, d):
    e = X.clean_employment(domain.employment(spark, d))
    return e.select("AREA_TITLE", "OCC_CODE", X.CODE, "TOT_EMP", "A_MEAN")


@query("risk_category", sql="""
  SELECT SOC_Code_Cleaned, tech_intensity_score, hot_tech_ratio, automation_susceptibility,
         {cat} AS automation_risk_category FROM all_tech_s""".replace(
    "{cat}", oracle_exposure.risk_cat("automation_susceptibility")),
       views=("all_tech_s",), rounded=("automation_susceptibility",), group="exposure", ops=("P7", "P8", "P9", "W1"))
def risk_category(spark, d):
    t = X.tech_susceptibility(domain.all_tech(spark, d))
    return t.select(X.CODE, "tech_intensity_score", "hot_tech_ratio", "automation_susceptibility",
                    "automation_risk_category")


@query("level_fallback", sql="SELECT AREA_TITLE, OCC_CODE, O_GROUP FROM occ_levels", views=("occ_levels",),
       group="exposure", ops=("F2", "U2"))
def level_fallback(spark, d):
    e = X.clean_employment(domain.employment(spark, d))
    return X.select_levels(e.filter(X.is_state_area())).select("AREA_TITLE", "OCC_CODE", "O_GROUP")


@query("wage_fill", sql="SELECT AREA_TITLE, SOC_Code_Cleaned, A_MEAN FROM occ_wage", views=("occ_wage",),
       rounded=("A_MEAN",), group="exposure", ops=("J3",))
def wage_fill(spark, d):
    return _result(spark, d).occupations.select(X.AREA, X.CODE, "A_MEAN")


@query("app_coverage", sql="""
  SELECT AREA_TITLE, SOC_Code_Cleaned, major_group, estimated_zapier_apps, zapier_apps_per_worker,
         enhanced_automation_risk, enhanced_risk_category FROM occ_apps""", views=("occ_apps",),
       rounded=("estimated_zapier_apps", "zapier_apps_per_worker", "enhanced_automation_risk"),
       group="exposure", ops=("J2", "A4", "P10"))
def app_coverage(spark, d):
    occ = _result(spark, d).occupations
    return occ.select(X.AREA, X.CODE, "major_group", "estimated_zapier_apps", "zapier_apps_per_worker",
                      "enhanced_automation_risk", "enhanced_risk_category")


@query("area_list", sql="SELECT AREA_TITLE FROM states", views=("states",), group="exposure", ops=("S9",))
def area_list(spark, d):
    return X.state_areas(X.clean_employment(domain.employment(spark, d)))


@query("duplicate_keys", sql="""
  SELECT AREA_TITLE, OCC_TITLE, OCC_CODE, dup_count FROM (
    SELECT AREA_TITLE, OCC_TITLE, OCC_CODE, count(*) OVER (PARTITION BY AREA_TITLE, OCC_TITLE) AS dup_count
    FROM employment) WHERE dup_count > 1""", views=("employment",), group="exposure", ops=("W2",))
def duplicate_keys(spark, d):
    e = domain.employment(spark, d).select("AREA_TITLE", "OCC_TITLE", "OCC_CODE")
    return X.duplicate_keys(e, ["AREA_TITLE", "OCC_TITLE"])


@query("dedup_first", sql="""
  SELECT AREA_TITLE, OCC_TITLE, OCC_CODE FROM (
    SELECT *, row_number() OVER (PARTITION BY AREA_TITLE, OCC_TITLE ORDER BY OCC_CODE) AS rn FROM employment)
  WHERE rn = 1""", views=("employment",), group="exposure", ops=("W1",))
def dedup_first(spark, d):
    e = domain.employment(spark, d).select("AREA_TITLE", "OCC_TITLE", "OCC_CODE")
    return X.dedup_first(e, ["AREA_TITLE", "OCC_TITLE"], [F.col("OCC_CODE").asc()])


@query("quality_report", sql="""
  SELECT s.AREA_TITLE, official_total, calculated_total,
         abs(calculated_total - official_total) / NULLIF(official_total, 0) * 100.0 AS discrepancy_pct,
         coalesce(abs(calculated_total - official_total) / NULLIF(official_total, 0) * 100.0 > 5, false)
           AS total_mismatch,
         null_employment, duplicate_codes
  FROM (SELECT AREA_TITLE, coalesce(sum(TOT_EMP), 0.0) AS calculated_total,
               CAST(count_if(TOT_EMP IS NULL) AS BIGINT) AS null_employment,
               count(*) - count(DISTINCT SOC_Code_Cleaned) AS duplicate_codes
        FROM occ_levels GROUP BY AREA_TITLE) s
  LEFT JOIN (SELECT AREA_TITLE, min(TOT_EMP) AS official_total FROM emp_clean WHERE O_GROUP = 'total'
             GROUP BY AREA_TITLE) t ON s.AREA_TITLE = t.AREA_TITLE""", views=("occ_levels", "emp_clean"),
       rounded=("discrepancy_pct",), money=("official_total", "calculated_total"), group="exposure", ops=("A6",))
def quality_report(spark, d):
    return employment_quality(domain.employment(spark, d))


@query("write_roundtrip", sql="SELECT * FROM groups", views=("groups",), rounded=GROUP_DOUBLES, money=GROUP_MONEY,
       group="exposure", ops=("S6", "U1"))
def write_roundtrip(spark, d):
    """Minor-group table written partitioned by area to the shared checkpoint folder and read back."""
    import uuid

    from workrisk.session import ensure_checkpoint_dir
    from workrisk.sources.sinks import write_partitioned
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/groups-{uuid.uuid4().hex}"
    write_partitioned(_result(spark, d).groups, path, partition_by=X.AREA)
    return spark.read.parquet(path)
