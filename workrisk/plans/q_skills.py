"""Queries of the skills -> risk stage."""

from __future__ import annotations

from pyspark.sql import functions as F

from workrisk.operators import exposure as X
from workrisk.operators import skills as K
from workrisk.operators.common import scalar_quantiles, with_scalars
from workrisk.plans import oracle_skills as O
from workrisk.plans.q_exposure import _result
from workrisk.plans.registry import query
from workrisk.plans.stages import stage
from workrisk.session import write_stage
from workrisk.sources import domain

CATS = tuple(K.CATEGORY_NAMES)
ELEMENTS = [f"skill_{i:02d}" for i in range(64)]
REFERENCE_AREA = O.REFERENCE_AREA


def _cats(spark, d):
    return K.category_means(domain.skills_long(spark, d), domain.skill_categories(spark, d))


def _blended(spark, d, occ=None):
    occ = occ if occ is not None else _result(spark, d).occupations
    area = occ.filter(F.col(X.AREA) == REFERENCE_AREA)
    return K.top_decile_blend(K.short_term_risk(_cats(spark, d)), area)


def skills_risk_table(spark, d):
    """Stage B output (skills-based risk with backfill and adoption), materialised once per session."""
    def build():
        occ = _result(spark, d).occupations
        b = K.backfill_missing(_blended(spark, d, occ), occ)
        return write_stage(K.adoption_fill(b, domain.tech(spark, d)))
    return stage(spark, d, "skills_risk", build)


@query("skill_pivot", sql="SELECT onet_code, " + ", ".join(
    f"coalesce(max(CASE WHEN element = '{e}' THEN value END), 0.0) AS {e}" for e in ELEMENTS)
    + " FROM skills_imp GROUP BY onet_code",
       views=("skills_imp",), rounded=tuple(ELEMENTS), group="skills", ops=("F5", "A19"))
def skill_pivot(spark, d):
    return K.skill_matrix(domain.skills_long(spark, d), ELEMENTS)


@query("skill_categories", sql="SELECT * FROM cats", views=("cats",), rounded=CATS, group="skills",
       ops=("P17", "P15"))
def skill_categories(spark, d):
    return _cats(spark, d)


@query("risk_long_term", sql="SELECT * FROM long_risk", views=("long_risk",), rounded=CATS,
       group="skills", ops=("P18", "P16", "M18"))
def risk_long_term(spark, d):
    return K.long_term_risk(_cats(spark, d))


@query("risk_short_term", sql="SELECT * FROM short_risk", views=("short_risk",), rounded=CATS,
       group="skills", ops=("P19",))
def risk_short_term(spark, d):
    return K.short_term_risk(_cats(spark, d))


@query("top_decile_blend", sql="SELECT * FROM blended", views=("blended",), rounded=CATS + ("automation_risk",),
       group="skills", ops=("W20", "P16"))
def top_decile_blend(spark, d):
    return _blended(spark, d)


@query("nearest_code", sql="SELECT wc AS code, match, common_length FROM nearest", views=("nearest",),
       group="skills", ops=("J11", "J10", "P5"))
def nearest_code(spark, d):
    occ = _result(spark, d).occupations
    b = _blended(spark, d, occ)
    wanted = (occ.select(F.concat(F.col("OCC_CODE"), F.lit(".00")).alias("code")).distinct()
                 .join(b.select(F.col("onet_code").alias("code")), "code", "left_anti"))
    return K.nearest_code(wanted, b, "code", "onet_code").withColumn("common_length", F.col("common_length").cast("bigint"))


@query("missing_backfill", sql="SELECT * FROM backfilled", views=("backfilled",),
       rounded=CATS + ("automation_risk",), group="skills", ops=("U3", "J10", "J11"))
def missing_backfill(spark, d):
    occ = _result(spark, d).occupations
    return K.backfill_missing(_blended(spark, d, occ), occ)


@query("adoption_fill", sql="SELECT * FROM skills_risk", views=("skills_risk",),
       rounded=CATS + ("automation_risk", "adoption_rate"), group="skills", ops=("J8", "P35"))
def adoption_fill(spark, d):
    return skills_risk_table(spark, d)


@query("code_list", sql="""
  SELECT DISTINCT onet_code FROM skills_imp
  UNION
  SELECT DISTINCT OCC_CODE || '.00' FROM employment WHERE O_GROUP <> 'total'
    AND OCC_CODE || '.00' NOT IN (SELECT onet_code FROM skills_imp)""", views=("skills_imp", "employment"),
       group="skills", ops=("U4",))
def code_list(spark, d):
    a = K.importance(domain.skills_long(spark, d)).select("onet_code").distinct()
    b = (domain.employment(spark, d).filter(F.col("O_GROUP") != "total")
         .select(F.concat(F.col("OCC_CODE"), F.lit(".00")).alias("onet_code")).distinct())
    return a.unionByName(b.join(a, "onet_code", "left_anti")).distinct()


@query("distinct_counts", sql="""
  SELECT count(DISTINCT onet_code) AS n_codes, count(DISTINCT element) AS n_elements,
         count(DISTINCT title) AS n_titles, count(*) AS n_ratings FROM skills_imp""", views=("skills_imp",),
       group="skills", ops=("A17",))
def distinct_counts(spark, d):
    s = K.importance(domain.skills_long(spark, d))
    return s.agg(F.count_distinct("onet_code").alias("n_codes"), F.count_distinct("element").alias("n_elements"),
                 F.count_distinct("title").alias("n_titles"), F.count(F.lit(1)).alias("n_ratings"))


@query("risk_lookup", sql="""
  SELECT o.OCC_CODE, coalesce(r.automation_risk_score, m.med) AS automation_risk_score,
         r.automation_risk_score IS NULL AS used_default
  FROM (SELECT DISTINCT OCC_CODE FROM occupations) o
  LEFT JOIN long_risk r ON r.onet_code = o.OCC_CODE || '.00',
       (SELECT quantile_cont(automation_risk_score, 0.5) AS med FROM long_risk) m""",
       views=("occupations", "long_risk"), group="skills", ops=("J18", "P5", "A6"))
def risk_lookup(spark, d):
    """Long-term risk per occupation code; codes without skill data get the median (flagged)."""
    risk = K.long_term_risk(_cats(spark, d))
    med = scalar_quantiles(risk, "automation_risk_score", {"_m": 0.5})
    codes = _result(spark, d).occupations.select("OCC_CODE").distinct()
    r = risk.select(F.col("onet_code"), "automation_risk_score")
    j = with_scalars(codes.join(r, F.concat(codes.OCC_CODE, F.lit(".00")) == r.onet_code, "left"), med)
    return j.select("OCC_CODE", F.coalesce("automation_risk_score", "_m").alias("automation_risk_score"),
                    F.col("automation_risk_score").isNull().alias("used_default"))
