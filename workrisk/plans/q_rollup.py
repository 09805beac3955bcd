"""Queries of the opportunity (milestone 4) and roll-up (milestone 5) stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from workrisk.operators import opportunity as OP
from workrisk.operators import rollup as R
from workrisk.plans import oracle_rollup  # noqa: F401
from workrisk.plans.q_exposure import _result
from workrisk.plans.q_skills import skills_risk_table
from workrisk.plans.registry import query
from workrisk.plans.stages import stage
from workrisk.plans.sql import register
from workrisk.session import materialize, write_stage
from workrisk.sources import domain, sinks
from workrisk.sources.model import fresh_folder

SIX = tuple(OP.SIX)


def _risk(spark, d):
    return skills_risk_table(spark, d)


@query("tech_composition", sql="SELECT onet_code, technical_composition FROM opp_base", views=("opp_base",),
       rounded=("technical_composition",), group="opportunity", ops=("P20",))
def tech_composition(spark, d):
    return OP.technical_composition(_risk(spark, d)).select("onet_code", "technical_composition")


@query("opportunity_v1", sql=f"""
  SELECT onet_code, title, technical_composition, {', '.join(c for c in SIX if c != 'technical_skills')},
         technical_skills FROM opp_base WHERE technical_composition BETWEEN 0.1165 AND 0.1558""",
       views=("opp_base",), rounded=("technical_composition",) + SIX, group="opportunity", ops=("F6",))
def opportunity_v1(spark, d):
    return OP.opportunity_v1(_risk(spark, d))


@query("opportunity_v2", sql="SELECT * FROM opp_v2", views=("opp_v2",),
       rounded=("technical_composition", "transformation_score", "enhancement_score") + SIX,
       group="opportunity", ops=("P21", "P22", "P23", "P24", "P25"))
def opportunity_v2(spark, d):
    return OP.opportunity_v2(_risk(spark, d), with_scores=True)


@query("high_potential", sql="SELECT OCC_CODE FROM opp_hp", views=("opp_hp",), group="opportunity",
       ops=("F7", "F9"))
def high_potential(spark, d):
    return R.opportunity_codes(OP.opportunity_v2(_risk(spark, d)))


@query("composition_profile", sql="""
  SELECT quantile_cont(technical_composition, 0.2) AS p20, quantile_cont(technical_composition, 0.8) AS p80,
         avg(technical_composition) AS mean, median(technical_composition) AS median,
         stddev_samp(technical_composition) AS std, min(technical_composition) AS min,
         max(technical_composition) AS max, count(technical_composition) AS n FROM opp_base""",
       views=("opp_base",), rounded=("p20", "p80", "mean", "median", "std", "min", "max"),
       group="opportunity", ops=("T1",))
def composition_profile(spark, d):
    return OP.column_profile(OP.technical_composition(_risk(spark, d)), "technical_composition")


def _detailed(spark, d):
    def build():
        occ = _result(spark, d).occupations
        risk = _risk(spark, d)
        det = materialize(R.displacement(occ, domain.sector(spark, d), R.percentile_flag(risk)))
        return det, materialize(R.opportunity_codes(OP.opportunity_v2(risk)))
    return stage(spark, d, "detailed", build)


@query("percentile_flag", sql="""
  SELECT OCC_CODE, automation_risk_score, risk_threshold, perc_ile_thresholded_risk FROM job_risk""",
       views=("job_risk",), rounded=("risk_threshold",), group="rollup", ops=("W19", "W1", "P3", "F4"))
def percentile_flag(spark, d):
    return R.percentile_flag(_risk(spark, d)).select("OCC_CODE", "automation_risk_score", "risk_threshold",
                                                     "perc_ile_thresholded_risk")


@query("displacement", sql="""
  SELECT AREA_TITLE, OCC_CODE, sector, automation_risk_score, adoption_rate, displacement_rate,
         perc_ile_thresholded_risk, RISK_EMP, AT_RISK_ECONOMIC_VALUE FROM detailed""", views=("detailed",),
       rounded=("automation_risk_score", "adoption_rate", "displacement_rate"), group="rollup",
       ops=("P26", "J4", "J5", "P35"))
def displacement(spark, d):
    det, _ = _detailed(spark, d)
    return det.select("AREA_TITLE", "OCC_CODE", "sector", "automation_risk_score", "adoption_rate",
                      "displacement_rate", "perc_ile_thresholded_risk", "RISK_EMP", "AT_RISK_ECONOMIC_VALUE")


@query("opportunity_join", sql="""
  SELECT d.AREA_TITLE, d.OCC_CODE, d.TOT_EMP, d.economic_value, d.sector
  FROM detailed d JOIN opp_hp h ON d.OCC_CODE = h.OCC_CODE""", views=("detailed", "opp_hp"),
       money=("TOT_EMP", "economic_value"), group="rollup", ops=("J6",))
def opportunity_join(spark, d):
    det, opp = _detailed(spark, d)
    return R.opportunity_occupations(det, opp).select("AREA_TITLE", "OCC_CODE", "TOT_EMP", "economic_value", "sector")


@query("opportunity_rows_v1", sql="""
  SELECT h.OCC_CODE, h.technical_composition, d.AREA_TITLE, d.TOT_EMP, d.economic_value, d.sector FROM (
    SELECT split_part(onet_code, '.', 1) AS OCC_CODE, technical_composition,
           row_number() OVER (PARTITION BY split_part(onet_code, '.', 1)
                              ORDER BY technical_composition DESC NULLS LAST, onet_code) AS rn
    FROM opp_base WHERE technical_composition BETWEEN 0.1165 AND 0.1558) h
  LEFT JOIN detailed d ON d.OCC_CODE = h.OCC_CODE WHERE h.rn = 1""", views=("opp_base", "detailed"),
       rounded=("technical_composition",), money=("TOT_EMP", "economic_value"), group="rollup", ops=("J7",))
def opportunity_rows_v1(spark, d):
    codes = R.opportunity_codes_v1(OP.opportunity_v1(_risk(spark, d))).drop("title")
    return R.opportunity_rows(codes, _detailed(spark, d)[0])


@query("opportunity_rows_v2", sql="""
  SELECT h.OCC_CODE, d.AREA_TITLE, d.TOT_EMP, d.economic_value, d.sector
  FROM opp_hp h LEFT JOIN detailed d ON d.OCC_CODE = h.OCC_CODE""", views=("opp_hp", "detailed"),
       money=("TOT_EMP", "economic_value"), group="rollup", ops=("J7",))
def opportunity_rows_v2(spark, d):
    det, opp = _detailed(spark, d)
    return R.opportunity_rows(opp, det)


@query("opportunity_sector_value", sql="""
  SELECT d.sector, sum(coalesce(d.economic_value, 0.0)) AS economic_value
  FROM opp_hp h JOIN detailed d ON d.OCC_CODE = h.OCC_CODE WHERE d.sector IS NOT NULL GROUP BY d.sector""",
       views=("opp_hp", "detailed"), money=("economic_value",), group="rollup", ops=("J7",))
def opportunity_sector_value(spark, d):
    det, opp = _detailed(spark, d)
    return R.opportunity_sector_value(R.opportunity_rows(opp, det))


SECTOR_MONEY = ("employment", "economic_value", "opportunity_employment", "opportunity_economic_value")
SECTOR_DOUBLES = ("risk_impact_pct", "opportunity_impact_pct")


@query("sector_rollup", sql="SELECT * FROM sector_roll", views=("sector_roll",), rounded=SECTOR_DOUBLES, money=SECTOR_MONEY,
       group="rollup", ops=("A7", "A9", "J9", "M12", "M13", "F10", "F4"))
def sector_rollup(spark, d):
    det, opp = _detailed(spark, d)
    return R.sector_rollup(det, opp)


AREA_MONEY = ("total_jobs", "total_economic_value", "total_jobs_at_risk", "total_economic_value_at_risk",
              "total_jobs_opportunity", "total_economic_value_opportunity")
AREA_DOUBLES = ("total_jobs_at_risk_percentage",
                "total_economic_value_at_risk_percentage", "total_jobs_opportunity_percentage",
                "total_economic_value_opportunity_percentage")


@query("area_rollup", sql="SELECT * FROM area_roll", views=("area_roll",), rounded=AREA_DOUBLES, money=AREA_MONEY,
       group="rollup", ops=("A8",))
def area_rollup(spark, d):
    det, opp = _detailed(spark, d)
    return R.area_rollup(det, opp)


@query("sector_top5", sql="SELECT * FROM top5", views=("top5",), money=("employment", "economic_value"),
       group="rollup", ops=("W12",))
def sector_top5(spark, d):
    det, opp = _detailed(spark, d)
    return R.sector_top5(det, opp)


def _document(spark, d):
    det, opp = _detailed(spark, d)
    return R.risk_opportunity_document(R.area_rollup(det, opp), R.sector_rollup(det, opp), R.sector_top5(det, opp))


@query("risk_opportunity_doc", sql=None, group="rollup", ops=("D11",))
def risk_opportunity_doc(spark, d):
    return _document(spark, d)


_NONE = "CAST(NULL AS VARCHAR) AS sector, CAST(NULL AS BIGINT) AS position, CAST(NULL AS VARCHAR) AS code"
_FIELDS = " UNION ALL ".join(
    [f"SELECT state AS area, '{part}' AS part, '{name}' AS field, {_NONE}, CAST({column} AS DOUBLE) AS value FROM area_roll"
     for part, name, column in R.AREA_FIELDS]
    + [f"SELECT area, '{part}', '{name}', sector, NULL, NULL, CAST({column} AS DOUBLE) FROM sector_roll"
       + (f" WHERE {needs} > 0" if needs else "") for part, name, column, needs in R.SECTOR_FIELDS]
    + ["""SELECT area, kind, 'top_5_by_' || ranked_by, sector, CAST(rank AS BIGINT), OCC_CODE,
          CAST(CASE WHEN ranked_by = 'employment' THEN employment ELSE economic_value END AS DOUBLE) FROM top5"""])


@query("risk_opportunity_fields", sql=_FIELDS, views=("area_roll", "sector_roll", "top5"), money=("value",),
       group="rollup", ops=("D11",))
def risk_opportunity_fields(spark, d):
    return R.document_fields(_document(spark, d))


@query("document_roundtrip", sql=_FIELDS, views=("area_roll", "sector_roll", "top5"), money=("value",), group="rollup",
       ops=("S7", "D11"))
def document_roundtrip(spark, d):
    """The risk and opportunity documents written as JSON by area, and read back as rows."""
    docs, path = _document(spark, d), fresh_folder(spark, "documents")
    sinks.write_documents(docs, path, partition_by="area")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return R.document_fields(sinks.read_documents(spark, path, schema, "area"))


register("sector_sums", ("detailed",), """
  SELECT AREA_TITLE AS area, sector, grouping(sector) AS whole, coalesce(sum(TOT_EMP), 0.0) AS employment,
         coalesce(sum(economic_value), 0.0) AS economic_value,
         coalesce(sum(TOT_EMP) FILTER (perc_ile_thresholded_risk), 0.0) AS risk_employment,
         coalesce(sum(economic_value) FILTER (perc_ile_thresholded_risk), 0.0) AS risk_economic_value,
         count(*) FILTER (perc_ile_thresholded_risk) AS at_risk
  FROM detailed GROUP BY GROUPING SETS ((AREA_TITLE), (AREA_TITLE, sector))""")
register("sector_doc_sums", ("sector_sums",), """
  SELECT *, risk_employment / nullif(employment, 0) * 100.0 AS jobs_pct, risk_economic_value / nullif(economic_value, 0) * 100.0 AS value_pct,
         coalesce(risk_employment / nullif(employment, 0) * 100.0, 0.0) AS impact FROM sector_sums WHERE whole = 1 OR sector IS NOT NULL""")
_SECTOR_FIELDS = " UNION ALL ".join(
    [f"SELECT area, '{name}' AS field, {_NONE}, CAST({c} AS DOUBLE) AS value FROM sector_doc_sums WHERE whole = 1"
     for name, c in R.AREA_TOTALS.items()]
    + [f"SELECT area, '{name}', sector, NULL, NULL, CAST({c} AS DOUBLE) FROM sector_doc_sums WHERE whole = 0"
       + (" AND at_risk > 0" if c in R.RISKED else "") for name, c in R.SECTOR_MAPS.items()]
    + [f"""SELECT AREA_TITLE, 'top_5_by_{by}', sector, rank, OCC_CODE, CAST({c} AS DOUBLE) FROM (
          SELECT *, row_number() OVER (PARTITION BY AREA_TITLE, sector ORDER BY {c} DESC NULLS LAST, OCC_CODE) AS rank
          FROM detailed WHERE perc_ile_thresholded_risk AND sector IS NOT NULL) WHERE rank <= 5"""
       for by, c in (("employment", "TOT_EMP"), ("economic_value", "economic_value"))])


@query("sector_documents", sql=f"""
  SELECT s.source, f.* FROM ({_SECTOR_FIELDS}) f, (VALUES ('by area'), ('one map')) s(source)""",
       views=("sector_doc_sums", "detailed"), money=("value",), group="rollup", ops=("D12", "S7"))
def sector_documents(spark, d):
    """The sector documents of all areas, written as one JSON document an area and as one map of them, both read back."""
    docs = write_stage(R.sector_document(_detailed(spark, d)[0]))
    by_area, whole = fresh_folder(spark, "sectors"), fresh_folder(spark, "sector-map")
    sinks.write_documents(docs, by_area, partition_by="area")
    sinks.write_map_document(docs, whole, key="area")
    parts = [("by area", sinks.read_documents(spark, by_area, R.SECTOR_DOCUMENT, "area")),
             ("one map", sinks.read_map_document(spark, whole, R.SECTOR_DOCUMENT, key="area"))]
    first, second = (R.sector_document_fields(x).select(F.lit(name).alias("source"), "*") for name, x in parts)
    return first.union(second)
