"""Data-quality report (totals validation, null and duplicate counts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from workrisk.functions import safe_div, sum0
from workrisk.operators import exposure as X
from workrisk.session import materialize
from workrisk.sources.model import fresh_folder

MISMATCH_PCT = 5.0
MERGE_GROWTH = 1.1  # a join that makes the total larger than this has multiplied rows


def employment_quality(employment: DataFrame) -> DataFrame:
    """Per state area: official total vs the sum of the selected occupations.

    The official total is the area's ``total`` row; if several exist the
    smallest is used (deterministic stand-in for "the first one").
    """
    emp = materialize(X.clean_employment(employment))  # read by the levels, their statistics and the totals
    sel = X.select_levels(emp.filter(X.is_state_area()))
    calc = sel.groupBy(X.AREA).agg(
        sum0("TOT_EMP").alias("calculated_total"),
        F.count_if(F.col("TOT_EMP").isNull()).alias("null_employment"),
        (F.count(F.lit(1)) - F.count_distinct(X.CODE)).alias("duplicate_codes"))
    official = (emp.filter(F.col("O_GROUP") == "total").groupBy(X.AREA)
                   .agg(F.min("TOT_EMP").alias("official_total")))
    pct = safe_div(F.abs(F.col("calculated_total") - F.col("official_total")), "official_total") * 100.0
    return (calc.join(official, X.AREA, "left")
                .withColumn("discrepancy_pct", pct)
                .withColumn("total_mismatch", F.coalesce(pct > MISMATCH_PCT, F.lit(False)))
                .select(X.AREA, "official_total", "calculated_total", "discrepancy_pct", "total_mismatch",
                        "null_employment", "duplicate_codes"))


def checked_merge(employment: DataFrame, tech: DataFrame) -> tuple[DataFrame, dict]:
    """The left join of technology figures with its check: (merged rows, figures of the check).

    Totals before and after the join are observed while the stage is written, so the check costs no
    scan. If the join makes the employment total larger than ``MERGE_GROWTH`` times the original, a code
    was multiplied: one row of each area and code is kept (the smallest by technology figures)."""
    before, after = Observation("before"), Observation("after")
    emp = employment.observe(before, sum0("TOT_EMP").alias("total"), F.count(F.lit(1)).alias("rows"))
    dim = tech.select(X.CODE, "tech_intensity_score", "automation_susceptibility")
    merged = emp.join(dim, X.CODE, "left").observe(after, sum0("TOT_EMP").alias("total"), F.count(F.lit(1)).alias("rows"))
    path = fresh_folder(employment.sparkSession, "merged")
    merged.write.parquet(path)
    merged = employment.sparkSession.read.schema(merged.schema).parquet(path)
    found = {"original_total": before.get["total"], "merged_total": after.get["total"],
             "original_rows": before.get["rows"], "merged_rows": after.get["rows"]}
    found["multiplied"] = found["merged_total"] > found["original_total"] * MERGE_GROWTH
    if found["multiplied"]:
        merged = X.dedup_first(merged, [X.AREA, X.CODE], [F.col(c).asc_nulls_last() for c in (
            "tech_intensity_score", "automation_susceptibility", "OCC_TITLE", "TOT_EMP", "A_MEAN")])
    return merged, found
