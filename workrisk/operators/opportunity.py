"""Opportunity classification of occupations (stage C of the reference)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workrisk.functions import safe_div, tech_stratum
from workrisk.functions.categories import STRATUM_LOW_MAX, STRATUM_MEDIUM_MAX
from workrisk.operators.common import scalar_quantiles, with_scalars

SIX = ["cognitive_skills", "social_skills", "operations_skills", "maintenance_skills", "technical_skills",
       "management_skills"]
# Fixed values of the reference's classification rules.
TRANSFORMATION_LABELS = ["High Transformation Potential", "Moderate Transformation Potential",
                         "Low Transformation Potential", "Minimal Transformation Potential"]
ENHANCEMENT_LABELS = ["High Enhancement Potential", "Moderate Enhancement Potential",
                      "Low Enhancement Potential", "Minimal Enhancement Potential"]
NOT_APPLICABLE = "Not Applicable"
SCORE_COMPOSITION_CUT = 0.13


def technical_composition(df: DataFrame) -> DataFrame:
    """P20: technical / sum of the six non-basic categories."""
    total = sum((F.col(c) for c in SIX[1:]), F.col(SIX[0]))
    return df.withColumn("technical_composition", safe_div("technical_skills", total))


def _score_transformation() -> Column:
    cog, soc, ops = F.col("cognitive_skills"), F.col("social_skills"), F.col("operations_skills")
    return (F.when(cog >= 3.0, 2).when(cog >= 2.8, 1).otherwise(0)
            + F.when((soc >= 2.5) & (soc <= 3.8), 1).otherwise(0)
            + F.when(ops <= 2.0, 2).when(ops <= 2.5, 1).otherwise(0)
            - F.when(ops >= 3.0, 2).otherwise(0))


def transformation_class(medium_max: float = STRATUM_MEDIUM_MAX) -> Column:
    """Integer score of cognitive/social/operations bands (low/medium-tech only)."""
    s = _score_transformation()
    hi, mod, low, minimal = TRANSFORMATION_LABELS
    return (F.when(F.col("technical_composition") > medium_max, F.lit(NOT_APPLICABLE))
             .when(s >= 4, hi).when(s >= 2, mod).when(s >= 0, low).otherwise(minimal))


def _enh_base() -> Column:
    return (F.col("cognitive_skills") * 0.25 - F.col("operations_skills") * 0.3
            + F.col("technical_composition") * 2.0 + F.col("technical_skills") * 0.15)


def enhancement_class(medium_max: float = STRATUM_MEDIUM_MAX) -> Column:
    """Weighted score for high-tech occupations."""
    s = _enh_base()
    hi, mod, low, minimal = ENHANCEMENT_LABELS
    return (F.when(F.col("technical_composition") <= medium_max, F.lit(NOT_APPLICABLE))
             .when(s >= 2.0, hi).when(s >= 1.5, mod).when(s >= 1.0, low).otherwise(minimal))


def transformation_score(cut: float = SCORE_COMPOSITION_CUT) -> Column:
    """Continuous transformation score (0 above the composition cut, floor 0)."""
    tc, soc = F.col("technical_composition"), F.col("social_skills")
    s = ((F.lit(cut) - tc) * 10 + F.col("cognitive_skills") * 0.4
         + F.when((soc >= 2.5) & (soc <= 3.8), soc * 0.3).otherwise(0.0)
         + F.col("management_skills") * 0.25 - F.col("operations_skills") * 0.2)
    return F.when(tc > cut, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), s))


def enhancement_score(cut: float = SCORE_COMPOSITION_CUT) -> Column:
    """P25: continuous enhancement score with a management bonus (0 at or below the cut)."""
    mg = F.col("management_skills")
    s = _enh_base() + F.when(mg >= 2.5, 0.4).when(mg >= 2.0, 0.2).otherwise(0.0)
    return F.when(F.col("technical_composition") <= cut, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), s))


V1_COLUMNS = ["onet_code", "title", "technical_composition"] + [c for c in SIX if c != "technical_skills"] \
    + ["technical_skills"]


def opportunity_v1(df: DataFrame, lo: float = STRATUM_LOW_MAX, hi: float = STRATUM_MEDIUM_MAX) -> DataFrame:
    """composition band [lo, hi], highest composition first."""
    return (technical_composition(df).filter(F.col("technical_composition").between(lo, hi))
            .select(*V1_COLUMNS).orderBy(F.col("technical_composition").desc_nulls_last(), "onet_code"))


def opportunity_v2(df: DataFrame, with_scores: bool = False) -> DataFrame:
    """P21-P23 (+ P24/P25 optionally) for every occupation."""
    t = technical_composition(df)
    out = (t.withColumn("Tech_Stratum", tech_stratum("technical_composition"))
            .withColumn("AI_Transformation_Classification", transformation_class())
            .withColumn("AI_Enhancement_Classification", enhancement_class()))
    cols = ["onet_code", "title", "technical_composition", "Tech_Stratum"] + SIX + \
        ["AI_Transformation_Classification", "AI_Enhancement_Classification"]
    if with_scores:
        out = out.withColumn("transformation_score", transformation_score()) \
                 .withColumn("enhancement_score", enhancement_score())
        cols += ["transformation_score", "enhancement_score"]
    return out.select(*cols)


def high_potential(v2: DataFrame) -> DataFrame:
    """high transformation potential among low/medium-tech occupations."""
    return v2.filter((F.col("AI_Transformation_Classification") == TRANSFORMATION_LABELS[0])
                     & F.col("Tech_Stratum").isin("Low-Tech", "Medium-Tech"))


def column_profile(df: DataFrame, col: str, quantiles=(0.2, 0.8)) -> DataFrame:
    """One-row profile - percentiles, mean, median, sample std, min, max, n."""
    c = F.col(col)
    names = {f"p{int(round(q * 100))}": q for q in quantiles}
    found = scalar_quantiles(df, col, names | {"_median": 0.5})
    rest = df.agg(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"),
                  F.count(c).alias("n"))
    return with_scalars(rest, found).select(*names, "mean", F.col("_median").alias("median"), "std", "min", "max", "n")
