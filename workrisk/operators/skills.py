"""Skill ratings -> category means -> automation risk (stage B of the reference).

Inputs are long skill ratings ``(code, title, element, scale, value)``; all
work stays in long form (join with the element->category map, group, pivot
the seven categories) so that no wide row has to be built per skill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workrisk.functions import null_max, safe_div
from workrisk.operators.common import scalar_quantiles, with_scalars
from workrisk.session import write_stage

# ---------------------------------------------------------------- fixed values
# Category of each O*NET skill element, as used by the reference model.
REFERENCE_SKILL_CATEGORIES = {
    "basic_skills": ["Reading Comprehension", "Active Listening", "Writing", "Speaking"],
    "cognitive_skills": ["Critical Thinking", "Active Learning", "Learning Strategies", "Monitoring",
                         "Complex Problem Solving", "Judgment and Decision Making", "Operations Analysis"],
    "social_skills": ["Social Perceptiveness", "Coordination", "Persuasion", "Negotiation", "Instructing",
                      "Service Orientation"],
    "operations_skills": ["Operation and Control", "Operations Monitoring", "Quality Control Analysis",
                          "Troubleshooting"],
    "maintenance_skills": ["Equipment Selection", "Installation", "Equipment Maintenance", "Repairing"],
    "technical_skills": ["Technology Design", "Programming", "Mathematics", "Science"],
    "management_skills": ["Systems Analysis", "Systems Evaluation", "Time Management",
                          "Management of Financial Resources", "Management of Material Resources",
                          "Management of Personnel Resources"],
}
CATEGORY_NAMES = list(REFERENCE_SKILL_CATEGORIES)
# Growth-sector title pattern (case-insensitive) of the long-term model.
GROWTH_SECTOR_PATTERN = (r"(?:nurs|therap|counsel|teacher|educat|ai\b|ml\b|machine learning|data|cyber|"
                         r"engineer|developer|analyst|renewable|solar|wind|green|sustain|"
                         r"project manager|operations manager)")
LONG_TERM = dict(routine=(0.5, 0.5), human=(0.40, 0.30, 0.20, 0.10), shield=(0.30, 0.10),
                 raw=(0.55, 0.30, 0.15), growth_discount=0.70, growth_min=0.60)
SHORT_TERM = dict(field=(0.3, 0.7), raw=(0.5, 0.3, 0.2))
LOGISTIC_CENTER, LOGISTIC_SLOPE = 0.40, 4.0
TOP_TECH_QUANTILE = 0.9
TOP_TECH_BLEND = (0.2, 0.8)  # intermediate risk, area susceptibility
IMPORTANCE = "Importance"


def category_map(spark, mapping: dict[str, list[str]] | None = None) -> DataFrame:
    """(element, category) rows of a category -> elements mapping."""
    mapping = mapping or REFERENCE_SKILL_CATEGORIES
    rows = [(e, c) for c, es in mapping.items() for e in es]
    return spark.createDataFrame(rows, "element string, category string")


def importance(skills: DataFrame, scale: str = IMPORTANCE) -> DataFrame:
    """keep the importance scale."""
    return skills.filter(F.col("scale") == scale)


def skill_matrix(skills: DataFrame, elements: list[str], code: str = "onet_code") -> DataFrame:
    """Long -> wide (code x element), missing cells 0. ``elements`` fixes the columns."""
    return (importance(skills).groupBy(code).pivot("element", elements).agg(F.max("value"))
                              .na.fill(0.0, subset=elements))


def category_means(skills: DataFrame, categories: DataFrame, code: str = "onet_code",
                   title: str = "title") -> DataFrame:
    """Mean importance per category (only elements present, nulls skipped)."""
    imp = importance(skills).join(F.broadcast(categories), "element")  # mapping: fixed taxonomy size
    return (imp.groupBy(code, title).pivot("category", CATEGORY_NAMES).agg(F.avg("value")))


def _norm(c: str) -> Column:
    """1-5 scale -> 0-1."""
    return (F.col(c) - 1.0) / 4.0


def logistic_score(raw: Column) -> Column:
    """bround(100 / (1 + e^(-4 (raw - 0.40))), 1)."""
    return F.bround(100.0 / (1.0 + F.exp(-LOGISTIC_SLOPE * (raw - LOGISTIC_CENTER))), 1)


def long_term_risk(cats: DataFrame, title: str = "title", pattern: str = GROWTH_SECTOR_PATTERN) -> DataFrame:
    """Long-term risk score for every code at once."""
    b, cg, so, op, mt, te, mg = (_norm(c) for c in CATEGORY_NAMES)
    r1, r2 = LONG_TERM["routine"]
    h1, h2, h3, h4 = LONG_TERM["human"]
    s1, s2 = LONG_TERM["shield"]
    w1, w2, w3 = LONG_TERM["raw"]
    routine = op * r1 + mt * r2
    human = so * h1 + mg * h2 + cg * h3 + b * h4
    shield = te * s1 + cg * s2
    raw = routine * w1 + (1 - human) * w2 + (1 - shield) * w3
    growth = (F.coalesce(F.col(title).rlike("(?i)" + pattern), F.lit(False))
              & ((so >= LONG_TERM["growth_min"]) | (te >= LONG_TERM["growth_min"])))
    raw = F.when(growth, raw * LONG_TERM["growth_discount"]).otherwise(raw)
    return (cats.withColumn("_raw", raw)
                .withColumn("growth_discounted", F.coalesce(growth, F.lit(False)))
                .withColumn("automation_risk", F.bround(F.col("_raw") * 100.0, 1))
                .withColumn("automation_risk_score", logistic_score(F.col("_raw")))
                .drop("_raw"))


def short_term_risk(cats: DataFrame) -> DataFrame:
    """Intermediate (short-term) risk, rounded to 2 places."""
    b, cg, so, op, mt, te, mg = (_norm(c) for c in CATEGORY_NAMES)
    f1, f2 = SHORT_TERM["field"]
    w1, w2, w3 = SHORT_TERM["raw"]
    field = op * f1 + mt * f2
    human = null_max(so, mg)
    tech_comp = safe_div(te, te + mg + so + mt)
    raw = tech_comp * w1 + (1 - field) * w2 + (1 - human) * w3
    return cats.withColumn("intermediate_automation_risk", F.bround(raw, 2))


def top_decile_blend(risk: DataFrame, area_occupations: DataFrame, code: str = "onet_code") -> DataFrame:
    """W20 + P16: for technical_skills >= p90, blend with the area's susceptibility.

    ``area_occupations``: (OCC_CODE, automation_susceptibility) of the
    reference area; the first row per OCC_CODE (by code order) is used.
    """
    risk = write_stage(risk)  # a row for each code, read by the quantile and by the join: the ratings behind it are read once
    p90 = scalar_quantiles(risk, "technical_skills", {"_p90": TOP_TECH_QUANTILE})
    area = (area_occupations.groupBy("OCC_CODE")
                            .agg(F.min_by("automation_susceptibility", "SOC_Code_Cleaned").alias("_susc")))
    j = with_scalars(risk.withColumn("OCC_CODE", F.substring_index(F.col(code), ".", 1))
                     .join(area, "OCC_CODE", "left"), p90)
    a, s = TOP_TECH_BLEND
    blend = (F.col("technical_skills") >= F.col("_p90")) & F.col("_susc").isNotNull()
    risk_col = F.when(blend, F.col("intermediate_automation_risk") * a + F.col("_susc") / 100.0 * s) \
                .otherwise(F.col("intermediate_automation_risk"))
    return (j.withColumn("automation_risk", risk_col)
             .withColumn("automation_risk_score", logistic_score(F.col("automation_risk")))
             .drop("_p90", "_susc", "OCC_CODE"))


# ---------------------------------------------------------------- nearest code

def _prefixes(df: DataFrame, code: str) -> DataFrame:
    """(code, k, prefix of length k, next char) for k = 0..len(code)."""
    return (df.select(F.col(code).alias("_code"))
              .withColumn("_k", F.explode(F.sequence(F.lit(0), F.length("_code"))))
              .withColumn("_prefix", F.substring("_code", 1, F.col("_k")))
              .withColumn("_next", F.substring("_code", F.col("_k") + 1, 1)))


def nearest_code(wanted: DataFrame, available: DataFrame, wanted_col: str = "code",
                 available_col: str = "onet_code") -> DataFrame:
    """Nearest available code by longest common prefix.

    Ties: the smallest distance between the first differing characters
    (numeric for two digits, else code points), then the first code in code
    order; candidates that end at the common prefix come last. No cross join:
    prefixes of both sides are equi-joined, and per (prefix, next character)
    only the first code is kept, so the fan-out per wanted code is bounded by
    the alphabet size.
    Returns (wanted_col, ``match``, ``common_length``).
    """
    avail = available.select(F.col(available_col).alias("_c")).distinct()
    ap = _prefixes(avail, "_c")
    by_next = ap.groupBy("_prefix", "_next").agg(F.min("_code").alias("_first"))
    prefix_set = ap.select("_prefix").distinct()
    w = wanted.select(F.col(wanted_col).alias("_w")).distinct()
    wp = (_prefixes(w, "_w").withColumnRenamed("_code", "_w")
            .join(prefix_set, "_prefix", "left_semi")
            .groupBy("_w").agg(F.max("_k").alias("_kmax")))
    wp = wp.withColumn("_prefix", F.substring("_w", 1, F.col("_kmax"))) \
           .withColumn("_wnext", F.substring("_w", F.col("_kmax") + 1, 1))
    cand = wp.join(by_next, "_prefix")
    both_digits = F.col("_wnext").rlike("^[0-9]$") & F.col("_next").rlike("^[0-9]$")
    diff = F.when(both_digits, F.abs(F.col("_wnext").cast("int") - F.col("_next").cast("int"))) \
            .otherwise(F.abs(F.ascii("_wnext") - F.ascii("_next")))
    comparable = (F.col("_wnext") != "") & (F.col("_next") != "")
    exact = F.col("_w") == F.col("_first")
    cand = cand.withColumn("_diff", F.when(comparable, diff))
    win = Window.partitionBy("_w").orderBy(F.col("_exact").desc(), F.col("_diff").asc_nulls_last(),
                                           F.col("_first").asc())
    return (cand.withColumn("_exact", exact)
                .withColumn("_rn", F.row_number().over(win)).filter(F.col("_rn") == 1)
                .select(F.col("_w").alias(wanted_col), F.col("_first").alias("match"),
                        F.col("_kmax").alias("common_length")))


def backfill_missing(risk: DataFrame, occupations: DataFrame, code: str = "onet_code",
                     title: str = "title") -> DataFrame:
    """J10 + J11 + U3: add rows for occupation codes without skill data.

    Each missing code gets a copy of its nearest code's row with its own code
    and title and ``missing_job = true``. ``occupations``: (OCC_CODE,
    OCC_TITLE, AREA_TITLE); the first row per code (by area) gives the title.
    """
    occ = (occupations.groupBy("OCC_CODE").agg(F.min_by("OCC_TITLE", "AREA_TITLE").alias("_t"))
                      .select(F.concat(F.col("OCC_CODE"), F.lit(".00")).alias("_wc"), "_t"))
    risk = write_stage(risk)  # a row for each code, read by both joins, the search and the union
    missing = occ.join(risk.select(F.col(code).alias("_wc")), "_wc", "left_anti")
    missing = write_stage(missing)  # read by the search and by the copies
    near = nearest_code(missing, risk, "_wc", code)
    # The copied source row is the first row of the matched code.
    src = risk.withColumn("_rn", F.row_number().over(Window.partitionBy(code).orderBy(F.col(title).asc_nulls_last())))
    src = src.filter(F.col("_rn") == 1).drop("_rn")
    copies = (near.join(missing, "_wc").join(src, near.match == src[code])
                  .drop(code, title, "match", "common_length")
                  .withColumnRenamed("_wc", code).withColumnRenamed("_t", title)
                  .withColumn("missing_job", F.lit(True)))
    return risk.withColumn("missing_job", F.lit(False)).unionByName(copies)


def adoption_fill(risk: DataFrame, tech: DataFrame, code: str = "onet_code") -> DataFrame:
    """adoption_rate = hot-tech ratio by code; misses get the median of the merged column."""
    t = tech.select(F.col("onet_code").alias(code), F.col("hot_tech_ratio").alias("adoption_rate"))
    # read for the median and for the rows; a row for each code: never through the driver
    j = write_stage(risk).join(t.hint("merge"), code, "left")
    med = scalar_quantiles(j, "adoption_rate", {"_m": 0.5})
    return (with_scalars(j, med).withColumn("adoption_rate", F.coalesce("adoption_rate", "_m")).drop("_m"))


def skills_based_risk(skills: DataFrame, categories: DataFrame, area_occupations: DataFrame,
                      all_occupations: DataFrame, tech: DataFrame) -> DataFrame:
    """Stage B end to end: categories -> short-term risk -> blend -> backfill -> adoption."""
    cats = category_means(skills, categories)
    r = top_decile_blend(short_term_risk(cats), area_occupations)
    return adoption_fill(backfill_missing(r, all_occupations), tech)
