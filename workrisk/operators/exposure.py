"""Exposure index: area -> occupation -> minor group (stage A of the reference).

All areas are computed in one pass. Per-area scalars (totals, maxima,
medians) are computed with ``groupBy(area)`` - partial aggregation before the
shuffle - and joined back on the area key, instead of windows partitioned by
area: a window would put every row of a hot area into one task. The joined-back
side has one row per area (or per area x major group / 2-digit prefix), a size
bounded by geography x occupation taxonomy and not by data volume, so it is
broadcast explicitly (``_per_area``) and the occupation table is never
shuffled for a join-back. Global scalars (tech maximum, tech median) are
one-row aggregates (``with_scalars``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workrisk.functions import (clean_soc_code, clip, dirty_to_double, major_code, minor_code,
                                risk_category, safe_div, sum0)
from workrisk.operators.common import quantiles_by_key, scalar_quantiles, with_scalars
from workrisk.session import materialize, write_stage

AREA = "AREA_TITLE"
CODE = "SOC_Code_Cleaned"
US_AREA = "U.S."
# Fixed values of the reference's model.
POTENTIAL_THRESHOLD = 50
CURRENT_THRESHOLD = 60
SUSCEPTIBILITY_WEIGHTS = (0.8, 0.2)     # normalised tech intensity, hot-tech ratio
ENHANCED_WEIGHTS = (0.75, 0.25)         # susceptibility, normalised app count
DETAILED_SHARE_MIN = 0.7
DEFAULT_WAGE = 50000.0
LEVEL_ORDER = ["detailed", "broad", "major", "minor", "total"]


def _per_area(stats: DataFrame) -> DataFrame:
    """Broadcast a per-area (or area x major-group) aggregate: bounded by geography x taxonomy.

    It is cut first, so that readers of the joined table do not aggregate again."""
    return F.broadcast(materialize(stats))


def _level_rank(c: str = "O_GROUP") -> Column:
    pos = F.array_position(F.array(*[F.lit(x) for x in LEVEL_ORDER]), F.col(c))
    return F.when(pos > 0, pos).otherwise(F.lit(len(LEVEL_ORDER) + 1))


# --------------------------------------------------------------------- cleaning

def clean_employment(emp: DataFrame, numeric=("TOT_EMP", "A_MEAN", "A_MEDIAN")) -> DataFrame:
    """P1 + P6: cleaned code column and dirty text numbers converted to double."""
    out = emp.withColumn(CODE, clean_soc_code("OCC_CODE"))
    for c in numeric:
        if c in emp.columns:
            out = out.withColumn(c, dirty_to_double(c))
    return out


def is_state_area(area: str = AREA) -> Column:
    """Row predicate: the area is a state (not the national row, no metro areas, no commas)."""
    a = F.col(area)
    return (a.isNotNull() & (a != US_AREA) & ~a.startswith("Metropolitan")
            & ~a.startswith("Nonmetropolitan") & ~a.contains(","))


def state_areas(emp: DataFrame, area: str = AREA) -> DataFrame:
    """The distinct state areas."""
    return emp.filter(is_state_area(area)).select(area).distinct()


def select_levels(emp: DataFrame, area: str = AREA, level: str = "O_GROUP", code: str = "OCC_CODE",
                  detailed_share_min: float = DETAILED_SHARE_MIN) -> DataFrame:
    """keep detailed occupations, with broad fallback, per area in one pass.

    One aggregation at (area, 2-digit prefix) grain; the area totals are
    window sums over that small table, so the fact is scanned once for stats.
    """
    lv = F.col(level)
    with_prefix = emp.withColumn("_p2", F.coalesce(F.substring(F.col(code).cast("string"), 1, 2), F.lit("")))  # rows without code stay
    prefix_stats = with_prefix.groupBy(area, "_p2").agg(
        F.count(F.lit(1)).alias("_c_all"), F.count_if(lv == "detailed").alias("_c_det"),
        F.count_if(lv == "broad").alias("_c_broad"), F.count_if(lv == "total").alias("_c_total"),
        F.count_if(lv == "major").alias("_c_major"))
    whole = Window.partitionBy(area)    # the prefixes of an area: bounded by the taxonomy
    stats = prefix_stats.select(
        area, "_p2", F.sum("_c_all").over(whole).alias("_n_all"), F.sum("_c_det").over(whole).alias("_n_det"),
        F.sum("_c_broad").over(whole).alias("_n_broad"), F.sum("_c_total").over(whole).alias("_n_total"),
        (F.col("_c_det") > 0).alias("_det_prefix"), (F.col("_c_major") > 0).alias("_major_prefix"))
    j = with_prefix.join(_per_area(stats), [area, "_p2"])
    add_broad = ((F.col("_n_det") < F.col("_n_all") * detailed_share_min) & (F.col("_n_broad") > 0)
                 & (lv == "broad") & F.col("_major_prefix") & ~F.col("_det_prefix"))
    keep = (F.when(F.col("_n_det") > 0, (lv == "detailed") | add_broad)
             .when(F.col("_n_broad") > 0, lv == "broad")
             .otherwise((F.col("_n_total") == 0) | (lv != "total")))
    return j.filter(keep).drop("_p2", "_n_all", "_n_det", "_n_broad", "_n_total",
                               "_det_prefix", "_major_prefix")


def dedup_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Keep the first row per key under an explicit total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Every row whose key occurs more than once (``duplicated(keep=False)``)."""
    dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("dup_count")).filter(F.col("dup_count") > 1)
    return df.join(dup, keys)


# --------------------------------------------------------------------- tech / wages / apps

def tech_susceptibility(tech: DataFrame, code_col: str = "SOC_Code") -> DataFrame:
    """P7-P9 on the tech dimension; deduplicated on the cleaned code."""
    mx = (tech.agg(F.max("tech_intensity_score").alias("_max_tis")))
    w_norm, w_hot = SUSCEPTIBILITY_WEIGHTS
    t = (with_scalars(tech, mx)
             .withColumn("tech_intensity_normalized", safe_div("tech_intensity_score", "_max_tis"))
             .withColumn("automation_susceptibility",
                         clip((F.col("tech_intensity_normalized") * w_norm + F.col("hot_tech_ratio") * w_hot)
                              * 100.0, 0, 100))
             .withColumn("automation_risk_category", risk_category("automation_susceptibility"))
             .withColumn(CODE, clean_soc_code(code_col))
             .drop("_max_tis"))
    return dedup_first(t, [CODE], [F.col(code_col).asc_nulls_last(), F.col("tech_intensity_score").desc_nulls_last()])


def attach_tech(occ: DataFrame, tech_s: DataFrame) -> DataFrame:
    """J1 + P35: left join susceptibility; fill misses with the median of the tech table."""
    med = scalar_quantiles(tech_s, "automation_susceptibility", {"_med_susc": 0.5})
    dim = tech_s.select(CODE, "tech_intensity_score", "automation_susceptibility")
    susc = F.coalesce(F.col("automation_susceptibility"), F.col("_med_susc"))
    return (with_scalars(occ.join(dim.hint("merge"), CODE, "left"), med)
               .withColumn("automation_susceptibility", susc)
               .withColumn("automation_risk_category", risk_category("automation_susceptibility"))
               .drop("_med_susc"))


def national_wages(emp_clean: DataFrame, area: str = AREA) -> DataFrame:
    """(code, national wage) from the national rows; one row per code."""
    nat = emp_clean.filter(F.col(area) == US_AREA)
    # Duplicate national codes: the largest wage is used (a deterministic
    # replacement for the file-order dependent "last one wins").
    return nat.groupBy(CODE).agg(F.max("A_MEAN").alias("_nat_wage"))


def fill_wages(occ: DataFrame, nat_wages: DataFrame, area: str = AREA,
               default_wage: float = DEFAULT_WAGE) -> DataFrame:
    """missing/zero wage -> national wage -> area median of the rest -> default."""
    missing = F.col("A_MEAN").isNull() | (F.col("A_MEAN") == 0)
    # cut once: read by the median and by the final fill
    step1 = write_stage(occ.join(nat_wages.hint("merge"), CODE, "left")
                           .withColumn("A_MEAN", F.when(missing, F.col("_nat_wage")).otherwise(F.col("A_MEAN")))
                           .drop("_nat_wage"))
    ok = F.col("A_MEAN").isNotNull() & (F.col("A_MEAN") != 0)
    # exact median per area without buffering an area's wages in one task
    med = (quantiles_by_key(step1.filter(ok), [area], "A_MEAN", [0.5])
           .select(area, F.col("quantile").alias("_med_wage")))
    fill = F.coalesce(F.when(F.col("_med_wage") != 0, F.col("_med_wage")), F.lit(default_wage))
    return (step1.join(_per_area(med), area, "left")
                 .withColumn("A_MEAN", F.when(ok, F.col("A_MEAN")).otherwise(fill))
                 .drop("_med_wage"))


def app_counts_by_major(apps: DataFrame | None) -> DataFrame | None:
    """App coverage config -> (major_group, apps).

    Of several entries of a major group the last one counts if the entries have a ``position``
    (as the readers give it), else - without an order - the largest."""
    if apps is None:
        return None
    code_col = "major_group_code" if "major_group_code" in apps.columns else "soc_code"
    a = apps.withColumn("_major", major_code(clean_soc_code(code_col)))
    chosen = F.max_by("estimated_apps", "position") if "position" in apps.columns else F.max("estimated_apps")
    return a.groupBy("_major").agg(chosen.cast("double").alias("estimated_zapier_apps_major"))


def app_coverage(occ: DataFrame, apps_by_major: DataFrame | None, area: str = AREA) -> DataFrame:
    """J2 + A4 + P10: apps spread by employment share; enhanced risk.

    The per-area maximum of the spread app count is derived from the small
    (area, major) table: max_i apps_major * emp_i / emp_major equals
    apps_major * max_emp / emp_major per major, so the fact is aggregated once;
    the app counts join that table and reach the fact with it.
    """
    o = occ.withColumn("major_group", major_code(CODE))
    major = o.groupBy(area, "major_group").agg(sum0("TOT_EMP").alias("major_group_emp_total"), F.max("TOT_EMP").alias("_max_emp"))
    if apps_by_major is None:
        major = major.withColumn("_am", F.lit(0.0))
    else:
        am = apps_by_major.select(F.col("_major").alias("major_group"), F.col("estimated_zapier_apps_major").alias("_am"))
        major = major.join(F.broadcast(am), "major_group", "left").withColumn("_am", F.coalesce("_am", F.lit(0.0)))
    spread_max = F.coalesce(F.col("_am") * safe_div("_max_emp", "major_group_emp_total"), F.lit(0.0))
    stats = major.select(area, "major_group", F.col("_am").alias("estimated_zapier_apps_major"), "major_group_emp_total",
                         F.max(spread_max).over(Window.partitionBy(area)).alias("_max_apps"))
    o = o.join(_per_area(stats), [area, "major_group"])
    apps = F.coalesce(F.col("estimated_zapier_apps_major") * safe_div("TOT_EMP", "major_group_emp_total"),
                      F.lit(0.0))
    o = (o.withColumn("estimated_zapier_apps", apps)
          .withColumn("zapier_apps_per_worker",
                      F.coalesce(safe_div("estimated_zapier_apps", "TOT_EMP"), F.lit(0.0))))
    w_s, w_a = ENHANCED_WEIGHTS
    apps_norm = F.when(F.col("_max_apps") > 0, F.col("estimated_zapier_apps") / F.col("_max_apps")).otherwise(0.0)
    enhanced = clip((F.col("automation_susceptibility") / 100.0 * w_s + apps_norm * w_a) * 100.0, 0, 100)
    return (o.withColumn("enhanced_automation_risk", enhanced)
             .withColumn("enhanced_risk_category", risk_category("enhanced_automation_risk"))
             .drop("_max_apps"))


# --------------------------------------------------------------------- measure

def area_totals(occ: DataFrame, area: str = AREA) -> DataFrame:
    """Value, employment and the maxima of the econ potential of each area, in one aggregation
    (division by the positive area total is monotone, so the row maximum of
    susc * ev / total is max(susc * ev) / total)."""
    ev, susc = F.col("TOT_EMP") * F.col("A_MEAN"), F.col("automation_susceptibility")
    return occ.groupBy(area).agg(sum0(ev).alias("_tot_ev"), sum0("TOT_EMP").alias("_tot_emp"),
                                 F.max(susc * ev).alias("_mx_ev"), F.max(susc * F.col("TOT_EMP")).alias("_mx_emp"))


def measure(occ: DataFrame, minor_titles: DataFrame | None = None, area: str = AREA,
            threshold: float = POTENTIAL_THRESHOLD, current_threshold: float = CURRENT_THRESHOLD,
            totals: DataFrame | None = None) -> DataFrame:
    """P11-P13 + F3: economic value, risk flags, econ potential, minor group.

    ``totals`` are the ``area_totals`` of these rows; taken from an earlier step of the same rows
    they spare the steps in between a second run."""
    ev = F.col("TOT_EMP") * F.col("A_MEAN")
    susc = F.col("automation_susceptibility")
    o = occ.join(_per_area(area_totals(occ, area) if totals is None else totals), area)
    use_emp = F.col("_tot_ev") == 0
    o = (o.withColumn("economic_value", F.when(use_emp, F.col("TOT_EMP")).otherwise(ev))
          .withColumn("area_economic_value", F.when(use_emp, F.col("_tot_emp")).otherwise(F.col("_tot_ev")))
          .withColumn("is_potentially_at_risk", F.coalesce(susc > threshold, F.lit(False)))
          .withColumn("is_currently_at_risk",
                      F.coalesce(F.col("enhanced_automation_risk") > current_threshold, F.lit(False)))
          .withColumn("potential_index", F.when(F.col("is_potentially_at_risk"), 100.0).otherwise(0.0))
          .withColumn("_epi", safe_div(susc * F.col("economic_value"), "area_economic_value"))
          .withColumn("_max_epi", safe_div(F.when(use_emp, F.col("_mx_emp")).otherwise(F.col("_mx_ev")),
                                           "area_economic_value"))
          .withColumn("econ_potential_index", safe_div("_epi", "_max_epi"))
          .drop("_tot_ev", "_tot_emp", "_mx_ev", "_mx_emp", "_epi", "_max_epi"))
    o = o.filter(F.col(CODE).isNotNull() & (F.trim(F.col(CODE)) != ""))
    o = o.withColumn("minor_group", minor_code(CODE))
    if minor_titles is not None:
        t = minor_titles.select(F.col("minor_code").alias("minor_group"), F.col("minor_title").alias("_mt"))
        o = o.join(t, "minor_group", "left")
    else:
        o = o.withColumn("_mt", F.lit(None).cast("string"))
    return o.withColumn("minor_group_name", F.coalesce(F.col("_mt"), F.col("minor_group"))).drop("_mt")


def group_index(occ: DataFrame, area: str = AREA) -> DataFrame:
    """A1-A3: minor-group roll-up, indices, gap and area-weighted index."""
    pot, cur, ev = F.col("is_potentially_at_risk"), F.col("is_currently_at_risk"), F.col("economic_value")
    g = occ.groupBy(area, "minor_group", "minor_group_name").agg(
        sum0("TOT_EMP").alias("TOT_EMP"),
        sum0("economic_value").alias("economic_value"),
        F.avg("automation_susceptibility").alias("automation_susceptibility"),
        F.avg("enhanced_automation_risk").alias("enhanced_automation_risk"),
        F.count_if(pot).alias("is_potentially_at_risk"),
        F.count_if(cur).alias("is_currently_at_risk"),
        sum0("estimated_zapier_apps").alias("estimated_zapier_apps"),
        F.avg("zapier_apps_per_worker").alias("zapier_apps_per_worker"),
        F.array_join(F.array_sort(F.collect_list(F.when(pot, F.col(CODE)))), ",").alias("at_risk_soc_codes"),
        sum0(F.when(pot, ev)).alias("potential_econ_value_at_risk"),
        sum0(F.when(cur, ev)).alias("current_econ_value_at_risk"),
        F.first("area_economic_value").alias("_area_ev"))
    return (g.withColumn("minor_potential_index", safe_div("potential_econ_value_at_risk", "economic_value") * 100.0)
             .withColumn("minor_current_index", safe_div("current_econ_value_at_risk", "economic_value") * 100.0)
             .withColumn("automation_gap", F.col("minor_potential_index") - F.col("minor_current_index"))
             .withColumn("weighted_current_index",
                         F.col("minor_current_index") * safe_div("economic_value", "_area_ev"))
             .drop("_area_ev"))


def ranked_names(groups: DataFrame, area: str = AREA, score: str = "minor_current_index",
                 name: str = "minor_group_name", k: int = 3) -> DataFrame:
    """Per area the first and last ``k`` names by ``score`` descending (nulls last)."""
    w = Window.partitionBy(area).orderBy(F.col(score).desc_nulls_last(), F.col("minor_group").asc())
    r = (groups.withColumn("_rn", F.row_number().over(w))
               .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(area))))
    pair = F.struct(F.col("_rn"), F.col(name).alias("n"))
    return r.groupBy(area).agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_rn") <= k, pair))), lambda s: s["n"])
         .alias("highest_risk_industries"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_rn") > F.col("_n") - k, pair))), lambda s: s["n"])
         .alias("lowest_risk_industries"))


def area_summary(occ: DataFrame, groups: DataFrame, area: str = AREA,
                 threshold: float = POTENTIAL_THRESHOLD) -> DataFrame:
    """A5 + W3: one summary row per area."""
    pot, cur, emp = F.col("is_potentially_at_risk"), F.col("is_currently_at_risk"), F.col("TOT_EMP")
    o = occ.groupBy(area).agg(
        F.count(F.lit(1)).alias("total_occupations"),
        F.count_if(pot).alias("occupations_at_potential_risk"),
        F.count_if(cur).alias("occupations_at_current_risk"),
        sum0(emp).alias("total_employment"),
        sum0(F.when(pot, emp)).alias("potential_employment_at_risk"),
        sum0(F.when(cur, emp)).alias("current_employment_at_risk"),
        F.first("area_economic_value").alias("economic_value_total"))
    # one row per area x minor group (bounded by the taxonomy), read by the sums and by the names
    groups = materialize(groups.select(area, "minor_group", "minor_group_name", "minor_current_index",
                                       "potential_econ_value_at_risk", "current_econ_value_at_risk"))
    g = groups.groupBy(area).agg(sum0("potential_econ_value_at_risk").alias("potential_economic_value_at_risk"),
                                 sum0("current_econ_value_at_risk").alias("current_economic_value_at_risk"))
    tot = F.col("economic_value_total")
    ratio = lambda c: F.when(tot > 0, F.col(c) / tot * 100.0).otherwise(0.0)
    s = (o.join(g, area, "left").join(ranked_names(groups, area), area, "left")
          .withColumn("potential_ratio", ratio("potential_economic_value_at_risk"))
          .withColumn("current_ratio", ratio("current_economic_value_at_risk"))
          .withColumn("automation_gap", F.col("potential_ratio") - F.col("current_ratio"))
          .withColumn("risk_threshold_used", F.lit(int(threshold)).cast("bigint"))
          .withColumn("pct_potential_employment_at_risk",
                      safe_div("potential_employment_at_risk", "total_employment") * 100.0)
          .withColumn("pct_current_employment_at_risk",
                      safe_div("current_employment_at_risk", "total_employment") * 100.0)
          .withColumn("pct_potential_economic_value_at_risk", F.col("potential_ratio"))
          .withColumn("pct_current_economic_value_at_risk", F.col("current_ratio")))
    return s.withColumnRenamed(area, "state")


@dataclass
class ExposureResult:
    occupations: DataFrame
    groups: DataFrame
    summary: DataFrame


def occupations(employment: DataFrame, tech: DataFrame, apps: DataFrame | None = None,
                minor_titles: DataFrame | None = None, threshold: float = POTENTIAL_THRESHOLD) -> DataFrame:
    """Occupation-level table for every state area (stage A up to P13/F3)."""
    # The raw fact is read once: cleaned employment rows are written and
    # then feed level selection, the national wage map and validation.
    emp = write_stage(clean_employment(employment).drop(CODE)).withColumn(CODE, clean_soc_code("OCC_CODE"))
    # One shuffle by code serves the deduplication and both joins by code; the code comes
    # first in the sort, which the joins then share. Rows of one code meet in one task: as many as
    # areas, and more only where the code is missing.
    occ = select_levels(emp.filter(is_state_area())).repartition(CODE)
    occ = dedup_first(occ, [CODE, AREA], [_level_rank().asc(), F.col("OCC_CODE").asc(), F.col("OCC_TITLE").asc()])
    occ = attach_tech(occ, write_stage(tech_susceptibility(tech).select(CODE, "tech_intensity_score", "automation_susceptibility")))
    # Written by ``fill_wages``. What follows are broadcast joins with small written tables, so the
    # wide result is not stored: its readers compute the columns they need.
    occ = fill_wages(occ, national_wages(emp))
    totals = area_totals(occ)
    occ = app_coverage(occ, app_counts_by_major(apps))
    return measure(occ, minor_titles, threshold=threshold, totals=totals)


def exposure_index(employment: DataFrame, tech: DataFrame, apps: DataFrame | None = None,
                   minor_titles: DataFrame | None = None, threshold: float = POTENTIAL_THRESHOLD) -> ExposureResult:
    occ = occupations(employment, tech, apps, minor_titles, threshold)
    groups = group_index(occ)
    return ExposureResult(occ, groups, area_summary(occ, groups, threshold=threshold))
