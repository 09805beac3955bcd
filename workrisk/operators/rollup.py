"""Risk and opportunity roll-up by area x sector and nationally (stage D).

The reference loops over every area plus ``None`` (national); here a single
GROUPING SETS aggregation produces both levels. ``grouping_id`` - not a NULL
area - marks the national level, because a sector can itself be NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workrisk.functions import occ_from_onet, safe_div, sum0
from workrisk.operators.common import multi_top_k, scalar_quantiles, with_scalars
from workrisk.operators.exposure import AREA

RISK_PERCENTILE = 0.8
NATIONAL = "National"
SECTOR = "sector"


def first_per_occ(df: DataFrame, code: str = "onet_code") -> DataFrame:
    """OCC_CODE from an O*NET code; the first row per OCC_CODE (by O*NET code) is kept."""
    from workrisk.operators.exposure import dedup_first
    d = df.withColumn("OCC_CODE", occ_from_onet(code))
    return dedup_first(d, ["OCC_CODE"], [F.col(code).asc()])


def percentile_flag(risk: DataFrame, q: float = RISK_PERCENTILE) -> DataFrame:
    """automation_risk_score >= its q-quantile over the deduplicated codes."""
    r = first_per_occ(risk)
    thr = scalar_quantiles(r, "automation_risk_score", {"risk_threshold": q})
    return (with_scalars(r, thr)
             .withColumn("perc_ile_thresholded_risk", F.col("automation_risk_score") >= F.col("risk_threshold")))


def sector_dim(sector: DataFrame) -> DataFrame:
    """J4 input: (OCC_CODE, sector), first row per OCC_CODE."""
    return first_per_occ(sector).select("OCC_CODE", SECTOR)


def displacement(occupations: DataFrame, sector: DataFrame, job_risk: DataFrame) -> DataFrame:
    """J4 + J5 + P26: occupations with sector, risk score (median filled) and displacement."""
    jr = job_risk.select("OCC_CODE", "automation_risk_score", "perc_ile_thresholded_risk", "adoption_rate")
    j = occupations.join(sector_dim(sector), "OCC_CODE", "left").join(jr, "OCC_CODE", "left")
    med = scalar_quantiles(j, "automation_risk_score", {"_med": 0.5})
    rate = F.col("adoption_rate") * (F.col("automation_risk_score") / 100.0)
    return (with_scalars(j, med)
             .withColumn("automation_risk_score", F.coalesce("automation_risk_score", "_med"))
             .withColumn("displacement_rate", rate)
             .withColumn("RISK_EMP", F.coalesce(F.col("TOT_EMP") * F.col("displacement_rate"), F.lit(0.0))
                         .cast("bigint"))
             .withColumn("AT_RISK_ECONOMIC_VALUE",
                         F.coalesce(F.col("economic_value") * F.col("displacement_rate"), F.lit(0.0)).cast("bigint"))
             .withColumn("perc_ile_thresholded_risk", F.coalesce("perc_ile_thresholded_risk", F.lit(False)))
             .drop("_med"))


def opportunity_codes(v2: DataFrame) -> DataFrame:
    """F7 after W1: the first classification row per OCC_CODE, kept if it is high potential."""
    from workrisk.operators.opportunity import high_potential
    return high_potential(first_per_occ(v2)).select("OCC_CODE")


def opportunity_codes_v1(v1: DataFrame) -> DataFrame:
    """J7 input: the composition band's first row per OCC_CODE in its order (highest composition first)."""
    from workrisk.operators.exposure import dedup_first
    d = v1.withColumn("OCC_CODE", occ_from_onet("onet_code"))
    order = [F.col("technical_composition").desc_nulls_last(), F.col("onet_code").asc()]
    return dedup_first(d, ["OCC_CODE"], order).select("OCC_CODE", "title", "technical_composition")


def opportunity_rows(codes: DataFrame, detailed: DataFrame) -> DataFrame:
    """Every opportunity code with its occupation rows; codes without any keep one row of NULLs."""
    return codes.join(detailed.select("OCC_CODE", "AREA_TITLE", "TOT_EMP", "economic_value", SECTOR), "OCC_CODE", "left")


def opportunity_sector_value(rows: DataFrame) -> DataFrame:
    """Economic value of the opportunity rows by sector (rows without a sector are in no group)."""
    return (rows.filter(F.col(SECTOR).isNotNull()).groupBy(SECTOR)
                .agg(sum0("economic_value").alias("economic_value")))


def opportunity_occupations(detailed: DataFrame, opp_codes: DataFrame) -> DataFrame:
    """The high-potential occupation codes joined to every area's rows."""
    return detailed.join(opp_codes, "OCC_CODE")


def sector_rollup(detailed: DataFrame, opportunity: DataFrame) -> DataFrame:
    """A7 + A9 + J9: per (area, sector) and per sector nationally, in one GROUPING SETS pass.

    Rows with a NULL sector are not grouped (pandas drops NaN keys) but are
    part of the area totals of ``area_rollup``.
    """
    opp = opportunity.select("OCC_CODE").withColumn("_opp", F.lit(True))
    d = (detailed.join(opp, "OCC_CODE", "left")
                 .withColumn("_opp", F.coalesce("_opp", F.lit(False)))
                 .filter(F.col(SECTOR).isNotNull()))
    flag, opp_c = F.col("perc_ile_thresholded_risk"), F.col("_opp")
    g = (d.groupingSets([[AREA, SECTOR], [SECTOR]], AREA, SECTOR)
          .agg(F.grouping_id().alias("_gid"),
               sum0("TOT_EMP").alias("employment"),
               sum0("economic_value").alias("economic_value"),
               F.coalesce(F.sum(F.when(flag, F.col("RISK_EMP"))), F.lit(0)).alias("risk_employment"),
               F.coalesce(F.sum(F.when(flag, F.col("AT_RISK_ECONOMIC_VALUE"))), F.lit(0))
                .alias("risk_economic_value"),
               F.count_if(flag).alias("risk_occupations"),
               sum0(F.when(opp_c, F.col("TOT_EMP"))).alias("opportunity_employment"),
               sum0(F.when(opp_c, F.col("economic_value"))).alias("opportunity_economic_value"),
               F.count_if(opp_c).alias("opportunity_occupations")))
    return (g.withColumn("area", F.when(F.col("_gid") == 0, F.col(AREA)).otherwise(F.lit(NATIONAL)))
             .withColumn("risk_impact_pct",
                         F.coalesce(safe_div("risk_employment", "employment") * 100.0, F.lit(0.0)))
             .withColumn("opportunity_impact_pct",
                         F.coalesce(safe_div("opportunity_employment", "employment") * 100.0, F.lit(0.0)))
             .select("area", SECTOR, "employment", "economic_value", "risk_employment", "risk_economic_value",
                     "risk_occupations", "opportunity_employment", "opportunity_economic_value",
                     "opportunity_occupations", "risk_impact_pct", "opportunity_impact_pct"))


def area_rollup(detailed: DataFrame, opportunity: DataFrame) -> DataFrame:
    """Area and national totals and shares for risk and opportunity (GROUPING SETS ((area), ()))."""
    opp = opportunity.select("OCC_CODE").withColumn("_opp", F.lit(True))
    d = detailed.join(opp, "OCC_CODE", "left").withColumn("_opp", F.coalesce("_opp", F.lit(False)))
    flag, opp_c = F.col("perc_ile_thresholded_risk"), F.col("_opp")
    g = (d.groupingSets([[AREA], []], AREA)
          .agg(F.grouping_id().alias("_gid"),
               sum0("TOT_EMP").alias("total_jobs"),
               sum0("economic_value").alias("total_economic_value"),
               sum0(F.when(flag, F.col("TOT_EMP"))).alias("total_jobs_at_risk"),
               sum0(F.when(flag, F.col("economic_value"))).alias("total_economic_value_at_risk"),
               sum0(F.when(opp_c, F.col("TOT_EMP"))).alias("total_jobs_opportunity"),
               sum0(F.when(opp_c, F.col("economic_value"))).alias("total_economic_value_opportunity")))
    pct = lambda a, b: safe_div(a, b) * 100.0
    return (g.withColumn("state", F.when(F.col("_gid") == 0, F.col(AREA)).otherwise(F.lit(NATIONAL)))
             .withColumn("total_jobs_at_risk_percentage", pct("total_jobs_at_risk", "total_jobs"))
             .withColumn("total_economic_value_at_risk_percentage",
                         pct("total_economic_value_at_risk", "total_economic_value"))
             .withColumn("total_jobs_opportunity_percentage", pct("total_jobs_opportunity", "total_jobs"))
             .withColumn("total_economic_value_opportunity_percentage",
                         pct("total_economic_value_opportunity", "total_economic_value"))
             .drop("_gid", AREA))


def sector_top5(detailed: DataFrame, opportunity: DataFrame, k: int = 5) -> DataFrame:
    """Top-k occupations per (area, sector) and per sector nationally.

    Risk rankings use RISK_EMP / AT_RISK_ECONOMIC_VALUE of flagged rows;
    opportunity rankings TOT_EMP / economic_value of high-potential rows.
    Ties are broken by (OCC_CODE, area) so every ranking is a total order.
    """
    codes = opportunity.select("OCC_CODE").distinct().withColumn("_opp", F.lit(True))
    rows = (detailed.join(codes, "OCC_CODE", "left").filter(F.col(SECTOR).isNotNull())
            .select(F.col(AREA).alias("src_area"), SECTOR, "OCC_CODE", "OCC_TITLE", "perc_ile_thresholded_risk", "_opp",
                    *[F.col(c).cast("double").alias(c) for c in ("TOT_EMP", "economic_value", "RISK_EMP", "AT_RISK_ECONOMIC_VALUE")]))
    sides = [("risk", F.col("perc_ile_thresholded_risk"), "RISK_EMP", "AT_RISK_ECONOMIC_VALUE"),
             ("opportunity", F.coalesce("_opp", F.lit(False)), "TOT_EMP", "economic_value")]
    entries = [F.when(takes_part, F.struct(F.lit(kind).alias("kind"), F.lit(by).alias("ranked_by"), area.alias("area"),
                                           F.col(emp).alias("employment"), F.col(ev).alias("value"), F.col(order).alias("_order")))
               for kind, takes_part, emp, ev in sides for by, order in (("employment", emp), ("economic_value", ev))
               for area in (F.col("src_area"), F.lit(NATIONAL))]
    ranked = multi_top_k(rows.filter(sides[0][1] | sides[1][1]), ["kind", "ranked_by", "area", SECTOR],
                         F.array_compact(F.array(*entries)), k, [F.col("_order").desc_nulls_last()], ["OCC_CODE", "src_area"])
    return ranked.select("kind", "ranked_by", "area", SECTOR, "rank", "OCC_CODE", "OCC_TITLE", "src_area", "employment",
                         F.col("value").alias("economic_value"))


# Fields of the document: part, name, column of the area totals; part, name, column by sector, count that must be positive.
AREA_FIELDS = [
    ("all", "total_jobs", "total_jobs"),
    ("all", "total_economic_value", "total_economic_value"),
    ("risk", "total_jobs_at_risk", "total_jobs_at_risk"),
    ("risk", "total_jobs_at_risk_percentage", "total_jobs_at_risk_percentage"),
    ("risk", "total_economic_value_at_risk", "total_economic_value_at_risk"),
    ("risk", "total_economic_value_at_risk_percentage", "total_economic_value_at_risk_percentage"),
    ("opportunity", "total_jobs_opportunity", "total_jobs_opportunity"),
    ("opportunity", "total_jobs_opportunity_percentage", "total_jobs_opportunity_percentage"),
    ("opportunity", "total_economic_value_opportunity", "total_economic_value_opportunity"),
    ("opportunity", "total_economic_value_opportunity_percentage", "total_economic_value_opportunity_percentage"),
]
SECTOR_FIELDS = [
    ("all", "employment_by_industry", "employment", None),
    ("all", "economic_value_by_industry", "economic_value", None),
    ("risk", "industry_impact_percentage", "risk_impact_pct", None),
    ("risk", "employment_at_risk_by_industry", "risk_employment", "risk_occupations"),
    ("risk", "economic_value_at_risk_by_industry", "risk_economic_value", "risk_occupations"),
    ("opportunity", "industry_impact_percentage", "opportunity_impact_pct", None),
    ("opportunity", "employment_opportunity_by_industry", "opportunity_employment", "opportunity_occupations"),
    ("opportunity", "economic_value_opportunity_by_industry", "opportunity_economic_value", "opportunity_occupations"),
]
TOP_JOBS = "industry_wise_top_5_jobs"


def risk_opportunity_document(area_totals: DataFrame, sectors: DataFrame, top5: DataFrame) -> DataFrame:
    """One nested document per area (and ``National``): totals and maps by sector, and a
    ``risk`` and an ``opportunity`` part with their totals, maps by sector and top-5 lists.

    A sector without a flagged (high-potential) occupation is not in the maps of that part.
    Lists and maps are bounded by the sectors of an area."""
    def entry(column: str, needs: str | None):
        pair = F.struct(SECTOR, F.col(column).cast("double"))
        return F.collect_list(pair if needs is None else F.when(F.col(needs) > 0, pair))

    by_sector = sectors.groupBy("area").agg(*[
        F.map_from_entries(entry(column, needs)).alias(f"_{part}_{name}") for part, name, column, needs in SECTOR_FIELDS])
    job = F.struct("ranked_by", SECTOR, F.col("rank").cast("bigint").alias("rank"), "OCC_CODE", "OCC_TITLE", "employment",
                   "economic_value")
    tops = top5.groupBy("area").agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == kind, job)))
                                      .alias(f"_{kind}_{TOP_JOBS}") for kind in ("risk", "opportunity")])
    joined = (area_totals.withColumnRenamed("state", "area").join(by_sector, "area", "left")
              .join(tops, "area", "left"))

    def fields(part: str):
        empty = F.create_map().cast("map<string,double>")
        out = [F.col(column).alias(name) for of, name, column in AREA_FIELDS if of == part]
        out += [F.coalesce(f"_{part}_{name}", empty).alias(name) for of, name, _, _ in SECTOR_FIELDS if of == part]
        if part != "all":
            jobs = F.col(f"_{part}_{TOP_JOBS}")
            out.append(F.coalesce(jobs, F.array().cast(tops.schema[f"_{part}_{TOP_JOBS}"].dataType)).alias(TOP_JOBS))
        return out

    return joined.select("area", *fields("all"), F.struct(*fields("risk")).alias("risk"),
                         F.struct(*fields("opportunity")).alias("opportunity"))


def document_fields(doc: DataFrame) -> DataFrame:
    """The document as rows: area, part, field, sector, position, code, value."""
    def row(part, field, value, sector=None, position=None, code=None):
        return F.struct(F.lit(part).alias("part"), field.alias("field"),
                        F.lit(None).cast("string").alias("sector") if sector is None else sector.alias("sector"),
                        (F.lit(None) if position is None else position).cast("bigint").alias("position"),
                        (F.lit(None) if code is None else code).cast("string").alias("code"),
                        value.cast("double").alias("value"))

    def at(part: str, name: str):
        return F.col(name) if part == "all" else F.col(f"{part}.{name}")

    lists = [F.array(*[row(part, F.lit(name), at(part, name)) for part, name, _ in AREA_FIELDS])]
    def by_sector(part: str, name: str):
        return F.transform(F.map_entries(at(part, name)), lambda e: row(part, F.lit(name), e["value"], e["key"]))

    def jobs(part: str):
        return F.transform(at(part, TOP_JOBS), lambda e: row(
            part, F.concat(F.lit("top_5_by_"), e["ranked_by"]),
            F.when(e["ranked_by"] == "employment", e["employment"]).otherwise(e["economic_value"]),
            e[SECTOR], e["rank"], e["OCC_CODE"]))

    lists += [by_sector(part, name) for part, name, _, _ in SECTOR_FIELDS]
    lists += [jobs(part) for part in ("risk", "opportunity")]
    return doc.select("area", F.explode(F.concat(*lists)).alias("x")).select("area", "x.*")


# ---------------------------------------------------------------- D12

SECTOR_MAPS = {"industry_impact_percentage": "impact", "industry_wise_economic_value": "economic_value",
               "industry_wise_employment": "employment", "risked_top_5_industry_by_employment": "risk_employment",
               "risked_top_5_industry_by_economic_value": "risk_economic_value"}
RISKED = ("risk_employment", "risk_economic_value")  # only sectors with a row at risk are in these maps
AREA_TOTALS = {"total_jobs": "employment", "total_economic_value": "economic_value", "total_jobs_at_risk": "risk_employment",
               "total_jobs_at_risk_percentage": "jobs_pct", "total_economic_value_at_risk": "risk_economic_value",
               "total_economic_value_at_risk_percentage": "value_pct"}
SECTOR_DOCUMENT = ("area string, " + ", ".join(f"{c} double" for c in AREA_TOTALS) + ", "
                   + ", ".join(f"{c} map<string,double>" for c in SECTOR_MAPS)
                   + f", {TOP_JOBS} array<struct<ranked_by:string,sector:string,rank:bigint,OCC_CODE:string,OCC_TITLE:string,"
                     "employment:double,economic_value:double>>")


def sector_document(detailed: DataFrame, k: int = 5) -> DataFrame:
    """One document for each area: totals, maps by sector, and the top-k occupations at risk of each sector.

    Totals and sectors come from one aggregation, the top lists from one ranking; both are rows
    (area, section, ...) of one union that a single grouping by area turns into documents. A list
    is bounded by the sectors of an area."""
    flag = F.col("perc_ile_thresholded_risk")
    sums = (detailed.groupingSets([[AREA], [AREA, SECTOR]], AREA, SECTOR)
            .agg(F.grouping(SECTOR).alias("whole"), sum0("TOT_EMP").alias("employment"), sum0("economic_value").alias("economic_value"),
                 sum0(F.when(flag, F.col("TOT_EMP"))).alias("risk_employment"),
                 sum0(F.when(flag, F.col("economic_value"))).alias("risk_economic_value"), F.count_if(flag).alias("at_risk"))
            .filter((F.col("whole") == 1) | F.col(SECTOR).isNotNull())
            .withColumn("jobs_pct", safe_div("risk_employment", "employment") * 100.0)
            .withColumn("value_pct", safe_div("risk_economic_value", "economic_value") * 100.0)
            .withColumn("impact", F.coalesce("jobs_pct", F.lit(0.0))))
    rankings = F.array(*[F.struct(F.lit(by).alias("ranked_by"), F.col(c).alias("_order"))
                         for by, c in (("employment", "TOT_EMP"), ("economic_value", "economic_value"))])
    jobs = multi_top_k(detailed.filter(flag & F.col(SECTOR).isNotNull()).select(AREA, SECTOR, "OCC_CODE", "OCC_TITLE", "TOT_EMP", "economic_value"),
                       [AREA, SECTOR, "ranked_by"], rankings, k, [F.col("_order").desc_nulls_last()], ["OCC_CODE"])
    numbers = [*dict.fromkeys([*AREA_TOTALS.values(), *SECTOR_MAPS.values(), "at_risk"])]
    job = F.struct("ranked_by", F.col(SECTOR).alias("sector"), F.col("rank").cast("bigint").alias("rank"), "OCC_CODE", "OCC_TITLE",
                   F.col("TOT_EMP").cast("double").alias("employment"), F.col("economic_value").cast("double").alias("economic_value"))
    rows = sums.select(F.col(AREA).alias("area"), F.when(F.col("whole") == 0, F.col(SECTOR)).alias("sector"),
                       F.struct(*[F.col(c).cast("double").alias(c) for c in numbers]).alias("n"), F.lit(None).cast(jobs.select(job.alias("j")).schema["j"].dataType).alias("job"))
    tops = jobs.select(F.col(AREA).alias("area"), F.lit(None).cast("string").alias("sector"), F.lit(None).cast(rows.schema["n"].dataType).alias("n"),
                       job.alias("job"))
    is_total = F.col("sector").isNull() & F.col("n").isNotNull()
    total = F.max(F.when(is_total, F.col("n")))

    def by_sector(c: str) -> Column:
        here = F.col("sector").isNotNull()
        if c in RISKED:
            here = here & (F.col("n.at_risk") > 0)
        return F.map_from_entries(F.array_sort(F.collect_list(F.when(here, F.struct("sector", F.col(f"n.{c}"))))))

    return rows.union(tops).groupBy("area").agg(
        *[total[c].alias(name) for name, c in AREA_TOTALS.items()], *[by_sector(c).alias(name) for name, c in SECTOR_MAPS.items()],
        F.array_sort(F.collect_list("job")).alias(TOP_JOBS))


def sector_document_fields(docs: DataFrame) -> DataFrame:
    """The documents of D12 as rows: area, field, sector, position, code, value."""
    def row(field, value, sector=None, position=None, code=None):
        return F.struct(field.alias("field"), (F.lit(None) if sector is None else sector).cast("string").alias("sector"),
                        (F.lit(None) if position is None else position).cast("bigint").alias("position"),
                        (F.lit(None) if code is None else code).cast("string").alias("code"), value.cast("double").alias("value"))

    def of_map(name: str) -> Column:
        return F.transform(F.map_entries(name), lambda e: row(F.lit(name), e["value"], e["key"]))

    jobs = F.transform(TOP_JOBS, lambda e: row(F.concat(F.lit("top_5_by_"), e["ranked_by"]),
                                               F.when(e["ranked_by"] == "employment", e["employment"]).otherwise(e["economic_value"]),
                                               e["sector"], e["rank"], e["OCC_CODE"]))
    lists = [F.array(*[row(F.lit(c), F.col(c)) for c in AREA_TOTALS]), *map(of_map, SECTOR_MAPS), jobs]
    return docs.select("area", F.inline(F.concat(*lists)))
