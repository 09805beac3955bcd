"""Domain-shaped inputs derived from the driver tables.

The reference consumes labour statistics (employment by area and occupation,
a technology-intensity table, app coverage by major group, a sector map and
long skill ratings). The driver ships TPC-H-like tables instead, so this
module derives tables of exactly the reference's shape from them, entirely
with Spark (their size grows with the driver tables):

* ``employment``: one row per (nation, part) with dirty text numbers, plus
  the national aggregate (``U.S.``) and per-area ``total`` rows - the area x part
  sums of ``lineitem``, shuffled once by part.
* ``tech``, ``sector``: one row per part; ``apps``: one row per brand.
* ``skills``: ``embeddings`` exploded to (code, element, scale, value).

``workrisk.plans.sql`` holds the same definitions as SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from workrisk.sources.driver import dimension, table

US_AREA = "U.S."
TOTAL_CODE = "00-0000"
_PART_CODE = "%02d-%02d%06d"
# Category of skill ``pos`` of an embedding is CATEGORIES[pos % 7].
CATEGORIES = ["basic_skills", "cognitive_skills", "social_skills", "operations_skills",
              "maintenance_skills", "technical_skills", "management_skills"]


def _brand_no(col: str = "p_brand") -> Column:
    return F.substring(F.col(col), 7, 10).cast("int")


def part_code(pk: str = "p_partkey", brand: str = "p_brand", size: str = "p_size") -> Column:
    """SOC-like code ``BB-SSPPPPPP``: major = brand, minor = brand + size digit."""
    return F.format_string(_PART_CODE, _brand_no(brand), F.col(size), F.col(pk))


def occupation_level(pk: str = "p_partkey", brand: str = "p_brand") -> Column:
    b, k = _brand_no(brand), F.col(pk)
    return (F.when(b % 5 == 0, F.when(k % 3 == 0, "major").otherwise("broad"))
             .when(k % 10 < 8, "detailed")
             .when(k % 10 == 8, "broad")
             .otherwise("major"))


def _thousands(c: Column) -> Column:
    return F.format_number(c, 0)


def _cents(c: str) -> Column:
    """Hundredths rounded half away from zero, as ``round`` gives them, without a decimal for every row."""
    x = F.abs(F.col(c) * 100)
    whole = F.floor(x)
    rounded = F.when(x - whole >= 0.5, whole + 1).otherwise(whole)
    return F.when(F.col(c) < 0, -rounded).otherwise(rounded)


def employment(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    # 25 rows: fixed size; an area is a name, numbered by the first nation of that name
    nat = table(spark, sf_dir, "nation").select(
        "n_nationkey", "n_name", F.min("n_nationkey").over(Window.partitionBy("n_name")).alias("area"))
    names = F.broadcast(nat.select("area", "n_name").distinct())
    facts = (li.join(sup, li.l_suppkey == sup.s_suppkey)
               .join(F.broadcast(nat), F.col("s_nationkey") == F.col("n_nationkey"))
               .select("area", "l_partkey", F.col("l_quantity").cast("bigint").alias("qty"),
                       _cents("l_extendedprice").alias("cents")))
    # One shuffle by part: the sums of area x part, the national sums of a part (carried by the row of
    # its first area) and the part itself meet there. The few totals come from a scan of their own.
    sums = (facts.repartition("l_partkey").groupBy("l_partkey", "area")
                 .agg(F.sum("qty").alias("qty"), F.sum("cents").alias("cents")))
    of_part = Window.partitionBy("l_partkey")
    sums = sums.select("*", F.sum("qty").over(of_part).alias("us_qty"), F.sum("cents").over(of_part).alias("us_cents"),
                       F.min("area").over(of_part).alias("first_area"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", part_code().alias("code"),
                                               occupation_level().alias("level"))
    rows = sums.join(dimension(part), sums.l_partkey == part.p_partkey, "left")
    own = F.struct(F.col("area"), F.col("qty"), F.col("cents"))
    us = F.struct(F.lit(None).cast("int").alias("area"), F.col("us_qty").alias("qty"), F.col("us_cents").alias("cents"))
    k = F.col("p_partkey")
    no_part = F.format_string(_PART_CODE, *[F.lit(None).cast("int")] * 3)
    # code and level of facts without a part are those of empty fields
    by_part = (rows.select(k, F.col("p_name").alias("OCC_TITLE"), F.coalesce("code", no_part).alias("OCC_CODE"),
                           F.coalesce("level", F.lit("major")).alias("O_GROUP"),
                           F.inline(F.when(F.col("area") == F.col("first_area"), F.array(own, us))
                                     .otherwise(F.array(own)))))
    totals = (facts.groupBy("area").agg(F.sum("qty").alias("qty"), F.sum("cents").alias("cents"))
                   .groupingSets([["area"], []], "area").agg(F.sum("qty").alias("qty"), F.sum("cents").alias("cents")))
    is_us = F.col("area").isNull()
    area_title = F.when(is_us, F.lit(US_AREA)).otherwise(F.col("n_name")).alias("AREA_TITLE")
    emp = _thousands(F.col("qty") * 10)
    wage = _thousands(F.expr("cents * 2 div (qty * 5)"))
    by_part = by_part.join(names, "area", "left").select(
        area_title, "OCC_CODE", "OCC_TITLE", "O_GROUP",
        F.when(k % 7 == 0, F.lit("*")).otherwise(emp).alias("TOT_EMP"),
        F.when(is_us & (k % 38 == 0), F.lit("#"))
         .when(~is_us & (k % 19 == 0), F.lit("#"))
         .when(~is_us & (k % 23 == 0), F.lit("0"))
         .otherwise(wage).alias("A_MEAN"))
    totals = totals.join(names, "area", "left").select(
        area_title, F.lit(TOTAL_CODE).alias("OCC_CODE"), F.lit("All Occupations").alias("OCC_TITLE"),
        F.lit("total").alias("O_GROUP"), emp.alias("TOT_EMP"), wage.alias("A_MEAN"))
    return by_part.unionByName(totals)


def tech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``all_tech`` with planted lookup misses, for the joins."""
    return _tech(table(spark, sf_dir, "part").filter(F.col("p_partkey") % 13 != 0))


def all_tech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Technology figures of every part, for the profiles."""
    return _tech(table(spark, sf_dir, "part"))


def _tech(p: DataFrame) -> DataFrame:
    n = F.col("p_size") * 3
    return p.select(
        part_code().alias("SOC_Code"),
        F.concat(part_code(), F.lit(".00")).alias("onet_code"),
        F.col("p_size").cast("double").alias("tech_intensity_score"),
        ((F.col("p_partkey") % 11) / 10.0).alias("hot_tech_ratio"),
        n.cast("bigint").alias("total_technologies"),
        F.expr("p_size * 3 * (p_partkey % 11) div 10").cast("bigint").alias("hot_technologies"),
    )


def apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(_brand_no().alias("b"))
    return (p.filter(F.col("b") % 4 != 0).groupBy("b")
             .agg(F.count(F.lit(1)).alias("estimated_apps"))
             .select(F.format_string("%02d-0000", F.col("b")).alias("soc_code"),
                     F.format_string("%02d", F.col("b")).alias("major_group"),
                     "estimated_apps"))


def sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.concat(part_code(), F.lit(".00")).alias("onet_code"),
                    F.col("p_name").alias("title"),
                    F.when(F.col("p_partkey") % 17 != 0, F.col("p_type")).alias("sector"))


def _vector_code() -> Column:
    """Code of a vector's part; vectors without a part get a code from their own id."""
    return (F.when(F.col("p_partkey").isNull(), F.format_string("00-00%06d.00", F.col("vec_id")))
             .otherwise(F.concat(part_code(), F.lit(".00"))))


def skills_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long skill ratings: (onet_code, title, element, scale, value)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    j = e.join(dimension(p), e.vec_id == p.p_partkey, "left")
    x = j.select(_vector_code().alias("onet_code"),
                 F.coalesce("p_name", F.concat(F.lit("vector "), F.col("vec_id").cast("string"))).alias("title"),
                 F.posexplode("embedding").alias("pos", "x"))
    value = F.least(F.lit(5.0), F.greatest(F.lit(1.0), F.col("x").cast("double") * 12.0 + 3.0))
    elem = F.format_string("skill_%02d", F.col("pos"))
    imp = x.select("onet_code", "title", elem.alias("element"), F.lit("Importance").alias("scale"),
                   value.alias("value"))
    lvl = x.select("onet_code", "title", elem.alias("element"), F.lit("Level").alias("scale"),
                   (value * 0.9).alias("value"))
    return imp.unionByName(lvl)


def skill_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(element, category) for the synthetic skills: fixed 64-row mapping by rule."""
    cats = F.array(*[F.lit(c) for c in CATEGORIES])
    return (spark.range(64).select(
        F.format_string("skill_%02d", F.col("id")).alias("element"),
        F.element_at(cats, (F.col("id") % 7 + 1).cast("int")).alias("category")))


def part_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hot-tech ratio of every job that has a skill vector (graph inputs)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    return (e.join(dimension(p), e.vec_id == p.p_partkey, "left")
             .select(_vector_code().alias("onet_code"),
                     ((F.col("vec_id") % 11) / 10.0).alias("hot_tech_ratio"),
                     F.coalesce("p_size", F.lit(0)).cast("double").alias("tech_intensity_score")))


def soc_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detailed-code -> title map (first title per code); the job-title lookup."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    return p.select(F.concat(part_code(), F.lit(".00")).alias("onet_code"), F.col("p_name").alias("title"))


def score_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, score, label) for label-density profiling: documents x labels."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return d.join(lab, "doc_id").select("doc_id", F.col("n_chars").cast("double").alias("score"),
                                        F.col("toxic").alias("label"))
