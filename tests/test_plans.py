"""Plan-shape checks behind the scale claims (no cross joins; broadcast join-backs)."""

import contextlib
import io

from pyspark.sql import functions as F

from conftest import SF_SMALL
from workrisk.operators import dashboards as DB
from workrisk.operators import exposure as X
from workrisk.operators import skills as K
from workrisk.operators import transitions as G
from workrisk.sources import domain

NO_PAIRS = ("CartesianProduct", "BroadcastNestedLoopJoin")


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def test_tiles_have_no_cross_join(spark):
    jobs = spark.createDataFrame([(f"j{i}", [float(i), 1.0], float(i % 3), 0.5) for i in range(10)],
                                 "code string, v array<double>, risk double, hot double")
    plan = _plan(G.pair_weights(jobs, tile_size=4))
    assert not any(op in plan for op in NO_PAIRS)


def test_nearest_code_has_no_cross_join(spark):
    w = spark.createDataFrame([("11-1011.00",), ("13-2000.00",)], "code string")
    a = spark.createDataFrame([("11-1021.00",), ("13-2011.00",)], "onet_code string")
    plan = _plan(K.nearest_code(w, a))
    assert not any(op in plan for op in NO_PAIRS)


def test_band_join_is_an_equi_join(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.2), ("c", 3.0)], "state string, current_ratio double")
    plan = _plan(DB.band_join(df, "state", "current_ratio", 0.75, 1.25))
    assert not any(op in plan for op in NO_PAIRS)


def test_level_stats_are_broadcast(spark):
    emp = X.clean_employment(domain.employment(spark, SF_SMALL)).filter(X.is_state_area())
    plan = _plan(X.select_levels(emp).select("AREA_TITLE", "OCC_CODE", F.col("O_GROUP")))
    # the per-(area, prefix) statistics are joined back as a broadcast: the fact is not shuffled for it
    assert "BroadcastHashJoin" in plan


def test_facts_are_summed_before_grouping_sets(spark):
    tree = _plan(domain.employment(spark, SF_SMALL)).split("\n\n")[0]
    below = tree[tree.index("Expand"):]
    assert below.index("HashAggregate") < below.index("Scan")


def test_ratings_are_read_once(spark):
    """Risk of the codes: the quantile, the joins and the search read a written table, not the ratings again."""
    from workrisk.plans import q_skills
    files = q_skills._blended(spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not [f for f in files if "embeddings" in f]


def test_facts_are_shuffled_once_by_part(spark):
    """The sums, the national sums and the part meet in one shuffle of the facts; no copy of the sums is shuffled."""
    exchanges = [ln for ln in _plan(domain.employment(spark, SF_SMALL)).split("\n") if ln.startswith("Arguments: hashpartitioning(")]
    assert len([ln for ln in exchanges if "l_partkey" in ln]) == 1
    assert not [ln for ln in exchanges if "n_name" in ln and "l_partkey" in ln]


def test_occupations_read_only_the_columns_needed(spark):
    """Readers of the occupations scan the written wages table, without the columns that they do not use."""
    occ = X.occupations(domain.employment(spark, SF_SMALL), domain.tech(spark, SF_SMALL), domain.apps(spark, SF_SMALL))
    assert occ.inputFiles()
    plan = _plan(occ.groupBy(X.AREA).agg(F.sum("A_MEAN")))
    scans = [ln for ln in plan.split("\n") if ln.startswith("ReadSchema")]
    assert scans and not [ln for ln in scans if "OCC_TITLE" in ln or "tech_intensity_score" in ln]


def test_summary_is_kept(spark):
    """Dashboards of the same session read the summary once computed, not the occupations again."""
    from workrisk.plans import q_exposure
    s = q_exposure._summary(spark, SF_SMALL)
    assert s is q_exposure._summary(spark, SF_SMALL)
    assert "Scan parquet" not in _plan(DB.projections(s))
