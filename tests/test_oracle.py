"""Registered queries against their DuckDB oracle at sf0.001 (one or more per stage)."""

import pytest

from conftest import SF_SMALL
from oracle import compare, duck
from workrisk.plans.catalog import all_queries

SAMPLE = ["exposure_index_by_group", "area_summary", "occupation_details", "level_fallback", "wage_fill",
          "quality_report", "box_stats", "synthetic_distribution",
          "skill_categories", "risk_long_term", "nearest_code", "adoption_fill", "opportunity_v2",
          "sector_rollup", "sector_top5", "transition_matrix", "recommendations", "skill_gaps",
          "wage_quartiles", "similar_areas", "projection", "histogram", "ecdf", "label_density",
          "employment_from_csv", "app_entries", "apps_by_major", "soc_titles_from_json", "title_lookup", "merge_check",
          "groups_csv_roundtrip", "requested_recommendations", "document_roundtrip", "sector_documents", "profile",
          "percentile_flag", "top_decile_blend", "kde", "top_occupations", "area_group_chart", "area_occupation_gaps"]


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, con, name):
    q = all_queries()[name]
    ok, msg = compare(q.build(spark, SF_SMALL), con, q.sql, check_types=True)
    assert ok, msg


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0
    assert set(E.oracle_sql()) <= set(E.queries())
