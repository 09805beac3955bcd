"""Readers and sinks on small files written by the test itself."""

import json
import os
import tempfile

from workrisk.sources import readers, sinks


def test_app_coverage_prefers_detailed(spark):
    d = tempfile.mkdtemp()
    p = os.path.join(d, "apps.json")
    doc = {"zapier_apps_by_soc": [{"soc_code": "11-0000", "major_group": "11", "estimated_apps": 5,
                                   "percentage": 1.0, "key_zapier_categories": ["a"]}],
           "metadata": {"total_zapier_apps": 5, "source": "s", "date": "d"}}
    with open(p, "w") as f:
        json.dump(doc, f, indent=2)
    rows = readers.read_app_coverage(spark, p).collect()
    assert [(r.soc_code, r.estimated_apps) for r in rows] == [("11-0000", 5)]


def test_soc_mapping_and_minor_titles(spark):
    d = tempfile.mkdtemp()
    p = os.path.join(d, "soc.json")
    doc = {"11-1011": {"minor_code": "11-1000", "minor_title": "Top Executives", "major_code": "11-0000",
                       "major_title": "Management", "broad_title": "b", "detailed_title": "Chief Executives"},
           "11-1021": {"minor_code": "11-1000", "minor_title": "Other", "major_code": "11-0000",
                       "major_title": "Management", "broad_title": "b", "detailed_title": "GM"}}
    with open(p, "w") as f:
        json.dump(doc, f)
    m = readers.read_soc_mapping(spark, p)
    assert m.count() == 2
    t = {r.minor_code: r.minor_title for r in readers.minor_titles(m).collect()}
    assert t == {"111": "Top Executives"}
    g = {(r.level, r.code): r.title for r in readers.group_titles(m).collect()}
    assert g == {("major", "11"): "Management", ("minor", "111"): "Top Executives", ("broad", "1110"): "b"}


def test_code_list_and_roundtrip(spark):
    d = tempfile.mkdtemp()
    p = os.path.join(d, "codes.txt")
    with open(p, "w") as f:
        f.write("11-1011.00\n\n 13-2011.00 \n")
    codes = readers.read_code_list(spark, p)
    assert sorted(r.code for r in codes.collect()) == ["11-1011.00", "13-2011.00"]
    df = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "state string, v double")
    out = os.path.join(d, "out")
    sinks.write_partitioned(df, out)
    back = spark.read.parquet(out)
    assert sorted((r.state, r.v) for r in back.collect()) == [("A", 1.0), ("B", 2.0)]


def test_area_files(spark):
    d = tempfile.mkdtemp()
    for area, v in (("new_york", 1), ("guam", 2)):
        with open(os.path.join(d, f"{area}_industry_analysis.csv"), "w") as f:
            f.write(f"minor_group,TOT_EMP\n111,{v}\n")
        with open(os.path.join(d, f"{area}_summary.csv"), "w") as f:
            f.write("x\n1\n")
    df = readers.read_area_files(spark, d, "_industry_analysis.csv", "minor_group string, TOT_EMP double")
    assert sorted((r.state, r.TOT_EMP) for r in df.collect()) == [("Guam", 2.0), ("New York", 1.0)]


def test_employment_csv_end_to_end(spark):  # S1 + P1/P6 (M1)
    from workrisk.operators import exposure as X
    d = tempfile.mkdtemp()
    p = os.path.join(d, "emp.csv")
    with open(p, "w") as f:
        f.write("AREA_TITLE,OCC_CODE,OCC_TITLE,O_GROUP,TOT_EMP,A_MEAN,A_MEDIAN\n"
                'Guam,11-1011,Chief Executives,detailed,"1,234","123,080",*\n'
                "Guam,11-1021,Managers,detailed,*,#,\n")
    e = X.clean_employment(readers.read_employment(spark, p))
    got = sorted((r.SOC_Code_Cleaned, r.TOT_EMP, r.A_MEAN, r.A_MEDIAN) for r in e.collect())
    assert got == [("111011", 1234.0, 123080.0, None), ("111021", None, None, None)]


def test_recommendations_for_requested_codes(spark):  # S4 + G7
    import pytest

    from workrisk.operators import transitions as G
    vec = spark.createDataFrame([("11-1011.00", [1.0, 0.5]), ("11-2011.00", [0.8, 0.4]), ("13-1011.00", [0.1, 0.9])],
                                "code string, v array<double>")
    edges = spark.createDataFrame([("11-1011.00", "11-2011.00", 0.7), ("11-1011.00", "13-1011.00", 0.3),
                                   ("13-1011.00", "11-1011.00", 1.0)], "src string, dst string, weight double")
    titles = spark.createDataFrame([("11-1011.00", "CEO"), ("11-2011.00", "Ad manager")], "onet_code string, title string")
    tech = spark.createDataFrame([("11-2011.00", 20.0, 0.5)], "onet_code string, tech_intensity_score double, hot_tech_ratio double")
    d = tempfile.mkdtemp()
    p = os.path.join(d, "look_for.txt")
    with open(p, "w") as f:
        f.write("11-1011.00\n99-9999.00\n")
    req = readers.read_code_list(spark, p)
    rows = G.recommendations(edges, vec, titles, tech, ["a", "b"], n=5, transition_type="general", sources=req).collect()
    assert sorted((r.source_job, r.target_job, r.rank) for r in rows) == [
        ("11-1011.00", "11-2011.00", 1), ("11-1011.00", "13-1011.00", 2)]
    by_dst = {r.target_job: r for r in rows}
    assert by_dst["13-1011.00"].target_title == "Unknown Job (13-1011.00)"
    assert by_dst["11-2011.00"].transition_type == "different_minor"
    with pytest.raises(ValueError):
        G.recommendations(edges, vec, titles, tech, ["a", "b"], transition_type="lateral")


def test_broken_csv_lines_are_kept_apart(spark):
    d = tempfile.mkdtemp()
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write("AREA_TITLE,OCC_CODE,OCC_TITLE,O_GROUP,TOT_EMP,A_MEAN,A_MEDIAN\n"
                'Alabama,11-1011,"Chief, ""head""",detailed,"1,234",*,#\nAlabama,11-1012\n'
                "Alabama,11-1013,x,detailed,1,2,3,4\nGuam,11-1014,,broad,,,\n")
    rows = readers.read_employment(spark, d, corrupt=readers.CORRUPT).collect()
    good = [r for r in rows if r[readers.CORRUPT] is None]
    assert [(r.OCC_CODE, r.OCC_TITLE, r.TOT_EMP) for r in good] == [("11-1011", 'Chief, "head"', "1,234"), ("11-1014", None, None)]
    assert sorted(r[readers.CORRUPT] for r in rows if r not in good) == ["Alabama,11-1012", "Alabama,11-1013,x,detailed,1,2,3,4"]
    assert readers.read_employment(spark, d).count() == 4  # without the column all lines are rows


def test_last_app_entry_of_a_major_group_counts(spark):
    from workrisk.operators import exposure as X
    d = tempfile.mkdtemp()
    entry = lambda code, n: {"soc_code": code, "major_group": code[:2], "estimated_apps": n}
    for name, doc in (("a", {"zapier_apps_by_soc": [entry("11-0000", 9), entry("11-0000", 2), entry("13-0000", 4)]}),
                      ("b", {"zapier_apps_by_detailed_soc": [entry("15-1111", 7), entry("15-2222", 1)], "zapier_apps_by_soc": [entry("15-0000", 99)]}),
                      ("c", {"metadata": {"total_zapier_apps": 1}})):
        with open(os.path.join(d, name + ".json"), "w") as f:
            json.dump(doc, f, indent=1)
    apps = readers.read_app_coverage(spark, d)
    assert [r.soc_code for r in apps.orderBy("position").collect()] == ["11-0000", "11-0000", "13-0000", "15-1111", "15-2222"]
    assert dict(X.app_counts_by_major(apps).collect()) == {"11": 2.0, "13": 4.0, "15": 1.0}
    assert dict(X.app_counts_by_major(apps.drop("position")).collect()) == {"11": 9.0, "13": 4.0, "15": 7.0}


def test_title_objects_of_many_files_and_lines(spark):
    d = tempfile.mkdtemp()
    for i in range(8):
        with open(os.path.join(d, f"{i}.json"), "w") as f:
            json.dump({f"11-{i:04d}": {"minor_code": "11-1000", "minor_title": f"t{i}", "other": [1]}}, f, indent=2)
    with open(os.path.join(d, "bad.json"), "w") as f:
        f.write('{"11-9999": {')
    m = readers.read_soc_mapping(spark, d)
    assert m.rdd.getNumPartitions() > 1  # small files are packed, but spread over the cores
    assert sorted((r.detailed_code, r.minor_title, r.major_title) for r in m.collect()) == [(f"11-{i:04d}", f"t{i}", None) for i in range(8)]
    p = os.path.join(tempfile.mkdtemp(), "lines.json")
    with open(p, "w") as f:
        f.write('{"11-0001": {"minor_title": "a"}, "11-0002": null}\nnot json\n{"11-0003": {"minor_title": "c"}}\n')
    assert sorted((r.detailed_code, r.minor_title) for r in readers.read_soc_mapping(spark, p, lines=True).collect()) == [
        ("11-0001", "a"), ("11-0002", None), ("11-0003", "c")]


def test_document_sinks_round_trip(spark):
    schema = "state string, total double, maps map<string,double>, list array<struct<n:bigint,t:string>>"
    rows = [("New York", 1.5, {"a b": 2.0, "c": 0.1}, [(1, "x"), (2, None)]), ("Guam", None, {}, [])]
    df = spark.createDataFrame(rows, schema)
    d = tempfile.mkdtemp()
    sinks.write_documents(df, os.path.join(d, "by"))
    sinks.write_map_document(df, os.path.join(d, "map"))
    key = lambda r: r.state
    want = sorted(df.collect(), key=key)
    assert sorted(sinks.read_documents(spark, os.path.join(d, "by"), schema).collect(), key=key) == want
    assert sorted(sinks.read_map_document(spark, os.path.join(d, "map"), schema).collect(), key=key) == want


def test_merge_check_mends_multiplied_rows(spark):
    from workrisk.operators import exposure as X
    from workrisk.operators.quality import checked_merge
    emp = spark.createDataFrame([("A", "111011", "t", 100.0, 1.0), ("A", "111012", "u", 50.0, 1.0), ("B", "111011", "t", None, 1.0)],
                                f"{X.AREA} string, {X.CODE} string, OCC_TITLE string, TOT_EMP double, A_MEAN double")
    tech = spark.createDataFrame([("111011", 2.0, 9.0), ("111011", 1.0, 8.0)],
                                 f"{X.CODE} string, tech_intensity_score double, automation_susceptibility double")
    merged, found = checked_merge(emp, tech)
    assert found == {"original_total": 150.0, "merged_total": 250.0, "original_rows": 3, "merged_rows": 5, "multiplied": True}
    assert sorted((r[X.AREA], r[X.CODE], r.tech_intensity_score) for r in merged.collect()) == [
        ("A", "111011", 1.0), ("A", "111012", None), ("B", "111011", 1.0)]
    merged, found = checked_merge(emp, tech.limit(1))
    assert not found["multiplied"] and merged.count() == 3


def test_employment_of_odd_facts(spark):
    """Facts without a part or a part key, parts sold in one area, negative and half-cent prices, two nations of a name."""
    from workrisk.sources import domain
    d = tempfile.mkdtemp()
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    write("nation", [(0, "A", 0), (1, "B", 0), (2, "B", 0)], "n_nationkey int, n_name string, n_regionkey int")
    write("supplier", [(1, 0), (2, 1), (3, 2)], "s_suppkey bigint, s_nationkey int")
    write("part", [(1, "p1", "Brand#11", 5), (2, "p2", "Brand#12", 6)],
          "p_partkey bigint, p_name string, p_brand string, p_size int")
    write("lineitem", [(1, 1, 1.0, 0.125), (1, 2, 1.0, 10.0), (1, 3, 1.0, 20.0), (2, 1, 2.0, -0.125), (9, 1, 1.0, 30.0),
                       (None, 2, 1.0, 40.0)], "l_partkey bigint, l_suppkey bigint, l_quantity double, l_extendedprice double")
    rows = {(r.AREA_TITLE, r.OCC_CODE): (r.OCC_TITLE, r.O_GROUP, r.TOT_EMP, r.A_MEAN)
            for r in domain.employment(spark, d).filter("OCC_TITLE IS NOT NULL").collect()}
    assert rows == {
        ("A", "11-05000001"): ("p1", "detailed", "10", "5"), ("B", "11-05000001"): ("p1", "detailed", "20", "600"),
        ("U.S.", "11-05000001"): ("p1", "detailed", "30", "401"),
        ("A", "12-06000002"): ("p2", "detailed", "20", "-2"), ("U.S.", "12-06000002"): ("p2", "detailed", "20", "-2"),
        ("A", "00-0000"): ("All Occupations", "total", "40", "300"),
        ("B", "00-0000"): ("All Occupations", "total", "30", "933"),
        ("U.S.", "00-0000"): ("All Occupations", "total", "70", "571")}
    orphans = domain.employment(spark, d).filter("OCC_TITLE IS NULL").collect()
    code = "null-null  null"
    assert sorted((r.AREA_TITLE, r.OCC_CODE, r.O_GROUP, r.TOT_EMP, r.A_MEAN) for r in orphans) == [
        ("A", code, "major", "10", "1,200"), ("B", code, "major", "10", "1,600"),
        ("U.S.", code, "major", "10", "1,200"), ("U.S.", code, "major", "10", "1,600")]
