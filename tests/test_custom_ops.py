"""Custom distributed operators against brute-force Python implementations."""

import random

import numpy as np
import pandas as pd

from workrisk.operators import dashboards as DB
from workrisk.operators import profiling as P
from workrisk.operators import skills as K
from workrisk.operators import transitions as G


def _nearest_brute(code, avail):
    if code in avail:
        return code
    def cpl(a, b):
        n = 0
        for x, y in zip(a, b):
            if x != y:
                break
            n += 1
        return n
    best = max(cpl(code, c) for c in avail)
    cands = sorted(c for c in avail if cpl(code, c) == best)
    scored = []
    for c in cands:
        if best < len(code) and best < len(c):
            x, y = code[best], c[best]
            d = abs(int(x) - int(y)) if x.isdigit() and y.isdigit() else abs(ord(x) - ord(y))
            scored.append((d, c))
    return min(scored)[1] if scored else cands[0]


def test_nearest_code_matches_brute_force(spark):  # J11
    rnd = random.Random(7)
    avail = sorted({f"{rnd.randint(10, 19)}-{rnd.randint(0, 9999):04d}.00" for _ in range(60)} | {"11-10"})
    wanted = [f"{rnd.randint(10, 21)}-{rnd.randint(0, 9999):04d}.00" for _ in range(40)] + [avail[3], "11-1", "9"]
    w = spark.createDataFrame([(c,) for c in wanted], "code string")
    a = spark.createDataFrame([(c,) for c in avail], "onet_code string")
    got = {r.code: r.match for r in K.nearest_code(w, a).collect()}
    assert got == {c: _nearest_brute(c, avail) for c in set(wanted)}


def test_growth_pattern(spark):  # M18
    rows = [("Data Analyst", 4.0), ("Claims Adjuster", 4.0), ("AI lead", 4.0), ("Paint", 4.0), (None, 4.0)]
    cats = spark.createDataFrame([(f"c{i}", t, 3.0, 3.0, s, 3.0, 3.0, s, 3.0) for i, (t, s) in enumerate(rows)],
                                 "onet_code string, title string, basic_skills double, cognitive_skills double, "
                                 "social_skills double, operations_skills double, maintenance_skills double, "
                                 "technical_skills double, management_skills double")
    got = [r.growth_discounted for r in K.long_term_risk(cats).orderBy("onet_code").collect()]
    assert got == [True, False, True, False, False]


def test_pair_weights_brute_force(spark):  # G2-G4
    rnd = np.random.default_rng(3)
    n, k = 23, 6
    V = rnd.normal(size=(n, k))
    risk = rnd.choice([10.0, 20.0, 30.0, 0.0], size=n)
    hot = rnd.uniform(size=n)
    rows = [(f"j{i:02d}", [float(x) for x in V[i]], float(risk[i]), float(hot[i])) for i in range(n)]
    jobs = spark.createDataFrame(rows, "code string, v array<double>, risk double, hot double")
    got = {(r.src, r.dst): r.w for r in G.pair_weights(jobs, tile_size=5).collect()}
    exp = {}
    for i in range(n):
        for j in range(n):
            if i == j or risk[j] > risk[i]:
                continue
            sim = V[i] @ V[j] / (np.linalg.norm(V[i]) * np.linalg.norm(V[j]))
            cost = float(np.sum(np.abs(V[j] - V[i]) * V[j]))
            rf = 1 - risk[j] / risk[i] if risk[i] > 0 else 0.0
            exp[(f"j{i:02d}", f"j{j:02d}")] = 0.4 * sim + 0.2 / (1 + cost) + 0.3 * rf + 0.1 * (1 - abs(hot[i] - hot[j]))
    assert got.keys() == exp.keys()
    assert all(abs(got[p] - exp[p]) < 1e-9 * (1 + abs(exp[p])) for p in exp)


def test_job_rank_matches_python(spark):  # G6
    edges = [("a", "b", 0.5), ("a", "c", 0.5), ("b", "a", 1.0), ("c", "a", 0.25), ("d", "a", 1.0)]
    df = spark.createDataFrame(edges, "src string, dst string, weight double")
    got = {r.node: r.rank for r in G.job_rank(df, max_iter=30).collect()}
    nodes = sorted({x for e in edges for x in e[:2]})
    r = {v: 1 / len(nodes) for v in nodes}
    for _ in range(30):
        r = {v: 0.15 / len(nodes) + 0.85 * sum(r[s] * w for s, d, w in edges if d == v) for v in nodes}
    assert all(abs(got[v] - r[v]) < 1e-12 for v in nodes)


def test_label_density_matches_pandas(spark):  # W16 / M17
    for n in (19, 20, 21, 57):
        rnd = random.Random(n)
        rows = [(i, float(rnd.randint(0, 9)), rnd.randint(0, 1)) for i in range(n)]
        df = spark.createDataFrame(rows, "doc_id long, score double, label int")
        got = {r.doc_id: r.label_sum for r in P.label_density(df, "score", "label", "doc_id").collect()}
        pdf = pd.DataFrame(rows, columns=["doc_id", "score", "label"]).sort_values(["score", "doc_id"],
                                                                                   ascending=[False, True])
        exp = pdf["label"].rolling(20).sum()
        for doc, val in zip(pdf["doc_id"], exp):
            assert (got[doc] is None) == pd.isna(val)
            if got[doc] is not None:
                assert got[doc] == val


def test_wage_quartiles_qcut_semantics(spark):  # M16
    wages = [1, 2, 3, 3, 3, 4, 5, 6]
    occ = spark.createDataFrame([("A", f"c{i}", float(w), 1.0, 10.0, 10.0) for i, w in enumerate(wages)],
                                "AREA_TITLE string, SOC_Code_Cleaned string, A_MEAN double, TOT_EMP double, "
                                "automation_susceptibility double, enhanced_automation_risk double")
    got = {r.wage_quartile: r.total_employment for r in DB.wage_quartiles(occ).collect()}
    exp = pd.Series(1.0, index=pd.qcut(pd.Series(wages, dtype=float), 4, labels=DB.WAGE_LABELS)).groupby(level=0,
                                                                                                         observed=True).sum()
    assert got == exp.to_dict()


def test_band_join(spark):  # J14
    vals = [0.0, 0.0, 1.0, 1.2, 1.3, 0.76, 5.0, 6.0, -1.0]
    df = spark.createDataFrame([(f"s{i}", v) for i, v in enumerate(vals)], "state string, current_ratio double")
    got = {(r.a, r.b) for r in DB.band_join(df, "state", "current_ratio", 0.75, 1.25).collect()}
    exp = {(f"s{i}", f"s{j}") for i, a in enumerate(vals) for j, b in enumerate(vals)
           if i != j and b >= a * 0.75 and b <= a * 1.25}
    assert got == exp


def test_transition_types(spark):  # F8 / G7 labels
    pairs = [("11-1011.00", "11-1021.00"), ("11-1011.00", "11-2011.00"), ("11-1011.00", "13-1011.00")]
    df = spark.createDataFrame(pairs, "src string, dst string")
    from pyspark.sql import functions as F
    labels = [r[0] for r in df.select(G.transition_label(F.col("src"), F.col("dst"))).collect()]
    assert labels == ["same_minor", "different_minor", "general"]
    keep = [r[0] for r in df.select(G.type_filter("different_minor")).collect()]
    assert keep == [False, True, False]
    keep = [r[0] for r in df.select(G.type_filter("different_major")).collect()]
    assert keep == [False, False, True]
    import pytest
    with pytest.raises(ValueError):
        G.type_filter("sideways")


def test_tiles_with_ties_lose_no_pair(spark):  # G2: risk-ordered blocks
    from pyspark.sql import functions as F
    rnd = random.Random(5)
    rows = [(f"j{i:02d}", [rnd.random(), rnd.random()], float(rnd.choice([0, 1, 1, 1, 1, 2, 3])), 0.5) for i in range(40)]
    jobs = spark.createDataFrame(rows, "code string, v array<double>, risk double, hot double")
    table = G.pair_table(jobs, tile_size=4).collect()
    assert sorted((r.src, r.dst) for r in table if r.dst) == sorted(
        (a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and b[2] <= a[2])
    by_src = {}
    for r in table:
        part = by_src.setdefault(r.src, [0.0, 0.0])
        part[r.dst is None] += r.w
    assert all(abs(a - b) < 1e-9 for a, b in by_src.values())
    formed = {(r.bi, r.bj) for r in G.tiles(jobs.withColumn("risk", F.expr("cast(substr(code, 2) as double)")), 4).collect()}
    assert formed == {(i, j) for i in range(10) for j in range(i + 1)}  # distinct risks: half of the grid
    written = spark.createDataFrame(table, G.PAIR_SCHEMA)
    exact = {(r.src, r.dst): r.p for r in G.transition_matrix(written.filter("dst is not null")).collect()}
    found = {(r.src, r.dst): r.p for r in G.table_matrix(written).collect()}
    assert found.keys() == exact.keys() and all(abs(found[k] - exact[k]) < 1e-9 for k in exact)


def test_transition_edge_cases(spark):  # G3-G6 fixtures
    # a: risk 0 -> risk factor 0; b is riskier than a -> no a->b pair; c has a vector that makes a
    # negative weight (kept in the row sum, dropped from the graph); d is isolated (only riskier targets).
    jobs = spark.createDataFrame([
        ("a", [1.0, 0.0], 0.0, 0.5), ("b", [0.0, 1.0], 50.0, 0.5),
        ("c", [-3.0, -3.0], 50.0, 0.0), ("d", [1.0, 1.0], -1.0, 1.0)],
        "code string, v array<double>, risk double, hot double")
    pairs = G.pair_weights(jobs, tile_size=2)
    got = {(r.src, r.dst): r.w for r in pairs.collect()}
    assert ("a", "b") not in got and ("d", "a") not in got   # riskier targets have weight 0
    assert ("a", "d") in got and ("b", "c") in got and ("c", "b") in got
    m = {(r.src, r.dst): r.p for r in G.transition_matrix(pairs).collect()}
    for src in {"a", "b", "c"}:
        row = [p for (s, _), p in m.items() if s == src]
        assert abs(sum(row) - 1.0) < 1e-9          # rows (incl. negative weights) sum to 1
    edges = G.graph_edges(G.transition_matrix(pairs))
    assert all(r.weight > 0 for r in edges.collect())


def test_quantiles_by_key_matches_percentile(spark):
    from pyspark.sql import functions as F
    from workrisk.operators.common import quantiles_by_key
    rnd = random.Random(11)
    rows = [("hot", float(rnd.randint(0, 50))) for _ in range(400)]          # a hot key with ties
    rows += [(f"k{i}", float(rnd.random())) for i in range(30) for _ in range(rnd.randint(1, 4))]
    rows += [("nulls", None), ("k0", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    qs = [0.25, 0.5, 0.75, 0.9]
    got = {(r.k, r.q): r.quantile for r in quantiles_by_key(df, ["k"], "v", qs).collect()}
    exp = {}
    for r in df.groupBy("k").agg(F.percentile("v", qs).alias("p")).collect():
        if r.p is not None:
            for q, x in zip(qs, r.p):
                exp[(r.k, q)] = x
    assert got.keys() == exp.keys()
    assert all(abs(got[key] - exp[key]) <= 1e-12 * (1 + abs(exp[key])) for key in exp)


def test_quantiles_without_keys_and_with_null_keys(spark):
    from pyspark.sql import functions as F
    from workrisk.operators.common import quantiles_by_key, scalar_quantiles
    rows = [(None, 1.0), (None, 2.0), ("", 5.0), ("a", 7.0)] + [("a", 3.0)] * 200 + [("a", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {(r.k, r.q): r.quantile for r in quantiles_by_key(df, ["k"], "v", [0.0, 0.5, 1.0]).collect()}
    assert got == {(None, 0.0): 1.0, (None, 0.5): 1.5, (None, 1.0): 2.0, ("", 0.0): 5.0, ("", 0.5): 5.0, ("", 1.0): 5.0,
                   ("a", 0.0): 3.0, ("a", 0.5): 3.0, ("a", 1.0): 7.0}
    one = scalar_quantiles(df, "v", {"low": 0.1, "mid": 0.5, "top": 0.999}).first()
    exact = df.agg(F.percentile("v", [0.1, 0.5, 0.999]).alias("p")).first().p
    assert all(abs(a - b) < 1e-9 for a, b in zip(one, exact))
    assert tuple(scalar_quantiles(df.limit(0), "v", {"mid": 0.5}).first()) == (None,)


def test_keyed_positions_stable_under_checkpoint(spark):
    """Positions must not depend on whether the range shuffle is evaluated once or twice."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    from workrisk.operators.common import keyed_positions
    from workrisk.session import materialize
    rnd = random.Random(5)
    rows = [("hot" if i % 3 else f"k{i % 7}", rnd.random(), f"c{i:05d}") for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v double, code string")
    order = [F.col("v").desc(), F.col("code").asc()]
    kp = materialize(keyed_positions(df, ["k"], order))
    w = kp.withColumn("p2", F.row_number().over(Window.partitionBy("k").orderBy(*order)))
    assert w.count() == 3000
    assert w.filter(F.col("pos") != F.col("p2")).count() == 0


def test_ties_nulls_and_duplicates(spark):  # M10 / M11
    from pyspark.sql import functions as F
    from workrisk.operators.common import top_k
    from workrisk.operators.exposure import dedup_first
    rows = [("A", "c3", 5.0), ("A", "c1", 5.0), ("A", "c2", None), ("A", "c4", 7.0), ("A", "c5", 5.0)]
    df = spark.createDataFrame(rows, "k string, code string, v double")
    got = [(r.rank, r.code) for r in top_k(df, ["k"], [F.col("v").desc_nulls_last()], 4, ["code"])
           .orderBy("rank").collect()]
    assert got == [(1, "c4"), (2, "c1"), (3, "c3"), (4, "c5")]          # ties by code, NULL last
    dup = spark.createDataFrame([("A", "c1", "x", 2), ("A", "c1", "y", 1), ("B", "c1", "z", 3)],
                                "k string, code string, payload string, o int")
    kept = {(r.k, r.code): r.payload for r in dedup_first(dup, ["k", "code"], [F.col("o").asc()]).collect()}
    assert kept == {("A", "c1"): "y", ("B", "c1"): "z"}


def test_histogram_last_bin_closed(spark):  # T3
    vals = [0.0, 1.0, 2.5, 10.0, 10.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = {r.bin: r["count"] for r in P.histogram(df, "x", bins=4).collect()}
    exp_counts, _ = np.histogram(vals, bins=4)
    assert [got[i + 1] for i in range(4)] == list(exp_counts)


def test_kde_matches_numpy(spark):  # T5
    rnd = np.random.default_rng(2)
    vals = rnd.normal(10, 3, size=200)
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = sorted((r.point, r.density) for r in P.kde(df, "x").collect())
    h = vals.std(ddof=1) * len(vals) ** (-0.2)
    grid = np.linspace(vals.min(), vals.max(), 100)
    exp = (np.exp(-0.5 * ((grid[:, None] - vals[None, :]) / h) ** 2) / (h * np.sqrt(2 * np.pi))).mean(axis=1)
    assert len(got) == 100
    assert np.allclose([d for _, d in got], exp, rtol=1e-9, atol=1e-12)


def test_box_stats_match_numpy(spark):  # T4
    vals = [1.0, 2.0, 3.0, 3.0, 4.0, 5.0, 6.0, 40.0, -30.0]
    r = P.box_stats(spark.createDataFrame([(v,) for v in vals], "x double"), "x").collect()[0]
    q1, med, q3 = np.percentile(vals, [25, 50, 75])
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    inside = [v for v in vals if lo <= v <= hi]
    assert (r.q1, r.median, r.q3) == (q1, med, q3)
    assert (r.whisker_low, r.whisker_high, r.outliers) == (min(inside), max(inside), len(vals) - len(inside))


def test_ecdf_positions(spark):  # T6 (ties are not merged)
    vals = [3.0, 1.0, 2.0, 2.0, None, 5.0]
    df = spark.createDataFrame([(f"k{i}", v) for i, v in enumerate(vals)], "k string, x double")
    got = sorted((r.pos, r.k, r.ecdf) for r in P.ecdf(df, "x", "k").collect())
    order = sorted((v, f"k{i}") for i, v in enumerate(vals) if v is not None)
    assert got == [(i + 1, k, (i + 1) / 5) for i, (_, k) in enumerate(order)]


def test_opportunity_rows_keep_codes_without_an_area(spark):
    from workrisk.operators import rollup as R
    v1 = spark.createDataFrame([("11-1.00", "a", 0.12), ("11-1.01", "b", 0.14), ("12-2.00", "c", None)],
                               "onet_code string, title string, technical_composition double")
    codes = R.opportunity_codes_v1(v1)
    assert sorted(tuple(r) for r in codes.collect()) == [("11-1", "b", 0.14), ("12-2", "c", None)]
    area = spark.createDataFrame([("11-1", "X", 5.0, 2.0, "s"), ("11-1", "Y", 1.0, 3.0, None), ("99-9", "X", 1.0, 1.0, "s")],
                                 "OCC_CODE string, AREA_TITLE string, TOT_EMP double, economic_value double, sector string")
    rows = R.opportunity_rows(codes, area)
    assert sorted((r["OCC_CODE"], r["AREA_TITLE"] or "") for r in rows.collect()) == [("11-1", "X"), ("11-1", "Y"), ("12-2", "")]
    assert [tuple(r) for r in R.opportunity_sector_value(rows).collect()] == [("s", 2.0)]


def test_document_without_sectors_has_empty_maps(spark):
    from workrisk.operators import rollup as R
    schema = ("AREA_TITLE string, OCC_CODE string, OCC_TITLE string, TOT_EMP double, economic_value double, sector string, "
              "RISK_EMP long, AT_RISK_ECONOMIC_VALUE long, perc_ile_thresholded_risk boolean")
    det = spark.createDataFrame([("X", "1", "a", 4.0, 8.0, None, 1, 2, True), ("Y", "2", "b", 6.0, 2.0, "s", 3, 1, False)], schema)
    opp = spark.createDataFrame([("2",)], "OCC_CODE string")
    doc = R.risk_opportunity_document(R.area_rollup(det, opp), R.sector_rollup(det, opp), R.sector_top5(det, opp))
    by = {r["area"]: r for r in doc.collect()}
    assert by["X"]["risk"]["total_jobs_at_risk"] == 4.0 and by["X"]["employment_by_industry"] == {}
    assert by["Y"]["risk"]["employment_at_risk_by_industry"] == {} and by["Y"]["risk"]["industry_wise_top_5_jobs"] == []
    assert by["Y"]["opportunity"]["economic_value_opportunity_by_industry"] == {"s": 2.0}
    assert R.document_fields(doc).where("area = 'X'").count() == len(R.AREA_FIELDS)
