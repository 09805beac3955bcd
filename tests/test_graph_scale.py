"""The graph without a stored table of pairs: row sums, matrix and best edges against all pairs."""
import random

import pytest
from pyspark.sql import functions as F
from workrisk.operators import transitions as G

KINDS = {"general": lambda s, d: True,
         "different_minor": lambda s, d: s[:3] != d[:3] and s[:2] == d[:2],
         "different_major": lambda s, d: s[:2] != d[:2]}


@pytest.fixture(scope="module")
def jobs(spark):
    rnd = random.Random(9)
    rows = []
    for k in range(60):
        code = f"{rnd.choice([11, 13])}-{rnd.choice([1, 2, 3])}{k:03d}.00"
        # long negative vectors: weights and some row sums below 0; copies: equal weights
        v = [rnd.uniform(-2, 1), rnd.uniform(-2, 1)] if k % 4 else [0.5, 0.25]
        rows.append((code, v, float(rnd.choice([0, 1, 2, 3])), rnd.choice([0.0, 0.5])))
    return spark.createDataFrame(rows, "code string, v array<double>, risk double, hot double").cache()


@pytest.fixture(scope="module")
def edges(spark, jobs):
    table = G.pair_table(jobs, tile_size=7).collect()
    matrix = G.table_matrix(spark.createDataFrame(table, G.PAIR_SCHEMA)).collect()
    return [(r.src, r.dst, r.p) for r in matrix]


def test_matrix_of_two_passes(jobs, edges):
    sums = G.row_sums(jobs, 7)
    got = {(r.src, r.dst): r.p for r in G.jobs_matrix(jobs, sums, 11).collect()}
    assert got.keys() == {(s, d) for s, d, _ in edges}
    assert all(abs(got[s, d] - p) < 1e-9 * max(1, abs(p)) for s, d, p in edges)
    assert any(p < 0 for _, _, p in edges)


@pytest.mark.parametrize("kinds", [("different_minor",), ("general", "different_minor", "different_major")])
def test_best_edges_hold_the_best_of_each_type(jobs, edges, kinds):
    n, sums = 3, G.row_sums(jobs, 7)
    found = [(r.src, r.dst, r.weight) for r in G.best_edges(jobs, sums, n, kinds, tile_size=7).collect()]
    assert len(found) == len({x[:2] for x in found}) < len(edges)

    def top(all_edges, kind):
        out = {}
        for s, d, p in sorted(all_edges, key=lambda x: (x[0], -round(x[2], 9), x[1])):
            if p > 0 and KINDS[kind](s, d) and len(out.setdefault(s, [])) < n:
                out[s].append((d, round(p, 7)))
        return {s: x for s, x in out.items() if x}
    for kind in kinds:
        assert top(found, kind) == top(edges, kind)


def test_best_edges_of_some_sources(jobs, edges, spark):
    codes = [r.code for r in jobs.select("code").limit(3).collect()]
    wanted = spark.createDataFrame([(c,) for c in codes + codes + ["none"]], "code string")
    sums = G.row_sums(jobs, 7)
    part = G.best_edges(jobs, sums, 2, ("general",), wanted, tile_size=7).collect()
    whole = G.best_edges(jobs, sums, 2, ("general",), tile_size=7).filter(F.col("src").isin(codes)).collect()
    assert sorted(part) == sorted(whole) and {r.src for r in part} <= set(codes)


def test_queries_store_no_table_of_pairs(spark, monkeypatch):
    """The tables that a recommendations' query writes hold a few rows for each vector, not a row for each pair."""
    from conftest import SF_SMALL
    from workrisk.plans import q_graph, stages
    stages.clear()
    rows, write = [], q_graph.write_stage

    def counted(df):
        out = write(df)
        rows.append(out.count())
        return out
    monkeypatch.setattr(q_graph, "write_stage", counted)
    assert q_graph._recs(spark, SF_SMALL).count() > 0
    n = q_graph.jobs_table(spark, SF_SMALL).count()
    stages.clear()
    assert rows and max(rows) <= 12 * n < n * (n - 1) // 4


def test_rank_packs_the_edges_and_writes_no_table_of_them(spark):
    """Nodes in many slices, some without outgoing or incoming edges; nothing but sums goes to the shared folder."""
    import os
    from workrisk.session import ensure_checkpoint_dir
    from workrisk.sources import model as M
    rnd = random.Random(3)
    pairs = {(rnd.randrange(40), rnd.randrange(50)) for _ in range(300)}
    edges = [(f"n{s}", f"n{d}", rnd.random() / 8) for s, d in sorted(pairs)]
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    df = spark.createDataFrame(edges, "src string, dst string, weight double")
    nodes, n_edges = M.counted_nodes(df)
    assert n_edges == len(edges) and sorted(r.id for r in nodes.collect()) == list(range(nodes.count()))
    names = sorted({x for e in edges for x in e[:2]})
    want = {v: 1 / len(names) for v in names}
    for _ in range(15):
        new = {v: 0.15 / len(names) for v in names}
        for s, d, w in edges:
            new[d] += 0.85 * want[s] * w
        want = new
    for got in (G.job_rank(df, max_iter=15), G.model_rank(nodes, M.numbered_edges(df, nodes), 7, max_iter=15, checkpoint_every=4)):
        got = {r.node: r["rank"] for r in got.collect()}
        assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-12 for v in names)
    assert not [x for x in set(os.listdir(folder)) - before if x.startswith("edges")]


def test_growing_dimensions_do_not_go_through_the_driver(spark):
    """Parts are a row for each code: a scan of few compressed bytes is no small table, whatever the size check says."""
    from conftest import SF_SMALL
    from workrisk.operators import skills as K
    from workrisk.sources import domain
    risk = spark.range(3).select(F.format_string("x%d", "id").alias("onet_code"))
    for df in (domain.employment(spark, SF_SMALL), domain.skills_long(spark, SF_SMALL), K.adoption_fill(risk, domain.tech(spark, SF_SMALL))):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "p_partkey" in plan and "SortMergeJoin" in plan
        lines = plan.split("\n")
        for at, line in enumerate(lines):  # a broadcast side is indented below its exchange
            if "BroadcastExchange" in line or "BuildRight" in line and "Broadcast" in line:
                assert "p_partkey" not in line
