"""Occupation transition graph, weighted rank and recommendations (stage E).

Pair weights need every ordered pair of occupations (the row normalisation
sums over all targets), so they are evaluated on a tile grid: vectors are
cut into blocks of the risk order, each vector is replicated to the tiles of
its row and column that can hold a pair (an equi-join on the tile key, no
cross join), and every tile (block_i x block_j) is evaluated in vectorised
numpy steps in ``applyInArrow``. A tile holds at most ``2 * tile_size``
vectors, and some sources of it are computed at a time.

The pairs grow with the square of the vectors, so no table of them is
written: one pass over the tiles gives the row sums (a row for each source),
which the sources then carry into a second pass that gives the normalised
matrix, or, for recommendations, only the best edges of each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workrisk.functions import clean_onet_code
from workrisk.functions import major_code as _major
from workrisk.functions import minor_code as _minor
from workrisk.operators import _kernels
from workrisk.operators.common import keyed_positions, top_k, with_scalars
from workrisk.operators._kernels import WEIGHTS  # noqa: F401
from workrisk.session import materialize, settings, write_stage
from workrisk.sources.model import bucket_count, counted_nodes, fresh_folder, numbered_edges

def major_code(c: Column) -> Column:
    """Major group of an O*NET code: first 2 characters of the cleaned code."""
    return _major(clean_onet_code(c))


def minor_code(c: Column) -> Column:
    """Minor group of an O*NET code: first 3 characters of the cleaned code."""
    return _minor(clean_onet_code(c))


ZERO_ROW_SUM = 1e-10
ALPHA = 0.85
MAX_ITER = 100
TRANSITION_TYPES = ("general", "different_minor", "different_major")
# Kind of gap, training and its length.
TRAINING = [("new_skill", "comprehensive_training", "3-6 months"),
            ("upgrade_gt_0.5", "advanced_training", "1-3 months"),
            ("upgrade", "refresher_course", "2-4 weeks")]
UPGRADE_THRESHOLD = 0.5


# ---------------------------------------------------------------- G1 vectors

def skill_vectors(skills: DataFrame, elements: list[str], code: str = "onet_code") -> DataFrame:
    """G1 + T8: importance matrix (missing = 0), standardised per element with the
    population std (zero std -> scale 1), as ``array<double>`` in ``elements`` order."""
    wide = (skills.filter(F.col("scale") == "Importance").groupBy(code)
                  .pivot("element", elements).agg(F.max("value")).na.fill(0.0, subset=elements))
    stats = wide.agg(*[F.avg(e).alias(f"m_{i}") for i, e in enumerate(elements)],
                     *[F.stddev_pop(e).alias(f"s_{i}") for i, e in enumerate(elements)])
    z = [(F.col(e) - F.col(f"m_{i}")) / F.when(F.col(f"s_{i}") == 0, 1.0).otherwise(F.col(f"s_{i}"))
         for i, e in enumerate(elements)]
    return with_scalars(wide, stats).select(F.col(code).alias("code"), F.array(*z).alias("v"))


# ---------------------------------------------------------------- G2-G4 tiles

PAIR_SCHEMA = _kernels.PAIR_SCHEMA


def block_size(n: int) -> int:
    """Vectors of a block: some 32 blocks, of at least 256 vectors and at most 16,384 (8 MB of 64 numbers each)."""
    return min(16384, max(256, -(-n // 32)))


def tiles(jobs: DataFrame, tile_size: int | None = None, carried: tuple[str, ...] = (), sources: str | None = None,
          within: str | None = None) -> DataFrame:
    """``jobs`` replicated to the tiles that need them: bi (block of the source), bj (of the target), role.

    Blocks are ranges of the risk order, so a block only meets blocks of no higher risk: tiles whose
    targets are all riskier than their sources are never formed, which is half of the grid. Blocks
    after a source block take part only while they start with that block's highest risk (ties).
    ``carried``: further columns for the tiles. ``sources``: a boolean column that limits the sources.
    ``within``: one of the carried columns; only rows that agree in it meet, and it is part of a tile's key.
    A tile is much work for few bytes, so their number, not their size, gives the partitions."""
    columns = ["code", "v", "risk", "hot", *carried]
    key = within or "_all"
    j = jobs.select(*columns, *([sources] if sources else []), *([] if within else [F.lit(0).alias("_all")]))
    ranked = materialize(keyed_positions(j, [key], [F.col("risk").asc_nulls_first(), F.col("code").asc()], "_pos"))
    tile_size = tile_size or block_size(ranked.count())
    ranked = ranked.withColumn("_b", F.expr(f"int((_pos - 1) div {tile_size})"))
    edges = materialize(ranked.groupBy(key, "_b").agg(F.min("risk").alias("_low"), F.max("risk").alias("_high")))  # a row for each block
    ties = (edges.select(key, F.col("_b").alias("_i"), F.col("_high").alias("_tie"))
            .join(edges.select(key, F.col("_b").alias("_j"), F.col("_low").alias("_tie")), [key, "_tie"]).filter("_j > _i"))
    last = ties.groupBy(key, F.col("_i").alias("_b")).agg(F.max("_j").alias("_last"))
    first = ties.groupBy(key, F.col("_j").alias("_b")).agg(F.min("_i").alias("_first"))
    count = edges.groupBy(key).agg((F.max("_b")).alias("_top"))
    reach = (edges.join(count, key).join(last, [key, "_b"], "left").join(first, [key, "_b"], "left")
             .select(key, "_b", "_top", F.coalesce("_last", "_b").alias("_last"), F.coalesce("_first", "_b").alias("_first")))
    r = ranked.drop("_pos").join(F.broadcast(reach), [key, "_b"])  # one row for each block of ``tile_size`` jobs
    from_here = r.filter(sources) if sources else r
    as_src = from_here.select(F.col("_b").alias("bi"), F.explode(F.sequence(F.lit(0), "_last")).alias("bj"), F.lit("s").alias("role"), *columns)
    as_dst = r.select(F.explode(F.sequence("_first", "_top")).alias("bi"), F.col("_b").alias("bj"), F.lit("t").alias("role"), *columns)
    n, tasks = edges.count(), jobs.sparkSession.sparkContext.defaultParallelism
    grid = [within, "bi", "bj"] if within else ["bi", "bj"]
    return as_src.unionByName(as_dst).repartition(max(tasks, min(n * (n + 1) // 2, 16 * tasks)), *grid)


def pair_table(jobs: DataFrame, tile_size: int | None = None) -> DataFrame:
    """Raw weights of every ordered pair (src, dst) with risk(dst) <= risk(src), and their row sums.

    ``jobs``: (code, v array<double>, risk double, hot double). Pairs whose target is riskier have
    weight 0 and are not emitted (they add nothing to a row sum). Returns (src, dst, w, sim, cost);
    a row without dst holds the sum of a source's weights over a part of its pairs, so that no pair has
    to be shuffled for the normalisation."""
    return tiles(jobs, tile_size).groupBy("bi", "bj").applyInArrow(_kernels.tile_pairs, PAIR_SCHEMA)


def pair_weights(jobs: DataFrame, tile_size: int | None = None) -> DataFrame:
    """The pairs of ``pair_table`` alone."""
    return pair_table(jobs, tile_size).filter(F.col("dst").isNotNull())


def row_sums(jobs: DataFrame, tile_size: int | None = None) -> DataFrame:
    """(src, _rs): the sum of the weights of every source that has a pair; no pair leaves its tile."""
    sums = tiles(jobs, tile_size).groupBy("bi", "bj").applyInArrow(_kernels.tile_sums, "src string, total double")
    return sums.groupBy("src").agg(F.sum("total").alias("_rs"))


def _with_total(jobs: DataFrame, sums: DataFrame) -> DataFrame:
    return (jobs.join(sums.withColumnRenamed("src", "code"), "code", "left")
            .withColumn("total", F.when(F.col("_rs") == 0, F.lit(ZERO_ROW_SUM)).otherwise(F.col("_rs"))).drop("_rs"))


def jobs_matrix(jobs: DataFrame, sums: DataFrame, tile_size: int | None = None) -> DataFrame:
    """(src, dst, p) of every pair, from the jobs and their ``row_sums``; nothing of the size of the pairs is stored."""
    grid = tiles(_with_total(jobs, sums), tile_size, ("total",))
    return grid.groupBy("bi", "bj").applyInArrow(_kernels.tile_matrix, "src string, dst string, p double")


def best_edges(jobs: DataFrame, sums: DataFrame, n: int, transition_types: tuple[str, ...], sources: DataFrame | None = None,
               tile_size: int | None = None) -> DataFrame:
    """Edges (src, dst, weight) that hold the ``n`` best ones of every source for each transition type.

    Every pair that one of the types allows is formed; a tile keeps, of each type, the ``n`` highest probabilities of a source (of
    equal ones the first targets), so at most ``n`` rows of a source, tile and type are written.
    ``sources`` (one column ``code``) limits the sources."""
    j = (_with_total(jobs, sums).withColumn("major", major_code(F.col("code"))).withColumn("minor", minor_code(F.col("code"))))
    if sources is not None:
        wanted = sources.select("code").distinct().withColumn("_wanted", F.lit(True))
        j = j.join(wanted, "code", "left").withColumn("_wanted", F.coalesce("_wanted", F.lit(False)))
    within = "major" if set(transition_types) == {"different_minor"} else None
    grid = tiles(j, tile_size, ("total", "major", "minor"), None if sources is None else "_wanted", within)
    best = grid.groupBy(*([within] if within else []), "bi", "bj").applyInArrow(_kernels.tile_best(tuple(transition_types), n), "src string, dst string, p double")
    return graph_edges(best)


def transition_matrix(pairs: DataFrame) -> DataFrame:
    """G4 normalisation of pairs: p = w / row sum (a zero row sum becomes 1e-10)."""
    return _normalised(pairs, pairs.groupBy("src").agg(F.sum("w").alias("_rs")))


def table_matrix(table: DataFrame) -> DataFrame:
    """``transition_matrix`` of a written ``pair_table``: the tiles' partial sums are added up by source.

    The pairs are read once and joined in place as long as the sums (one row for each source) can be
    broadcast, by the runtime's size check."""
    sums = table.filter(F.col("dst").isNull()).groupBy("src").agg(F.sum("w").alias("_rs"))
    return _normalised(table.filter(F.col("dst").isNotNull()), sums)


def _normalised(pairs: DataFrame, sums: DataFrame) -> DataFrame:
    rs = F.when(F.col("_rs") == 0, F.lit(ZERO_ROW_SUM)).otherwise(F.col("_rs"))
    return pairs.join(sums, "src").withColumn("p", F.col("w") / rs).drop("_rs")


def graph_edges(matrix: DataFrame) -> DataFrame:
    """Edges with a strictly positive probability."""
    return matrix.filter(F.col("p") > 0).select("src", "dst", F.col("p").alias("weight"))


# ---------------------------------------------------------------- G6 rank

# The plan of the iterations is settled by the slices: no join to choose, no partition to merge or split, and
# buckets are kept though a scan alone would not need them.
LOOP_CONF = {"spark.sql.adaptive.enabled": "false", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}


RANK_BLOCK, WIDEST = 3072, 2048  # nodes of a block, and of one risk in it, at most: its own edges are one matrix in a task


def job_rank(edges: DataFrame, alpha: float = ALPHA, max_iter: int = MAX_ITER, checkpoint_every: int = 10, jobs: DataFrame | None = None,
             sums: DataFrame | None = None) -> DataFrame:
    """Weighted PageRank of (src, dst, weight), fixed iterations, no dangling redistribution.

    n = nodes touching at least one edge; start 1/n; new = (1-a)/n + a * sum(rank * w);
    a graph without edges has no ranks. ``edges`` is read twice: for the numbers of the nodes
    and to pack it, see ``model_rank``; no table of edges is written. If they are the edges of ``jobs``
    with the row ``sums``, nothing of their size is stored at all, see ``tile_rank``."""
    if jobs is not None and (ranks := ordered_rank(jobs, sums, alpha, max_iter)) is not None:
        return ranks
    nodes, n_edges = counted_nodes(edges)
    return model_rank(nodes, numbered_edges(edges, nodes), bucket_count(edges.sparkSession, n_edges), alpha, max_iter,
                      checkpoint_every)


def ordered_jobs(jobs: DataFrame, sums: DataFrame, tile_size: int | None = None, widest: int = WIDEST) -> DataFrame | None:
    """The jobs with their row ``sums`` in blocks of falling risk (block, at, code, v, risk, hot, total); jobs of one risk are in one block.

    None where that can't be bounded or a row is no node: more than ``widest`` jobs of one risk, or a code in several
    rows. Jobs without a risk have no pair."""
    j = _with_total(jobs, sums).filter(F.col("risk").isNotNull()).select("code", "v", "risk", "hot", "total")
    most = j.groupBy("risk").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if most[0] > widest or not j.groupBy("code").count().filter("count > 1").isEmpty():
        return None
    size = tile_size or min(RANK_BLOCK, block_size(most[1]))
    placed = keyed_positions(j, [], [F.col("risk").desc(), F.col("code").asc()], "_pos")
    first = placed.groupBy("risk").agg(F.min("_pos").alias("_first"))
    blocked = placed.join(first, "risk").withColumn("block", F.expr(f"int((_first - 1) div {size})"))
    at = F.row_number().over(Window.partitionBy("block").orderBy("_pos")) - 1  # a block is bounded
    return write_stage(blocked.select("block", at.alias("at"), "code", "v", "risk", "hot", "total"))


def ordered_tiles(ranked: DataFrame) -> DataFrame:
    """The edges of ``ordered_jobs`` as tiles: (bi, bj, first, weights), the weights of some sources of block bi
    (from row ``first``) to all of block bj as 8-byte numbers, 0 where there is no edge."""
    spark = ranked.sparkSession
    blocks = [r.block for r in ranked.select("block").distinct().orderBy("block").collect()]  # a number for each block
    n, tasks = len(blocks), spark.sparkContext.defaultParallelism
    known = F.array(*[F.lit(b) for b in blocks]).cast("array<int>")
    as_src = ranked.withColumn("bi", F.col("block")).withColumn("bj", F.explode(F.filter(known, lambda b: b >= F.col("block"))))
    as_dst = ranked.withColumn("bj", F.col("block")).withColumn("bi", F.explode(F.filter(known, lambda b: b <= F.col("block"))))
    grid = as_src.withColumn("role", F.lit("s")).unionByName(as_dst.withColumn("role", F.lit("t")))
    return (grid.repartition(max(tasks, min(n * (n + 1) // 2, 16 * tasks)), "bi", "bj").groupBy("bi", "bj")
            .applyInArrow(_kernels.tile_weights, _kernels.TILE_SCHEMA))


def ordered_rank(jobs: DataFrame, sums: DataFrame, alpha: float = ALPHA, max_iter: int = MAX_ITER, tile_size: int | None = None,
                 widest: int = WIDEST) -> DataFrame | None:
    """``job_rank`` of the edges of all jobs, each formed once; None where there is no ``ordered_jobs``."""
    ranked = ordered_jobs(jobs, sums, tile_size, widest)
    return None if ranked is None else tile_rank(ranked, None, alpha, max_iter).select("node", "rank")


def tile_rank(nodes: DataFrame, tiles: DataFrame | None, alpha: float = ALPHA, max_iter: int = MAX_ITER) -> DataFrame:
    """(node, rank, n_edges, weight): the rank and each node's edges, from ``ordered_jobs`` or from the nodes (block, at, code) of saved tiles.

    An edge never leads to a riskier job. So once every riskier block has its ranks of all iterations, the sums
    that they send to a block are one product of matrices for each tile (the tile's weights times the
    ranks of every iteration), and the block's own iterations need only the edges inside it. A job keeps its
    ranks of all iterations (8 bytes each); weights are formed (or read) once and leave no task.
    The ranks are computed for 1 in place of 1/n, and divided by the number of nodes when that is known."""
    spark = nodes.sparkSession
    blocks = {r.block: r["count"] for r in nodes.groupBy("block").count().orderBy("block").collect()}  # a number for each block
    if not blocks:
        return spark.createDataFrame([], "node string, rank double, n_edges bigint, weight double")
    settle = _kernels.settle(max_iter, 1.0 - alpha, alpha)
    folder, tasks = fresh_folder(spark, "rank"), spark.sparkContext.defaultParallelism
    done: list[str] = []
    conf = LOOP_CONF | {"spark.sql.shuffle.partitions": str(4 * tasks), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
                        "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
    with settings(spark, conf):
        for block, size in blocks.items():
            here, sent = nodes.filter(F.col("block") == block), None
            if done:
                known = spark.read.schema(_kernels.RANKED_SCHEMA).parquet(*done).filter(F.col("course").isNotNull())
                if tiles is None:
                    earlier = nodes.toDF(*nodes.columns).filter(F.col("block") < block)
                    known = known.select("block", "at", "course").unionByName(earlier, allowMissingColumns=True)  # put together by the task
                    copies = here.withColumn("_to", F.explode(F.array(*[F.lit(b) for b in list(blocks)[:len(done)]])))
                    sent = known.groupBy("block").cogroup(copies.groupBy("_to")).applyInArrow(_kernels.send(max_iter), _kernels.SENT_SCHEMA)
                else:
                    saved = tiles.filter((F.col("bj") == block) & (F.col("bi") < block))
                    sent = known.groupBy("block").cogroup(saved.groupBy("bi")).applyInArrow(_kernels.send_saved(max_iter, size), _kernels.SENT_SCHEMA)
                kind = F.when(F.col("slice") < 0, -1 - F.col("origin")).otherwise(F.col("slice"))
                sent = sent.groupBy(kind).applyInArrow(_kernels.add_sent, _kernels.SENT_SCHEMA)
            if tiles is not None:
                mine = tiles.filter((F.col("bj") == block) & (F.col("bi") == block)).select(
                    F.lit(_kernels.OWN).alias("slice"), F.col("first").alias("origin"), F.col("weights").alias("sums"),
                    *[F.lit(None).cast("binary").alias(c) for c in ("hit", "edges")])
                sent = mine if sent is None else sent.unionByName(mine)
            sent = spark.createDataFrame([], _kernels.SENT_SCHEMA) if sent is None else sent
            one = here.groupBy("block").cogroup(sent.groupBy(F.lit(block).alias("block"))).applyInArrow(settle, _kernels.RANKED_SCHEMA)
            one.write.parquet(f"{folder}/{len(done)}")
            done.append(f"{folder}/{len(done)}")
    rows = spark.read.schema(_kernels.RANKED_SCHEMA).parquet(*done)
    out = (rows.filter("node is null").mapInArrow(_kernels.edge_counts, "block int, at int, n_edges bigint, weight double")
           .groupBy("block", "at").agg(F.sum("n_edges").alias("n_edges"), F.sum("weight").alias("weight")))
    found = rows.filter("node is not null").mapInArrow(_kernels.last_ranks, "block int, at int, node string, y double, hit boolean")
    found = materialize(found.join(out, ["block", "at"], "left").filter(F.col("hit") | F.col("n_edges").isNotNull())
                        .select("node", "y", "n_edges", "weight"))
    found = with_scalars(found, found.agg(F.count(F.lit(1)).alias("_n")))
    return found.select("node", (F.col("y") / F.col("_n")).alias("rank"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"),
                        F.coalesce("weight", F.lit(0.0)).alias("weight"))


def model_rank(nodes: DataFrame, edges: DataFrame, buckets: int, alpha: float = ALPHA, max_iter: int = MAX_ITER,
               checkpoint_every: int = 10) -> DataFrame:
    """``job_rank`` of the numbered nodes (node, id) and edges (s, d, weight), e.g. of a saved model.

    The ids are cut into slices, one for each bucket. The edges of a slice of sources are packed
    into arrays once and cached where the slice is; an iteration cogroups them, in place, with
    the sums that were sent to the slice, and shuffles only new sums: one array for each pair of
    slices. Sums are checkpointed every ``checkpoint_every`` iterations (bounded lineage;
    survives executor loss)."""
    spark = nodes.sparkSession
    n, top = nodes.agg(F.count(F.lit(1)), F.max("id")).first()
    if n == 0:
        return spark.createDataFrame([], "node string, rank double")
    if top != n - 1:
        raise ValueError("ids must be 0 to n - 1, as numbered_nodes gives them")
    width, base = -(-n // buckets), (1.0 - alpha) / n
    with settings(spark, LOOP_CONF | {"spark.sql.shuffle.partitions": str(buckets), "spark.sql.execution.arrow.maxRecordsPerBatch": "100000"}):
        packed = edges.select("s", "d", "weight").mapInArrow(_kernels.pack_edges(width), _kernels.PACKED_SCHEMA)
        packed = packed.repartition(buckets, "slice").sortWithinPartitions("slice").persist()
        packed.count()  # packed now, in batches of many edges
    # a row holds up to some MB of edges: few rows for each batch
    with settings(spark, LOOP_CONF | {"spark.sql.shuffle.partitions": str(buckets), "spark.sql.execution.arrow.maxRecordsPerBatch": "64"}):
        state = start_sums(spark, n, width)
        for it in range(1, max_iter + 1):
            step = _kernels.rank_slice(n, width, base, alpha, it == 1)
            state = state.groupBy("slice").cogroup(packed.groupBy("slice")).applyInArrow(step, _kernels.STATE_SCHEMA)
            if it % checkpoint_every == 0 or it == max_iter:
                state = materialize(state)
        packed.unpersist()
        ranks = materialize(state.groupBy("slice").applyInArrow(_kernels.slice_ranks(width, base, alpha, max_iter == 0), "id bigint, rank double"))
    return ranks.join(nodes.select("node", "id"), "id").select("node", "rank")


def start_sums(spark, n: int, width: int) -> DataFrame:
    """The ranks 1/n of all slices."""
    start = lambda batches: _kernels.start_slices(batches, n, width)
    return spark.range(-(-n // width)).mapInArrow(start, _kernels.STATE_SCHEMA)


def rank_step(edges: DataFrame, ranks: DataFrame, base: float, alpha: float) -> DataFrame:
    """One iteration: (id, rank) from the bucketed edges (s, d, weight) and the ranks before."""
    sources = ranks.withColumnRenamed("id", "s").hint("shuffle_hash")
    return (edges.join(sources, "s").groupBy(F.col("d").alias("id"))
            .agg((F.lit(base) + F.lit(alpha) * F.sum(F.col("rank") * F.col("weight"))).alias("rank")))


# ---------------------------------------------------------------- G7-G9 recommendations

def transition_label(src: Column, dst: Column) -> Column:
    """'general' when the major groups differ, else 'different_minor', else 'same_minor'."""
    return (F.when(major_code(src) != major_code(dst), F.lit("general"))
             .when(minor_code(src) != minor_code(dst), F.lit("different_minor"))
             .otherwise(F.lit("same_minor")))


def type_filter(transition_type: str | None) -> Column:
    """F8: general = all; different_minor = minor differs within the major; different_major."""
    if transition_type is None or transition_type == "general":
        return F.lit(True)
    if transition_type not in TRANSITION_TYPES:
        raise ValueError(f"transition_type must be one of {TRANSITION_TYPES}")
    s, d = F.col("src"), F.col("dst")
    if transition_type == "different_minor":
        return (minor_code(s) != minor_code(d)) & (major_code(s) == major_code(d))
    return major_code(s) != major_code(d)


def skill_gaps(src_v: Column, dst_v: Column, names: list[str]) -> Column:
    """New skills (t > 0, s = 0) and upgrades (t > s), largest gap first."""
    pairs = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("k"), src_v.alias("s"), dst_v.alias("t"))
    g = F.transform(F.filter(pairs, lambda x: ((x["t"] > 0) & (x["s"] == 0)) | (x["t"] > x["s"])),
                    lambda x: F.struct(x["k"].alias("skill"),
                                       F.when((x["t"] > 0) & (x["s"] == 0), x["t"]).otherwise(x["t"] - x["s"])
                                        .alias("gap"),
                                       F.when((x["t"] > 0) & (x["s"] == 0), F.lit("new_skill"))
                                        .otherwise(F.lit("skill_upgrade")).alias("type")))
    return F.array_sort(g, lambda a, b: F.when(a["gap"] > b["gap"], -1).when(a["gap"] < b["gap"], 1).otherwise(0))


def skill_overlap(src_v: Column, dst_v: Column, names: list[str]) -> Column:
    """Skills held at or above the target level, smallest difference first."""
    pairs = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("k"), src_v.alias("s"), dst_v.alias("t"))
    o = F.transform(F.filter(pairs, lambda x: (x["t"] > 0) & (x["s"] > 0) & (x["s"] >= x["t"])),
                    lambda x: F.struct(x["k"].alias("skill"), F.abs(x["s"] - x["t"]).alias("gap"),
                                       F.lit("skill_overlap").alias("type")))
    return F.array_sort(o, lambda a, b: F.when(a["gap"] < b["gap"], -1).when(a["gap"] > b["gap"], 1).otherwise(0))


def training_plan(gaps: Column) -> Column:
    """Training need per gap."""
    return F.transform(gaps, lambda g: F.struct(
        g["skill"].alias("skill"),
        F.when(g["type"] == "new_skill", F.lit(TRAINING[0][1]))
         .when(g["gap"] > UPGRADE_THRESHOLD, F.lit(TRAINING[1][1])).otherwise(F.lit(TRAINING[2][1]))
         .alias("training_type"),
        F.when(g["type"] == "new_skill", F.lit(TRAINING[0][2]))
         .when(g["gap"] > UPGRADE_THRESHOLD, F.lit(TRAINING[1][2])).otherwise(F.lit(TRAINING[2][2]))
         .alias("estimated_duration")))


def title_keys(code: Column) -> Column:
    """Lookup keys of a code, best first: the code itself, then its integer without suffix and hyphen."""
    number = F.replace(F.substring_index(code, ".", 1), F.lit("-"), F.lit("")).try_cast("bigint")
    return F.array(F.concat(F.lit("="), code), F.concat(F.lit("#"), number.cast("string")))


def job_titles(codes: DataFrame, titles: DataFrame, code: str = "code") -> DataFrame:
    """Exact code, else the cleaned integer code, else ``Unknown Job (code)``.

    Both sides are exploded into (priority, key), so all levels of the lookup are one equi-join. Of
    several titles the smallest of an exact code counts, and the one of the smallest code of an integer."""
    found = (titles.select("title", F.col("onet_code").alias("_c"), F.posexplode(title_keys(F.col("onet_code"))).alias("_p", "_k"))
             .groupBy("_k").agg(F.min(F.when(F.col("_p") == 0, F.col("title"))).alias("_exact"),
                                F.min_by("title", "_c").alias("_first"))
             .select("_k", F.coalesce("_exact", "_first").alias("_title")))
    wanted = codes.select("*", F.posexplode(title_keys(F.col(code))).alias("_p", "_k"))
    # a code has two keys: the best one with a title, found by one aggregation
    best = (wanted.join(found, "_k", "left").groupBy(*codes.columns)
            .agg(F.min_by("_title", F.when(F.col("_title").isNotNull(), F.col("_p"))).alias("title")))
    return best.withColumn("title", F.coalesce("title", F.concat(F.lit("Unknown Job ("), F.col(code), F.lit(")"))))


def recommendations(edges: DataFrame, vectors: DataFrame, titles: DataFrame, tech: DataFrame,
                    names: list[str], n: int = 5, transition_type: str | None = "general",
                    sources: DataFrame | None = None) -> DataFrame:
    """G7 (+ W15, F8, J16, G8, G9): top-n transitions per source, all sources in one job.

    ``sources`` (one column ``code``, e.g. read from a request file) limits the
    sources; unknown codes yield no rows. Order: weight desc, then target code.
    """
    e = edges.filter(type_filter(transition_type))
    if sources is not None:
        e = e.join(sources.select(F.col("code").alias("src")).distinct(), "src", "left_semi")
    top = top_k(e, ["src"], [F.col("weight").desc()], n, ["dst"])
    vs = vectors.select(F.col("code").alias("src"), F.col("v").alias("sv"))
    vt = vectors.select(F.col("code").alias("dst"), F.col("v").alias("tv"))
    st = job_titles(top.select(F.col("src").alias("code")).distinct(), titles).withColumnRenamed("code", "src") \
        .withColumnRenamed("title", "source_title")
    tt = job_titles(top.select(F.col("dst").alias("code")).distinct(), titles).withColumnRenamed("code", "dst") \
        .withColumnRenamed("title", "target_title")
    tech_t = tech.select(F.col("onet_code").alias("dst"), F.col("tech_intensity_score").alias("tech_intensity"),
                         "hot_tech_ratio")
    r = (top.join(vs, "src").join(vt, "dst").join(st, "src", "left").join(tt, "dst", "left")
            .join(tech_t, "dst", "left"))
    gaps = skill_gaps(F.col("sv"), F.col("tv"), names)
    return r.select(F.col("src").alias("source_job"), "source_title", F.col("dst").alias("target_job"),
                    "target_title", F.col("weight").alias("transition_probability"), "rank",
                    transition_label(F.col("src"), F.col("dst")).alias("transition_type"),
                    "tech_intensity", "hot_tech_ratio", gaps.alias("skill_gaps"),
                    skill_overlap(F.col("sv"), F.col("tv"), names).alias("skill_overlap"),
                    training_plan(gaps).alias("required_training"))
