"""Corpus pipeline: raw documents to token ids, in five stages.

Every stage is a function of (spark, docs, sf_dir) that works on all rows its predecessor
kept; its result is written as Parquet and reread as the next stage's documents. All but
the last return the columns of ``docs``; columns beyond those of ``documents`` pass through.

Defined results: a null or empty text has no letter and goes in the first stage; rows with
a null id are never removed as duplicates or as contaminated; rows that repeat an id with the
same text are one document, of which the row that is first by its other columns (as JSON)
stays after the third stage; rows that repeat an id with different texts are documents of
their own there; an empty table passes through. Columns that a stage needs for itself get names
that the documents do not have, so every column keeps its own values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workrisk.llm import bpe, decontaminate, jaccard, langid, quality
from workrisk.llm.common import fold_of, free_name, table, with_ids, written
from workrisk.llm.queries import LANG_FOLDS, LANG_HELD, QUALITY_FOLDS, QUALITY_HELD, QUALITY_THRESHOLD, tokenizer_path

LANGUAGE_THRESHOLD = 0.1  # below it no learned language explains the text


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in one of the learned languages."""
    model = langid.fit(docs.where(fold_of("doc_id", LANG_FOLDS) != LANG_HELD))
    lang, score = free_name(docs, "_lang_pred"), free_name(docs, "_lang_score")
    found = langid.predict(docs, model, lang_out=lang, score_out=score)
    kept = (F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LANGUAGE_THRESHOLD)
    return found.where(kept).select(docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the quality classifier accepts; it learns from labelled documents that are left."""
    labels = table(spark, sf_dir, "labels").where(fold_of("doc_id", QUALITY_FOLDS) != QUALITY_HELD)
    net = quality.fit(docs.select("doc_id", "text").join(labels.select("doc_id", "quality"), "doc_id"))
    score = free_name(docs, "_quality")
    return quality.score(docs, net, score_out=score).where(F.col(score) >= QUALITY_THRESHOLD).select(docs.columns)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked documents the one with the smallest id stays."""
    repeated = written(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
                       .select("doc_id"), "repeated")
    if repeated.isEmpty():
        groups = jaccard.join_components(docs.select("doc_id", "text"))
        removed = written(groups.where("doc_id <> component_id").select("doc_id").distinct(), "removed")
        return with_ids(docs, removed, "doc_id", "left_anti").select(docs.columns)
    # one row for each text of a repeated id, under a key of its own
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    key, packed = free_name(docs, "_key"), free_name(docs, "_row")
    again = with_ids(docs, repeated, "doc_id", "left_semi")
    if rest:
        row = F.struct(*(F.col(f"`{c}`") for c in rest))
        again = (again.groupBy("doc_id", "text").agg(F.min_by(row, F.to_json(row)).alias(packed))
                 .select("doc_id", "text", f"{packed}.*"))
    else:
        again = again.distinct()
    again = again.select(*docs.columns, F.xxhash64("doc_id", "text", F.lit("document")).alias(key))
    once = with_ids(docs, repeated, "doc_id", "left_anti").select(*docs.columns, F.col("doc_id").alias(key))
    keyed = written(once.union(again), "keyed")
    groups = written(jaccard.join_components(keyed.select(key, "text"), id_col=key), "keys")
    groups = groups.where(F.col(key).isNotNull()).join(keyed.select(key, "doc_id"), key)
    first = groups.groupBy("component_id").agg(F.min(F.struct("doc_id", key)).alias("first"))
    removed = groups.join(first, "component_id").where(F.col(key) != F.col(f"first.{key}")).select(key).distinct()
    return with_ids(keyed, written(removed, "removed"), key, "left_anti").select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    found = decontaminate.overlaps(docs.select("doc_id", "text"), items)
    removed = written(found.where("doc_id is not null").select("doc_id").distinct(), "removed")
    return with_ids(docs, removed, "doc_id", "left_anti").select(docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the whole texts: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers)."""
    coded = bpe.encode(docs.select("doc_id", "text"), tokenizer_path())
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language", language_stage),
    ("quality", quality_stage),
    ("duplicates", duplicate_stage),
    ("decontamination", decontamination_stage),
    ("tokens", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


# No stage sequence of learned models can be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
