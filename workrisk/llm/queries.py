"""The queries of the training-data operators: name -> function of (spark, sf_dir)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, covertree, decontaminate, htmltext, jaccard, langid, license, merkle, packing, piecebpe, quality, warc
from .common import fold_of, table

TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
QUALITY_THRESHOLD = 0.3
QUALITY_FOLDS, QUALITY_HELD = 5, 0
LANG_FOLDS, LANG_HELD = 4, 2
TAMPER_FOLDS, TAMPERED = 5, 0


def tokenizer_path() -> str:
    """The public tokenizer file (a parameter of the operators)."""
    import public_tokenizers
    return os.environ.get("WORKRISK_TOKENIZER", public_tokenizers.path(TOKENIZER))


def pieces_path() -> str:
    """The public model file of pieces (a parameter of the operators)."""
    import public_tokenizers
    return os.environ.get("WORKRISK_PIECES", public_tokenizers.path(PIECES))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, tokenizer_path(), decoded_col="decoded").drop("text")
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive(table(spark, sf_dir, "pages"))
    return warc.read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type",
                                                    "refers_to")


def quality_network(spark: SparkSession, sf_dir: str) -> quality.Network:
    labels = table(spark, sf_dir, "labels").where(fold_of("doc_id", QUALITY_FOLDS) != QUALITY_HELD)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.fit(docs.join(labels.select("doc_id", "quality"), "doc_id"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality_network(spark, sf_dir)).drop("text")
    return scored.select("doc_id", (fold_of("doc_id", QUALITY_FOLDS) == QUALITY_HELD).alias("held_out"), "score",
                         (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def language_filter(spark: SparkSession, sf_dir: str) -> langid.LanguageFilter:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.fit(docs.where(fold_of("doc_id", LANG_FOLDS) != LANG_HELD))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = langid.predict(docs, language_filter(spark, sf_dir)).drop("text")
    return found.select("doc_id", (fold_of("doc_id", LANG_FOLDS) == LANG_HELD).alias("held_out"), "lang_pred", "score")


def op5_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license.scan(docs, license.fit(docs)).drop("text")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return covertree.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.overlaps(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return (htmltext.extract(pages, htmltext.fit(pages))
            .select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars")))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = piecebpe.encode(docs, pieces_path(), decoded_col="decoded").drop("text")
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"), tokenizer_path(), pieces_path())


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered={"text": merkle.lower_ascii(F.col("text"))},
                           where=fold_of("doc_id", TAMPER_FOLDS) == TAMPERED)


QUERIES = {
    "op1_packing": op1_packing,
    "op2_bpe": op2_bpe,
    "op3_warc": op3_warc,
    "op4_quality": op4_quality,
    "op5_license": op5_license,
    "op6_topk": op6_topk,
    "op7_decontaminate": op7_decontaminate,
    "op8_jaccard": op8_jaccard,
    "op9_langid": op9_langid,
    "op10_htmltext": op10_htmltext,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_alignment": op12_alignment,
    "op13_merkle": op13_merkle,
}
SQL: dict[str, str] = {"op7_decontaminate": decontaminate.SQL}
