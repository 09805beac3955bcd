"""Sinks (S6-S8): partitioned table/CSV/JSON writes instead of one file per area."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_partitioned(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = "state",
                      mode: str = "overwrite") -> None:
    """One folder per area (partition pruning on read); parquet by default."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(partition_by)
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)


def write_documents(df: DataFrame, path: str, partition_by: str = "state", mode: str = "overwrite") -> None:
    """Nested result documents (struct/map/array columns) as JSON lines per area."""
    df.write.mode(mode).partitionBy(partition_by).json(path)


def read_documents(spark: SparkSession, path: str, schema: str, partition_by: str = "state") -> DataFrame:
    """The documents of ``write_documents``, with their schema (the folder gives ``partition_by``)."""
    return spark.read.schema(schema).json(path).select(*T.StructType.fromDDL(schema).fieldNames())


def write_map_document(df: DataFrame, path: str, key: str = "state") -> None:
    """One JSON document {key -> document}; all keys in one file, so their number must be bounded (areas)."""
    rest = F.struct(*[c for c in df.columns if c != key])
    whole = df.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(key, rest.alias("document"))))).alias("value"))
    whole.coalesce(1).write.text(path)


def read_map_document(spark: SparkSession, path: str, schema: str, key: str = "state") -> DataFrame:
    """The documents of ``write_map_document`` as rows."""
    fields = T.StructType([f for f in T.StructType.fromDDL(schema).fields if f.name != key])
    text = spark.read.text(path, wholetext=True)
    docs = text.select(F.explode(F.from_json("value", T.MapType(T.StringType(), fields))).alias(key, "document"))
    return docs.select(key, "document.*")
