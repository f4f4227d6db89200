"""The driver tables seen as tables of a memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as entries: path by source, context = source."""
    suffix = F.element_at(F.array(F.lit(".md"), F.lit(".mdx"), F.lit(".txt")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("hash"),
        F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), suffix).alias("path"),
        F.col("text").alias("value"),
        F.octet_length("text").cast("long").alias("length"),
        F.col("source").alias("context"),
        (F.col("doc_id") * 60).alias("created_at"),
        F.pmod(F.col("doc_id") * 7919, F.lit(100003)).alias("last_accessed"),
    )


CONTENT_SQL = """(select doc_id as hash, '/' || source || '/' || doc_id || (case doc_id % 3 when 0 then '.md' when 1 then '.mdx' else '.txt' end) as path,
  text as value, strlen(text)::bigint as length, source as context, doc_id * 60 as created_at, (doc_id * 7919) % 100003 as last_accessed from documents)"""


def fts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("hash"), F.lit(0).alias("seq"), F.col("source").alias("context"), F.col("text").alias("content"))


def vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("hash"), F.lit(0).alias("seq"), "embedding", F.col("label"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50 is a query."""
    return table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as cached vectors of two models."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("text_hash"),
        F.when(F.col("label") % 2 == 0, "remote").otherwise("local").alias("provider"),
        F.lit("m1").alias("model"),
        "embedding",
        F.when(F.col("vec_id") % 10 == 9, 0).otherwise(F.size("embedding")).alias("dimension"),
        F.col("vec_id").alias("ins_seq"),
    )


CACHE_SQL = """(select vec_id as text_hash, case when label % 2 = 0 then 'remote' else 'local' end as provider, 'm1' as model, embedding,
  case when vec_id % 10 = 9 then 0 else len(embedding) end as dimension, vec_id as ins_seq from embeddings)"""
