"""Queries of this subpackage: thin calls that apply an operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from engram.llm.collocations import ORACLE_SQL as PHRASE_SQL
from engram.llm.collocations import collocations
from engram.llm.decontam import benchmark_leaks
from engram.llm.gru import lm_score
from engram.llm.langid import language_id
from engram.llm.mixing import mix_sources
from engram.llm.neardup import ORACLE_SQL as NEAR_SQL
from engram.llm.neardup import near_dup_groups
from engram.llm.pii import private_texts
from engram.llm.quality import ORACLE_SQL as QUALITY_SQL
from engram.llm.quality import quality_rules
from engram.llm.secrets import secret_scan
from engram.llm.suffix_dedup import substring_dedup
from engram.llm.toxicity import toxic_documents
from engram.llm.warc import ORACLE_SQL as WARC_SQL
from engram.llm.warc import archive_round_trip
from engram.llm.whitening import whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_texts(_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(_table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup_groups(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(_table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening(_table(spark, sf_dir, "embeddings"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def op13_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(_table(spark, sf_dir, "pages"), spark)


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": QUALITY_SQL, "op8_near_duplicates": NEAR_SQL, "op12_collocations": PHRASE_SQL, "op13_warc_archives": WARC_SQL}
