"""The driver tables in the shape the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.session import load_table

CN_LANGS = ["fr", "es"]


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """documents as literature items: first line as title, source language as origin."""
    return load_table(spark, sf, "documents").select(
        F.col("doc_id").alias("item_id"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("text").alias("abstract"),
        F.when(F.col("lang").isin(CN_LANGS), "cn_literature").otherwise("pubmed").alias("source_type"),
        F.when(F.col("source") == "src0", "seed_sample").otherwise("pubmed_live").alias("record_origin"),
        (F.lit(1990) + F.col("n_chars") % 30).cast("int").alias("year"),
        F.col("doc_id").alias("ord"),
        F.col("lang"), F.col("source"), F.col("n_chars"),
    )


CORPUS_SQL = """
items AS MATERIALIZED (
  SELECT doc_id AS item_id, lower(split_part(text, chr(10), 1)) AS title, lower(text) AS abstract,
         CASE WHEN lang IN ('fr','es') THEN 'cn_literature' ELSE 'pubmed' END AS source_type,
         CASE WHEN source = 'src0' THEN 0 ELSE 1 END AS real_ev,
         CAST(1990 + n_chars % 30 AS INTEGER) AS year, doc_id AS ord
  FROM documents)"""


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return load_table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def conversation_items(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as items (first turn's role and text start as title)."""
    turns = load_table(spark, sf, "conversations")
    return turns.groupBy("conv_id").agg(
        F.min_by("text", "turn").alias("title"), F.count("*").alias("n"),
    ).select(
        F.col("conv_id").alias("item_id"), "title", F.lit("pubmed").alias("source_type"),
        F.lit("pubmed_live").alias("record_origin"), F.col("n").cast("int").alias("year"),
        F.col("conv_id").alias("ord"),
    )


def conversation_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as chunks."""
    return load_table(spark, sf, "conversations").select(
        F.concat_ws("-", "conv_id", F.lpad(F.col("turn").cast("string"), 6, "0")).alias("chunk_id"),
        F.col("conv_id").alias("item_id"), "text", "turn", "role",
    )
