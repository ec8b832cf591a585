"""Corpus pipeline: toxicity, near duplicates, repeated passages, packing.

Each stage takes what its predecessor kept, reread from Parquet, and its decisions take effect. All but the last
return the columns of ``documents``; the last returns one row per packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm import jaccard_join, packing, suffix_dedup, toxicity
from evidra.llm.common import materialize
from evidra.session import load_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below its threshold. The model learns from the labelled rows among
    ``docs`` outside the held-out part; null and empty texts are scored by its bias and so stay."""
    model = toxicity.train(docs, load_table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=COLUMNS)
    return scored.where(F.col("predicted") == 0).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at a similarity of 0.8 over five-word shingles the one with the smallest id stays, once if
    its row is repeated. Rows without id and texts without words are in no group and stay."""
    found = jaccard_join.similarity_components(docs, words=5, percent=80)
    first = found.where(F.col("component_id") == F.col("doc_id")).select("doc_id").distinct()
    alone = docs.where(F.col("doc_id").isNull())
    stays = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return stays.select(*COLUMNS).unionByName(alone.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller id has too. A cut inside a character drops its rest; a text of
    which nothing is left stays as an empty one, a null text stays null. ``n_chars`` follows the text."""
    cut = suffix_dedup.remove_repeats(docs, keep=["text", "lang", "source", "n_chars"])
    whole = F.try_validate_utf8(F.col("kept").cast("string"))
    readable = F.coalesce(whole, F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "\N{REPLACEMENT CHARACTER}", ""))
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(readable)
    return cut.select("doc_id", text.alias("text"), "lang", "source", "n_removed", F.col("n_chars").alias("_n")).select(
        "doc_id", "text", "lang", "source", F.when(F.col("n_removed") == 0, F.col("_n")).otherwise(F.length("text")).cast("long").alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document in sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic), ("jaccard_join", drop_near_duplicates), ("suffix_dedup", cut_repeats), ("best_fit_packing", pack_sequences),
]
#: Model scores and tokens are beyond SQL; tests/llm/test_pipeline.py holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``, each staged as Parquet before the next."""
    docs = load_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
