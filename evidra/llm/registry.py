"""The registered queries of the subpackage: name -> (callable, equivalent SQL or None)."""

from __future__ import annotations

import logging

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm import (
    byte_bpe, graph_dedup, jaccard_join, license_scan, packing, periodic_runs, prefix_trie, projection_forest, suffix_dedup, toxicity,
    training_order, warc, winnowing,
)
from evidra.session import load_table, work_folder


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "warc")
    warc.write(load_table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op2_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_forest.neighbours(load_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token stream of the documents in training order, written to shards and read back: slot, shard, offset, length, record_crc32."""
    stream = training_order.token_sequences(load_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    folder = work_folder(spark, "shards")
    training_order.write_shards(training_order.ordered(stream, key=20261201), folder)
    return training_order.read_from(spark, folder).select("slot", "shard", "offset", "length", F.crc32("ids").alias("record_crc32"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(load_table(spark, sf_dir, "documents")).drop("kept")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, load_table(spark, sf_dir, "labels")))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_components(load_table(spark, sf_dir, "documents"), words=3, percent=90)


def op7_graph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, audit = graph_dedup.near_duplicates(load_table(spark, sf_dir, "embeddings"))
    true, found = audit.first()
    logging.getLogger(__name__).warning("op7_graph_dedup: found %d of %d links of the audited entries", found, true)
    return vectors


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(byte_bpe.encode(load_table(spark, sf_dir, "documents"), path), path)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load_table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(load_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = prefix_trie.trie(load_table(spark, sf_dir, "conversations"), base=prefix_trie.hundred, head=prefix_trie.head_length)
    return nodes.drop("ref_conv", "ref_turn")


def op12_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.digests(winnowing.shared_windows(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "benchmark")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    return periodic_runs.digests(periodic_runs.find_runs(docs, text=periodic_runs.with_loops(F.col("doc_id"), F.col("text"))))


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html),
     hexed AS (SELECT p.page_id, strlen(p.html) AS payload_bytes, sha1(p.html) AS h, f.first FROM p JOIN f USING (html)),
     coded AS (SELECT page_id, payload_bytes, first, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + CAST((('0x' || substr(h, 1 + 10 * (g // 8), 10))::BIGINT >> (35 - 5 * (g % 8))) & 31 AS INTEGER), 1), '' ORDER BY g) AS b
               FROM hexed, (SELECT unnest(range(32)) AS g) GROUP BY page_id, payload_bytes, first)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, b AS payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to, true AS intact
FROM coded
"""

QUERIES = {
    "op1_warc": (op1_warc, OP1_SQL),
    "op2_projection_forest": (op2_projection_forest, None),
    "op3_training_order": (op3_training_order, None),
    "op4_suffix_dedup": (op4_suffix_dedup, None),
    "op5_toxicity": (op5_toxicity, None),
    "op6_jaccard_join": (op6_jaccard_join, None),
    "op7_graph_dedup": (op7_graph_dedup, None),
    "op8_byte_bpe": (op8_byte_bpe, None),
    "op9_best_fit_packing": (op9_best_fit_packing, None),
    "op10_license_scan": (op10_license_scan, license_scan.scan_sql()),
    "op11_prefix_trie": (op11_prefix_trie, prefix_trie.trie_sql()),
    "op12_winnowing": (op12_winnowing, winnowing.contamination_sql()),
    "op13_periodic_runs": (op13_periodic_runs, None),
}
