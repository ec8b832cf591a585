"""Typed entity tables and gene sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidra.sources.positions import positioned

SCHEMAS = {
    "herb": "id string, name string, pinyin string, latin_name string, category string, evidence_tags array<string>",
    "formula": "id string, name string, pinyin string, indication_tags array<string>, herb_ids array<string>, summary string",
    "compound": "id string, name string, english_name string, pubchem_cid string, herb_ids array<string>",
    "target": "id string, symbol string, name string, uniprot_id string, disease_ids array<string>",
    "pathway": "id string, name string, kegg_id string, category string, target_ids array<string>",
    "edge": "compound_id string, target_id string, pathway_id string, disease string, score double",
    "gene_set": "id string, name string, name_zh string, category string, genes array<string>",
}


def read_entities(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One typed table with ``ord``; the id column is named after the kind (herb_id, ...)."""
    table = positioned(spark.read.schema(SCHEMAS[kind]).option("multiLine", True).json(path), "ord")
    return table if kind in ("edge", "gene_set") else table.withColumnRenamed("id", f"{kind}_id")


def read_gene_sets(spark: SparkSession, path: str) -> DataFrame:
    """Gene sets; a path that does not exist gives an empty table."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], SCHEMAS["gene_set"] + ", ord bigint")
    return read_entities(spark, path, "gene_set")
