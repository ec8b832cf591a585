"""Gene-set enrichment: overlap, hypergeometric tail, Bonferroni per collection, top terms.

inputs: task_id, symbol, one row per entry       terms: collection, term_id, ord (and name), one row per term
genes:  collection, term_id, symbol, one row per entry

Sets stay long tables of any size; only counts meet per task and term. Tables with a list per row (``symbols``, ``genes``) are
taken as well and spread at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions.stats import hypergeometric_tail
from evidra.session import union_all

# Defaults of the source system.
TOP_TERMS = 20
MIN_OVERLAP = 2
MAX_P = 0.05


def long_inputs(inputs: DataFrame) -> DataFrame:
    return inputs.select("task_id", F.explode("symbols").alias("symbol")) if "symbols" in inputs.columns else inputs.select("task_id", "symbol")


def long_genes(terms: DataFrame) -> DataFrame:
    return terms.select("collection", "term_id", F.explode("genes").alias("symbol"))


def overlaps(inputs: DataFrame, terms: DataFrame, genes: DataFrame | None = None) -> DataFrame:
    """(task, collection, term, ord, gene_count, n_input, overlap_count) of terms sharing a symbol with the input.

    Sizes count entries, the overlap counts distinct symbols.
    """
    inputs, genes = long_inputs(inputs), long_genes(terms) if genes is None else genes
    n_input = inputs.groupBy("task_id").agg(F.count("*").alias("n_input"))
    n_genes = genes.groupBy("collection", "term_id").agg(F.count("*").alias("gene_count"))
    counts = inputs.distinct().join(genes.select("collection", "term_id", "symbol").distinct(), "symbol").groupBy(
        "task_id", "collection", "term_id").agg(F.count("*").alias("overlap_count"))
    return counts.join(n_input, "task_id").join(n_genes, ["collection", "term_id"]).join(terms.select("collection", "term_id", "ord"), ["collection", "term_id"])


def enrich(
    inputs: DataFrame, terms: DataFrame, background: int = 20000, top: int = TOP_TERMS, max_p: float = MAX_P, min_overlap: int = MIN_OVERLAP,
    genes: DataFrame | None = None,
) -> DataFrame:
    """Terms per task and collection with at least ``min_overlap`` shared symbols and p below ``max_p``, best ``top`` by p; adjusted p
    multiplies by the number of all terms of the collection, empty ones included. Inputs of fewer than two symbols have none. Inputs with a list
    per row get the shared symbols as a list, ``genes``, too; for long ones see ``shared_symbols``."""
    sizes = terms.groupBy("collection").agg(F.count("*").alias("n_terms"))
    tail = hypergeometric_tail(F.col("overlap_count"), F.lit(background), F.col("gene_count"), F.col("n_input"))
    scored = (
        overlaps(inputs, terms, genes).where((F.col("n_input") >= 2) & (F.col("overlap_count") >= min_overlap))
        .withColumn("p_value", tail).where(F.col("p_value") < max_p)
        .join(sizes, "collection")
        .withColumn("adjusted_p_value", F.least(F.col("p_value") * F.col("n_terms"), F.lit(1.0)))
        .drop("n_terms", "n_input")
    )
    w = Window.partitionBy("task_id", "collection").orderBy("p_value", "ord")
    ranked = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    if "symbols" not in inputs.columns:
        return ranked
    lists = shared_symbols(ranked, inputs, terms, genes).groupBy("task_id", "collection", "term_id").agg(F.sort_array(F.collect_list("symbol")).alias("genes"))
    return ranked.join(lists, ["task_id", "collection", "term_id"])


def shared_symbols(enriched: DataFrame, inputs: DataFrame, terms: DataFrame, genes: DataFrame | None = None) -> DataFrame:
    """(task, collection, term, symbol): the symbols behind the overlap of the kept terms, one row each."""
    genes = long_genes(terms) if genes is None else genes
    kept = enriched.select("task_id", "collection", "term_id")
    # an input's symbols meet their terms, as in ``overlaps``; all genes of every kept term would be many more rows
    pairs = long_inputs(inputs).join(genes.select("collection", "term_id", "symbol"), "symbol")
    return pairs.join(kept, ["task_id", "collection", "term_id"], "left_semi").select("task_id", "collection", "term_id", "symbol").distinct()


def combined(enriched: DataFrame, collection_order: list[str], top: int = TOP_TERMS) -> DataFrame:
    """All collections of a task by p (ties in collection order), best ``top``."""
    place = F.array_position(F.lit(collection_order), F.col("collection"))
    w = Window.partitionBy("task_id").orderBy("p_value", place, "rank")
    return enriched.withColumn("combined_rank", F.row_number().over(w)).where(F.col("combined_rank") <= top)


def enrichment_summary(inputs: DataFrame, combined_terms: DataFrame, background: int = 20000) -> DataFrame:
    """One row per task with at least two symbols, also when no term passes."""
    counts = combined_terms.groupBy("task_id").agg(F.count("*").alias("n_terms"))
    sizes = long_inputs(inputs).groupBy("task_id").agg(F.count("*").cast("int").alias("input_gene_count")).where("input_gene_count >= 2")
    return sizes.join(counts, "task_id", "left").select(
        "task_id", "input_gene_count", F.lit(background).alias("background_gene_count"), F.coalesce("n_terms", F.lit(0)).alias("n_terms"))


def load_collections(go_terms: DataFrame, pathways: DataFrame) -> DataFrame:
    """Ontology terms and pathways as one term table."""
    shape = lambda df, name: df.select(
        F.lit(name).alias("collection"), F.col("id").alias("term_id"), "name",
        F.coalesce("genes", F.array().cast("array<string>")).alias("genes"), "ord",
    )
    return union_all([shape(go_terms, "GO"), shape(pathways, "KEGG")])
