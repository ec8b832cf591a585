"""The candidates of each question that can be cited, without staging or shuffling all (question, candidate) pairs.

Candidates are dealt into parts and questions into sets; a part meets a set in one task, which adds up the scores of its pairs and keeps
``k`` per question and class. A class is what citation selection tells apart: linked with a named entity or not, fit for the other
language's slot or not. The pairs themselves never leave the task; what leaves it are at most 4 k rows per question and part, with the
number of pairs they stand for and their best score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions.text import preferred_source_type
from evidra.operators import answers, retrieval
from evidra.session import broadcast_if_small, materialize

#: Candidates of a part and questions of a set, on average.
PART_ROWS, SET_QUERIES = 1024, 1024
CLASS = ["hit", "other"]


def _asked(queries: DataFrame, tokens: DataFrame) -> DataFrame:
    """(query_id, preferred, n_asked, n_all, wanted, asked): rows of a question that prefer the same source, with what its tokens name."""
    per = queries.select("query_id", preferred_source_type(F.col("text")).alias("preferred")).groupBy("query_id", "preferred").agg(F.count("*").alias("n_asked"))
    total = per.groupBy("query_id").agg(F.sum("n_asked").alias("n_all"))
    wanted = answers.wanted_entities(tokens).groupBy("query_id").agg(F.collect_set("entity").alias("wanted"))  # a question's own tokens
    return per.join(total, "query_id").join(wanted, "query_id", "left").join(answers.network_queries(tokens), "query_id", "left")


def _rows(candidates: DataFrame, items: DataFrame, linked: DataFrame, chunks: DataFrame | None) -> DataFrame:
    """One row per candidate and differing keys and tags of its item: its terms, the keys of every order, its entities, and how often these
    keys, these tags and all of the item occur (``copies``, ``tag_copies``, ``all_copies``), as orders join both by the item's id."""
    postings = candidates.groupBy("item_id", "chunk_id").agg(F.collect_list(F.struct("term", "weight")).alias("postings"))
    keys = items.select("item_id", "source_type", "record_origin", "year", "ord")
    keys = keys.groupBy(keys.columns).agg(F.count("*").alias("copies"))
    tags = answers.domain_tags(linked)
    tags = tags.groupBy(tags.columns).agg(F.count("*").alias("tag_copies"))
    keys = materialize(keys.join(tags, "item_id"))
    total = keys.groupBy("item_id").agg(F.sum(F.col("copies") * F.col("tag_copies")).alias("all_copies"))
    rows = postings.join(keys.join(total, "item_id"), "item_id")
    names = answers.linked_entities(linked, "item_id").groupBy("item_id").agg(F.sort_array(F.collect_set("entity")).alias("_of_item"))
    rows = rows.join(names, "item_id", "left")
    none = F.array().cast("array<string>")
    if chunks is None or "related_entity_ids" not in chunks.columns:
        return rows.withColumn("entities", F.coalesce("_of_item", none)).drop("_of_item")
    names = answers.linked_entities(chunks, "chunk_id").groupBy("chunk_id").agg(F.sort_array(F.collect_set("entity")).alias("_of_chunk"))
    rows = rows.join(names, "chunk_id", "left")
    return rows.withColumn("entities", F.array_union(F.coalesce("_of_item", none), F.coalesce("_of_chunk", none))).drop("_of_item", "_of_chunk")


def citable_candidates(
    queries: DataFrame,
    items: DataFrame,
    tokens: DataFrame,
    chunks: DataFrame | None,
    named: DataFrame,
    linked: DataFrame,
    k: int,
    stop_share: float | None = None,
    part_rows: int = PART_ROWS,
    set_queries: int = SET_QUERIES,
) -> tuple[DataFrame, DataFrame]:
    """(ranked, totals) of ``retrieval.keyword_candidates``, both staged.

    ranked: its columns; of each question the rows that can be among the k best, be it of all candidates, of those with a named entity or of
    those fit for the other language's slot, in the order of ``answers.domain_order``. totals: query_id, score (the best of all candidates),
    available_citation_count (candidates with a named entity, or all if there are none).
    ``named``: tokens that name entities and the domain; ``linked``: the items with evidence_tags and related_entity_ids.
    """
    candidates, weights = retrieval.weighed_candidates(items, tokens, chunks, stop_share)
    rows = materialize(_rows(candidates, items, linked, chunks))
    asked = materialize(_asked(queries, named))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    n_sets = -(-asked.count() // set_queries) or 1
    n_parts = max(-(-rows.count() // part_rows), -(-cores // n_sets))
    which = lambda n, *of: F.pmod(F.xxhash64(*of), F.lit(n))
    dealt = rows.withColumn("part", which(n_parts, "item_id", "chunk_id")).withColumn("set", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_sets - 1).cast("long"))))
    dealt = dealt.withColumn("cell", (F.col("part") * n_sets + F.col("set")).cast("int")).repartitionById(n_parts * n_sets, "cell").drop("part")
    fixed = [c for c in dealt.columns if c != "postings"]
    met = dealt.select(*fixed, F.explode("postings").alias("p")).select(*fixed, "p.*").join(
        broadcast_if_small(weights.withColumn("set", which(n_sets, "query_id"))), ["set", "term"])
    scored = met.groupBy(*fixed, "query_id").agg(F.sum(F.col("weight") * F.col("idf")).alias("score")).where("score > 0")
    pairs = retrieval.with_order_keys(scored.join(broadcast_if_small(asked), "query_id"))
    pairs = pairs.withColumn("place_key", answers.domain_key(retrieval.order_key())).withColumn(
        "hit", F.coalesce(F.arrays_overlap("wanted", "entities"), F.lit(False))).withColumn("other", (F.col("bonus") == 0) & F.col("chunk_id").isNotNull())
    # orders and entity links join by question and item, so what occurs twice there counts so often
    often = F.col("n_asked") * F.col("copies") * F.col("tag_copies")
    several = F.lit(True) if chunks is not None and "related_entity_ids" in chunks.columns else F.lit(False)
    often = often * F.when(F.col("hit") & ~several, F.col("n_all") * F.col("all_copies")).otherwise(F.lit(1))
    local = Window.partitionBy("cell", "query_id", *CLASS)
    kept = pairs.withColumn("place", F.row_number().over(local.orderBy("place_key"))).withColumn("n", F.sum(often).over(local)).withColumn(
        "top", F.max("score").over(local)).where(F.col("place") <= k)
    ranked_columns = ["query_id", "item_id", "chunk_id", "score", "source_type", "record_origin", "year", "ord", "bonus", "real", "rank"]
    kept = kept.withColumn("rank", F.col("place_key.before"))
    kept = materialize(kept.select(*ranked_columns, "place_key", *CLASS, "place", "n", "top", "n_asked", "copies"))
    per = kept.where("place = 1").groupBy("query_id").agg(
        F.max("top").alias("score"), F.sum(F.when(F.col("hit"), F.col("n"))).alias("n_hit"), F.sum("n").alias("n_all"))
    totals = per.select("query_id", "score", F.coalesce("n_hit", "n_all").alias("available_citation_count"))
    best = Window.partitionBy("query_id", *CLASS).orderBy("place_key")
    first = kept.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select(*ranked_columns, "n_asked", "copies").distinct()
    ranked = first.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("n_asked") * F.col("copies")))).select(*ranked_columns)
    return materialize(ranked), materialize(totals)
