"""Literature search for a batch of queries: filter, score, sort mode, page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions import lexicon
from evidra.functions.text import preferred_source_type
from evidra.operators.matching import KEYWORD, match_fields, sum_of, weigh
from evidra.operators.retrieval import field_text
from evidra.operators.tokenize import broad_disease_queries, tokenize_searches
from evidra.session import broadcast_if_small, materialize

DEFAULT_PAGE_SIZE = 10


def filter_items(items: DataFrame, source: str = "all", has_upload: bool | None = None) -> DataFrame:
    """Source and upload filters before scoring; both reach the scan."""
    if source != "all":
        items = items.where(F.col("source_type") == source)
    if has_upload is not None:
        uploaded = F.col("pdf_upload_id").isNotNull() & (F.col("pdf_upload_id") != "")
        items = items.where(uploaded if has_upload else ~uploaded)
    return items


def search_scores(items: DataFrame, search_terms: DataFrame) -> DataFrame:
    """(query_id, item_id, score > 0): every matching (field, term) adds the field's weight."""
    fields = {}
    for name in lexicon.SEARCH_FIELD_WEIGHTS:
        if name not in items.columns:
            continue
        fields[name] = field_text(items, name)
        if name == "evidence_tags":
            spaced = F.transform("evidence_tags", lambda t: F.replace(t, F.lit("_"), F.lit(" ")))
            fields[name] = F.lower(F.concat_ws(" ", F.concat("evidence_tags", spaced)))
    found = match_fields(items, ["item_id"], fields, search_terms.select("term"), KEYWORD)
    matched = found.withColumn("weight", weigh(fields, lexicon.SEARCH_FIELD_WEIGHTS, sum_of)).where("weight > 0")
    return (
        matched.join(broadcast_if_small(search_terms), "term")
        .groupBy("query_id", "item_id").agg(F.sum("weight").cast("int").alias("score"))
    )


def sort_keys(sort: str, broad: Column) -> list[Column]:
    """Ordering of one sort mode; ``ord`` keeps input order on ties."""
    if sort == "year_desc":
        return [F.desc("year"), F.desc("score"), F.desc("bonus"), F.asc("ord")]
    if sort == "year_asc":
        return [F.asc("year"), F.desc("score"), F.desc("bonus"), F.asc("ord")]
    on_topic = lambda name: F.desc(F.when(broad, F.lit(0)).otherwise(F.col(name)))
    return [F.desc("bonus"), on_topic("score"), on_topic("year"), F.asc("ord")]


def search_literature(
    queries: DataFrame,
    items: DataFrame,
    source: str = "all",
    page: int = 1,
    page_size: int = DEFAULT_PAGE_SIZE,
    sort: str = "relevance",
    has_upload: bool | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(page rows, summary): one summary row per query, also for queries without a hit."""
    page = max(page, 1)
    if page_size < 1:
        raise ValueError("a page holds one row at least")
    pool = filter_items(items, source, has_upload)
    terms = materialize(tokenize_searches(queries))
    scores = search_scores(pool, terms)
    preferred = queries.select("query_id", preferred_source_type(F.col("text")).alias("preferred"))
    broad = broad_disease_queries(terms).withColumn("broad", F.lit(True))
    rows = (
        scores.join(pool.select("item_id", "source_type", "year", "ord"), "item_id")
        .join(preferred, "query_id")
        .join(broad, "query_id", "left")
        .withColumn("bonus", F.when(F.col("source_type") == F.col("preferred"), 1).otherwise(0))
        .withColumn("broad", F.coalesce("broad", F.lit(False)))
    )
    w = Window.partitionBy("query_id").orderBy(*sort_keys(sort, F.col("broad")))
    last = page * page_size
    ranked = rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= last)
    page_rows = ranked.where(F.col("position") > last - page_size).select(
        "query_id", "item_id", "score", "bonus", "year", "position"
    )
    totals = scores.groupBy("query_id").agg(F.count("*").alias("total"))
    summary = queries.select("query_id").join(totals, "query_id", "left").select(
        "query_id", F.coalesce("total", F.lit(0)).alias("total"), F.lit(page).alias("page"),
        F.lit(page_size).alias("page_size"),
        F.ceil(F.coalesce("total", F.lit(0)) / page_size).cast("bigint").alias("total_pages"),
    )
    return page_rows, summary
