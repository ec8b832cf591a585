"""Keyword, vector and fused ranking of (item, chunk) candidates for a batch of queries.

items:  item_id, title, source_type, record_origin, year, ord and optional keywords,
        evidence_tags, related_entity_ids, snippet, abstract
chunks: chunk_id, item_id, text and optional evidence_tags, related_entity_ids
tokens: query_id, token            queries: query_id, text
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions import lexicon
from evidra.functions.embedding import hashing_embedding
from evidra.functions.text import preferred_source_type
from evidra.operators import topk
from evidra.operators.matching import SUBSTRING, TextIndex, best_of, build_index, match_fields, match_index, match_texts, weigh
from evidra.session import union_all, broadcast_if_small, materialize


def field_text(df: DataFrame, name: str) -> Column:
    """Lower-cased haystack of one field; arrays are joined by a space."""
    if name not in df.columns:
        return F.lit("")
    if dict(df.dtypes)[name].startswith("array"):
        return F.lower(F.concat_ws(" ", F.col(name)))
    return F.lower(F.coalesce(F.col(name), F.lit("")))


def tag_bonus(
    owners: DataFrame, key: str, tokens: DataFrame, canonical: DataFrame, weight: int
) -> DataFrame:
    """(query_id, key, bonus): weight x canonical query tokens contained in any tag."""
    wanted = broadcast_if_small(materialize(tokens.join(canonical, "token", "left_semi")))
    tags = owners.select(key, F.explode(F.array_distinct("evidence_tags")).alias("tag"))
    tag_terms = match_texts(
        tags.select("tag", F.col("tag").alias("text")).distinct(), wanted.select(F.col("token").alias("term")), ["tag"], matcher=SUBSTRING,
    ).where(F.contains("tag", "term"))
    # a frequent tag would gather its owners in one task, so the terms go to the tags; owners stay together from there on
    named = broadcast_if_small(materialize(tag_terms.groupBy("tag").agg(F.collect_list("term").alias("terms"))))
    owner_terms = tags.join(named, "tag").select(key, F.explode("terms").alias("token")).repartition(key).distinct()
    return (
        owner_terms.join(wanted, "token").groupBy("query_id", key)
        .agg((F.count("*") * weight).cast("double").alias("bonus"))
    )


def token_idf(matched: DataFrame, n_items: DataFrame, stop_share: float | None = None, stop_above: int = 0) -> DataFrame:
    """(token, df, idf) from item-level document frequency; ln((N+1)/(df+1))+1.

    With ``stop_share`` tokens in more than that share of the items weigh nothing, where the corpus has more than ``stop_above`` items.
    The source system takes half for corpora of more than a hundred items and no limit for smaller ones.
    """
    df = matched.select("term", "item_id").distinct().groupBy("term").agg(F.count("*").alias("df"))
    n, freq = F.col("n"), F.col("df")
    idf = F.log((n + 1) / (freq + 1)) + 1
    return (
        df.join(F.broadcast(n_items.select(F.count("*").alias("n"))))  # one row
        .select(F.col("term").alias("token"), "df", (
            idf if stop_share is None else F.when((n > stop_above) & (freq > n * stop_share), F.lit(0.0)).otherwise(idf)).alias("idf"))
    )


def _fields(df: DataFrame, weights: dict[str, int]) -> dict[str, Column]:
    """All fields in order; a missing one is empty, so that its neighbours lie two spaces apart."""
    return {name: field_text(df, name) for name in weights}


def _seams(items: DataFrame, chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """(item_id, term) of phrases that run between an item's fields and its chunks'. An item with chunks reads as item, chunk, item,
    chunk, ... in chunk order, all fields one space apart; of a long field only the ends can take part, so its middle stays out."""
    phrases = terms.where(F.col("term").rlike("[\\s\u3000]"))
    longest = phrases.agg(F.max(F.length("term"))).first()[0]
    if longest is None:
        return items.select("item_id", F.lit("").alias("term")).limit(0)
    keep = F.lit(int(longest))

    def ends(df: DataFrame, weights: dict[str, int]) -> Column:
        parts = [field_text(df, name) for name in weights]
        cut = [F.when(F.length(t) <= 2 * keep, t).otherwise(F.concat(F.left(t, keep), F.lit("\u0000"), F.right(t, keep))) for t in parts]
        return F.array_join(F.array(*cut), " ")

    around = items.select("item_id", ends(items, lexicon.ITEM_FIELD_WEIGHTS).alias("outer"))
    inner = chunks.select("item_id", "chunk_id", ends(chunks, lexicon.CHUNK_FIELD_WEIGHTS).alias("inner"))
    last = chunks.groupBy("item_id").agg(F.max("chunk_id").alias("last"))
    rows = around.join(inner, "item_id").join(last, "item_id").select(
        "item_id", "chunk_id", F.concat_ws(" ", "outer", "inner", F.when(F.col("chunk_id") != F.col("last"), F.col("outer"))).alias("text"))
    return match_texts(rows, phrases, ["item_id", "chunk_id"]).select("item_id", "term").distinct()


def item_index(items: DataFrame) -> TextIndex:
    """The positional index of all item fields, for a corpus that is asked more than once."""
    return build_index(items, ["item_id"], _fields(items, lexicon.ITEM_FIELD_WEIGHTS))


def match_candidates(
    items: DataFrame, chunks: DataFrame | None, tokens: DataFrame, index: TextIndex | None = None
) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(item_id, term, weight) and (item_id, chunk_id, term, weight) with the best field weight, and (item_id, term) of every item
    that holds the term, be it from one field into the next. All staged. With ``index`` the items' texts are not read again."""
    terms = materialize(tokens.select(F.col("token").alias("term")).distinct())

    def weighed(df: DataFrame, keys: list[str], weights: dict[str, int]) -> DataFrame:
        return materialize(df.select(*keys, "term", weigh(weights, weights, best_of).alias("weight")))

    matched = match_fields(items, ["item_id"], _fields(items, lexicon.ITEM_FIELD_WEIGHTS), terms) if index is None else match_index(index, terms)
    found = weighed(matched, ["item_id"], lexicon.ITEM_FIELD_WEIGHTS)
    item_matches, held = found.where("weight > 0"), found.select("item_id", "term")
    if chunks is None:
        return item_matches, None, held
    keys = ["item_id", "chunk_id"]
    parts = weighed(match_fields(chunks, keys, _fields(chunks, lexicon.CHUNK_FIELD_WEIGHTS), terms), keys, lexicon.CHUNK_FIELD_WEIGHTS)
    held = union_all([held, parts.select("item_id", "term"), _seams(items, chunks, terms)])
    return item_matches, parts.where("weight > 0"), held


def weighed_candidates(
    items: DataFrame, tokens: DataFrame, chunks: DataFrame | None = None, stop_share: float | None = None
) -> tuple[DataFrame, DataFrame]:
    """(item_id, chunk_id, term, weight) with the best field weight of item and chunk, and (query_id, term, idf) of tokens that weigh
    anything, staged. Items without chunks stand as a candidate with a null chunk."""
    item_matches, chunk_matches, held = match_candidates(items, chunks, tokens)
    idf = token_idf(held, items, stop_share)
    weights = materialize(tokens.join(idf, "token").where("idf > 0").select("query_id", F.col("token").alias("term"), "idf"))
    if chunks is None:
        return item_matches.withColumn("chunk_id", F.lit(None).cast("string")), weights
    pairs = items.select("item_id").join(chunks.select("item_id", "chunk_id"), "item_id", "left")
    from_items = item_matches.join(pairs, "item_id")
    candidates = (
        from_items.select("item_id", "chunk_id", "term", "weight")
        .unionByName(chunk_matches.select("item_id", "chunk_id", "term", "weight"))
        .groupBy("item_id", "chunk_id", "term").agg(F.max("weight").alias("weight"))
    )
    return candidates, weights


def keyword_scores(
    items: DataFrame,
    tokens: DataFrame,
    chunks: DataFrame | None = None,
    canonical: DataFrame | None = None,
    stop_share: float | None = None,
) -> DataFrame:
    """Positive keyword scores: (query_id, item_id, chunk_id, score).

    Per token the best field weight of item and chunk counts once, times its IDF. Items
    without chunks stand as a candidate with a null chunk.
    """
    candidates, weights = weighed_candidates(items, tokens, chunks, stop_share)
    scores = candidates.join(broadcast_if_small(weights), "term").groupBy("query_id", "item_id", "chunk_id").agg(
        F.sum(F.col("weight") * F.col("idf")).alias("score")
    )
    if canonical is not None:
        scores = _add_tag_bonus(scores, items, chunks, tokens, canonical)
    return scores.where("score > 0")


def _add_tag_bonus(scores, items, chunks, tokens, canonical):
    parts = [scores]
    if "evidence_tags" in items.columns:
        bonus = tag_bonus(items, "item_id", tokens, canonical, lexicon.ITEM_TAG_BONUS)
        if chunks is None:
            rows = bonus.withColumn("chunk_id", F.lit(None).cast("string"))
        else:
            pairs = items.select("item_id").join(chunks.select("item_id", "chunk_id"), "item_id", "left")
            rows = bonus.join(pairs, "item_id")
        parts.append(rows.select("query_id", "item_id", "chunk_id", F.col("bonus").alias("score")))
    if chunks is not None and "evidence_tags" in chunks.columns:
        bonus = tag_bonus(chunks, "chunk_id", tokens, canonical, lexicon.CHUNK_TAG_BONUS)
        rows = bonus.join(chunks.select("chunk_id", "item_id"), "chunk_id")
        parts.append(rows.select("query_id", "item_id", "chunk_id", F.col("bonus").alias("score")))
    merged = union_all(parts)
    return merged.groupBy("query_id", "item_id", "chunk_id").agg(F.sum("score").alias("score"))


def with_item_keys(scores: DataFrame, items: DataFrame, queries: DataFrame) -> DataFrame:
    """Adds real, bonus, year and ord, the keys every ordering uses."""
    preferred = queries.select("query_id", preferred_source_type(F.col("text")).alias("preferred"))
    keys = items.select("item_id", "source_type", "record_origin", "year", "ord")
    return with_order_keys(scores.join(keys, "item_id").join(preferred, "query_id")).drop("preferred")


def with_order_keys(rows: DataFrame) -> DataFrame:
    """Adds bonus and real from source_type, preferred and record_origin."""
    return rows.withColumn("bonus", F.when(F.col("source_type") == F.col("preferred"), 1).otherwise(0)).withColumn(
        "real", F.when(F.col("record_origin") != "seed_sample", 1).otherwise(0))


def retrieval_order() -> list[Column]:
    """Real evidence, score, language bonus, year (all descending), then input order."""
    return [
        F.desc("real"), F.desc(F.round("score", 9)), F.desc("bonus"), F.desc("year"),
        F.asc("ord"), F.asc("chunk_id"),
    ]


def order_key() -> Column:
    """retrieval_order as one ascending struct. Operators that need the order but no number
    (first per item, best k of a pool, counts) take it as ``rank``, so that no task ever sorts
    all candidates of a query."""
    return F.struct(
        (-F.col("real")).alias("r"), (-F.round("score", 9)).alias("s"), (-F.col("bonus")).alias("b"),
        (-F.col("year")).alias("y"), F.col("ord"), F.coalesce("chunk_id", F.lit("")).alias("c"),
    )


def rank_candidates(
    candidates: DataFrame, order: list[Column] | None = None, k: int | None = None
) -> DataFrame:
    """``rank`` from 1 per query; with ``k`` only the first k are kept, and each task cuts to k
    before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(*(order or retrieval_order()))
    ranked = candidates.withColumn("_place", F.row_number().over(w))
    if k is not None:
        ranked = ranked.where(F.col("_place") <= k)
    return ranked.drop("rank").withColumnRenamed("_place", "rank")


def keyword_candidates(
    queries: DataFrame,
    items: DataFrame,
    tokens: DataFrame,
    chunks: DataFrame | None = None,
    canonical: DataFrame | None = None,
    stop_share: float | None = None,
) -> DataFrame:
    """All positive candidates; ``rank`` is their order key."""
    scores = keyword_scores(items, tokens, chunks, canonical, stop_share)
    return with_item_keys(scores, items, queries).withColumn("rank", order_key())


def rank_keyword(
    queries: DataFrame,
    items: DataFrame,
    tokens: DataFrame,
    chunks: DataFrame | None = None,
    canonical: DataFrame | None = None,
    k: int = 50,
    encode: Callable | None = None,
    stop_share: float | None = None,
) -> DataFrame:
    """Best k candidates per query, numbered from 1; ``encode`` is not needed here. Whole items without tags are ranked by
    score bounds, without forming all pairs."""
    if chunks is None and (canonical is None or "evidence_tags" not in items.columns):
        matches, weights = weighed_terms(items, tokens, stop_share)
        return rank_candidates(top_candidates(queries, items, matches, weights, k))
    return rank_candidates(keyword_candidates(queries, items, tokens, chunks, canonical, stop_share), k=k)


def weighed_terms(items: DataFrame, tokens: DataFrame, stop_share: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(item_id, term, weight) of the items and (query_id, term, idf) of the queries' tokens with a weight; both staged."""
    matches, _, held = match_candidates(items, None, tokens)
    idf = token_idf(held, items, stop_share).where("idf > 0")
    weights = tokens.join(idf, "token").select("query_id", F.col("token").alias("term"), "idf").distinct()
    return matches, materialize(weights)


def top_candidates(queries: DataFrame, items: DataFrame, matches: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """The k best candidates of every query with their keys; ``rank`` is their order key."""
    first = items.where("record_origin <> 'seed_sample'")  # real evidence comes before all other
    scores = topk.top_scores(matches, weights, first, k).withColumn("chunk_id", F.lit(None).cast("string"))
    return rank_candidates(with_item_keys(scores, items, queries), k=k).withColumn("rank", order_key())


def fallback_candidates(
    items: DataFrame, queries: DataFrame, hits: DataFrame, k: int, chunks: DataFrame | None = None
) -> DataFrame:
    """First k candidates (score 0) for queries without any positive candidate; with ``chunks`` an
    item stands once per chunk.

    The order of unscored items depends on the preferred source only, so k rows per
    preference are selected once and then handed to the queries.
    """
    prefs = queries.select(preferred_source_type(F.col("text")).alias("preferred")).distinct()
    order = [F.desc("real"), F.desc("bonus"), F.desc("year"), F.asc("ord")]
    w = Window.partitionBy("preferred").orderBy(*order)
    heads = (
        items.select("item_id", "source_type", "record_origin", "year", "ord",
                     F.explode(F.array(F.lit("cn_literature"), F.lit("pubmed"))).alias("preferred"))
        .join(F.broadcast(prefs), "preferred", "left_semi")
        .withColumn("bonus", F.when(F.col("source_type") == F.col("preferred"), 1).otherwise(0))
        .withColumn("real", F.when(F.col("record_origin") != "seed_sample", 1).otherwise(0))
        .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        .withColumn("chunk_id", F.lit(None).cast("string"))
    )
    if chunks is not None:
        each = Window.partitionBy("preferred").orderBy(*order, F.asc("chunk_id"))
        heads = (
            heads.drop("chunk_id").join(chunks.select("item_id", "chunk_id"), "item_id", "left")
            .withColumn("rank", F.row_number().over(each)).where(F.col("rank") <= k)
        )
    lonely = queries.join(hits.select("query_id").distinct(), "query_id", "left_anti").select(
        "query_id", preferred_source_type(F.col("text")).alias("preferred")
    )
    return lonely.join(heads, "preferred").drop("preferred").withColumn("score", F.lit(0.0))


# --- vectors ------------------------------------------------------------------------------

#: Bytes of vectors on either side of a grid block, and cells of the score matrix formed at a time.
CELL_BYTES = 24 * 1024 * 1024
CELL_SCORES = 4 * 1024 * 1024
#: Vectors a cell has on average, the greatest number of cells, and vectors sampled per cell for its centroid.
CELL_ROWS, MOST_CELLS, SAMPLE_PER_CELL = 4096, 1024, 16


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm <= 1e-12, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / norm))
    )


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Exact inner-product top-k: queries (query_id, qvec), vectors (vec_id, vec) ->
    (query_id, vec_id, score, rank); ties go to the smaller id. Null vectors take no part.

    Vectors are dealt to the nearest of some centroids. No vector of a cell scores more than q.c + |q| r, so a query first meets the
    cells with the best bounds, and then only those whose bound reaches its k-th score. Cells lie in blocks of bounded bytes, and a query
    goes once to every block that holds a cell it has to meet. Executors emit k rows per query and block at most, and after the first
    cells only scores that reach the k-th one. Neither side is broadcast or brought to the driver.
    """
    return pruned_top_k(queries, vectors, k, cell_rows)[0]


def pruned_top_k(queries: DataFrame, vectors: DataFrame, k: int, cell_rows: int = CELL_ROWS) -> tuple[DataFrame, DataFrame]:
    """(the rows of ``vector_top_k``, (query_id, met, cells): how many of the cells each query met)."""
    spark = vectors.sparkSession
    id_type, query_type = dict(vectors.dtypes)["vec_id"], dict(queries.dtypes)["query_id"]
    schema = f"query_id {query_type}, vec_id {id_type}, score double"
    queries, vectors = queries.where("qvec is not null"), vectors.where("vec is not null")
    total = vectors.count() if k > 0 else 0
    if not total:
        return spark.createDataFrame([], schema + ", rank int"), spark.createDataFrame([], f"query_id {query_type}, met long, cells long")
    n_cells = max(1, min(MOST_CELLS, total // cell_rows))
    element = "float" if all(dict(df.dtypes)[c] == "array<float>" for df, c in ((vectors, "vec"), (queries, "qvec"))) else "double"
    vectors = vectors.select("vec_id", F.col("vec").cast(f"array<{element}>").alias("vec"))
    queries = queries.select("query_id", F.col("qvec").cast(f"array<{element}>").alias("qvec"))
    if n_cells == 1:
        alone = vectors.withColumn("cell", F.lit(0))
        opening = queries.select("*", F.lit(None).cast("double").alias("least"), F.lit(0).alias("block"), F.array(F.lit(0)).alias("cells"))
        found = _grid(opening, alone, _blocks(alone), k, schema)
        return _ranked_vectors(found, k), queries.select("query_id", F.lit(1).cast("long").alias("met"), F.lit(1).cast("long").alias("cells"))
    # twice as many distinct vectors as cells, by a hash of the vector, at most: the spread ones of them are the centroids
    sample = vectors.select("vec").distinct().orderBy(F.xxhash64("vec")).limit(SAMPLE_PER_CELL * n_cells)
    centres = _spread_centres([r["vec"] for r in sample.collect()], n_cells)
    dealt = materialize(vectors.mapInArrow(_nearest_centre(centres), f"vec_id {id_type}, vec array<{element}>, cell int, far double"))
    size = {r["cell"]: (r["far"], r["n"]) for r in dealt.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()}  # one row per cell
    dealt, blocks = dealt.drop("far"), _blocks(dealt)
    # a query meets the best cells that hold k vectors, then those that its k-th score leaves open
    asked = f"query_id {query_type}, qvec array<{element}>, least double, block int, cells array<int>"
    opening = materialize(queries.withColumn("least", F.lit(None).cast("double")).mapInArrow(_open_cells(centres, size, k, blocks), asked))
    first = materialize(_grid(opening, dealt, blocks, k, schema))
    least = _ranked_vectors(first, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    later = queries.join(least, "query_id", "left").select("query_id", "qvec", F.coalesce("least", F.lit(float("-inf"))).alias("least")).mapInArrow(
        _open_cells(centres, size, k, blocks), asked)
    seen = opening.groupBy("query_id", "block").agg(F.array_distinct(F.flatten(F.collect_list("cells"))).alias("before"))
    rest = materialize(later.join(seen, ["query_id", "block"], "left").withColumn(
        "cells", F.array_except("cells", F.coalesce("before", F.array().cast("array<int>")))).drop("before").where(F.size("cells") > 0))
    found = first.unionByName(_grid(rest, dealt, blocks, k, schema))
    met = opening.select("query_id", "cells").unionByName(rest.select("query_id", "cells")).groupBy("query_id").agg(F.sum(F.size("cells")).alias("met"))
    return _ranked_vectors(found, k), met.withColumn("cells", F.lit(len(size)).cast("long"))


def _ranked_vectors(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _blocks(vectors: DataFrame) -> dict[int, tuple[int, int]]:
    """cell -> (block, parts): small cells share a block of bounded bytes, a large one is a block of several parts."""
    width = {"array<float>": 4, "array<double>": 8}[dict(vectors.dtypes)["vec"]]
    rows = vectors.groupBy("cell").agg(F.sum(F.size("vec").cast("bigint") * width).alias("b")).collect()  # one row per cell, MOST_CELLS at most
    out, block, filled = {}, -1, CELL_BYTES
    for cell, held in sorted((r["cell"], r["b"]) for r in rows):
        if filled + held > CELL_BYTES:
            block, filled = block + 1, 0
        out[cell], filled = (block, max(1, -(-held // CELL_BYTES))), filled + held
    return out


def _grid(queries: DataFrame, vectors: DataFrame, blocks: dict[int, tuple[int, int]], k: int, schema: str) -> DataFrame:
    """Every query (query_id, qvec, least, block, cells) with every vector of its cells, at most k rows per query and part of a block. Of the
    queries of a block so many shares are made that each has bounded bytes too; a block's vectors go to each of them."""
    spark, n_blocks = vectors.sparkSession, sum({b: p for b, p in blocks.values()}.values())
    width = {"array<float>": 4, "array<double>": 8}[dict(queries.dtypes)["qvec"]]
    least = -(-2 * spark.sparkContext.defaultParallelism // n_blocks)  # small inputs are cut finer on the query side, which adds no result rows
    shares = F.broadcast(materialize(queries.groupBy("block").agg(F.greatest(
        F.ceil(F.sum(F.size("qvec").cast("bigint") * width) / CELL_BYTES), F.lit(least).cast("bigint")).alias("shares"))))  # one row per block
    table = F.broadcast(spark.createDataFrame([(c, b, p) for c, (b, p) in blocks.items()], "cell int, block int, parts long"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    # hashes of different seeds, as both sides may have one id
    left = queries.join(shares, "block").join(F.broadcast(table.select("block", "parts").distinct()), "block").select(
        "query_id", "qvec", "least", "cells", "block", F.pmod(F.xxhash64("query_id"), F.col("shares")).alias("_q"), each("parts").alias("_v"))
    right = vectors.join(table, "cell").join(shares, "block").select(
        "vec_id", "vec", "cell", "block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("parts")).alias("_v"), each("shares").alias("_q"))
    return left.groupBy("block", "_q", "_v").cogroup(right.groupBy("block", "_q", "_v")).applyInPandas(_best_of_block(k), schema)


def _spread_centres(sample: list[list[float]], n: int) -> np.ndarray:
    """``n`` vectors of a bounded sample, each the farthest from those before it, moved once to the mean of their neighbours."""
    rows = np.asarray(sample, dtype=np.float64)
    chosen, gap = [0], ((rows - rows[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(rows)):
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((rows - rows[chosen[-1]]) ** 2).sum(1))
    centres = rows[chosen]
    owner = np.argmin((centres**2).sum(1) - 2 * rows @ centres.T, axis=1)
    return np.stack([rows[owner == i].mean(0) if (owner == i).any() else c for i, c in enumerate(centres)])


def _nearest_centre(centres: np.ndarray) -> Callable:
    def run(batches):
        for batch in batches:
            rows = np.asarray(batch.column("vec").to_pylist(), dtype=np.float64).reshape(-1, centres.shape[1])
            cell = np.argmin((centres**2).sum(1) - 2 * rows @ centres.T, axis=1)
            far = np.sqrt(((rows - centres[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vec"), pa.array(cell, pa.int32()), pa.array(far)], ["vec_id", "vec", "cell", "far"])

    return run


def _open_cells(centres: np.ndarray, size: dict[int, tuple[float, int]], k: int, blocks: dict[int, tuple[int, int]]) -> Callable:
    """One row per query and block, with its cells that the query has to meet: those whose bound reaches ``least``, or without it the best
    that hold k vectors."""
    cells = np.array(sorted(size))
    far, held = np.array([size[c][0] for c in cells]), np.array([size[c][1] for c in cells])
    block_of = np.array([blocks[c][0] for c in cells])  # ascending, as blocks follow the cells

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                rows = np.asarray(batch.column("qvec").to_pylist(), dtype=np.float64).reshape(-1, centres.shape[1])
                norm = np.sqrt((rows**2).sum(1))[:, None]
                bound = rows @ centres[cells].T + norm * far
                bound += 1e-9 * (1 + norm * (far + np.sqrt((centres[cells] ** 2).sum(1))))  # rounding
                least = batch.column("least").to_numpy(zero_copy_only=False).astype(float)
                order = np.argsort(-bound, axis=1, kind="stable")
                before = np.cumsum(held[order], axis=1) - held[order]
                opening = np.zeros(bound.shape, bool)
                np.put_along_axis(opening, order, before < k, axis=1)
                row, at = np.where(np.isnan(least)[:, None], opening, bound >= np.nan_to_num(least, nan=0.0, neginf=-np.inf)[:, None]).nonzero()
                heads = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(block_of[at]) != 0)][:len(row)])
                taken = pa.array(row[heads])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("query_id").take(taken), batch.column("qvec").take(taken), batch.column("least").take(taken), pa.array(block_of[at[heads]], pa.int32()),
                     pa.ListArray.from_arrays(pa.array(np.r_[heads, len(row)], pa.int32()), pa.array(cells[at], pa.int32()))],
                    ["query_id", "qvec", "least", "block", "cells"])

    return run


def _best_of_block(k: int) -> Callable:
    def best(left, right):
        import numpy as np
        import pandas as pd

        columns = {"query_id": left["query_id"][:0], "vec_id": right["vec_id"][:0], "score": np.empty(0)}
        if left.empty or right.empty:
            return pd.DataFrame(columns)
        right = right.sort_values("vec_id", kind="stable")  # a tie is settled by position
        single = all(len(v) == 0 or getattr(v[0], "dtype", None) == np.float32 for v in (left["qvec"].iloc[0], right["vec"].iloc[0]))
        kind = np.float32 if single else np.float64
        vectors = np.asarray(right["vec"].tolist(), dtype=kind)
        queries = np.asarray(left["qvec"].tolist(), dtype=kind)
        least = left["least"].to_numpy(dtype=np.float64, na_value=np.nan)
        # rows of each cell, and the queries that meet it
        by_cell = {cell: np.asarray(at) for cell, at in right.reset_index(drop=True).groupby("cell").indices.items()}
        lists = left["cells"].tolist()
        asked = np.repeat(np.arange(len(left)), [len(c) for c in lists])
        met = np.concatenate(lists)
        order = np.argsort(met, kind="stable")
        asked, met = asked[order], met[order]
        norms = [np.sqrt((m.astype(np.float64) ** 2).sum(1)) for m in (queries, vectors)]
        held, waiting, n_waiting = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)), [], 0
        for cell, at in by_cell.items():
            first, last = np.searchsorted(met, [cell, cell + 1])
            here, step, longest = vectors[at], max(1, CELL_SCORES // len(at)), norms[1][at].max()
            for start in range(first, last, step):
                who = asked[start:min(start + step, last)]
                known = ~np.isnan(least[who])
                for some, bounded in ((who[known], True), (who[~known], False)):
                    if not len(some):
                        continue
                    row, column = _reaching(queries[some], here, least[some], norms[0][some] * longest) if bounded else _top_of(queries[some], here, k)
                    waiting.append((some[row], at[column], _products(queries, vectors, some[row], at[column])))
                    n_waiting += len(row)
                if n_waiting > max(CELL_SCORES // 4, 2 * len(held[0])):
                    held, waiting, n_waiting = _first_of([held, *waiting], k), [], 0
        held = _first_of([held, *waiting], k)
        return pd.DataFrame({"query_id": left["query_id"].to_numpy()[held[0]], "vec_id": right["vec_id"].to_numpy()[held[1]], "score": held[2]})

    return best


def _first_of(parts: list[tuple], k: int) -> tuple:
    """The k best (query, position, score) of every query; of equal scores the smaller positions."""
    query, position, score = (np.concatenate(p) for p in zip(*parts))
    order = np.lexsort((position, -score, query))
    query, position, score = query[order], position[order], score[order]
    heads = np.flatnonzero(np.r_[True, np.diff(query) != 0][:len(query)])
    place = np.arange(len(query)) - np.repeat(heads, np.diff(np.r_[heads, len(query)]))
    kept = place < k
    return query[kept], position[kept], score[kept]


def _products(queries: np.ndarray, vectors: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Inner products of the given pairs in double precision, some at a time."""
    out = np.empty(len(row))
    for i in range(0, len(row), 65536):
        some = slice(i, i + 65536)
        out[some] = np.einsum("ij,ij->i", queries[row[some]].astype(np.float64), vectors[column[some]].astype(np.float64))
    return out


def _reaching(queries: np.ndarray, vectors: np.ndarray, least: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the scores that reach the query's ``least``, or miss it by a rounding error of the product; ``norms``: no score is greater."""
    kind = np.finfo(vectors.dtype)
    slack = (vectors.shape[1] + 8) * (kind.eps * norms + kind.tiny) + 1e-9 * np.abs(np.where(np.isfinite(least), least, 0.0))
    with np.errstate(over="ignore", invalid="ignore"):
        floor = np.nextafter((least - slack).astype(kind.dtype), kind.dtype.type(-np.inf))
        below = queries @ vectors.T < floor[:, None]
    return np.logical_not(below, out=below).nonzero()  # what overflows is not below


def _top_of(queries: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best scores of every query, of equal ones the smaller columns."""
    kept = min(k, len(vectors))
    scores = queries.astype(np.float64) @ vectors.astype(np.float64).T
    last = np.partition(scores, len(vectors) - kept, axis=1)[:, len(vectors) - kept, None]
    above, level = scores > last, scores == last
    return (above | (level & (level.cumsum(axis=1) <= kept - above.sum(axis=1, keepdims=True)))).nonzero()


def rank_vector(
    queries: DataFrame, items: DataFrame, tokens: DataFrame | None = None, chunks: DataFrame | None = None,
    canonical: DataFrame | None = None, k: int = 50, encode: Callable = hashing_embedding, stop_share: float | None = None,
) -> DataFrame:
    """Vector ranking of chunks with score = pool - rank (rank from 0), then items without chunks
    at score 0 in input order, k candidates per query in all; ``encode`` maps a text column to a
    vector column. ``tokens``, ``canonical`` and ``stop_share`` belong to the calling convention of ``STRATEGIES``."""
    vectors = chunks.select(F.col("chunk_id").alias("vec_id"), encode(F.col("text")).alias("vec"))
    qvecs = queries.select("query_id", encode(F.col("text")).alias("qvec"))
    hits = vector_top_k(qvecs, vectors, k)
    pool = chunks.select(F.count("*").alias("pool"))
    scored = (
        hits.join(F.broadcast(pool))  # one row
        .select("query_id", F.col("vec_id").alias("chunk_id"),
                (F.col("pool") - F.col("rank") + 1).cast("double").alias("score"))
        .join(chunks.select("chunk_id", "item_id"), "chunk_id")
    )
    bare = chunkless_candidates(items, chunks).join(items.select("item_id", "ord"), "item_id")
    first = bare.orderBy("ord", "item_id").limit(k).drop("ord")
    rest = queries.select("query_id").join(F.broadcast(first))  # k rows at most
    both = union_all([scored.select("query_id", "item_id", "chunk_id", "score"), rest.select("query_id", "item_id", "chunk_id", "score")])
    return rank_candidates(with_item_keys(both, items, queries), [F.desc("score"), F.asc("ord")], k)


def chunkless_candidates(items: DataFrame, chunks: DataFrame) -> DataFrame:
    return items.join(chunks.select("item_id").distinct(), "item_id", "left_anti").select(
        "item_id", F.lit(None).cast("string").alias("chunk_id"), F.lit(0.0).alias("score")
    )


def rank_to_score(ranked: DataFrame) -> DataFrame:
    """score = pool - rank (rank from 0), the pool being the query's candidate count."""
    pool = ranked.groupBy("query_id").agg(F.count("*").alias("pool"))
    return ranked.join(pool, "query_id").withColumn("score", F.col("pool") - F.col("rank") + 1)


# --- fusion -------------------------------------------------------------------------------


def list_heads(candidates: DataFrame, list_no: int, order: list[Column], limit: int) -> DataFrame:
    """Positive candidates of one list (all where a query has none), best ``limit`` by order."""
    any_positive = candidates.groupBy("query_id").agg(F.max("score").alias("_top"))
    pool = candidates.join(any_positive, "query_id").where((F.col("score") > 0) | (F.col("_top") <= 0))
    return rank_candidates(pool.drop("_top"), order, limit).withColumn("list_no", F.lit(list_no))


def fuse(lists: list[DataFrame], k: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, item_id, chunk_id, rank, bonus, year,
    list_no): sum of 1/(60+rank), best bonus; order by sum, bonus, year, then first seen."""
    merged = union_all([
        df.select("query_id", "item_id", "chunk_id", "rank", "bonus", "year", "list_no") for df in lists
    ])
    fused = merged.groupBy("query_id", "item_id", "chunk_id").agg(
        F.sum(F.lit(1.0) / (F.lit(lexicon.RRF_K) + F.col("rank"))).alias("rrf"),
        F.max("bonus").alias("bonus"), F.max("year").alias("year"),
        F.min(F.struct("list_no", "rank")).alias("seen"),
    )
    order = [F.desc(F.round("rrf", 12)), F.desc("bonus"), F.desc("year"), F.asc("seen")]
    pool = fused.groupBy("query_id").agg(F.count("*").alias("pool"))
    ranked = rank_candidates(fused, order, k).join(pool, "query_id")
    return ranked.withColumn("score", F.col("pool") - F.col("rank") + 1).drop("pool", "seen")


def rank_hybrid(
    queries: DataFrame, items: DataFrame, tokens: DataFrame, chunks: DataFrame,
    canonical: DataFrame | None = None, k: int | None = None, encode: Callable = hashing_embedding,
    list_limit: int = lexicon.RRF_LIST_LIMIT, stop_share: float | None = None,
) -> DataFrame:
    """Fused keyword and vector ranking; each list gives its best ``list_limit`` candidates, ``k`` at least.
    A question without a positive keyword hit takes the first unscored candidates as its keyword list."""
    list_limit = max(list_limit, k or 0)
    positive = materialize(list_heads(
        keyword_candidates(queries, items, tokens, chunks, canonical, stop_share), 0, [F.asc("rank")], list_limit,
    ))
    unscored = fallback_candidates(items, queries, positive, list_limit, chunks).withColumn("list_no", F.lit(0))
    vector = list_heads(
        rank_vector(queries, items, tokens, chunks, canonical, list_limit, encode), 1,
        [F.desc("score"), F.asc("ord")], list_limit,
    )
    return fuse([positive, unscored, vector], k)


def select_strategy(name: str | None) -> str:
    """Registry lookup: unknown or empty names fall back to keyword."""
    cleaned = (name or "").strip().lower()
    return cleaned if cleaned in STRATEGIES else "keyword"


STRATEGIES = {"keyword": rank_keyword, "vector": rank_vector, "hybrid": rank_hybrid}


def first_per_item(ranked: DataFrame, k: int) -> DataFrame:
    """Ordered de-duplication: the best rank (number or order key) of each item, cut to k."""
    best = ranked.groupBy("query_id", "item_id").agg(F.min("rank").alias("first_rank"))
    w = Window.partitionBy("query_id").orderBy("first_rank")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("first_rank")
