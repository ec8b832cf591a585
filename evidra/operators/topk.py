"""Exact top-k of weighted term sums without forming all (query, item) pairs.

A term's postings fall into blocks of equal field weight, each with one impact (weight times IDF). Per query:

1. the blocks of the greatest impact give partial sums, the best of these items their exact scores, and the k-th of those a threshold;
2. blocks are set aside from the smallest impact up, as long as an item that lies in such blocks alone stays below the threshold;
3. the items of the other blocks are candidates if their sum there, and the most the rest can add, reaches the threshold; only they are scored.

Blocks set aside are never joined with their items. ``positive_counts`` counts all items a query hits by OR-ing bitmaps, without pairs too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidra.session import broadcast_if_small, materialize

#: Postings read per wanted item in the first pass, and items scored exactly for the threshold.
FIRST_POSTINGS, FIRST_ITEMS = 200, 20
#: Scores are compared after rounding to nine digits.
SLACK = 1e-6
#: From so many items on a bucket of a term is a bitmap (4 KB), below they stay rows.
BITMAP_ROWS = 256
#: Up to so many joined postings the plain sum over all pairs is cheaper than the passes of the bounds; the rows are the same.
PLAIN_POSTINGS = 50_000_000


def exact_scores(pairs: DataFrame, matches: DataFrame, weights: DataFrame) -> DataFrame:
    """(query_id, item_id, score) of the given pairs."""
    wanted = pairs.select("query_id", "item_id").join(weights, "query_id")
    return wanted.join(matches, ["item_id", "term"]).groupBy("query_id", "item_id").agg(F.sum(F.col("weight") * F.col("idf")).alias("score"))


def candidates(matches: DataFrame, weights: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """(query_id, item_id) of all items that can be among the k best.

    ``matches``: item_id, term, weight (staged); ``weights``: query_id, term, idf (staged, idf > 0); ``first``: item_id of the items that come
    before all others. Items outside ``first`` are candidates only of queries without k items in it.
    """
    sizes = materialize(matches.groupBy("term", "weight").agg(F.count("*").alias("n")))  # one row per block
    blocks = weights.join(sizes, "term").withColumn("impact", F.col("weight") * F.col("idf"))
    down = Window.partitionBy("query_id").orderBy(F.desc("impact"), "term").rowsBetween(Window.unboundedPreceding, -1)
    opening = blocks.withColumn("before", F.coalesce(F.sum("n").over(down), F.lit(0))).where(F.col("before") < FIRST_POSTINGS * k)
    ahead = materialize(matches.join(first.select("item_id"), "item_id", "left_semi"))
    partial = ahead.join(broadcast_if_small(materialize(opening.select("query_id", "term", "weight", "impact"))), ["term", "weight"]).groupBy(
        "query_id", "item_id").agg(F.sum("impact").alias("part"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("part"), "item_id"))
    scored = exact_scores(partial.withColumn("place", place).where(F.col("place") <= FIRST_ITEMS * k), ahead, weights)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    bound = materialize(scored.withColumn("place", place).where(F.col("place") <= k).where(F.col("place") == k).select("query_id", F.col("score").alias("bound")))

    up = Window.partitionBy("query_id", "term").orderBy("impact")
    rise = F.col("impact") - F.coalesce(F.lag("impact").over(up), F.lit(0.0))
    upward = Window.partitionBy("query_id").orderBy("impact", "term").rowsBetween(Window.unboundedPreceding, 0)
    ranked = blocks.withColumn("rise", rise).withColumn("most", F.sum("rise").over(upward)).join(bound, "query_id", "left")
    ranked = materialize(ranked.withColumn("aside", F.coalesce(F.col("most") < F.col("bound") - SLACK, F.lit(False))))
    rest = ranked.where("aside").groupBy("query_id").agg(F.max("most").alias("rest"))
    kept = ranked.where("not aside").select("query_id", "term", "weight", "impact", "bound")

    def reach(of: DataFrame, taken: DataFrame) -> DataFrame:
        return of.join(broadcast_if_small(materialize(taken)), ["term", "weight"]).groupBy("query_id", "item_id").agg(
            F.sum("impact").alias("part"), F.max("bound").alias("bound"))

    bounded = reach(ahead, kept.where("bound is not null")).join(rest, "query_id", "left").where(
        F.col("part") + F.coalesce("rest", F.lit(0.0)) >= F.col("bound") - SLACK)
    free = reach(matches, kept.where("bound is null"))
    return bounded.select("query_id", "item_id").unionByName(free.select("query_id", "item_id"))


def joined_postings(matches: DataFrame, weights: DataFrame) -> int:
    """Rows that a join of all postings with all query terms would have."""
    terms = matches.groupBy("term").agg(F.count("*").alias("n")).join(weights.groupBy("term").agg(F.count("*").alias("q")), "term")
    return int(terms.agg(F.sum(F.col("n") * F.col("q"))).first()[0] or 0)


def top_scores(matches: DataFrame, weights: DataFrame, first: DataFrame, k: int, plain_postings: int = PLAIN_POSTINGS) -> DataFrame:
    """(query_id, item_id, score) of the items that can be among the k best, with exact scores (of all, where that costs less)."""
    if joined_postings(matches, weights) <= plain_postings:
        return matches.join(broadcast_if_small(weights), "term").groupBy("query_id", "item_id").agg(F.sum(F.col("weight") * F.col("idf")).alias("score"))
    return exact_scores(materialize(candidates(matches, weights, first, k)), matches, weights)


def positive_counts(matches: DataFrame, weights: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, n): number of items with any of the query's terms.

    ``items``: item_id and a distinct whole number ``ord`` of 0 or more. The items of a term meet in bitmaps of 32,768 numbers, and a
    query's count is that of the OR over its terms; buckets with few items stay rows.
    """
    numbered = matches.select("item_id", "term").join(items.select("item_id", F.col("ord").cast("long").alias("ord")), "item_id")
    placed = numbered.select("term", F.bitmap_bucket_number(F.col("ord") + 1).alias("bucket"), F.bitmap_bit_position(F.col("ord") + 1).alias("bit"))
    # a bucket has 32,768 numbers at most
    held = materialize(placed.groupBy("term", "bucket").agg(
        F.count("*").alias("n"), F.bitmap_construct_agg("bit").alias("bits"), F.collect_list("bit").alias("few"))
        .select("term", "bucket", F.when(F.col("n") >= BITMAP_ROWS, F.col("bits")).alias("bits"), F.when(F.col("n") < BITMAP_ROWS, F.col("few")).alias("few")))
    asked = broadcast_if_small(weights.select("query_id", "term"))
    dense = held.where("bits is not null").join(asked, "term").select("query_id", "bucket", "bits")
    sparse = held.where("few is not null").join(asked, "term").select("query_id", "bucket", F.explode("few").alias("bit")).groupBy(
        "query_id", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    merged = dense.unionByName(sparse).groupBy("query_id", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy("query_id").agg(F.sum(F.bitmap_count("bits")).alias("n"))
