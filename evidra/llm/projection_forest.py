"""Nearest neighbours by a forest of random-projection trees and one priority queue per query.

The forest has a bounded size: directions are random, thresholds are medians of a bounded sample, every row of the
table is indexed. A query walks all trees at once through one priority queue, ordered by how far it lies on the
wrong side of the splits above a leaf, until it has popped ``search_share`` of the leaves; their rows are candidates and are ranked
by exact distance. Leaves are dealt out as (tree, leaf, part) groups and queries as blocks, both of bounded size, so no group
grows with the table.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.llm.common import materialize

#: Bound of the sample that the thresholds come from.
SAMPLE_ROWS = 16_384
TREES, DEPTH, SEARCH_SHARE = 4, 8, 0.4
#: Rows of a leaf's part.
PART_ROWS = 4096
#: Queries that meet a part at a time.
QUERY_ROWS = 4096


def usable(vector: Column) -> Column:
    """True for vectors that take part: not null, not empty, without null, NaN or infinite components, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Forest:
    """Complete trees of ``depth`` levels; node k of a level splits by its own direction at its threshold."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 11) -> None:
        random = np.random.default_rng(seed)
        self.depth, self.leaves = depth, 1 << depth
        self.splits: list[list[tuple[np.ndarray, np.ndarray]]] = []
        for _ in range(trees):
            node, levels = np.zeros(len(sample), np.int64), []
            for level in range(depth):
                directions = random.standard_normal((1 << level, sample.shape[1]))
                directions /= np.linalg.norm(directions, axis=1, keepdims=True)
                side = np.einsum("ij,ij->i", sample, directions[node])
                cut = np.zeros(1 << level)
                for k in range(1 << level):
                    if (node == k).any():
                        cut[k] = np.median(side[node == k])
                levels.append((directions, cut))
                node = 2 * node + (side > cut[node])
            self.splits.append(levels)

    def leaf_of(self, rows: np.ndarray) -> np.ndarray:
        """Leaf of every row in every tree, shape (rows, trees)."""
        found = []
        for levels in self.splits:
            node = np.zeros(len(rows), np.int64)
            for directions, cut in levels:
                node = 2 * node + (np.einsum("ij,ij->i", rows, directions[node]) > cut[node])
            found.append(node)
        return np.stack(found, axis=1)

    def search(self, query: np.ndarray, leaves: int, rows: np.ndarray, least: int) -> list[int]:
        """The first ``leaves`` occupied cells (tree * leaves of a tree + leaf) that one priority queue over all trees gives
        out, and more until they hold ``least`` rows; ``rows`` has the rows of every cell."""
        queue = [(0.0, tree, 0, 0) for tree in range(len(self.splits))]
        out: list[int] = []
        held = 0
        sides = [[directions @ query - cut for directions, cut in levels] for levels in self.splits]
        while queue and (len(out) < leaves or held < least):
            cost, tree, level, node = heapq.heappop(queue)
            while level < self.depth:
                side = sides[tree][level][node]
                near = 2 * node + int(side > 0)
                heapq.heappush(queue, (cost + side * side, tree, level + 1, near ^ 1))
                level, node = level + 1, near
            cell = tree * self.leaves + node
            if rows[cell]:
                out.append(cell)
                held += int(rows[cell])
        return out


def _vectors(column: pa.Array, dtype: type = np.float64) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(len(column), -1)


def neighbours(rows: DataFrame, queries: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", trees: int = TREES,
               depth: int = DEPTH, search_share: float = SEARCH_SHARE, sample_rows: int = SAMPLE_ROWS, part_rows: int = PART_ROWS,
               query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id long, rank int, vec_id long, score double: the k nearest rows found by Euclidean distance.

    ``queries`` picks the query rows; candidates are all rows but the query's own. Ties go to the smaller key. Rows without a
    key and vectors that are null, empty, zero or hold null or non-finite components take no part, nor do vectors of
    another length than the table's most frequent one (the smaller of two). Equal vectors share one entry that keeps their k + 1
    smallest keys, which loses nothing: no query can return more of them. Repeated rows are one row. An empty table gives an
    empty table.
    """
    spark = rows.sparkSession
    clean = materialize(rows.where(F.col(key).isNotNull() & usable(F.col(vector))).select(
        F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), queries.alias("ask")).dropDuplicates(["id", "v"]))
    schema = "query_id long, rank int, vec_id long, score double"
    common = clean.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if common is None:
        return spark.createDataFrame([], schema)
    clean = clean.where(F.size("v") == common["width"])
    # a plain limit per vector, so that each task cuts its share of a hot vector before the shuffle
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    kept = materialize(clean.select("id", "v").withColumn("place", place).where(F.col("place") <= k + 1))
    sample = kept.where("place = 1").select("id", "v").orderBy(F.xxhash64("id"), "id").limit(sample_rows).toPandas()
    stacked = np.stack([np.asarray(v, dtype=float) for v in sample["v"]])
    depth = min(depth, max(0, int(np.log2(len(stacked) / (4 * (k + 1))))) if len(stacked) > 4 * (k + 1) else 0)
    forest = Forest(stacked, trees, depth)
    entries = kept.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    # at most k + 1 keys meet here per vector

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = forest.leaf_of(_vectors(batch.column("v")))
                cells = (leaf + np.arange(trees) * forest.leaves).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids"), batch.column("v"), pa.array(list(cells), pa.list_(pa.int32()))], ["ids", "v", "cells"])

    indexed = materialize(entries.select("ids", "v").mapInArrow(index, "ids array<long>, v array<double>, cells array<int>"))
    sizes = indexed.select(F.explode("cells").alias("cell")).groupBy("cell").count()
    held = {r["cell"]: r["count"] for r in sizes.collect()}  # at most trees * leaves rows
    rows_in = np.array([held.get(c, 0) for c in range(trees * forest.leaves)])
    most = -(-rows_in // part_rows)
    pops = max(1, math.ceil(search_share * np.count_nonzero(most)))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                query = _vectors(batch.column("v").slice(row, 1))[0]
                cells = np.array(forest.search(query, pops, rows_in, trees * (k + 2)))
                cell = np.repeat(cells, most[cells])
                part = np.concatenate([np.arange(most[c]) for c in cells]) if len(cell) else cell
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(batch.column("id")[row].as_py(), len(cell)), pa.int64()),
                    batch.column("v").take(pa.array(np.full(len(cell), row))), pa.array(cell, pa.int32()), pa.array(part, pa.int32())],
                    ["id", "v", "cell", "part"])

    asking = clean.where("ask").select("id", "v")
    blocks = -(-asking.count() // max(1, int(query_rows / search_share)))  # a cell meets about ``query_rows`` queries of a block at a time
    asked = asking.mapInArrow(walk, "id long, v array<double>, cell int, part int").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(blocks, 1))).cast("int"))
    table = spark.createDataFrame([(c, int(most[c])) for c in held], "cell int, parts int")
    dealt = indexed.select("ids", "v", F.explode("cells").alias("cell")).join(F.broadcast(table), "cell")  # at most trees * leaves rows
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("ids"), F.col("parts")).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(max(blocks, 1) - 1))))

    def rank(cell: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _best([], k)
        ids = left.column("ids").to_pylist()
        base, asks = _vectors(left.column("v").combine_chunks()), _vectors(right.column("v").combine_chunks())
        norm = np.einsum("ij,ij->i", base, base)
        out = []
        for row, (query_id, query) in enumerate(zip(right.column("id").to_pylist(), asks, strict=True)):
            rough = norm - 2 * (base @ query)
            near = np.argpartition(rough, k + 1)[:k + 2] if len(rough) > k + 2 else np.arange(len(rough))
            edge = rough[near].max() + 1e-9 * (1 + np.abs(norm).max() + query @ query)
            near = np.flatnonzero(rough <= edge)
            exact = np.sqrt(((base[near] - query) ** 2).sum(axis=1))
            found = sorted((float(d), i) for d, at in zip(exact, near, strict=True) for i in ids[at] if i != query_id)[:k]
            out += [(query_id, i, d) for d, i in found]
        return _best(out, k)

    found = dealt.groupBy("cell", "part", "block").cogroup(asked.groupBy("cell", "part", "block")).applyInArrow(rank, "query_id long, vec_id long, score double")
    single = found.dropDuplicates(["query_id", "vec_id"])
    ranked = single.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best(found: list[tuple[int, int, float]], k: int) -> pa.Table:
    columns = list(zip(*found, strict=True)) if found else [[], [], []]
    return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())],
                    ["query_id", "vec_id", "score"])


def recall(found: DataFrame, truth: DataFrame) -> float:
    """Share of the true (query_id, vec_id) pairs that were found."""
    total = truth.count()
    hits = truth.join(found, ["query_id", "vec_id"], "left_semi").count()
    return hits / total if total else 1.0
