"""Near-duplicate vectors by a robust-pruned flat graph.

1. Equal vectors are one entry. A bounded sample gives centroids; centroids within the link radius of each other, directly or over
   others, are one shard, so that a family of near copies keeps together however many centroids fall into it. Every entry joins
   its ``overlap`` nearest shards, and large shards are dealt out in parts of bounded size.
2. Each part builds its own graph: nearest members of every node and the nodes it is nearest to, thinned by robust pruning (a neighbour
   is dropped when a kept one is closer to it than the node is, up to ``alpha``). The adjacency lists of an entry's shards are united.
3. Every two parts of a shard meet in one task and search each other: greedy steps from the part's medoid (and from the asking entry's
   own adjacency list as far as it leads there), then the range expands over all nodes within ``slack`` squared times the radius until
   nothing new is found. Entries with more than ``CROWD`` nodes in that range are compared with the whole part instead.
4. What was found from either end is verified by the cosine of the original vectors in double precision and counts for both ends.

Links whose ends share no shard, or that the graph misses, are lost. The audit compares a fixed number of entries with all others, whatever
their shards, and gives the recall.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import components, local_roots, materialize
from evidra.llm.projection_forest import _vectors, usable

#: Bound of the sample that the centroids come from, and rows wanted per shard and per part of a shard.
SAMPLE_ROWS, SHARD_ROWS, PART_ROWS = 16_384, 2048, 4096
OVERLAP, DEGREE, CANDIDATES, ALPHA, BEAM, SLACK = 3, 24, 48, 1.2, 8, 2.0
#: An entry with more nodes than this in its wide range is compared with the whole part.
CROWD = 64
#: So many entries, chosen by a hash of their ids, are audited.
AUDITED = 1000


def centroids(sample: np.ndarray, count: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Spherical k-means over the sample (unit rows)."""
    random = np.random.default_rng(seed)
    centres = sample[random.permutation(len(sample))[:count]]
    for _ in range(rounds):
        nearest = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-30), centres)
    return centres


def merged(centres: np.ndarray, threshold: float, block: int = 256) -> np.ndarray:
    """Shard of every centroid, 0 and up: centroids whose cosine is at least ``threshold``, directly or over others, have one in common."""
    unit = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-30)
    every = np.arange(len(unit))
    root = every
    for a in range(0, len(unit), block):
        left, right = np.nonzero(unit[a:a + block] @ unit.T >= threshold)
        root = local_roots(len(unit), np.concatenate((every, left + a)), np.concatenate((root, right)))
    return np.unique(root, return_inverse=True)[1]


def nearest_shards(unit: np.ndarray, centres: np.ndarray, shard_of: np.ndarray, overlap: int, block: int = 1024) -> np.ndarray:
    """The ``overlap`` shards with the most similar centroids of every row."""
    order = np.argsort(shard_of, kind="stable")
    starts = np.searchsorted(shard_of[order], np.arange(shard_of.max() + 1))
    out = np.empty((len(unit), overlap), np.int32)
    for a in range(0, len(unit), block):
        near = np.maximum.reduceat(unit[a:a + block] @ centres[order].T, starts, axis=1)
        out[a:a + block] = np.argpartition(-near, overlap - 1, axis=1)[:, :overlap]
    return out


def with_reverse(near: np.ndarray) -> np.ndarray:
    """Candidate lists, each followed by up to as many nodes that have the row in theirs (those that rank it highest)."""
    n, k = near.shape
    source, slot = np.nonzero(near >= 0)
    target = near[source, slot]
    order = np.lexsort((slot, target))
    source, target = source[order], target[order]
    place = np.arange(len(target)) - np.searchsorted(target, target)
    back = np.full((n, k), -1, np.int64)
    back[target[place < k], place[place < k]] = source[place < k]
    return np.concatenate((near, back), axis=1)


def nearest_members(unit: np.ndarray, count: int, block: int = 512) -> np.ndarray:
    """The ``count`` most similar other rows of every row, most similar first; -1 where there are fewer."""
    n = len(unit)
    out = np.full((n, count), -1, np.int64)
    take = min(count, n - 1)
    for a in range(0, n if take > 0 else 0, block):
        near = unit[a:a + block] @ unit.T
        near[np.arange(len(near)), np.arange(a, a + len(near))] = -np.inf
        best = np.argpartition(near, -take, axis=1)[:, -take:]
        order = np.argsort(-np.take_along_axis(near, best, 1), axis=1, kind="stable")
        out[a:a + block, :take] = np.take_along_axis(best, order, 1)
    return out


def robust_prune(unit: np.ndarray, near: np.ndarray, degree: int, alpha: float, block: int = 512) -> np.ndarray:
    """Thins the candidate lists of all nodes together, nearest first; -1 fills rows with fewer than ``degree`` neighbours."""
    kept = np.full((len(near), degree), -1, np.int64)
    for start in range(0, len(near), block):
        lists = near[start:start + block]
        distance = np.where(lists >= 0, 1 - np.einsum("ij,ikj->ik", unit[start:start + block], unit[lists]), np.inf)
        order = np.argsort(distance, axis=1, kind="stable")
        lists, distance = np.take_along_axis(lists, order, 1), np.take_along_axis(distance, order, 1)
        members = unit[lists]
        between = 1 - members @ members.transpose(0, 2, 1)  # distances among the candidates of each node
        filled, alive = np.zeros(len(lists), np.int64), lists >= 0
        for c in range(lists.shape[1]):
            take = np.flatnonzero(alive[:, c] & (filled < degree))
            kept[start + take, filled[take]] = lists[take, c]
            filled[take] += 1
            alive[take] &= alpha * between[take, c] > distance[take]
    return kept


def range_search(unit: np.ndarray, graph: np.ndarray, queries: np.ndarray, entry: np.ndarray, radius: float, slack: float = SLACK,
                 beam: int = BEAM, crowd: int = CROWD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, node) pairs with cosine distance up to ``radius`` that the graph leads to, and the crowded queries.

    Beam search from the entry nodes (one row per query, -1 unused) until the beam stops improving; from then on every node
    within ``slack`` squared times the radius is expanded. A query that meets more than ``crowd`` such nodes stops there: it is
    left to the caller, and its pairs are not whole.
    """
    q, n = len(queries), len(unit)
    seen, last = np.zeros(q * n, bool), np.empty(q * n, np.int32)
    best = np.full((q, beam), np.inf, np.float32)  # distances of every query's beam
    wide = radius * slack * slack
    met = np.zeros(q, np.int64)  # nodes of the wide range
    found = []
    row, slot = np.nonzero(entry >= 0)
    node = entry[row, slot]
    while len(row):
        flat = row * n + node
        flat = flat[~seen[flat]]
        last[flat] = np.arange(len(flat), dtype=np.int32)
        flat = flat[last[flat] == np.arange(len(flat), dtype=np.int32)]  # each pair once
        seen[flat] = True
        row, node = np.divmod(flat, n)
        distance = 1 - _dots(queries, row, unit, node)
        hit = distance <= radius + 1e-6
        found.append((row[hit], node[hit]))
        closer = np.flatnonzero(distance < best[row, -1])
        closer = closer[np.lexsort((distance[closer], row[closer]))]
        owner, starts, counts = np.unique(row[closer], return_index=True, return_counts=True)
        fresh = np.full((len(owner), beam), np.inf, np.float32)
        place = np.arange(len(closer)) - np.repeat(starts, counts)
        fits = place < beam
        fresh[np.repeat(np.arange(len(owner)), counts)[fits], place[fits]] = distance[closer][fits]
        best[owner] = np.sort(np.concatenate((best[owner], fresh), axis=1), axis=1)[:, :beam]
        met += np.bincount(row[distance <= wide], minlength=q)
        go = ((distance <= best[row, -1]) | (distance <= wide)) & (met[row] <= crowd)
        neighbours = graph[node[go]]
        at, slot = np.nonzero(neighbours >= 0)
        row, node = row[go][at], neighbours[at, slot]
    return np.concatenate([r for r, _ in found] or [row]), np.concatenate([v for _, v in found] or [node]), np.flatnonzero(met > crowd)


def _dots(a: np.ndarray, row: np.ndarray, b: np.ndarray, node: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """Products of the paired rows, a bounded number at a time."""
    return np.concatenate([np.einsum("ij,ij->i", a[row[s:s + block]], b[node[s:s + block]]) for s in range(0, len(row), block)]
                          or [np.empty(0, a.dtype)])


def near_duplicates(rows: DataFrame, threshold: float = 0.95, key: str = "vec_id", vector: str = "embedding", overlap: int = OVERLAP,
                    shard_rows: int = SHARD_ROWS, sample_rows: int = SAMPLE_ROWS, part_rows: int = PART_ROWS) -> tuple[DataFrame, DataFrame]:
    """(vectors, audit).

    vectors: one row per input row: key, n_links long (other rows linked directly), component_id long (smallest key reachable),
    kept boolean (key = component_id). Rows are linked when the cosine of their vectors is at least ``threshold``. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing and stand alone; a null key has null component and is not
    kept; repeated rows count as one. Vectors of another length than most of the sample's link with nothing. An empty table gives
    an empty table. audit: one row, true_links and found_links of ``AUDITED`` entries (of all, if there are fewer): how many other entries
    are linked with them when they are compared with all, and how many of these links were found.
    """
    spark = rows.sparkSession
    every = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    clean = every.where(F.col("id").isNotNull() & usable(F.col("v"))).dropDuplicates(["id", "v"])
    entries = materialize(clean.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    sample = entries.select("rep", "v").orderBy(F.xxhash64("rep"), "rep").limit(sample_rows).toPandas()
    single = every.select("id").distinct().select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if not len(sample):
        audit = spark.createDataFrame([(0, 0)], "true_links long, found_links long")
        return _spread(every, single, key), audit
    width = int(sample["v"].map(len).mode()[0])
    total = entries.count()
    count = max(1, min(-(-total // shard_rows), len(sample) // 4))
    stacked = np.stack([np.asarray(v, dtype=float) for v in sample["v"] if len(v) == width])
    centres = centroids(stacked / np.linalg.norm(stacked, axis=1, keepdims=True), count)
    shard_of = merged(centres, threshold)
    overlap = min(overlap, int(shard_of.max()) + 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                shards = nearest_shards(_units(_vectors(batch.column("v"))), centres, shard_of, overlap)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("rep", "copies", "v")], pa.array(list(shards), pa.list_(pa.int32()))],
                                                 ["rep", "copies", "v", "shards"])

    dealt = materialize(entries.where(F.size("v") == width).select("rep", "copies", "v").mapInArrow(
        deal, "rep long, copies long, v array<double>, shards array<int>"))
    members = dealt.select("rep", "copies", "v", "shards", F.explode("shards").alias("shard"))
    parts = members.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(part_rows)).cast("int").alias("parts"))
    placed = members.join(F.broadcast(parts), "shard").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    # ``parts`` has a row per shard, of which there are at most sample_rows / 4

    def build(group: pa.Table) -> pa.Table:
        rep = group.column("rep").to_numpy()
        unit = _units(_vectors(group.column("v").combine_chunks())).astype(np.float32)
        graph = robust_prune(unit, with_reverse(nearest_members(unit, CANDIDATES)), DEGREE, ALPHA)
        lists = [rep[g[g >= 0]].tolist() for g in graph]
        return pa.table([group.column("rep"), pa.array(lists, pa.list_(pa.int64()))], ["rep", "near"])

    built = placed.select("shard", "part", "rep", "v").groupBy("shard", "part").applyInArrow(build, "rep long, near array<long>")
    united = materialize(built.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))  # overlap lists of DEGREE
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    meeting = placed.join(united, "rep").withColumn("other", other).select(
        "shard", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "rep", "copies", "v", "shards", "near")

    def search(group: pa.Table) -> pa.Table:
        """The entries of two parts of a shard (or of one, with itself), each with its adjacency list."""
        shard, low, high = (group.column(c)[0].as_py() for c in ("shard", "low", "high"))
        part = group.column("part").to_numpy()
        first = _Side(group.filter(pa.array(part == low)))
        second = first if low == high else _Side(group.filter(pa.array(part == high)))
        if not len(first.rep) or not len(second.rep):
            return _found([])
        link = _links(first, second, threshold)
        if first is second:
            link |= link.T
            np.fill_diagonal(link, False)
        else:
            link |= _links(second, first, threshold).T
        ends = first.rep if first is second else np.concatenate((first.rep, second.rep))
        every = np.arange(len(ends))
        root = every
        for s in range(0, len(link), 256):
            a, b = np.nonzero(link[s:s + 256])
            root = local_roots(len(ends), np.concatenate((every, a + s)), np.concatenate((root, b + len(ends) - len(second.rep))))
        out = [(int(ends[m]), int(ends[root[m]]), 0, 0) for m in np.flatnonzero(root != every)]
        for earlier in np.intersect1d(first.shards[first.shards < shard], second.shards[second.shards < shard]):  # counted there
            link[np.ix_((first.shards == earlier).any(axis=1), (second.shards == earlier).any(axis=1))] = False
        sides = [(first, link, second)] if first is second else [(first, link, second), (second, link.T, first)]
        for one, linked, another in sides:
            for i in np.flatnonzero(linked.any(axis=1)):
                others = linked[i]
                out.append((int(one.rep[i]), int(one.rep[i]), int(another.copies[others].sum()), int(others.sum())))
        return _found(out)

    met = materialize(meeting.groupBy("shard", "low", "high").applyInArrow(search, "a long, b long, n_links long, pairs long"))
    sums = met.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("n_links").alias("links"))
    names = components(met.where("a <> b").select("a", "b"))
    classes = entries.join(sums, "rep", "left").join(names, F.col("rep") == F.col("node"), "left").select(
        "v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked_rows = clean.join(classes, "v").select(F.col("id").alias(key), "n_links", "component_id")
    asked = sample["rep"][sample["v"].map(len) == width].to_numpy(dtype=np.int64)[:AUDITED]
    asked_units = _units(stacked[:AUDITED])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            true = 0
            for s in range(0, batch.num_rows, 1024):
                block = batch.slice(s, 1024)
                near = _units(_vectors(block.column("v"))) @ asked_units.T >= threshold
                true += int((near & (block.column("rep").to_numpy()[:, None] != asked)).sum())
            yield pa.RecordBatch.from_arrays([pa.array([true], pa.int64())], ["true_links"])

    none = F.lit(0).cast("long")
    true = dealt.select("rep", "v").mapInArrow(compare, "true_links long").withColumn("found_links", none)
    audited = spark.createDataFrame([(int(i),) for i in asked], "a long")
    found = met.where("a = b").join(F.broadcast(audited), "a").select(none.alias("true_links"), F.col("pairs").alias("found_links"))
    audit = true.unionByName(found).agg(*[F.coalesce(F.sum(c), none).alias(c) for c in ("true_links", "found_links")])
    return _spread(every, linked_rows, key), audit


class _Side:
    """Entries of a part with their adjacency lists."""

    def __init__(self, group: pa.Table) -> None:
        self.rep, self.copies = group.column("rep").to_numpy(), group.column("copies").to_numpy()
        if not len(self.rep):
            return
        self.unit = _units(_vectors(group.column("v").combine_chunks()))
        self.low = self.unit.astype(np.float32)
        self.shards = np.array(group.column("shards").to_pylist(), dtype=np.int64)
        self.medoid = int(np.argmax(self.unit @ self.unit.mean(axis=0)))
        self.order = np.argsort(self.rep)
        near = group.column("near").combine_chunks()
        self.owner = np.repeat(np.arange(len(self.rep)), np.diff(near.offsets.to_numpy()))
        self.target = near.values.to_numpy()[near.offsets[0].as_py():near.offsets[-1].as_py()]

    def lists(self, nodes: _Side) -> np.ndarray:
        """The adjacency lists as far as they lead to ``nodes``, as positions there; -1 fills."""
        at = nodes.order[np.minimum(np.searchsorted(nodes.rep, self.target, sorter=nodes.order), len(nodes.rep) - 1)]
        there = nodes.rep[at] == self.target
        owner, at = self.owner[there], at[there]
        fill = np.arange(len(owner)) - np.searchsorted(owner, owner)
        out = np.full((len(self.rep), int(fill.max()) + 1 if len(fill) else 1), -1, np.int64)
        out[owner, fill] = at
        return out


def _links(asking: _Side, nodes: _Side, threshold: float, block: int = 512) -> np.ndarray:
    """Which rows of ``asking`` are linked with which of ``nodes``, as far as the graph of ``nodes`` leads there; verified."""
    link = np.zeros((len(asking.rep), len(nodes.rep)), bool)
    graph, own = nodes.lists(nodes), asking.lists(nodes)
    for s in range(0, len(asking.rep), block):
        entry = np.column_stack((np.full(len(own[s:s + block]), nodes.medoid), own[s:s + block]))
        row, node, crowded = range_search(nodes.low, graph, asking.low[s:s + block], entry, 1 - threshold)
        good = _dots(asking.unit, row + s, nodes.unit, node) >= threshold
        link[row[good] + s, node[good]] = True
        link[crowded + s] = asking.unit[crowded + s] @ nodes.unit.T >= threshold
    return link


def _units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that very large and very small components neither overflow nor vanish."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _found(rows: list[tuple]) -> pa.Table:
    names = ["a", "b", "n_links", "pairs"]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.table([pa.array(list(c), pa.int64()) for c in columns], names)


def _spread(every: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Results for every input row; rows without one stand alone."""
    known = known.withColumnRenamed(key, "_id").dropDuplicates(["_id"])
    joined = every.select("id").join(known, F.col("id") == F.col("_id"), "left")
    component = F.coalesce("component_id", "id")
    return joined.select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
