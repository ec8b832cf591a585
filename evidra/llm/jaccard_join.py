"""Exact similarity join on word n-grams with adaptive multi-match prefixes.

1. Every text becomes a set of hashed shingles. Equal sets are one class; a fixed-size sketch of shingle counts over all
   texts gives a global order, rare shingles first.
2. Two sets that reach the threshold share at least l shingles of their l-prefixes (the first
   n - ceil(t n) + l in that order), for every l. Prefixes up to l = ``MAX_MATCHES`` meet by shingle; the document frequency of
   every prefix shingle goes back to its document, which picks the l with the least estimated cost (postings read plus
   candidates to verify) and from then on asks for l common prefix shingles.
3. Inside a shingle's posting list, pairs are pruned by size and by an exact bound from parity bitmaps (their Hamming
   distance never exceeds the symmetric difference). Short lists give pairs, which are counted; long lists, as in
   large groups of near copies, give one edge per member instead of all pairs.
4. Candidates connected by such edges are a family. Families are verified on their full sets, in blocks of
   bounded size, and only a spanning set of true links leaves a task. Components of the links are the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import (
    bucket_count, bucket_of, components, doc_bucket, hash_bucket, local_roots, materialize, mix64, pack_by_bucket, rebatch, release,
    small_batches, tidy, unpacked,
)

MAX_MATCHES, SKETCH_BITS, BITMAP_BITS = 4, 18, 1024
#: Sets above this size fill their parity bitmap; they also carry so many one-byte counts, whose L1 distance is a bound too.
LARGE_SET, COUNT_CELLS = 1500, 512
#: Postings up to this length give pairs, longer ones a spanning set of candidate edges.
SHORT_LIST = 8
#: Relative cost of verifying a candidate against reading a posting.
VERIFY_COST = 8.0
#: Families up to this size are verified whole; larger ones by bands of set size that can reach each other, and in
#: blocks of so many documents and about so many shingles inside a band.
WHOLE_FAMILY, BLOCK, BLOCK_SHINGLES = 256, 1024, 400_000


def shingle_rows(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every shingle of the texts, with repeats: ``words`` consecutive words, or all of a shorter text."""
    split = [t.encode().lower().split() for t in texts]
    counts = np.array([len(s) for s in split], dtype=np.int64)
    flat = np.fromiter((xxhash.xxh3_64_intdigest(w) for s in split for w in s), np.uint64, int(counts.sum()))
    row = np.repeat(np.arange(len(texts)), counts)
    hashes = np.zeros(len(flat), np.uint64)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(flat))  # words from here to the end of the text
    with np.errstate(over="ignore"):
        for i in range(words):
            there = left > i
            shifted = np.zeros(len(flat), np.uint64)
            shifted[:len(flat) - i] = flat[i:]
            hashes = np.where(there, mix64(hashes * np.uint64(3) + shifted + np.uint64(1)), hashes)
    first = np.repeat(np.cumsum(counts) - counts, counts) == np.arange(len(flat))
    use = (left >= words) | (first & (left < words))
    return row[use], hashes[use]


def shingle_sets(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all sets, offsets): each text's distinct shingles in ascending order."""
    row, hashes = shingle_rows(texts, words)
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.concatenate(([0], np.cumsum(np.bincount(row[new], minlength=len(texts)))))


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of a set of n with any set that reaches the threshold."""
    return (percent * n + 99) // 100


def _levels(spark_rows: DataFrame, words: int) -> np.ndarray:
    """Order class of every sketch cell: 0 up to the mean count, one more for every doubling."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in rebatch(batches, "text"):
            _, hashes = shingle_rows(batch.column("text").to_pylist(), words)
            cells += np.bincount((hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(cells))
        used = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(cells[used])], ["cell", "n"])

    counted = spark_rows.select("text").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    cells = np.zeros(1 << SKETCH_BITS)
    found = counted.toPandas()  # a fixed number of cells, whatever the corpus
    cells[found["cell"].to_numpy()] = found["n"].to_numpy()
    mean = max(cells.mean(), 1.0)
    return np.floor(np.log2(np.maximum(cells / mean, 1))).astype(np.uint8)


def prefixes(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """doc, n, digest, prefix (packed hashes, rare first, up to the longest prefix), bitmap of every text."""
    levels = _levels(rows, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatch(batches, "text"):
            hashes, offsets = shingle_sets(batch.column("text").to_pylist(), words)
            n = np.diff(offsets)
            level = levels[(hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
            digest, prefix, bitmap = [], [], []
            length = np.minimum(n, n - needed(n, percent) + MAX_MATCHES)
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                own = hashes[a:b]
                digest.append(xxhash.xxh3_128_digest(own.tobytes()))
                prefix.append(own[np.argsort(level[a:b], kind="stable")[:length[i]]].tobytes())
                bits = np.bincount((own & np.uint64(BITMAP_BITS - 1)).astype(np.int64), minlength=BITMAP_BITS) & 1
                large = np.bincount(((own >> np.uint64(16)) % np.uint64(COUNT_CELLS)).astype(np.int64), minlength=COUNT_CELLS) \
                    if len(own) > LARGE_SET else np.empty(0)
                bitmap.append(np.packbits(bits.astype(np.uint8)).tobytes() + large.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(n, pa.int64()), *[pa.array(x, pa.binary()) for x in (digest, prefix, bitmap)]],
                ["doc", "n", "digest", "prefix", "bitmap"])

    return rows.mapInArrow(run, "doc long, n long, digest binary, prefix binary, bitmap binary")


PACKED = "bucket long, a binary, b binary, c binary, d binary, e binary, f binary, g binary"
_SCHEMA = pa.schema([("bucket", pa.int64()), *[(c, pa.binary()) for c in "abcdefg"]])


def _table(bucket: np.ndarray, columns: list[np.ndarray]) -> pa.Table:
    rows = list(pack_by_bucket(bucket, columns))
    cols = [[r[1][i] if i < len(r[1]) else b"" for r in rows] for i in range(7)]
    return pa.table([pa.array([r[0] for r in rows], pa.int64()), *[pa.array(c, pa.binary()) for c in cols]], schema=_SCHEMA)


def _add_counts(table: pa.Table, bucket: np.ndarray, large: np.ndarray, counts: np.ndarray) -> pa.Table:
    """Fills column g with the counts of the large sets' records only."""
    packed = {b: c[0] for b, c in pack_by_bucket(bucket[large], [counts])}
    column = pa.array([packed.get(b, b"") for b in table.column("bucket").to_pylist()], pa.binary())
    return table.set_column(table.column_names.index("g"), "g", column)


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of the runs of equal keys."""
    if not len(sorted_keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.concatenate(([0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1))
    return starts, np.diff(np.append(starts, len(sorted_keys)))


def candidate_edges(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) edges between documents of ``sets`` (doc, n, prefix, bitmap; one row per class) that may be linked; every
    pair at the threshold is connected through them."""
    buckets = bucket_count(sets.sparkSession)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatch(batches, "prefix"):
            n = batch.column("n").to_numpy()
            size = np.array([len(p) // 8 for p in batch.column("prefix").to_pylist()], dtype=np.int64)
            token = np.frombuffer(b"".join(batch.column("prefix").to_pylist()), np.uint64)
            row = np.repeat(np.arange(len(n)), size)
            position = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            level = np.maximum(1, position - (n - needed(n, percent))[row] + 1).astype(np.uint8)
            table = _table(hash_bucket(token, buckets), [token, batch.column("doc").to_numpy()[row], level])
            yield from table.to_batches()

    def frequencies(group: pa.Table) -> pa.Table:
        token, doc, level = unpacked(group, "a", np.uint64), unpacked(group, "b", np.int64), unpacked(group, "c", np.uint8)
        order = np.argsort(token, kind="stable")
        _, length = _runs(token[order])
        df = np.empty(len(token), np.int32)
        df[order] = np.repeat(length, length)
        shared = df > 1
        return _table(doc_bucket(doc[shared], buckets), [doc[shared], token[shared], level[shared], df[shared]])

    postings = sets.select("doc", "n", "prefix").mapInArrow(post, PACKED)
    answered = postings.groupBy("bucket").applyInArrow(frequencies, PACKED)

    def adapt(left: pa.Table, right: pa.Table) -> pa.Table:
        """Each document picks its number of matches; its postings up to it go back with size and bitmap."""
        if not left.num_rows or not right.num_rows:
            return _SCHEMA.empty_table()
        ids, n = left.column("doc").to_numpy(), left.column("n").to_numpy()
        held = left.column("bitmap").to_pylist()
        bitmaps = np.frombuffer(b"".join(h[:BITMAP_BITS // 8] for h in held), np.uint8).reshape(len(ids), -1)
        large_at = np.cumsum(n > LARGE_SET) - 1
        counts = np.frombuffer(b"".join(h[BITMAP_BITS // 8:] for h in held), np.uint8).reshape(-1, COUNT_CELLS)
        order = np.argsort(ids)
        doc, token = unpacked(right, "a", np.int64), unpacked(right, "b", np.uint64)
        level, df = unpacked(right, "c", np.uint8), unpacked(right, "d", np.int32)
        at = order[np.searchsorted(ids, doc, sorter=order)]
        cost = np.full((MAX_MATCHES, len(ids)), np.inf)
        read = np.zeros(len(ids))
        for matches in range(1, MAX_MATCHES + 1):
            here = level == matches
            read = read + np.bincount(at[here], (df[here] - 1).astype(float), len(ids))
            possible = matches <= np.maximum(needed(n, percent), 1)
            cost[matches - 1] = np.where(possible, read * (1 + VERIFY_COST / matches), np.inf)
        best = (np.argmin(cost, axis=0) + 1).astype(np.uint8)
        keep = level <= best[at]
        at, token, level = at[keep], token[keep], level[keep]
        bucket, large = hash_bucket(token, buckets), np.flatnonzero(n[at] > LARGE_SET)
        table = _table(bucket, [token, ids[at], n[at].astype(np.int32), level, best[at], bitmaps[at]])
        return _add_counts(table, bucket, large, counts[large_at[at[large]]])

    placed = sets.select("doc", "n", "bitmap").withColumn("bucket", bucket_of(F.col("doc"), buckets))
    adapted = placed.groupBy("bucket").cogroup(answered.groupBy("bucket")).applyInArrow(adapt, PACKED)

    def meet(group: pa.Table) -> pa.Table:
        token, doc, n = unpacked(group, "a", np.uint64), unpacked(group, "b", np.int64), unpacked(group, "c", np.int32)
        level, best = unpacked(group, "d", np.uint8), unpacked(group, "e", np.uint8)
        bounds = Bounds(n, unpacked(group, "f", np.uint64).reshape(len(doc), BITMAP_BITS // 64), unpacked(group, "g", np.uint8), percent)
        order = np.argsort(token, kind="stable")
        starts, lengths = _runs(token[order])
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for size in range(2, SHORT_LIST + 1):
            lists = order[starts[lengths == size][:, None] + np.arange(size)]
            i, j = np.triu_indices(size, 1)
            left, right = lists[:, i].ravel(), lists[:, j].ravel()
            for at in range(0, len(left), 1 << 18):
                a, b = left[at:at + (1 << 18)], right[at:at + (1 << 18)]
                need = np.minimum(best[a], best[b])
                asked = np.maximum(level[a], level[b]) <= need
                a, b, need = a[asked], b[asked], need[asked]
                fine = bounds.may_link(a, b)
                out.append((doc[a[fine]], doc[b[fine]], need[fine]))
        for start, length in zip(starts[lengths > SHORT_LIST].tolist(), lengths[lengths > SHORT_LIST].tolist(), strict=True):
            own = order[start:start + length]
            root = bounds.span(own)
            moved = np.flatnonzero(root != np.arange(length))
            out.append((doc[own[moved]], doc[own[root[moved]]], np.zeros(len(moved), np.uint8)))
        tidy()
        a, b, need = (np.concatenate([o[i] for o in out]) if out else np.empty(0, np.int64) for i in range(3))
        return pa.table([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64()), pa.array(need.astype(np.int32))], ["a", "b", "need"])

    met = adapted.groupBy("bucket").applyInArrow(meet, "a long, b long, need int")
    counted = met.groupBy("a", "b").agg(F.count("*").alias("matches"), F.min("need").alias("need"))
    return counted.where(F.col("matches") >= F.col("need")).select("a", "b")


class Bounds:
    """What rules out a link between two records without their sets: sizes, parity bitmaps, counts of large sets."""

    def __init__(self, n: np.ndarray, bitmap: np.ndarray, counts: np.ndarray, percent: int) -> None:
        self.n, self.bitmap, self.percent = n.astype(np.int64), bitmap, percent
        self.large = np.cumsum(n > LARGE_SET) - 1
        self.counts = counts.reshape(-1, COUNT_CELLS)

    def may_link(self, a: np.ndarray, b: np.ndarray, bits: bool = True) -> np.ndarray:
        """False only where the threshold is out of reach."""
        n, m = self.n[a], self.n[b]
        fine = 100 * np.minimum(n, m) >= self.percent * np.maximum(n, m)
        total = n + m
        room = total - 2 * -(-self.percent * total // (100 + self.percent))  # largest symmetric difference of a link
        if bits:
            fine &= np.bitwise_count(self.bitmap[a] ^ self.bitmap[b]).sum(axis=-1, dtype=np.int64) <= room
        both = np.flatnonzero(fine & (np.minimum(n, m) > LARGE_SET))
        for at in range(0, len(both), 1 << 14):
            part = both[at:at + (1 << 14)]
            step = self.counts[self.large[a[part]]] - self.counts[self.large[b[part]]]  # modulo 256: never more than the true distance
            fine[part] = np.minimum(step, 0 - step).sum(axis=-1, dtype=np.int64) <= room[part]
        return fine

    def span(self, own: np.ndarray, block: int = 256) -> np.ndarray:
        """Root (a position in ``own``) of every record of a long posting list over the pairs that may link; the list is compared
        with itself in blocks, and only pairs whose roots still differ are looked at further."""
        own_order = np.argsort(self.n[own], kind="stable")
        own = own[own_order]
        n, bitmap, root = self.n[own], self.bitmap[own], np.arange(len(own))
        for a in range(0, len(own), block):
            b = min(a + block, len(own))
            stop = int(np.searchsorted(n * self.percent, 100 * int(n[b - 1]) + 1))  # larger sets than these are out of reach
            for c in range(a, stop, 4096):
                d = min(c + 4096, stop)
                total = n[a:b, None] + n[None, c:d]
                room = total - 2 * -(-self.percent * total // (100 + self.percent))
                near = np.bitwise_count(bitmap[a:b, None] ^ bitmap[None, c:d]).sum(axis=-1, dtype=np.int64) <= room
                i, j = np.nonzero(near & (root[a:b, None] != root[None, c:d]))
                fine = self.may_link(own[i + a], own[j + c], bits=False)
                if fine.any():
                    root = root[local_roots(len(own), root[i[fine] + a], root[j[fine] + c])]
        back = np.empty(len(own), np.int64)
        back[own_order] = own_order[root]
        return back


def linked(sets: list[np.ndarray], others: list[np.ndarray] | None, percent: int, chunk: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """(left, right) indices of the pairs that reach the threshold: within ``sets``, or between it and ``others``."""
    both = sets + (others or [])
    size = np.array([len(s) for s in both], dtype=np.int64)
    token, owner = np.concatenate(both), np.repeat(np.arange(len(both)), size)
    order = np.argsort(token, kind="stable")
    starts, lengths = _runs(token[order])
    wide = np.repeat(lengths > 1, lengths)
    owner = owner[order][wide]
    column = np.repeat(np.arange((lengths > 1).sum()), lengths[lengths > 1])
    first = len(sets) if others is not None else 0
    overlap = np.zeros((len(sets), len(both) - first), np.float32)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, chunk):
        a, b = np.searchsorted(column, [c, c + chunk])
        dense = np.zeros((len(both), min(chunk, int(column[-1]) + 1 - c)), np.float32)
        dense[owner[a:b], column[a:b] - c] = 1
        overlap += dense[:len(sets)] @ dense[first:].T
    common = np.rint(overlap).astype(np.int64)
    union = size[:len(sets), None] + size[None, first:] - common
    i, j = np.nonzero((100 * common >= percent * union) & (common > 0))
    keep = i < j if others is None else np.ones(len(i), bool)
    return i[keep], j[keep]


def true_links(rows: DataFrame, families: DataFrame, sizes: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b) spanning links of each family: ``rows`` (doc, text) joined with ``families`` (node, component); ``sizes``
    has the number of shingles n of each doc."""
    buckets = bucket_count(rows.sparkSession)
    sized = families.join(sizes.select(F.col("doc").alias("node"), "n"), "node")
    counts = sized.groupBy("component").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    whole = (F.col("members") <= WHOLE_FAMILY) & (F.col("shingles") <= BLOCK_SHINGLES)
    width = math.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1e-9
    band = F.floor(F.log("n") / F.lit(width)).cast("long")  # linked sets lie in one band or in two neighbours
    units = sized.join(counts, "component").select(
        F.col("node").alias("doc"), "component", "n",
        F.explode(F.when(whole, F.array(F.lit(-1).cast("long"))).otherwise(F.array(band, band + 1))).alias("band"))
    blocks = units.groupBy("component", "band").agg(F.greatest(
        F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("int").alias("all_blocks")).select(
        "component", "band", F.when(F.col("band") < 0, F.lit(1)).otherwise(F.col("all_blocks")).alias("blocks"))
    placed = units.join(blocks, ["component", "band"]).groupBy("doc").agg(
        F.first("component").alias("component"), F.collect_list(F.struct("band", "blocks")).alias("units"))  # two at most

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatch(batches, "text"):
            hashes, offsets = shingle_sets(batch.column("text").to_pylist(), words)
            packed = [hashes[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc", "component", "units")], pa.array(packed, pa.binary())],
                                             ["doc", "component", "units", "set"])

    sets = rows.join(placed, "doc").dropDuplicates(["doc"]).select("doc", "component", "units", "text").mapInArrow(
        to_sets, "doc long, component long, units array<struct<band:long,blocks:int>>, set binary")
    at = sets.select("doc", "component", "set", F.explode("units").alias("u")).select("doc", "component", "set", "u.band", "u.blocks")
    own = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")
    gridded = at.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "doc", "component", "set", "own", "band",
        F.when(F.col("band") < 0, bucket_of(F.col("component"), buckets)).otherwise(F.col("component")).alias("unit"),
        F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def verify(group: pa.Table) -> pa.Table:
        doc, family = group.column("doc").to_numpy(), group.column("component").to_numpy()
        mine, i, j = group.column("own").to_numpy(), group.column("i").to_numpy(), group.column("j").to_numpy()
        sets = [np.frombuffer(b, np.uint64) for b in group.column("set").to_pylist()]
        left, right = [], []
        order = np.lexsort((doc, family))
        starts, lengths = _runs(family[order])
        for start, length in zip(starts.tolist(), lengths.tolist(), strict=True):
            own = order[start:start + length]
            if i[own[0]] == j[own[0]]:
                a, b = linked([sets[k] for k in own], None, percent)
                pair = own[a], own[b]
            else:
                first, second = own[mine[own] == i[own[0]]], own[mine[own] == j[own[0]]]
                if not len(first) or not len(second):
                    continue
                a, b = linked([sets[k] for k in first], [sets[k] for k in second], percent)
                pair = first[a], second[b]
            root = local_roots(len(doc), *pair)
            members = np.unique(np.concatenate(pair))
            moved = members[root[members] != members]
            left.append(doc[moved])
            right.append(doc[root[moved]])
        tidy()
        empty = np.empty(0, np.int64)
        return pa.table([pa.array(np.concatenate([empty, *left]), pa.int64()), pa.array(np.concatenate([empty, *right]), pa.int64())], ["a", "b"])

    return gridded.groupBy("band", "unit", "i", "j").applyInArrow(verify, "a long, b long")


def similarity_components(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, n_shingles long, component_id long.

    Texts are split at ASCII white space with A-Z lower-cased; a set holds the distinct runs of ``words`` words, or the whole text
    if it is shorter. Two documents are linked when 100 * overlap >= percent * union. ``component_id`` is the smallest key
    reachable over links; texts without words (null, empty, blank) have 0 shingles and stand alone. Keys are integers; a row
    with a null key links with nothing and has a null component. Rows that repeat a key are one document and have to repeat
    its text. Other columns of the input are ignored; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    staged = materialize(prefixes(rows, words, percent))
    usable = staged.where(F.col("doc").isNotNull() & (F.col("n") > 0))
    classes = materialize(usable.groupBy("digest").agg(F.min("doc").alias("rep")))
    sets = staged.join(classes.select(F.col("digest"), F.col("rep").alias("doc")), ["digest", "doc"], "left_semi").dropDuplicates(["doc"])
    sets = materialize(sets.drop("digest"))
    edges = materialize(candidate_edges(sets, percent))
    release(spark)
    families = components(edges)
    links = materialize(true_links(rows.where(F.col("doc").isNotNull()), families, sets, words, percent))
    release(spark)
    found = components(links)
    named = classes.join(found, classes["rep"] == found["node"], "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    return staged.select("doc", "n", "digest").join(named, "digest", "left").select(
        F.col("doc").alias(key), F.col("n").alias("n_shingles"),
        F.when((F.col("n") > 0) & F.col("doc").isNotNull(), F.col("component_id")).otherwise(F.col("doc")).alias("component_id"))
