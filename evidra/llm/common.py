"""What the training-data operators share: staging, packed exchanges and connected components.

Packed exchange: where an operator deals out tens of small records per kilobyte of text, a map task groups
its records by destination bucket and hands Spark one binary row per (bucket, flush) instead of one row per
record. Spark still partitions, shuffles and retries; only the rows are coarser.
"""

from __future__ import annotations

import contextlib
import ctypes
import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.session import materialize, prepare, release  # noqa: F401 - release: for the operators

ARROW_BYTES = 8 << 20


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_count(spark: SparkSession) -> int:
    """Buckets of packed exchanges: follow the cluster's shuffle partitions; odd, so that ids in even steps spread."""
    return shuffle_partitions(spark) | 1


def hash_bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64)


def doc_bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket that ``bucket_of`` gives a document on the Spark side."""
    return np.mod(doc ^ (doc >> 9) ^ (doc >> 21), buckets)


def bucket_of(doc: Column, buckets: int) -> Column:
    return F.pmod(doc.bitwiseXOR(F.shiftright(doc, 9)).bitwiseXOR(F.shiftright(doc, 21)), F.lit(buckets))


def unpacked(table: pa.Table, name: str, dtype: type) -> np.ndarray:
    """All records of a packed column; a side of a cogroup without rows may come without columns."""
    return np.frombuffer(b"".join(table.column(name).to_pylist()) if name in table.column_names else b"", dtype=dtype)


def to_planes(values: np.ndarray) -> bytes:
    """Differences byte plane by byte plane: slowly changing numbers leave runs of zeros for the shuffle's compression."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    return steps.view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()


def from_planes(table: pa.Table, name: str, dtype: type) -> np.ndarray:
    parts = []
    for packed in table.column(name).to_pylist() if name in table.column_names else []:
        planes = np.frombuffer(packed, np.uint8).reshape(np.dtype(dtype).itemsize, -1)
        parts.append(np.cumsum(np.ascontiguousarray(planes.T).view(dtype).ravel(), dtype=dtype))
    return np.concatenate(parts) if parts else np.empty(0, dtype)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser over unsigned 64-bit values (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def small_batches(spark: SparkSession) -> None:
    """Whole texts travel in Arrow batches of a few megabytes instead of ten thousand rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def tidy() -> None:
    """Gives freed memory of a worker back to the machine: workers stay alive between tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(AttributeError):  # other C libraries have no such call
            ctypes.CDLL(None).malloc_trim(0)


def rebatch(batches: Iterable[pa.RecordBatch], text: str, limit: int = ARROW_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``text`` column holds about ``limit`` bytes (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.array([len(v) if v is not None else 0 for v in batch.column(text).cast(pa.large_binary()).to_pylist()]) \
            if batch.column(text).nbytes > limit else None
        if sizes is None:
            yield batch
            continue
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        yield batch.slice(start)
    tidy()


def text_slices(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets); null texts count as empty."""
    filled = column.fill_null("") if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.fill_null(b"")
    blobs = filled.cast(pa.large_binary())
    offsets = np.frombuffer(blobs.buffers()[1], dtype=np.int64)[blobs.offset:blobs.offset + len(blobs) + 1]
    data = np.frombuffer(blobs.buffers()[2], dtype=np.uint8) if blobs.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def pack_by_bucket(bucket: np.ndarray, columns: list[np.ndarray], planes: tuple[int, ...] = ()) -> Iterator[tuple[int, list[bytes]]]:
    """One (bucket, packed columns) per bucket present; records keep their order inside a bucket. The columns
    whose positions are in ``planes`` are packed by ``to_planes``."""
    if len(bucket) == 0:
        return
    order = np.argsort(bucket, kind="stable")
    sorted_bucket = bucket[order]
    cuts = np.flatnonzero(np.diff(sorted_bucket)) + 1
    starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(order)]))
    moved = [np.ascontiguousarray(c[order]) for c in columns]
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        yield int(sorted_bucket[a]), [to_planes(c[a:b]) if i in planes else c[a:b].tobytes() for i, c in enumerate(moved)]


def numbered_rows(block: int, first: int, count: int) -> np.ndarray:
    """Numbers of ``count`` rows of a task's block, from its row ``first`` on; staged rows keep them for good."""
    return (np.int64(block) << np.int64(40)) + np.arange(first, first + count, dtype=np.int64)


def join_split_hot(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int, share: int = 1000) -> DataFrame:
    """``rows`` joined with ``table``, which has one row per key and in ``weight`` the number of its rows among the ``total`` rows.

    Keys that hold more than one row in ``share`` are fewer than ``share``, so their part of the table is broadcast and
    their rows stay where they are; the rest is shuffled, and none of its keys is heavy. Both inputs are read twice: stage them first.
    """
    heavy = F.col(weight) * share > max(total, share)
    hot, cold = F.broadcast(table.where(heavy)), table.where(~heavy)
    near = rows.join(hot, keys)
    far = rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys)
    prepare(rows.sparkSession)
    return near.unionByName(far)


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index reachable from every index 0..n-1 over the given links (inside one task)."""
    root = np.arange(n, dtype=np.int64)
    while len(left):
        a, b = root[left], root[right]
        low, high = np.minimum(a, b), np.maximum(a, b)
        open_ = low != high
        if not open_.any():
            break
        left, right = left[open_], right[open_]
        np.minimum.at(root, high[open_], low[open_])
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped
    return root


def components(edges: DataFrame, a: str = "a", b: str = "b", stage: Callable[[DataFrame], DataFrame] = materialize) -> DataFrame:
    """(node, component): component is the smallest node reachable; nodes without an edge are absent.

    Alternates large-star and small-star steps (every node is linked to the smallest node of its
    neighbourhood), so each round is two aggregations over at most as many rows as there are edges, and the
    number of rounds is logarithmic. Every round is staged, which cuts lineage. Self-links and repeated
    links are harmless; links with a null end are ignored.
    """
    prepare(edges.sparkSession)
    current = stage(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = low.where(F.col("m") == F.col("u")).select("u", F.col("m").alias("v"))
        starred = stage(large.unionByName(kept).distinct())
        down = starred.where(F.col("v") <= F.col("u"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))).distinct()
        following = stage(small)
        changed = following.join(current, ["u", "v"], "left_anti").limit(1).count() or \
            current.join(following, ["u", "v"], "left_anti").limit(1).count()
        current = following
        if not changed:
            break
    return current.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
