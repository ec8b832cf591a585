"""Best-fit-decreasing packing of token pieces into sequences, exact over the whole corpus at once.

Best fit looks only at remaining capacities, so bins with the same remaining capacity are interchangeable and
pieces of the same length are too. The histogram of piece lengths (at most ``capacity`` rows) therefore fixes
the whole packing: it is computed once, with a segment tree over remaining capacities that finds the tightest
open bin in logarithmic time, and kept as runs of equal placements. Every piece then finds its place from
its rank among the pieces of its length. No task or group holds the pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidra.llm.byte_bpe import encode_text, encoding
from evidra.llm.common import materialize, rebatch, small_batches

CAPACITY, END_ID = 2048, 0
RUN_FIELDS = ("length", "first_rank", "first_bin", "per_bin", "offset")


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity: which of them some open bin has."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.size)

    def mark(self, remaining: int, is_open: bool) -> None:
        node = self.size + remaining
        self.open[node] = is_open
        while node > 1:
            node >>= 1
            self.open[node] = self.open[2 * node] or self.open[2 * node + 1]

    def tightest(self, needed: int) -> int | None:
        """Smallest remaining capacity of an open bin that is at least ``needed``."""
        node = self.size + needed
        if self.open[node]:
            return needed
        while node > 1:
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Runs of placements: the pieces of ``length`` from rank ``first_rank`` on go ``per_bin`` to a bin, to bins
    ``first_bin`` and following, from ``offset`` on. Sorted by length and rank; bins count from 0."""
    tree, free, runs, bins = CapacityTree(capacity), {}, [], 0

    def keep(remaining: int, first: int, count: int) -> None:
        if count and remaining:
            free.setdefault(remaining, []).append((first, count))
            tree.mark(remaining, True)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining = capacity
                first, count = bins, -(-left // (capacity // length))
                bins += count
            else:
                first, count = free[remaining].pop()
                if not free[remaining]:
                    tree.mark(remaining, False)
            fit = remaining // length
            whole = min(count, left // fit)
            if whole:
                runs.append((length, rank, first, fit, capacity - remaining))
                keep(remaining - fit * length, first, whole)
                left, rank, first, count = left - whole * fit, rank + whole * fit, first + whole, count - whole
            if left and left < fit and count:
                runs.append((length, rank, first, left, capacity - remaining))
                keep(remaining - left * length, first, 1)
                left, rank, first, count = 0, rank + left, first + 1, count - 1
            keep(remaining, first, count)
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, len(RUN_FIELDS))
    return {name: table[:, i] for i, name in enumerate(RUN_FIELDS)}


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
           end_id: int = END_ID, keep_ids: bool = False, id_type: str = "<u4") -> DataFrame:
    """Tokenised pieces with the rank of each among the pieces of its length inside its task's block."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    names = ["key", "piece", "start", "length", "ids_crc32", "block", "nth"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, split = encoding(path), regex.compile(public_tokenizers.PATTERN)
        seen, block = np.zeros(capacity + 1, dtype=np.int64), TaskContext.get().partitionId()
        for batch in rebatch(batches, "text"):
            source, piece, start, length, crc, nth, kept = [], [], [], [], [], [], []
            for row, value in enumerate(batch.column("text").to_pylist()):
                ids = np.array([*encode_text(coder, split, value), end_id], dtype="<u4")
                first = len(ids) % capacity or capacity
                at = [0, *range(first, len(ids), capacity)]
                for i, (a, b) in enumerate(zip(at, [*at[1:], len(ids)], strict=True)):
                    source.append(row), piece.append(i), start.append(a), length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes())), nth.append(int(seen[b - a]))
                    seen[b - a] += 1
                    if keep_ids:
                        kept.append(ids[a:b].astype(id_type).tobytes())
            long = lambda x: pa.array(x, pa.int64())
            columns = [batch.column("key").take(long(source)), pa.array(piece, pa.int32()), long(start), long(length), long(crc),
                       long([block] * len(source)), long(nth)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * keep_ids, names)

    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long, block long, nth long" + ", ids binary" * keep_ids
    return rows.mapInArrow(run, schema)


def pack(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
         end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row per piece: key, piece int, start, length, ids_crc32, sequence_id, offset (and ids binary on request).

    A document is its token ids and ``end_id``; longer ones are cut so that all pieces but the first are full.
    A null or empty text is the end id alone; a null key stays; every repeated row is packed for itself; other
    columns of the input are ignored; an empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    staged = materialize(pieces(docs, path or public_tokenizers.path("byte_bpe_50k.json"), key, text, capacity, end_id, keep_ids))
    counted = staged.groupBy("length", "block").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    runs = plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = staged.join(offsets, ["length", "block"]).withColumn("rank", F.col("before") + F.col("nth")).drop("before", "nth", "block")
    columns = ["key", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    names = columns[:5] + ["sequence_id", "offset"] + columns[5:]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.int64(1) << np.int64(44)
        starts = runs["length"] * shift + runs["first_rank"]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(starts, length * shift + rank, side="right") - 1
            step = rank - runs["first_rank"][at]
            bin_, place_ = np.divmod(step, runs["per_bin"][at])
            put = {"sequence_id": pa.array(runs["first_bin"][at] + bin_), "offset": pa.array(runs["offset"][at] + place_ * length)}
            yield pa.RecordBatch.from_arrays([put[n] if n in put else batch.column(n) for n in names], names)

    kind = staged.schema["key"].dataType.simpleString()
    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * keep_ids
    return ranked.mapInArrow(place, schema).withColumnRenamed("key", key)
