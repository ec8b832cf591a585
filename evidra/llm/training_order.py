"""Training-order materialisation: a keyed permutation gives every sequence a global slot, shards have fixed-stride records.

A Feistel network over the smallest even number of bits that holds n, with cycle-walking for values outside, permutes 0..n-1
without a sort or a shared state. Sequences are dealt out by shard, sorted by slot and written by Spark's text writer as raw
records of one length: a shard is one file, record i of the training order lies at byte (i % shard_rows) * stride of shard
i // shard_rows, and reading starts anywhere by a seek.

A record is the number of tokens (four bytes), the ids, padding, and the writer's line end as the last byte. All numbers are
little-endian. Records are found by position, so a line end among the ids does no harm.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidra.llm.byte_bpe import encode_text, encoding
from evidra.llm.common import mix64, rebatch, release, small_batches, tidy
from evidra.session import broadcast_if_small, materialize

ROUNDS, STRIDE_TOKENS, SHARD_ROWS = 6, 2048, 4096
#: Parts in which the shards are written; only one part's records are in the shuffle at a time.
WRITE_PARTS = 4
HEAD_BYTES, END = 4, b"\n"
#: Text tokenised at a time.
TEXT_BYTES = 2 << 20


@dataclass(frozen=True)
class Layout:
    """Shape of the shards: tokens of a record, bytes of an id, records of a shard."""

    stride: int = STRIDE_TOKENS
    id_bytes: int = 2
    shard_rows: int = SHARD_ROWS

    @property
    def record_bytes(self) -> int:
        return HEAD_BYTES + self.stride * self.id_bytes + len(END)

    def place(self, slot: int) -> tuple[int, int]:
        """(shard, byte offset) of a slot."""
        return slot // self.shard_rows, slot % self.shard_rows * self.record_bytes


def _halves(n: int) -> int:
    return max(1, -(-max(n - 1, 1).bit_length() // 2))


def slots(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Slot of every index 0..n-1: a permutation fixed by ``key``."""
    half = np.uint64(_halves(n))
    mask = np.uint64((1 << int(half)) - 1)
    keys = mix64(np.arange(1, ROUNDS + 1, dtype=np.uint64) + mix64(np.array([key & (2**64 - 1)], dtype=np.uint64)))
    out, open_ = index.astype(np.uint64), np.arange(len(index))
    while len(open_):
        left, right = out[open_] >> half, out[open_] & mask
        for k in keys:
            left, right = right, left ^ (mix64(right + k) & mask)
        out[open_] = (left << half) | right
        open_ = open_[out[open_] >= np.uint64(n)]
    return out.astype(np.int64)


def token_sequences(docs: DataFrame, path: str, text: str = "text", layout: Layout = Layout(), end_id: int = 0) -> DataFrame:
    """ids binary: the token stream of the documents, each followed by ``end_id``, in sequences of ``stride`` tokens.

    The stream runs over the documents of one task of the input, so only the last sequence of a task is shorter and nothing
    is lost to padding. Null and empty texts are the end id alone; other columns are ignored; an empty table gives none.
    """
    small_batches(docs.sparkSession)
    kind, stride = f"<u{layout.id_bytes}", layout.stride

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, split = encoding(path), regex.compile(public_tokenizers.PATTERN)
        if coder.max_token_value >= 1 << 8 * layout.id_bytes:
            raise ValueError("token ids do not fit")
        rest = np.empty(0, kind)
        for batch in rebatch(batches, "text", TEXT_BYTES):
            parts = [np.array([*encode_text(coder, split, t), end_id], kind) for t in batch.column("text").to_pylist()]
            held = np.concatenate([rest, *parts])
            whole = len(held) - len(held) % stride
            rest = held[whole:].copy()
            if whole:
                yield pa.RecordBatch.from_arrays([pa.array([s.tobytes() for s in held[:whole].reshape(-1, stride)], pa.binary())], ["ids"])
        if len(rest):
            yield pa.RecordBatch.from_arrays([pa.array([rest.tobytes()], pa.binary())], ["ids"])

    return docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, "ids binary")


def numbered(sequences: DataFrame) -> tuple[DataFrame, int]:
    """(sequences with ``index`` 0..n-1, n). Task-local numbers plus the counts of the tasks before; the numbers are staged, so a
    task that runs again cannot change them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, block = 0, TaskContext.get().partitionId()
        for batch in batches:
            numbers = pa.array(np.arange(done, done + batch.num_rows))
            done += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, block, np.int64)), numbers],
                                             [*batch.schema.names, "_block", "_nth"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in sequences.schema.fields], "_block long", "_nth long"])
    staged = materialize(sequences.mapInArrow(count, schema), compression="zstd")
    sizes = staged.groupBy("_block").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    starts = broadcast_if_small(materialize(sizes.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))))
    total = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    return staged.join(starts, "_block").withColumn("index", F.col("_start") + F.col("_nth")).drop("_block", "_nth", "_start"), int(total)


@dataclass(frozen=True)
class TrainingOrder:
    """Numbered sequences (staged) and the key that orders them."""

    rows: DataFrame
    n: int
    key: int
    layout: Layout
    pad: int

    @property
    def shards(self) -> int:
        return -(-self.n // self.layout.shard_rows)

    def records(self, first_shard: int = 0, end_shard: int | None = None) -> DataFrame:
        """slot, shard, offset long, length int (tokens), record binary, of the shards from ``first_shard`` to before ``end_shard``."""
        n, key, layout, pad = self.n, self.key, self.layout, self.pad
        wide, width, end = layout.stride * layout.id_bytes, layout.id_bytes, self.shards if end_shard is None else end_shard

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fill = pad.to_bytes(width, "little")
            for batch in batches:
                slot = slots(batch.column("index").to_numpy(), n, key)
                here = np.flatnonzero((slot // layout.shard_rows >= first_shard) & (slot // layout.shard_rows < end))
                slot, packed = slot[here], batch.column("ids").take(pa.array(here)).to_pylist()
                if any(len(p) > wide or len(p) % width for p in packed):
                    raise ValueError(f"a sequence is longer than {layout.stride} tokens, or ends inside an id")
                records = [(len(p) // width).to_bytes(HEAD_BYTES, "little") + p + fill * ((wide - len(p)) // width) for p in packed]
                yield pa.RecordBatch.from_arrays([
                    pa.array(slot), pa.array(slot // layout.shard_rows), pa.array(slot % layout.shard_rows * layout.record_bytes),
                    pa.array([len(p) // width for p in packed], pa.int32()), pa.array(records, pa.binary())],
                    ["slot", "shard", "offset", "length", "record"])

        return self.rows.select("index", "ids").mapInArrow(place, "slot long, shard long, offset long, length int, record binary")


def ordered(sequences: DataFrame, key: int, layout: Layout = Layout(), ids: str = "ids", pad: int = 0) -> TrainingOrder:
    """Every row of ``sequences`` with its global slot.

    ``ids`` holds packed ids of at most ``stride`` tokens; shorter records are filled with ``pad``, null ones are all padding, longer ones
    are refused. Every repeated row is a sequence of its own; other columns are ignored; an empty table has no slot.
    """
    small_batches(sequences.sparkSession)
    rows, n = numbered(sequences.select(F.coalesce(F.col(ids), F.lit(b"")).alias("ids")))
    return TrainingOrder(rows, n, key, layout, pad)


def write_shards(order: TrainingOrder, folder: str, shards_per_task: int = 1, parts: int = WRITE_PARTS) -> None:
    """One raw file per shard below ``folder`` (which must not exist), committed by Spark like any other output.

    A shard goes to one task, and ``shards_per_task`` of them to each; the permutation fills them evenly, so no key is hot.
    The rows of a task are sorted by (shard, slot), which is the order the writer keeps. Stretches of shards are written one after
    the other, so that the shuffle never holds all records beside the finished shards.
    """
    step = max(1, -(-order.shards // parts))
    for first in range(0, max(order.shards, 1), step):
        tasks = max(1, -(-min(step, order.shards - first) // shards_per_task))
        dealt = order.records(first, first + step).repartitionById(tasks, F.floor((F.col("shard") - first) / shards_per_task).cast("int"))
        lines = dealt.sortWithinPartitions("shard", "slot").select(F.col("record").cast("string").alias("value"), "shard")
        lines.write.partitionBy("shard").mode("append").option("lineSep", END.decode()).option("compression", "none").text(folder)
        release(order.rows.sparkSession)


def read_from(spark: SparkSession, folder: str, slot: int = 0, layout: Layout = Layout()) -> DataFrame:
    """slot, shard, offset long, length int, ids binary (without padding), from ``slot`` on.

    Shards before that of ``slot`` are pruned by their folder, and its own is read from the slot's byte on. The rows of a shard
    come in slot order. A task holds one shard (``shard_rows`` records) at a time.
    """
    small_batches(spark)
    first, skip = layout.place(slot)
    files = spark.read.format("binaryFile").load(folder).select(F.col("shard").cast("long").alias("shard"), "content") \
        if _any_shard(spark, folder) else spark.createDataFrame([], "shard long, content binary")
    size, width = layout.record_bytes, layout.id_bytes

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
                data = memoryview(content.as_buffer())
                if len(data) % size:
                    raise ValueError(f"shard {shard} ends inside a record")
                for block in range(skip if shard == first else 0, len(data), 256 * size):
                    at = list(range(block, min(block + 256 * size, len(data)), size))
                    tokens = [int.from_bytes(data[a:a + HEAD_BYTES], "little") for a in at]
                    ids = [bytes(data[a + HEAD_BYTES:a + HEAD_BYTES + t * width]) for a, t in zip(at, tokens, strict=True)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([shard * layout.shard_rows + a // size for a in at], pa.int64()), pa.array([shard] * len(at), pa.int64()),
                        pa.array(at, pa.int64()), pa.array(tokens, pa.int32()), pa.array(ids, pa.binary())],
                        ["slot", "shard", "offset", "length", "ids"])
                del data, content
        tidy()

    return files.where(F.col("shard") >= first).mapInArrow(cut, "slot long, shard long, offset long, length int, ids binary")


def _any_shard(spark: SparkSession, folder: str) -> bool:
    """An empty order leaves a folder without shards, from which no partition column can be read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return any(s.isDirectory() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path))


def seek(file: os.PathLike | str, slot: int, layout: Layout = Layout()) -> np.ndarray:
    """The token ids of one slot from its shard's file, by position."""
    with open(file, "rb") as shard:
        shard.seek(layout.place(slot)[1])
        record = shard.read(layout.record_bytes)
    length = int.from_bytes(record[:HEAD_BYTES], "little")
    return np.frombuffer(record, f"<u{layout.id_bytes}", length, HEAD_BYTES)
