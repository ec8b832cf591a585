"""Benchmark decontamination by winnowing.

Every window of ``span`` words chooses the smallest hash among its k-grams as its fingerprint, so two texts that share a
window share its fingerprint, whatever surrounds it: no shared span of ``span`` words is missed. Documents and benchmark
meet on fingerprints, and a hit is extended to its whole window and verified word by word. Benchmark items shorter
than a window are one window of their own length, whose only fingerprint is the whole item.

Documents are read once. Their tasks carry two bitmaps of a fixed size over the benchmark's fingerprints and windows,
built by Spark's bitmap aggregates, so that only windows likely to be shared leave the task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidra.llm.common import join_split_hot, materialize, mix64, numbered_rows, rebatch, small_batches, text_slices, tidy
from evidra.session import broadcast_if_small

SPAN, GRAM = 10, 5
#: A bitmap has 16 bits for every window of the benchmark, but 8 MB at most; it comes as rows of 32,768 bits.
LEAST_BITS, MOST_BITS, BITMAP_ROW = 1 << 15, 1 << 26, 1 << 15
BATCH_BYTES, CHUNK_WINDOWS = 2 << 20, 4096

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
#: Digits, letters and everything beyond ASCII make up words.
IN_WORD = np.zeros(256, bool)
IN_WORD[ord("0"):ord("9") + 1] = IN_WORD[ord("a"):ord("z") + 1] = IN_WORD[128:] = True
TO_SPACE = bytes(int(LOWER[i]) if IN_WORD[LOWER[i]] else 32 for i in range(256))
BASE = 0x9E3779B97F4A7C15 | 1


@cache
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _word_edges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of every word of the texts that lie one after the other in ``data`` (lower-cased)."""
    inside = IN_WORD[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    before, after = np.concatenate(([False], inside[:-1])), np.concatenate((inside[1:], [False]))
    return np.flatnonzero(inside & (~before | border[:-1])), np.flatnonzero(inside & (~after | border[1:])) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash per word, of its bytes alone; equal words have equal hashes."""
    out, step, first = np.empty(len(starts), np.uint64), 1 << 20, 0
    inverse = pow(BASE, -1, 1 << 64)
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + step, side="right")))
        low, high = int(starts[first]), int(ends[last - 1])
        size = max(step + 1, 1 << (high - low).bit_length())
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * _powers(size, BASE)[:high - low])))
        at, to = starts[first:last] - low, ends[first:last] - low
        out[first:last] = mix64((sums[to] - sums[at]) * _powers(size, inverse)[at] + (to - at).astype(np.uint64) + np.uint64(seed))
        first = last
    return out


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from every position on."""
    total = np.zeros(max(len(words) - k + 1, 0), np.uint64)
    for i in range(k):
        total = total * np.uint64(BASE) + words[i:i + len(total)]
    return mix64(total + np.uint64(k))


def fingerprints(words: np.ndarray, span: int, k: int) -> np.ndarray:
    """For the window at every position the smallest hash among its k-grams."""
    grams = gram_hashes(words, k)
    least = grams[:max(len(words) - span + 1, 0)].copy()
    for i in range(1, span - k + 1):
        np.minimum(least, grams[i:i + len(least)], out=least)
    return least


class Batch:
    """The words of a batch of texts."""

    def __init__(self, column: pa.Array, seed: int) -> None:
        raw, offsets = text_slices(column)
        self.raw = raw
        data = LOWER[raw]
        self.starts, self.ends = _word_edges(data, offsets[:-1] if len(raw) else offsets[:0])
        self.first = np.searchsorted(self.starts, offsets)  # number of the first word of every text
        self.words = word_hashes(data, self.starts, self.ends, seed)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(len(column)), self.counts)

    def windows(self, span: int) -> np.ndarray:
        """First words of all windows that lie within one text."""
        at = np.arange(max(len(self.words) - span + 1, 0))
        return at[self.row[at] == self.row[at + span - 1]] if len(at) else at

    def texts(self, at: np.ndarray, span: int) -> list[bytes]:
        """The words of a window, lower-cased and joined by one space."""
        return [b" ".join(self.raw[a:b].tobytes().translate(TO_SPACE).split())
                for a, b in zip(self.starts[at].tolist(), self.ends[at + span - 1].tolist(), strict=True)]

    def prints(self, at: np.ndarray, span: int, full: int, k: int) -> np.ndarray:
        """Fingerprints of the windows: the least k-gram of a full one, the whole of a short one."""
        return fingerprints(self.words, span, k)[at] if span == full else gram_hashes(self.words, span)[at]


def _item_windows(items: DataFrame, key: str, text: str, span: int, k: int, seed: int) -> DataFrame:
    rows, batch_bytes = items.select(F.col(key).cast("string").alias("item"), F.col(text).alias("text")), BATCH_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatch(batches, "text", batch_bytes):
            read = Batch(batch.column("text"), seed)
            for size in range(1, span + 1):
                at = read.windows(size)
                if size < span:
                    at = at[read.counts[read.row[at]] == size]
                if len(at):
                    yield pa.RecordBatch.from_arrays([
                        batch.column("item").take(pa.array(read.row[at])), pa.array(np.full(len(at), size, np.int32)),
                        pa.array(read.prints(at, size, span, k).view(np.int64)), pa.array(gram_hashes(read.words, size)[at].view(np.int64)),
                        pa.array(read.texts(at, size), pa.binary())], ["item", "size", "print", "window", "words"])

    return rows.mapInArrow(run, "item string, size int, print long, window long, words binary")


def _bitmap(table: DataFrame, column: str, bits: int) -> bytes:
    """Bits of ``column`` modulo ``bits``; what reaches the driver has that size, whatever the table's."""
    number = F.pmod(F.col(column), F.lit(bits)) + 1  # Spark counts the numbers of a bitmap from 1
    parts = table.groupBy(F.bitmap_bucket_number(number).alias("at")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("held")).collect()
    out = bytearray(bits // 8)
    for row in parts:
        start = (row["at"] - 1) * BITMAP_ROW // 8
        out[start:start + BITMAP_ROW // 8] = row["held"]
    return bytes(out)


def _has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes.view(np.int64) % (8 * len(bitmap))
    return (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & np.uint8(1) != 0


def _scan(docs: DataFrame, key: str, text: str, span: int, k: int, seed: int, sizes: list[int], prints: bytes, windows: bytes) -> DataFrame:
    """One row per document with its number and word count, and further rows with its likely windows, some thousands a row."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((prints, windows))
    batch_bytes, chunk = BATCH_BYTES, CHUNK_WINDOWS
    names = ["row", "key", "n_words", "start", "size", "print", "window", "words"]
    types = [pa.int64(), None, pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [np.frombuffer(b, np.uint8) for b in shared.value]
        block, done = TaskContext.get().partitionId(), 0
        for batch in rebatch(batches, "text", batch_bytes):
            read, n = Batch(batch.column("text"), seed), batch.num_rows
            row = numbered_rows(block, done, n)
            done += n
            kind = batch.schema.field("key").type
            none = [pa.nulls(n, t) for t in types[3:]]
            yield pa.RecordBatch.from_arrays([pa.array(row), batch.column("key"), pa.array(read.counts.astype(np.int64)), *none], names)
            for size in sizes:
                at = read.windows(size)
                marks = read.prints(at, size, span, k)
                near = _has(known[0], marks)
                at, marks = at[near], marks[near]
                whole = gram_hashes(read.words, size)[at]
                near = _has(known[1], whole)
                at, marks, whole = at[near], marks[near], whole[near]
                for a in range(0, len(at), chunk):
                    part = slice(a, a + chunk)
                    of = read.row[at[part]]
                    edges = np.concatenate((np.flatnonzero(np.diff(of, prepend=-1)), [len(of)])).astype(np.int32)
                    lists = [pa.ListArray.from_arrays(pa.array(edges), values) for values in (
                        pa.array((at[part] - read.first[of]).astype(np.int64)), pa.array(np.full(len(of), size, np.int32)),
                        pa.array(marks[part].view(np.int64)), pa.array(whole[part].view(np.int64)), pa.array(read.texts(at[part], size), pa.binary()))]
                    yield pa.RecordBatch.from_arrays([pa.array(row[of[edges[:-1]]]), pa.nulls(len(edges) - 1, kind), pa.nulls(len(edges) - 1, pa.int64()), *lists], names)
        tidy()

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"row long, key {kind}, n_words long, start array<long>, size array<int>, print array<long>, "
                                "window array<long>, words array<binary>")


def _benchmark(spark: SparkSession, items: DataFrame, key: str, text: str, span: int, k: int, seeds: Iterable[int]) -> tuple[int, DataFrame, DataFrame]:
    """(seed, all windows of the items, the distinct ones): under that seed no two windows share a hash."""
    for seed in seeds:
        windows = materialize(_item_windows(items, key, text, span, k, seed))
        single = materialize(windows.select("size", "print", "window", "words").distinct())
        if not single.groupBy("window").count().where("count > 1").limit(1).count():
            return seed, windows, single
    raise ValueError("windows of the benchmark share hashes under all seeds")


def shared_windows(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                   item_text: str = "text", span: int = SPAN, k: int = GRAM, seeds: Iterable[int] = range(1, 9)) -> DataFrame:
    """key, n_words long, n_hit long, spans array<struct<start, end>> (word numbers of the maximal hit stretches), items array<string>
    (sorted ids of the items with a window in the document), one row per row of ``docs``.

    Words are runs of digits, A-Z in lower case, a-z and characters beyond ASCII; windows are all stretches of ``span`` item words, or the
    whole of a shorter item. A word inside any occurrence of a window is hit. A null or empty text has no words; an item
    without words has no window; an item without id marks words but is not listed; rows that repeat an item's id are one item; every
    repeated document row gets its own result; other columns are ignored; empty tables on either side are fine.
    """
    if not 0 < k <= span:
        raise ValueError("k must be between 1 and span")
    spark = docs.sparkSession
    small_batches(spark)
    seed, windows, single = _benchmark(spark, items, item_key, item_text, span, k, seeds)
    sizes = sorted(r["size"] for r in single.select("size").distinct().collect())  # at most ``span`` rows
    bits = min(max(1 << (16 * single.count()).bit_length(), LEAST_BITS), MOST_BITS)
    found = materialize(_scan(docs, key, text, span, k, seed, sizes, *(_bitmap(single, c, bits) for c in ("print", "window"))))

    likely = found.where(F.col("n_words").isNull()).select("row", F.explode(F.arrays_zip("start", "size", "print", "window", "words")).alias("w")).select("row", "w.*")
    hits = likely.join(broadcast_if_small(single), ["print", "size", "window", "words"])  # equal fingerprints, then the whole window, word by word
    hits = hits.select("row", "window", "start", (F.col("start") + F.col("size")).alias("end"))
    order = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = hits.withColumn("new", (F.coalesce(F.col("start") > reach, F.lit(True))).cast("int")).withColumn(
        "island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("row", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.collect_set("window").alias("windows"))
    per_row = merged.groupBy("row").agg(
        F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("windows")))).alias("windows"))
    # documents with the same windows have the same items: copies of a passage meet the items once, not per document
    classed = materialize(per_row.withColumn("class", F.sha2(F.array_join(F.transform("windows", lambda w: w.cast("string")), ","), 256)))
    weighed = classed.groupBy("class").agg(F.count("*").alias("n_rows"), F.first("windows").alias("windows"))
    named = windows.where(F.col("item").isNotNull()).select("window", "item").distinct()
    listed = weighed.select("class", F.explode("windows").alias("window")).join(broadcast_if_small(named), "window").select("class", "item").distinct()
    of_class = listed.groupBy("class").agg(F.array_sort(F.collect_list("item")).alias("items"))
    table = materialize(weighed.select("class", "n_rows").join(of_class, "class", "left"))
    total = classed.count()
    result = join_split_hot(classed.drop("windows"), table, ["class"], "n_rows", total).select("row", "n_hit", "spans", "items")
    empty = "array<struct<start: bigint, end: bigint>>"
    return found.where(F.col("n_words").isNotNull()).select("row", "key", "n_words").join(result, "row", "left").select(
        F.col("key").alias(key), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("spans", F.array().cast(empty)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The report of the query: counts, the item ids as SHA-256 and whether any word is hit."""
    return found.select(
        key, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def contamination_sql() -> str:
    """The same report in SQL: all windows of both sides, joined on their words."""
    words = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, coalesce({words.format('text')}, []) AS w FROM documents),
     i AS (SELECT item_id, {words.format('text')} AS w FROM benchmark),
     iw AS (SELECT DISTINCT item_id, size, array_to_string(w[s:s + size - 1], ' ') AS t
            FROM (SELECT item_id, w, least(len(w), {SPAN}) AS size, unnest(range(1, len(w) - least(len(w), {SPAN}) + 2)) AS s
                  FROM i WHERE len(w) > 0)),
     sizes AS (SELECT DISTINCT size FROM iw),
     dw AS (SELECT doc_id, size, s, array_to_string(w[s:s + size - 1], ' ') AS t
            FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size)),
     hit AS (SELECT DISTINCT doc_id, size, s FROM dw SEMI JOIN iw USING (size, t)),
     word AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS place FROM hit) GROUP BY doc_id),
     item AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
              FROM (SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (size, t)) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)
"""
