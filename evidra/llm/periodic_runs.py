"""Periodic runs of words: recursive frequency splitting, then a lag scan of the segments that survive.

A run is a stretch of consecutive words with smallest period q, at least ``least_repeats`` periods and ``least_words``
words long, that no neighbouring word extends. Every word of a run occurs at least ``least_repeats`` times in it, so a
word that is rarer inside its segment is in no run and splits the segment; the parts are split again until nothing
changes. Almost all text is gone then. The rest is scanned at lags: for blocks of 2, 4, 8, ... words the distance to the
next equal block names the lags worth a look, which keeps the scan at n log n on texts of any length.

Each text is one row and is handled by itself, so the job is a single pass without a shuffle, whatever key, source or
group of copies holds most rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import rebatch, small_batches

LEAST_WORDS, LEAST_REPEATS = 6, 4
#: Words are what lies between these ASCII characters.
SPACES = r"[\x20\x09-\x0D]+"
SLICE = 1 << 20
RUN_TYPE = "struct<start: bigint, length: bigint, period: bigint>"


class Vocabulary(dict):
    """Numbers words in the order of their first appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return self[word]


def word_slices(text: bytes, size: int = SLICE) -> Iterator[list[bytes]]:
    """The words of a text, about ``size`` bytes at a time; no word is cut."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            border = re.compile(rb"[\x20\x09-\x0D]").search(text, end)
            end = border.start() if border else len(text)
        yield text[at:end].split()  # bytes split at exactly these six characters
        at = end


def numbered(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """(word numbers, words by number): equal numbers are equal words."""
    known = Vocabulary()
    parts = [np.fromiter(map(known.__getitem__, words), np.int32, len(words)) for words in word_slices(text)]
    return np.concatenate(parts) if parts else np.empty(0, np.int32), list(known)


def stretches(kept: np.ndarray) -> np.ndarray:
    """(start, end) of the maximal stretches of true values."""
    edges = np.flatnonzero(np.diff(kept.astype(np.int8), prepend=0, append=0))
    return edges.reshape(-1, 2)


def segments(ids: np.ndarray, least_words: int = LEAST_WORDS, least_repeats: int = LEAST_REPEATS) -> list[tuple[int, int]]:
    """Segments in which every word occurs ``least_repeats`` times or more; no run reaches beyond one."""
    open_, stable = [(0, len(ids))], []
    while open_:
        start, end = open_.pop()
        if end - start < least_words:
            continue
        _, place, counts = np.unique(ids[start:end], return_inverse=True, return_counts=True)
        frequent = counts[place] >= least_repeats
        if frequent.all():
            stable.append((start, end))
        else:
            open_ += [(start + int(a), start + int(b)) for a, b in stretches(frequent)]
    return stable


def lag_scan(ids: np.ndarray, least_words: int = LEAST_WORDS, least_repeats: int = LEAST_REPEATS) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of every run of the segment.

    For periods of [B, 2B) the blocks have 2B words, so they are longer than the period and shorter than two: inside a run
    the next equal block lies exactly one (smallest) period further, and outside it does not. A stretch of positions with
    that distance q, from i to j, is therefore the run from i to j + q + 2B.
    """
    n, base = len(ids), 1
    name = ids.astype(np.int64)  # of the blocks of ``base`` words
    while base * least_repeats <= n:
        block = 2 * base
        pair = name[:n - block + 1] * (int(name.max()) + 1) + name[base:n - base + 1]
        _, name = np.unique(pair, return_inverse=True)
        order = np.argsort(name, kind="stable")
        ahead = np.zeros(len(name), np.int64)
        same = name[order[1:]] == name[order[:-1]]
        ahead[order[:-1][same]] = (order[1:] - order[:-1])[same]
        fits = (ahead >= base) & (ahead < block)
        cut = np.flatnonzero(np.diff(np.where(fits, ahead, 0), prepend=0, append=0))
        for a, b in zip(cut.tolist(), cut[1:].tolist(), strict=False):
            if fits[a]:
                period = int(ahead[a])
                length = b - 1 - a + period + block
                if length >= max(least_words, least_repeats * period):
                    yield a, length, period
        base = block


def runs_of(ids: np.ndarray, least_words: int = LEAST_WORDS, least_repeats: int = LEAST_REPEATS) -> list[tuple[int, int, int]]:
    """All runs, by start and period."""
    return sorted((start + a, length, period) for start, end in segments(ids, least_words, least_repeats)
                  for a, length, period in lag_scan(ids[start:end], least_words, least_repeats))


def collapsed(text: bytes, runs: list[tuple[int, int, int]], ids: np.ndarray, words: list[bytes]) -> bytes:
    """The words joined by one space, without those that lie in a run after its first period."""
    if not runs:
        return b" ".join(b" ".join(part) for part in word_slices(text) if part)
    depth = np.zeros(len(ids) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return b" ".join(map(words.__getitem__, ids[np.cumsum(depth[:-1]) == 0].tolist()))


def _over_texts(docs: DataFrame, text: str, added: str, names: list[str], make: Callable[[bytes | None], tuple]) -> DataFrame:
    """``docs`` with the columns ``make`` gives for each text (as bytes, null stays null), in place of ``text``."""
    small_batches(docs.sparkSession)
    others = [c for c in docs.columns if c != text]
    fields = [docs.schema[c] for c in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])), pa.binary(), pa.int64()]
        for batch in rebatch(batches, text):
            made = [make(t) for t in batch.column(text).cast(pa.large_binary()).to_pylist()]
            columns = [pa.array(values, kind) for values, kind in zip(zip(*made, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *columns], [*others, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), added])
    return docs.mapInArrow(run, schema)


def find_runs(docs: DataFrame, key: str = "doc_id", text: str | Column = "text", least_words: int = LEAST_WORDS,
              least_repeats: int = LEAST_REPEATS) -> DataFrame:
    """key, runs array<struct<start, length, period>> by start and period (word numbers from 0), collapsed string (the kept
    words joined by one space), n_words long.

    ``least_repeats`` is 4 or more: the scan tells periods apart only above three. A null or empty text has no words, no runs and an
    empty collapsed text; a null key stays; every repeated row is a text of its own; other columns are ignored; an empty table
    gives an empty table. A text is held once, with four bytes a word beside it.
    """
    if least_repeats < 4 or least_words < least_repeats:
        raise ValueError("least_repeats below 4, or more than least_words")
    rows = docs.select(F.col(key).alias("key"), (F.col(text) if isinstance(text, str) else text).alias("text"))

    def make(value: bytes | None) -> tuple[list[dict], bytes, int]:
        value = value or b""
        ids, words = numbered(value)
        runs = runs_of(ids, least_words, least_repeats)
        return [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], collapsed(value, runs, ids, words), len(ids)

    found = _over_texts(rows, "text", f"runs array<{RUN_TYPE}>, collapsed binary, n_words long", ["runs", "collapsed", "n_words"], make)
    return found.select(F.col("key").alias(key), "runs", F.col("collapsed").cast("string").alias("collapsed"), "n_words")


def with_loops(doc: Column, text: Column) -> Column:
    """The text in which, for one id of ten, every word from a on repeats the p words from a: a = g % n, p = 1 + floor((n - a) / (3 + g % 8)),
    g = floor(crc32(decimal id) / 10). Other texts, and rows without id or words, stay as they are."""
    h = F.crc32(doc.cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    n = F.size(words)
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    # slices, not an element per word: inside a lambda the words would be split anew for every element
    period = F.slice(words, a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    rebuilt = F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")
    return F.when(F.coalesce((h % 10 == 0) & (n > 0), F.lit(False)), rebuilt).otherwise(text)


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_runs, the run of the greatest exact length / period (ties: smallest start, then period; nulls without a run) as start, length,
    period, exponent_milli, and SHA-256 of the run lines and of the collapsed text."""
    better = F.array_sort("runs", lambda x, y: F.when(x.length * y.period != y.length * x.period,
                          F.when(x.length * y.period > y.length * x.period, -1).otherwise(1))
                          .when(x.start != y.start, F.when(x.start < y.start, -1).otherwise(1))
                          .otherwise(F.when(x.period < y.period, -1).when(x.period > y.period, 1).otherwise(0)))
    best = F.try_element_at(better, F.lit(1))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    ended = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.withColumn("_best", best).select(
        key, F.size("runs").cast("long").alias("n_runs"), *[F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("_best.length") / F.col("_best.period")).alias("exponent_milli"),
        F.sha2(ended, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
