"""Removal of repeated byte strings across documents by prefix-free parsing.

Parsing. A rolling hash over ``TRIGGER`` bytes is taken at every position; in every window of ``min_length``
bytes the place with the smallest hash is a trigger. The windows that share a trigger form one phrase, from the
first byte of the first window to the last byte of the last, so neighbouring phrases overlap by
``min_length - 1`` bytes, every string of ``min_length`` bytes lies in exactly one phrase, and equal strings lie
in phrases with the same trigger, wherever they stand.

Dictionary and parse. Phrases whose trigger occurs in one document only hold nothing repeated and are dropped
after a first exchange of triggers. The others meet by trigger: the distinct ones are the dictionary, whose
suffixes of at least ``min_length`` bytes are sorted (by their first eight bytes, then a fingerprint of the
first ``min_length``); the parse has the documents of each phrase. Combined they give the corpus order of all
suffixes up to ``min_length`` bytes with the smallest document of each equal run, which is what decides removal.

Pre-aggregation. Each map task first settles what repeats inside its own stretch of text; of a trigger that many
of its documents share it only sends the one with the smallest id, so a passage of a third of all documents
costs one record per stretch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from evidra.llm.common import (
    bucket_count, bucket_of, doc_bucket, from_planes, hash_bucket, materialize, mix64, pack_by_bucket, release, small_batches,
    text_slices, tidy, unpacked,
)

MIN_LENGTH, TRIGGER = 50, 16
#: Text bytes that are parsed at once, and that are pre-aggregated before a task sends anything.
STRETCH_BYTES, FLUSH_BYTES = 512 << 10, 8 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int, base: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(steps, dtype=np.uint64)


class Rolling:
    """Polynomial hashes of all windows of a stretch, from one prefix sum modulo 2**64."""

    def __init__(self, data: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            self.power = _powers(len(data), _BASE)
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power)))
            self.inverse = _powers(len(data), pow(_BASE, -1, 1 << 64))

    def all(self, width: int) -> np.ndarray:
        n = max(len(self.sums) - width, 0)
        with np.errstate(over="ignore"):
            return mix64((self.sums[width:width + n] - self.sums[:n]) * self.inverse[:n])

    def at(self, starts: np.ndarray, width: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[starts + width] - self.sums[starts]) * self.inverse[starts])


def _sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest value (the leftmost one) of every window, by doubling."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    at, span = np.arange(len(values), dtype=np.int64), 1
    while span < width:
        step = min(span, width - span)
        left, right = at[:len(at) - step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        span += step
    return at[:n]


class Stretch:
    """Phrases of a few documents: trigger hash and place, first window, number of windows, document row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, min_length: int, trigger: int) -> None:
        self.data, self.offsets, self.rolling = data, offsets, Rolling(data)
        windows = max(len(data) - min_length + 1, 0)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        hashes = self.rolling.all(trigger)
        place = _sliding_argmin(hashes, min_length - trigger + 1)[:windows]
        inside = row[:windows] == row[min_length - 1:] if windows else np.empty(0, bool)
        starts = np.flatnonzero(inside)
        place = place[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (np.diff(place) != 0) | (np.diff(starts) != 1) | (np.diff(row[starts]) != 0)
        first = np.flatnonzero(new)
        self.start = starts[first]
        self.count = np.diff(np.append(first, len(starts)))
        self.trigger = place[first]
        self.hash = hashes[self.trigger] if len(first) else np.empty(0, np.uint64)
        self.row = row[self.start] if len(first) else np.empty(0, np.int64)


def explode(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, position inside the owner) of every unit."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def _least(keys: list[np.ndarray], doc: np.ndarray, ascending: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(smallest doc, whether two docs share it) of each record's group of equal keys; ``ascending``: there is one
    key and the documents come in ascending order."""
    order = np.argsort(keys[0], kind="stable") if ascending else np.lexsort((doc, *keys))
    new = np.ones(len(order), bool)
    if len(order) > 1:
        new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(order)) - 1
    low, high = np.empty(len(doc), doc.dtype), np.empty(len(doc), doc.dtype)
    low[order], high[order] = doc[order[first]][group], doc[order[last]][group]
    return low, low != high


def merged_runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals as maximal runs (touching ones join)."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > reach[:-1]))
    first = np.flatnonzero(new)
    return starts[first], reach[np.append(first[1:], len(starts)) - 1]


def _stretches(batches: Iterator[pa.RecordBatch], limit: int = STRETCH_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, bytes, offsets) of some documents at a time, ids ascending; one longer than the limit is a stretch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = batch.take(pa.array(np.argsort(batch.column("doc").to_numpy(), kind="stable")))
        data, offsets = text_slices(batch.column("text"))
        ids = batch.column("doc").to_numpy()
        a = 0
        while a < len(ids):
            b = max(int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1, a + 1)
            yield ids[a:b], data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
            a = b
    tidy()


class Parser:
    def __init__(self, buckets: int, min_length: int, trigger: int) -> None:
        if not 8 <= trigger <= min_length:
            raise ValueError("the trigger needs 8 bytes at least and min_length at most")
        if min_length > 16384:
            raise ValueError("lengths of phrases are kept in two bytes")
        self.buckets, self.min_length, self.trigger = buckets, min_length, trigger

    def triggers(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packed (trigger hash, document, trigger place, shared in this stretch already)."""
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for ids, data, offsets in _stretches(batches):
            found = Stretch(data, offsets, self.min_length, self.trigger)
            held.append((found.hash, ids[found.row], (found.trigger - offsets[found.row]).astype(np.int32)))
            size += len(data)
            if size >= FLUSH_BYTES:
                yield from self._flush(held)
                held, size = [], 0
        if held:
            yield from self._flush(held)

    def _flush(self, held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        hashes, doc, local = (np.concatenate([h[i] for h in held]) for i in range(3))
        low, shared = _least([hashes], doc)
        send = doc == low
        short = hashes[send].astype(np.uint32)  # with the bucket, enough to tell triggers apart; a clash only adds comparisons
        yield self._packed(hash_bucket(hashes[send], self.buckets), [doc[send], local[send], short, shared[send].astype(np.uint8)], 0)
        more = shared & ~send  # known to repeat: no other task needs to hear of them
        yield self._packed(doc_bucket(doc[more], self.buckets), [doc[more], local[more]], 1)

    def _packed(self, bucket: np.ndarray, columns: list[np.ndarray], kind: int) -> pa.RecordBatch:
        rows = list(pack_by_bucket(bucket, columns, planes=(0, 1)))
        packed = [[r[1][i] if i < len(r[1]) else b"" for r in rows] for i in range(4)]
        return pa.RecordBatch.from_arrays(
            [pa.array([kind] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int64()), *[pa.array(c, pa.binary()) for c in packed]],
            ["kind", "bucket", "a", "b", "c", "d"])


PACKED = "kind int, bucket long, a binary, b binary, c binary, d binary"


def _to_docs(doc: np.ndarray, columns: list[np.ndarray], buckets: int) -> pa.Table:
    """Records dealt back to their documents' buckets."""
    rows = list(pack_by_bucket(doc_bucket(doc, buckets), [doc, *columns], planes=(0, 1, 2)))
    cols = [[r[1][i] if i < len(r[1]) else b"" for r in rows] for i in range(3)]
    return pa.table([pa.array([r[0] for r in rows], pa.int64()), *[pa.array(c, pa.binary()) for c in cols]], ["bucket", "a", "b", "c"])


BY_DOC = "bucket long, a binary, b binary, c binary"


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, trigger: int = TRIGGER) -> DataFrame:
    """Packed spans to remove, by document bucket: a = documents (int64), b = starts, c = ends (int32)."""
    spark = docs.sparkSession
    small_batches(spark)
    buckets = bucket_count(spark)
    parser = Parser(buckets, min_length, trigger)
    source = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def wanted(group: pa.Table) -> pa.Table:
        """Of the triggers of one bucket, those that two documents share; places known to repeat go straight back."""
        if group.column("kind")[0].as_py() == 1:
            return group.select(["bucket", "a", "b", "c"])
        doc, place = from_planes(group, "a", np.int64), from_planes(group, "b", np.int32)
        hashes, known = unpacked(group, "c", np.uint32), unpacked(group, "d", np.uint8).astype(bool)
        _, shared = _least([hashes], doc)
        order = np.argsort(hashes, kind="stable")  # a trigger shared inside any stretch is wanted from every stretch
        cut = np.flatnonzero(np.concatenate(([True], np.diff(hashes[order]) != 0))) if len(order) else np.empty(0, np.int64)
        if len(order):
            any_known = np.logical_or.reduceat(known[order], cut)
            spread = np.repeat(any_known, np.diff(np.append(cut, len(order))))
            shared[order] |= spread
        return _to_docs(doc[shared], [place[shared]], buckets)

    sent = source.mapInArrow(parser.triggers, PACKED)
    marks = materialize(sent.groupBy("kind", "bucket").applyInArrow(wanted, BY_DOC))
    release(spark)

    by_bucket = source.withColumn("bucket", bucket_of(F.col("doc"), buckets))

    def phrases(key_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return _phrases(left, right, parser)

    def settle(group: pa.Table) -> pa.Table:
        return group.select(["bucket", "a", "b", "c"]) if group.column("kind")[0].as_py() == 1 else _compare(group, parser)

    asked = _cogrouped(by_bucket, marks, phrases, PHRASES)
    spans = materialize(asked.groupBy("kind", "bucket").applyInArrow(settle, BY_DOC))
    release(spark)
    return spans


PHRASES = "kind int, bucket long, a binary, b binary, c binary, d binary, e binary"


def _cogrouped(texts: DataFrame, packed: DataFrame, run, schema: str) -> DataFrame:
    return texts.groupBy("bucket").cogroup(packed.groupBy("bucket")).applyInArrow(run, schema)


def _phrases(left: pa.Table, right: pa.Table, parser: Parser) -> pa.Table:
    out: list[tuple] = []
    held: list[tuple[np.ndarray, ...]] = []
    if not left.num_rows or not right.num_rows:
        return pa.Table.from_batches([], _schema(["kind"], "abcde"))
    doc, place = from_planes(right, "a", np.int64), from_planes(right, "b", np.int32)
    width, wanted = parser.min_length, np.sort(_pair(doc, place))
    for ids, data, offsets in _stretches(iter(left.to_batches())):
        found = Stretch(data, offsets, width, parser.trigger)
        local = found.trigger - offsets[found.row]
        own = _pair(ids[found.row], local)
        ask = wanted[np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)] == own
        start, count, row, hashes, owner = found.start[ask], found.count[ask], found.row[ask], found.hash[ask], ids[found.row[ask]]
        whole = np.empty(len(start), np.uint64)
        for n in np.unique(count):  # phrases that a smaller document of this stretch has too are settled here
            same = count == n
            whole[same] = found.rolling.at(start[same], int(n) + width - 1) + np.uint64(n)
        settled = _least([whole], owner, ascending=True)[0] < owner
        first = (start[settled] - offsets[row[settled]]).astype(np.int64)
        out += _packed_spans(owner[settled], first, first + count[settled] + width - 1, parser.buckets)
        open_ = ~settled
        start, count, row, hashes, owner = start[open_], count[open_], row[open_], hashes[open_], owner[open_]
        size = (count + width - 1).astype(np.uint16)
        unit, step = explode(size.astype(np.int64))
        held.append((owner, (start - offsets[row]).astype(np.int32), hashes, size, data[start[unit] + step]))
    if held:
        owner, local, hashes, size, data = (np.concatenate([h[i] for h in held]) for i in range(5))
        held.clear()
        begin = np.cumsum(size.astype(np.int64)) - size
        bucket = hash_bucket(hashes, parser.buckets)
        order = np.argsort(bucket, kind="stable")
        at = 0
        for b, (d, s, h, n) in pack_by_bucket(bucket, [owner, local, hashes, size], planes=(0, 1)):
            own = order[at:at + len(h) // 8]
            unit, step = explode(size[own].astype(np.int64))
            out.append((0, b, d, s, h, n, data[begin[own][unit] + step].tobytes()))
            at += len(own)
    columns = list(zip(*out, strict=True)) if out else [[]] * 7
    return pa.table([pa.array(list(c), k.type) for c, k in zip(columns, _schema(["kind"], "abcde"), strict=True)], ["kind", "bucket", *"abcde"])


def _schema(numbers: list[str], letters: str) -> pa.Schema:
    return pa.schema([*[(n, pa.int32()) for n in numbers], ("bucket", pa.int64()), *[(c, pa.binary()) for c in letters]])


def _pair(doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(doc.astype(np.int64).view(np.uint64)) + place.astype(np.uint64)


def _packed_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray, buckets: int) -> list[tuple]:
    """Spans to remove, as maximal runs of each document."""
    runs = _runs(doc, start, end)
    packed = _to_docs(*[runs[0], [runs[1].astype(np.int32), runs[2].astype(np.int32)]], buckets)
    return [(1, b, a, s, e, b"", b"") for b, a, s, e in zip(*[c.to_pylist() for c in packed.columns], strict=True)]


def _runs(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of the intervals of each document."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    group = np.cumsum(np.concatenate(([0], doc[1:] != doc[:-1])))
    shift = int(end.max()) + 1
    a, b = merged_runs(start + group * shift, end + group * shift)
    which = a // shift
    names = doc[np.concatenate(([True], doc[1:] != doc[:-1]))]
    return names[which], a - which * shift, b - which * shift


def _compare(group: pa.Table, parser: Parser) -> pa.Table:
    """One bucket of triggers, worked through in parts with whole triggers so that memory does not follow its size."""
    doc, local = from_planes(group, "a", np.int64), from_planes(group, "b", np.int32)
    hashes, size = unpacked(group, "c", np.uint64), unpacked(group, "d", np.uint16).astype(np.int64)
    data = unpacked(group, "e", np.uint8)
    begin = np.cumsum(size) - size
    order = np.argsort(hashes, kind="stable")
    out = [(doc[:0], local[:0].astype(np.int64))]
    for a, b in _parts(hashes[order], size[order]):
        own = order[a:b]
        unit, step = explode(size[own])
        letters = data[begin[own][unit] + step]
        out.append(_repeats(letters, size[own], hashes[own], doc[own], local[own], parser.min_length))
    tidy()
    start = np.concatenate([s for _, s in out])
    runs = _runs(np.concatenate([d for d, _ in out]), start, start + parser.min_length)
    return _to_docs(runs[0], [runs[1].astype(np.int32), runs[2].astype(np.int32)], parser.buckets)


def _repeats(data: np.ndarray, size: np.ndarray, hashes: np.ndarray, doc: np.ndarray, local: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, start) of every string that a smaller document has too: the sorted suffixes of the distinct phrases give
    the smallest document of each run of equal strings, the parse carries it to every occurrence of a phrase."""
    begin = np.cumsum(size) - size
    rolling, whole = Rolling(data), np.zeros(len(size), np.uint64)
    for n in np.unique(size):  # fingerprints of the phrases themselves, by length
        same = size == n
        whole[same] = rolling.at(begin[same], int(n))
    order = np.lexsort((doc, whole, size, hashes))
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in (hashes, size, whole)])
    entry = order[new]  # the dictionary: one occurrence of each phrase, that of the smallest document
    phrase = np.empty(len(order), np.int64)
    phrase[order] = np.cumsum(new) - 1  # the parse: phrase of every occurrence
    count = size[entry] - width + 1
    unit, step = explode(count)
    at = begin[entry][unit] + step
    lead = np.zeros(len(at), np.uint64)
    for i in range(8):
        lead = (lead << np.uint64(8)) | data[at + i].astype(np.uint64)
    low, _ = _least([rolling.at(at, width), lead], doc[entry][unit])
    base = np.cumsum(count) - count
    owner, step = explode(count[phrase])
    gone = low[base[phrase][owner] + step] < doc[owner]
    return doc[owner][gone], (local[owner] + step)[gone].astype(np.int64)


def _parts(keys: np.ndarray, weight: np.ndarray, limit: int = 1 << 20) -> list[tuple[int, int]]:
    """Stretches of sorted keys with about ``limit`` weight that never split a key."""
    edges = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
    reach = np.concatenate(([0], np.cumsum(weight)))[edges]
    parts, a = [], 0
    while a < len(edges) - 1:
        b = max(int(np.searchsorted(reach, reach[a] + limit, side="right")) - 1, a + 1)
        parts.append((int(edges[a]), int(edges[b])))
        a = b
    return parts


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, trigger: int = TRIGGER,
                   keep: list[str] | None = None) -> DataFrame:
    """Per row: key, the columns named in ``keep``, n_bytes, n_removed, n_spans long, kept_sha256 string, kept binary
    (the remaining bytes, concatenated).

    Removed is every byte covered by a string of ``min_length`` bytes that also starts in a document with a smaller
    key; strings are judged on the input and never cross documents. A null text is empty. A null key neither
    removes nor loses anything. Rows that repeat a key are one document and have to repeat its text; they get equal
    results. Other columns of the input are ignored; an empty table gives an empty table.
    """
    spans = repeated_spans(docs, key, text, min_length, trigger)
    buckets = bucket_count(docs.sparkSession)
    kept = [c for c in dict.fromkeys(keep or []) if c != key]
    renamed = [F.col(c).alias(f"keep_{i}") for i, c in enumerate(kept)]
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"), *renamed).withColumn(
        "bucket", bucket_of(F.coalesce("doc", F.lit(0)), buckets))
    extra = [f"keep_{i}" for i in range(len(kept))]
    names = ["doc", *extra, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

    kinds = pa.schema([("doc", pa.int64()), *[(e, to_arrow_type(rows.schema[e].dataType)) for e in extra], ("n_bytes", pa.int64()),
                       ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        doc, start, end = _runs(from_planes(right, "a", np.int64), from_planes(right, "b", np.int32).astype(np.int64),
                                from_planes(right, "c", np.int32).astype(np.int64))
        if not left.num_rows:
            return pa.Table.from_batches([], kinds)
        return pa.Table.from_batches([b for part in left.to_batches(max_chunksize=256) for b in cut_rows(part, doc, start, end).to_batches()], kinds)

    def cut_rows(left: pa.RecordBatch, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Table:
        out = []
        for i, value in zip(left.column("doc").to_pylist(), left.column("text").to_pylist(), strict=True):
            body = value.encode()
            a, b = (np.searchsorted(doc, i), np.searchsorted(doc, i, side="right")) if i is not None else (0, 0)
            at, pieces = 0, []
            for s, e in zip(start[a:b].tolist(), end[a:b].tolist(), strict=True):
                pieces.append(body[at:s])
                at = e
            rest = b"".join([*pieces, body[at:]])
            out.append((len(body), len(body) - len(rest), int(b - a), hashlib.sha256(rest).hexdigest(), rest))
        made = [pa.array(list(c), kinds.field(n).type) for c, n in zip(zip(*out, strict=True), names[-5:], strict=True)]
        return pa.table([left.column("doc"), *[left.column(c) for c in extra], *made], schema=kinds)

    fields = ", ".join(["doc long", *[f"{e} {rows.schema[e].dataType.simpleString()}" for e in extra], "n_bytes long", "n_removed long",
                        "n_spans long", "kept_sha256 string", "kept binary"])
    result = _cogrouped(rows, spans, cut, fields)
    return result.select(F.col("doc").alias(key), *[F.col(e).alias(c) for e, c in zip(extra, kept, strict=True)], *names[len(extra) + 1:])
