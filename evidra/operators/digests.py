"""SHA-256 over the ordered texts of a group, whatever its size, as a stream.

Rows are range-sorted by group and order. Groups that lie inside one task are digested there row by row; those that touch a task's border
leave pieces of text, which a second pass digests in order. No task ever holds the rows of a group, and the second pass sees a few
rows per task of the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.session import materialize

#: Text that a group gathers before it goes out as a piece.
PIECE_BYTES = 1 << 20


def streamed_sha256(rows: DataFrame, keys: list[str], order: list[str], text: str, part: str, between: str = ",", out: str = "sha256") -> DataFrame:
    """keys, ``out``: hex SHA-256 of the group's ``text`` values in ``order``, with ``between`` where two neighbours have the same ``part``.

    ``order`` has to start with ``part`` (a whole number) and to tell the rows of a group apart, unless equal rows have equal texts.
    """
    if order[0] != part:
        raise ValueError("the order has to start with the part")
    kinds = [rows.schema[k].dataType.simpleString() for k in keys]
    typed = ", ".join([*(f"`{k}` {t}" for k, t in zip(keys, kinds, strict=True)), "_task int, _nth long, _first int, _last int, _piece string, _digest string"])
    names, joint, piece_bytes = [*keys, "_task", "_nth", "_first", "_last", "_piece", "_digest"], between, PIECE_BYTES
    columns = list(dict.fromkeys([*keys, *order, text]))
    ordered = rows.select(*columns).repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)

    def batch_of(found: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
        types = [like.schema.field(k).type for k in keys] + [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*found, strict=True), types, strict=True)], names)

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, current, border, nth, held, size, begin, last, batch = TaskContext.get().partitionId(), None, True, 0, [], 0, 0, 0, None
        for batch in batches:
            found: list[tuple] = []
            for *key, p, value in zip(*(batch.column(k).to_pylist() for k in keys), batch.column(part).to_pylist(), batch.column(text).to_pylist(), strict=True):
                if key != current:
                    if current is not None:
                        whole = "".join(held)
                        if border:
                            found += [(*current, task, nth, begin, last, whole, None)] * bool(held)
                        else:
                            found.append((*current, None, None, None, None, None, hashlib.sha256(whole.encode()).hexdigest()))
                        border = False
                    current, nth, held, size, begin = key, 0, [], 0, p
                elif held and p == last:
                    held.append(joint)
                elif not held:
                    begin = p
                held.append(value)
                size, last = size + len(value), p
                if size >= piece_bytes:  # perhaps the task's last group, which only the end tells
                    found.append((*key, task, nth, begin, last, "".join(held), None))
                    border, nth, held, size = True, nth + 1, [], 0
            if found:
                yield batch_of(found, batch)
        if held:
            yield batch_of([(*current, task, nth, begin, last, "".join(held), None)], batch)

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last, digest, batch = None, None, hashlib.sha256(), None
        for batch in batches:
            found: list[tuple] = []
            fields = [batch.column(c).to_pylist() for c in ("_first", "_last", "_piece")]
            for *key, begin, end, piece in zip(*(batch.column(k).to_pylist() for k in keys), *fields, strict=True):
                if key != current:
                    if current is not None:
                        found.append((*current, None, None, None, None, None, digest.hexdigest()))
                    current, digest = key, hashlib.sha256()
                elif begin == last:
                    digest.update(joint.encode())
                digest.update(piece.encode())
                last = end
            if found:
                yield batch_of(found, batch)
        if current is not None:
            yield batch_of([(*current, None, None, None, None, None, digest.hexdigest())], batch)

    done = materialize(ordered.mapInArrow(first_pass, typed))
    pieces = done.where("_digest is null").repartition(*keys).sortWithinPartitions(*keys, "_task", "_nth").mapInArrow(second_pass, typed)
    return done.where("_digest is not null").unionByName(pieces).select(*keys, F.col("_digest").alias(out))
