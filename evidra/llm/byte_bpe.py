"""Byte-level BPE encoding and decoding of whole texts, long ones by overlapping chunks.

Texts up to one chunk are encoded where they are read. A longer text is cut into overlapping chunks that are
pre-tokenised in parallel; two neighbours are stitched at the first pre-token boundary both found in their
overlap, after which they agree. The pieces between stitches are encoded in parallel and their ids joined per
text. Where no boundary is shared (one pre-token longer than the overlap), the chunks stay one piece.
Decoding concatenates the ids' bytes.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidra.llm.common import materialize, rebatch, small_batches

CHUNK_CHARS, OVERLAP_CHARS = 32768, 512
#: White-space runs from here on are merged without the library's own splitting, whose stack they would exhaust.
LONG_RUN = re.compile(r"\s{10000}")


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    """From a rank file, or from a byte-level BPE vocabulary in JSON whose ids are its merge ranks."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        special = {t["content"] for t in content.get("added_tokens", [])}
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in content["model"]["vocab"].items() if token not in special}
    else:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in JSON vocabularies: bytes that print as themselves keep
    their code point, the others take those from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def encode_text(coder: tiktoken.Encoding, pattern: regex.Pattern, text: str) -> list[int]:
    if LONG_RUN.search(text) is None:
        return coder.encode_ordinary(text)
    return [i for match in pattern.finditer(text) for i in coder._encode_single_piece(match[0].encode())]


def boundaries(pattern: regex.Pattern, text: str, start: int, stop: int) -> list[int]:
    """Ends of pre-tokens in [start, stop), counted from the beginning of ``text``."""
    return [m.end() for m in pattern.finditer(text) if start <= m.end() < stop]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", pattern: str = public_tokenizers.PATTERN,
           chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """One row per input row: key, ids binary (little-endian unsigned 32-bit), n_bytes long (of the UTF-8 text).

    Null and empty texts have no ids; a null key and repeated rows stay as they are; other columns of the input
    are ignored. An empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    long = F.length("text") > chunk
    out = f"key {kind}, ids binary, n_bytes long"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, split = encoding(path, pattern), regex.compile(pattern)
        for batch in rebatch(batches, "text"):
            texts = batch.column("text").to_pylist()
            ids = [np.array(encode_text(coder, split, t), dtype="<u4").tobytes() for t in texts]
            sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(ids, pa.binary()), sizes], ["key", "ids", "n_bytes"])

    short = rows.where(~long).mapInArrow(whole, out)
    return short.unionByName(_encode_long(rows.where(long), path, pattern, chunk, overlap)).withColumnRenamed("key", key)


def _encode_long(rows: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    last = (F.length("text") - F.lit(1)) / F.lit(chunk)
    cut = F.substring(F.col("text"), F.col("i") * chunk + 1, F.lit(chunk + overlap))
    chunks = materialize(
        rows.withColumn("uid", F.monotonically_increasing_id()).withColumn("i", F.explode(F.sequence(F.lit(0), F.floor(last).cast("int"))))
        .select("uid", "key", "i", cut.alias("text")).repartition("uid", "i"))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern)
        for batch in rebatch(batches, "text"):
            texts = batch.column("text").to_pylist()
            head = [boundaries(split, t, 1, overlap) for t in texts]
            tail = [[b - chunk for b in boundaries(split, t, chunk + 1, chunk + overlap)] if len(t) > chunk else [] for t in texts]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("i"), pa.array(head, kind), pa.array(tail, kind)],
                                             ["uid", "i", "head", "tail"])

    order = Window.partitionBy("uid").orderBy("i")
    shared = F.array_min(F.array_intersect("head", F.lag("tail").over(order)))
    marks = chunks.select("uid", "i", "text").mapInArrow(edges, "uid long, i int, head array<int>, tail array<int>").select(
        "uid", "i", shared.alias("cut"))
    placed = marks.select(
        "uid", "i", "cut", F.lead("cut").over(order).alias("next_cut"),
        F.count("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("piece"))
    start = F.coalesce("cut", F.lit(0))
    part = F.substring(F.col("text"), start + 1, F.lit(chunk) + F.coalesce("next_cut", F.lit(0)) - start)
    pieces = chunks.join(placed, ["uid", "i"]).groupBy("uid", "piece").agg(
        F.first("key").alias("key"), F.array_sort(F.collect_list(F.struct("i", part.alias("s")))).alias("parts")).select(
        "uid", "piece", "key", F.array_join(F.transform("parts", lambda p: p["s"]), "").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, split = encoding(path, pattern), regex.compile(pattern)
        for batch in rebatch(batches, "text"):
            texts = batch.column("text").to_pylist()
            ids = [np.array(encode_text(coder, split, t), dtype="<u4").tobytes() for t in texts]
            sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid"), batch.column("piece"), batch.column("key"), pa.array(ids, pa.binary()), sizes],
                ["uid", "piece", "key", "ids", "n_bytes"])

    done = pieces.mapInArrow(encoded, f"uid long, piece long, key {kind}, ids binary, n_bytes long")
    ordered = F.array_sort(F.collect_list(F.struct("piece", "ids")))
    joined = F.aggregate(ordered, F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return done.groupBy("uid").agg(F.first("key").alias("key"), joined.alias("ids"), F.sum("n_bytes").alias("n_bytes")).select("key", "ids", "n_bytes")


def decode_bytes(coder: tiktoken.Encoding, ids: np.ndarray) -> bytes:
    return b"".join(coder.decode_tokens_bytes(ids.tolist()))


def digests(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """key, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the bytes the ids decode to)."""
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(path)
        for batch in rebatch(batches, "ids"):
            rows = [np.frombuffer(b, dtype="<u4") for b in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(key), pa.array([len(r) for r in rows], pa.int64()),
                pa.array([hashlib.sha256(",".join(map(str, r.tolist())).encode()).hexdigest() for r in rows]),
                pa.array([hashlib.sha256(decode_bytes(coder, r)).hexdigest() for r in rows])],
                [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select(key, "ids").mapInArrow(run, f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
