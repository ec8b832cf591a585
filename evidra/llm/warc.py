"""WARC archives compressed record by record with a Zstandard dictionary embedded in a leading skippable frame.

Spark's own text writer writes the archives, so the job commits and retries like any other: one row is one
compressed record, and the row separator is an empty skippable frame (its eight bytes are ASCII), which every
Zstandard reader passes over. The first row of each file is the skippable frame with the file's dictionary,
built from the first records of the file. Pages with equal payloads are stored once; the others revisit the
one with the smallest id.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm.common import prepare, rebatch, small_batches

DICTIONARY_MAGIC = (0x184D2A5D).to_bytes(4, "little")
#: An empty skippable frame (magic 0x184D2A50, length 0).
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
DICTIONARY_BYTES, SAMPLE_BYTES, LEVEL = 64 << 10, 4 << 20, 3
FIRST_RECORDS = 7  # fewer records than this can't train a dictionary; their bytes are one
DATE = "2000-01-01T00:00:00Z"


def skippable(payload: bytes) -> bytes:
    return DICTIONARY_MAGIC + len(payload).to_bytes(4, "little") + payload


def build_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> zstandard.ZstdCompressionDict | None:
    """Trained from the records; their last bytes where training finds too little in them; None without bytes."""
    size = min(size, sum(map(len, records)) // 8)
    if len(records) >= FIRST_RECORDS and size >= 1024:
        try:
            return zstandard.train_dictionary(size, records)
        except zstandard.ZstdError:
            pass
    raw = b"".join(records)[-DICTIONARY_BYTES // 4:]
    return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(raw) >= 8 else None


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """A response record, or a revisit of the page ``first``."""
    head = {
        "WARC-Type": "response" if first is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{'' if page is None else page}>",
        "WARC-Date": DATE,
        "WARC-Payload-Digest": f"sha1:{payload_digest(payload)}",
        "X-Payload-Length": str(len(payload)),
    }
    if url is not None:
        head["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    if first is None:
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        head["Content-Type"], block = "application/http; msgtype=response", http + payload
    else:
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["WARC-Refers-To"], block = f"<urn:page:{first}>", b""
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, payload) of one record; raises ValueError when it is damaged."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    size = int(fields["content-length"])
    if not version.startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError("damaged record")
    block = rest[:size]
    return fields, block.partition(b"\r\n\r\n")[2] if fields["warc-type"] == "response" else b""


def frames(content: memoryview, step: int = 1 << 18) -> Iterator[bytes]:
    """Decompressed records of one archive, with the dictionary of its leading skippable frame."""
    known, at = None, 0
    if content[:4] == DICTIONARY_MAGIC:
        size = int.from_bytes(content[4:8], "little")
        raw, at = bytes(content[8:8 + size]), 8 + size
        known = zstandard.ZstdCompressionDict(raw) if raw else None
    while at < len(content):
        if 0x50 <= content[at] <= 0x5F and content[at + 1:at + 4] == DICTIONARY_MAGIC[1:]:
            at += 8 + int.from_bytes(content[at + 4:at + 8], "little")
            continue
        reader, parts = zstandard.ZstdDecompressor(dict_data=known).decompressobj(), []
        while not reader.eof:
            if at >= len(content):
                raise ValueError("archive ends inside a record")
            parts.append(reader.decompress(content[at:at + step]))
            at = min(at + step, len(content)) - len(reader.unused_data)
        yield b"".join(parts)


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", min_payload: int = 0,
          level: int = LEVEL, dictionary_bytes: int = DICTIONARY_BYTES, sample_bytes: int = SAMPLE_BYTES) -> None:
    """Archives every row below ``folder`` (which must not exist), one file per task.

    Of rows with equal payloads of at least ``min_payload`` bytes those with the smallest id are responses and the
    others revisit it (rows that repeat the id as well are all responses). A null payload is empty; a row without
    id is always a response and is never referred to. Files of tasks without rows hold an empty dictionary frame.
    A file's dictionary is built from its first records, up to ``sample_bytes``.
    """
    small_batches(pages.sparkSession)
    prepare(pages.sparkSession)
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("page"), F.col(url).cast("string").alias("url"), body.alias("html")).withColumn(
        "same", F.when(F.col("page").isNotNull() & (F.octet_length("html") >= min_payload), F.sha2(F.col("html").cast("binary"), 256)))
    groups = rows.where(F.col("same").isNotNull()).groupBy("same").agg(F.min("page").alias("first"), F.max("page").alias("last"))
    repeated = groups.where(F.col("first") < F.col("last")).select("same", "first")
    marked = rows.join(repeated, "same", "left").select("page", "url", "html", F.when(F.col("first") < F.col("page"), F.col("first")).alias("first"))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size, ready, coder = 0, False, None

        def start() -> tuple[zstandard.ZstdCompressor, bytes]:
            known = build_dictionary(held, dictionary_bytes)
            return zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=True), skippable(known.as_bytes() if known else b"")

        for batch in rebatch(batches, "html"):
            out = []
            for page, link, html, first in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                record = record_bytes(page, link, html.encode(), first)
                if ready:
                    out.append(coder.compress(record))
                    continue
                held.append(record)
                size += len(record)
                if size >= sample_bytes:
                    coder, lead = start()
                    out, ready, held = [lead, *map(coder.compress, held)], True, []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])
        if not ready:
            coder, lead = start()
            yield pa.RecordBatch.from_arrays([pa.array([lead, *map(coder.compress, held)], pa.binary())], ["frame"])

    stored = marked.mapInArrow(archive, "frame binary").select(F.col("frame").cast("string").alias("value"))
    stored.write.option("lineSep", SEPARATOR).option("compression", "none").text(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per archived record: page_id, payload_bytes, payload_digest, record_type, refers_to, url, archive string,
    intact boolean (a response's payload has the stated digest and length)."""
    files = spark.read.format("binaryFile").load(folder).where(F.col("length") > 0).select("path", "content")
    schema = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string, "
              "intact boolean")
    names = [part.split()[0] for part in schema.split(", ")]
    number = lambda value: int(value[10:-1]) if value and value[10:-1] else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows = []
                for record in frames(memoryview(content.as_buffer())):
                    head, payload = parse_record(record)
                    digest, kind = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"]
                    stated = int(head["x-payload-length"])
                    intact = kind == "revisit" or (payload_digest(payload), len(payload)) == (digest, stated)
                    rows.append((number(head["warc-record-id"]), stated if kind == "revisit" else len(payload),
                                 digest if kind == "revisit" else payload_digest(payload), kind, number(head.get("warc-refers-to")),
                                 head.get("warc-target-uri"), path.as_py(), intact))
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], pa.schema([
                        ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
                        ("refers_to", pa.int64()), ("url", pa.string()), ("archive", pa.string()), ("intact", pa.bool_())]))

    return files.mapInArrow(run, schema)
