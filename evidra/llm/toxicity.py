"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(b + sum w_i + sum over pairs <v_i, v_j>) over the terms of the model present in the whole text, so that
the meeting of two terms (an insult and a group's name) weighs more than both apart. Open: a term enters the model only if its own
share of toxic rows lies ``MIN_Z`` standard errors from the overall share, so pairs of terms that are near neutral alone are not learnt. The model is fitted on a
bounded sample of labelled rows (``sample_rows``, chosen by a hash of the id) and has a fixed size; scoring
reads every row once, where it lies, without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import rebatch, small_batches

BITS, FACTORS = 18, 8
#: Bound of the training sample; the sampled ids are broadcast (16 bytes each).
SAMPLE_ROWS = 40_000
#: A term enters the model if its share of toxic rows is this many standard errors from the overall share.
MIN_Z, MIN_ROWS = 3.0, 3
THRESHOLD = 0.3
_WORD_BYTES = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else 32 for c in range(256))


def terms(text: str, bits: int = BITS) -> np.ndarray:
    """Distinct hashed terms: runs of letters, digits and non-ASCII bytes, A-Z lower-cased."""
    words = text.encode().lower().translate(_WORD_BYTES).split()
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return np.unique((hashed & np.uint64((1 << bits) - 1)).astype(np.int32))


class Model:
    """Bias, weight and factors of each hashed term that entered the model."""

    def __init__(self, bits: int, bias: float, used: np.ndarray, weight: np.ndarray, factors: np.ndarray) -> None:
        self.bias, self.weight, self.factors = bias, weight, factors
        self.slot = np.full(1 << bits, -1, dtype=np.int32)
        self.slot[used] = np.arange(len(used), dtype=np.int32)

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        row, slot = _flat([self.slot[r] for r in rows])
        margin, _ = _margins(self, row, slot, len(rows))
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    rows = [r[r >= 0] for r in rows]
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows) if rows else np.empty(0, np.int32)


def _sums(row: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(row, values[:, f], n) for f in range(values.shape[1])], axis=1)


def _margins(model: Model, row: np.ndarray, slot: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    factors = model.factors[slot]
    total = _sums(row, factors, n)
    pairs = 0.5 * ((total**2).sum(1) - _sums(row, factors**2, n).sum(1))
    return model.bias + np.bincount(row, model.weight[slot], n) + pairs, total


def fit(rows: list[np.ndarray], toxic: np.ndarray, bits: int = BITS, factors: int = FACTORS, epochs: int = 12, batch: int = 128,
        min_z: float = MIN_Z, min_rows: int = MIN_ROWS, seed: int = 7) -> Model:
    """Logistic loss by AdaGrad over shuffled mini-batches. Without rows of both labels the score is the constant
    share of toxic rows (0.0 without rows)."""
    share = float(toxic.mean()) if len(toxic) else 0.0
    bias = float(np.log((share + 1e-9) / (1 - share + 1e-9)))
    seen = np.bincount(np.concatenate([np.empty(0, np.int32), *rows]), minlength=1 << bits)
    bad = np.bincount(np.concatenate([np.empty(0, np.int32), *[r for r, t in zip(rows, toxic, strict=True) if t]]), minlength=1 << bits)
    error = np.sqrt(np.maximum(seen * share * (1 - share), 1e-12))
    used = np.flatnonzero((seen >= min_rows) & (np.abs(bad - seen * share) >= min_z * error)) if 0 < share < 1 else np.empty(0, np.int64)
    random = np.random.default_rng(seed)
    model = Model(bits, bias, used, np.zeros(len(used)), random.normal(0, 0.01, (len(used), factors)))
    if not len(used):
        return model
    kept = [s[s >= 0] for s in (model.slot[r] for r in rows)]
    grown_w, grown_v = np.full(len(used), 1e-6), np.full((len(used), factors), 1e-6)
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for start in range(0, len(order), batch):
            chosen = order[start:start + batch]
            row, slot = _flat([kept[i] for i in chosen])
            margin, total = _margins(model, row, slot, len(chosen))
            slope = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - toxic[chosen]) / len(chosen)
            model.bias -= 0.02 * float(slope.sum())
            at, inverse = np.unique(slot, return_inverse=True)
            dw = np.bincount(inverse, slope[row], len(at)) + 1e-4 * model.weight[at]
            dv = _sums(inverse, slope[row][:, None] * (total[row] - model.factors[slot]), len(at)) + 1e-4 * model.factors[at]
            grown_w[at] += dw**2
            grown_v[at] += dv**2
            model.weight[at] -= 0.1 * dw / np.sqrt(grown_w[at])
            model.factors[at] -= 0.02 * dv / np.sqrt(grown_v[at])
    return model


def held_out(key: Column) -> Column:
    """True where crc32 of the id's text leaves remainder 2 modulo 4; null ids are not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
          sample_rows: int = SAMPLE_ROWS, bits: int = BITS) -> Model:
    """Model from at most ``sample_rows`` labelled rows outside the held-out part, chosen by a hash of the id.

    Null ids and null labels are left out; an id labelled both ways counts as toxic; of documents that repeat an id the smallest text
    stands for it. The sample's hashed terms (not its texts) meet on the driver: at most ``sample_rows`` lists.
    """
    usable = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key)))
    ids = usable.groupBy(F.col(key).alias("key")).agg(F.max(F.col(label).cast("int")).alias("y")).orderBy(
        F.xxhash64("key"), "key").limit(sample_rows)
    chosen = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(ids), "key").groupBy(
        "key", "y").agg(F.min("text").alias("text"))
    found = chosen.select("key", "text", "y").mapInArrow(_termed(bits), "key long, y int, terms binary") if \
        dict(chosen.dtypes)["key"] == "bigint" else chosen.select(F.xxhash64("key").alias("key"), "text", "y").mapInArrow(
            _termed(bits), "key long, y int, terms binary")
    sample = found.toPandas().sort_values(["key", "y", "terms"], kind="stable")
    rows = [np.frombuffer(b, dtype=np.int32) for b in sample["terms"]]
    return fit(rows, sample["y"].to_numpy(dtype=float), bits)


def _termed(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatch(batches, "text"):
            packed = [terms(t, bits).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("y"), pa.array(packed, pa.binary())], ["key", "y", "terms"])

    return run


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, bits: int = BITS,
          keep: list[str] | None = None) -> DataFrame:
    """key, held_out boolean, score double, predicted int per row (after the columns named in ``keep``).

    Null and empty texts are scored by the bias alone; a null key is scored too; repeated rows get equal scores;
    labels, other columns and the key never enter a score.
    """
    small_batches(docs.sparkSession)
    columns = list(dict.fromkeys([key, *(keep or [])]))
    rows = docs.select(*[F.col(c) for c in columns], F.coalesce(F.col(text), F.lit("")).alias("_whole"), held_out(F.col(key)).alias("_out"))
    names = [*columns, "held_out", "score", "predicted"]
    taken = [c for c in ("held_out", "score", "predicted", "_whole", "_out") if c in columns]
    if taken:
        raise ValueError(f"columns {taken} would be overwritten")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatch(batches, "_whole"):
            found = model.scores([terms(t, bits) for t in batch.column("_whole").to_pylist()])
            put = [batch.column("_out"), pa.array(found), pa.array((found >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + put, names)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2]]
    return rows.mapInArrow(run, ", ".join([*fields, "held_out boolean", "score double", "predicted int"]))


def crc_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2
