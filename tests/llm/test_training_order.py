import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest

from evidra.llm import training_order
from evidra.llm.byte_bpe import encoding
from evidra.llm.registry import op3_training_order
from evidra.llm.training_order import Layout

SMALL = Layout(stride=8, id_bytes=4, shard_rows=64)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 64, 1000, 4097])
def test_slots_are_a_permutation_fixed_by_the_key(n):
    found = training_order.slots(np.arange(n), n, 5)
    assert sorted(found.tolist()) == list(range(n))
    assert np.array_equal(found, training_order.slots(np.arange(n), n, 5))
    assert n < 10 or not np.array_equal(found, training_order.slots(np.arange(n), n, 6))


def plain_slot(index, n, key):
    """One slot in plain Python: Feistel rounds over two halves, walked until below n."""
    mask64 = 2**64 - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask64
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask64
        return x ^ (x >> 31)

    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    keys = [mix((i + mix(key)) & mask64) for i in range(1, 7)]
    while True:
        left, right = index >> half, index & ((1 << half) - 1)
        for k in keys:
            left, right = right, left ^ (mix((right + k) & mask64) & ((1 << half) - 1))
        index = (left << half) | right
        if index < n:
            return index


@pytest.mark.parametrize(("n", "key"), [(5, 0), (100, 2**64 - 1), (1025, 7)])
def test_slots_against_plain_python(n, key):
    assert training_order.slots(np.arange(n), n, key).tolist() == [plain_slot(i, n, key) for i in range(n)]


def written(spark, folder, packed, layout=SMALL, per_task=1, parts=4):
    source = spark.createDataFrame([(p, 1, 2) for p in packed], "ids binary, slot int, index int").repartition(5)
    order = training_order.ordered(source, 3, layout)
    training_order.write_shards(order, folder, per_task, parts)
    return order.n


@pytest.mark.parametrize(("per_task", "parts"), [(1, 4), (3, 1), (2, 100)])
def test_files_hold_the_order_byte_by_byte(spark, tmp_path, per_task, parts):
    packed = [np.array([10, i] + [10] * (i % 7), "<u4").tobytes() for i in range(500)] + [None]  # 10 is the line end
    folder = tmp_path / "out"
    n = written(spark, str(folder), packed, per_task=per_task, parts=parts)
    assert n == 501
    files = sorted(folder.glob("shard=*/*.txt"), key=lambda f: int(f.parent.name[6:]))
    assert [int(f.parent.name[6:]) for f in files] == list(range(8))  # one file a shard
    assert [f.stat().st_size for f in files] == [64 * SMALL.record_bytes] * 7 + [53 * SMALL.record_bytes]
    rows = {r.slot: r for r in training_order.read_from(spark, str(folder), layout=SMALL).collect()}
    assert sorted(rows) == list(range(501))
    assert sorted(bytes(r.ids) for r in rows.values()) == sorted(p or b"" for p in packed)
    for slot, row in rows.items():
        shard, offset = SMALL.place(slot)
        assert (row.shard, row.offset) == (shard, offset) and row.length == len(row.ids) // 4
        assert training_order.seek(files[shard], slot, SMALL).tobytes() == bytes(row.ids)


def test_reading_resumes_inside_a_shard_and_prunes(spark, tmp_path):
    folder = str(tmp_path / "out")
    written(spark, folder, [np.array([i], "<u4").tobytes() for i in range(500)])
    rest = training_order.read_from(spark, folder, 150, SMALL)
    found = rest.collect()
    whole = {r.slot: r.ids for r in training_order.read_from(spark, folder, 0, SMALL).collect()}
    assert sorted(r.slot for r in found) == list(range(150, 500)) and all(whole[r.slot] == r.ids for r in found)
    by_shard = {}
    for r in found:
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert all(s == sorted(s) for s in by_shard.values())
    assert training_order.read_from(spark, folder, 500, SMALL).count() == 0
    plan = rest._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "shard" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {r.shard for r in found} == set(range(2, 8))


def test_a_damaged_shard_is_noticed(spark, tmp_path):
    folder = tmp_path / "out"
    written(spark, str(folder), [b"\0" * 4] * 70)
    file = next(iter((folder / "shard=1").glob("*.txt")))
    copy = tmp_path / "cut" / "shard=1"
    copy.mkdir(parents=True)
    (copy / "part.txt").write_bytes(file.read_bytes()[:-3])
    with pytest.raises(Exception, match="ends inside a record"):
        training_order.read_from(spark, str(tmp_path / "cut"), 0, SMALL).collect()


def test_sequences_refused(spark):
    for bad in (b"\0" * 36, b"\0" * 5):
        order = training_order.ordered(spark.createDataFrame([(bad,)], "ids binary"), 3, SMALL).records()
        with pytest.raises(Exception, match="longer than"):
            order.collect()


def test_empty_table(spark, tmp_path):
    order = training_order.ordered(spark.createDataFrame([], "ids binary"), 3, SMALL)
    assert (order.records().count(), order.n) == (0, 0)
    training_order.write_shards(order, str(tmp_path / "none"))
    assert training_order.read_from(spark, str(tmp_path / "none"), 0, SMALL).count() == 0


def test_query_holds_every_token(spark, docs_of, tmp_path):
    texts = ["", None, "some words " * 900, "Ünï", "a"] + [f"text {i}" * i for i in range(60)]
    docs_of(enumerate(texts)).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    path = public_tokenizers.path("byte_bpe_50k.json")
    layout = Layout(stride=64)
    rows = training_order.token_sequences(docs, path, layout=layout).collect()
    stream = np.concatenate([np.frombuffer(r.ids, "<u2") for r in rows])
    coder = encoding(path)
    parts = [tuple(coder.encode_ordinary(t or "")) for t in texts]
    assert len(stream) == sum(len(p) + 1 for p in parts)
    cut = np.split(stream, np.flatnonzero(stream == 0) + 1)
    # sequences of a task follow each other, those of different tasks meet at document ends
    assert sorted(tuple(c[:-1].tolist()) for c in cut if len(c)) == sorted(parts)
    found = op3_training_order(spark, str(tmp_path)).collect()
    assert [sorted(r.slot for r in found), {r.shard for r in found}] == [list(range(len(found))), {0}]
    assert sum(r.length for r in found) == len(stream)
    whole = {zlib.crc32(bytes(r.ids)) for r in training_order.token_sequences(docs, path).collect()}
    assert {r.record_crc32 for r in found} == whole
