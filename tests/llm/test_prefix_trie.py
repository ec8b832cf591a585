import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra.llm import prefix_trie
from evidra.llm.registry import op11_prefix_trie


def brute(rows, heads=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [(r, t) for _, r, t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % 6 if heads else 0
        base = c - c % 100 if c >= 0 else c + (-c) % 100
        rebuilt[c] = turns.get(base, [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    children, out = defaultdict(list), []
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = children[path]
        leaves[path] = sum(leaves[b] for b in below) or 1
        saved[path] = sum(saved[b] for b in below) + ((len(members[path]) - 1) * len(path[-1][1]) if path else 0)
    for path, who in members.items():
        ends = ",".join(map(str, sorted(c for c in who if len(rebuilt[c]) == len(path))))
        out.append((min(who), len(path), min(members[path[:-1]]) if path else None, len(who), len(children[path]), leaves[path], saved[path],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def cases():
    r = random.Random(8)
    rows = []
    for c in [*range(0, 260), 300, 301, 399, 505, 12345, -7, -100, -101]:
        for turn in range(r.choice([0, 1, 2, 3, 5, 8, 9])):
            rows.append((c, turn, ["user", "assistant"][turn % 2], r.choice(["hi", "no", "", "Ünï çode 漢字 \U0001F600", "x" * 50])))
    for c in range(600, 660):  # one conversation, copied
        rows += [(c, t, "user", f"same {t}") for t in range(9)]
    rows += [(777, t, None if t % 3 else "user", "loop") for t in range(400)]  # a long one
    rows += [(778, None, "system", None), (778, 3, None, "b"), (778, 3, "user", "b"), (778, -1, "user", "first"), (778, 3, "user", "b")]
    rows += [(None, 0, "user", "nobody"), (None, None, None, None)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, c int, first string").repartition(3)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_query_against_brute_force(spark, tmp_path):
    rows = [r for r in cases() if r[:2] != (778, 3)]  # ties of a turn go by a hash, below
    frame(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    result = op11_prefix_trie(spark, str(tmp_path))
    assert result.columns == COLUMNS
    assert sorted(map(tuple, result.collect())) == brute(rows)


def test_ties_repeats_and_references(spark):
    rows = cases()
    first = prefix_trie.trie(frame(spark, rows), prefix_trie.hundred, prefix_trie.head_length).collect()
    again = prefix_trie.trie(frame(spark, rows[::-1]), prefix_trie.hundred, prefix_trie.head_length).collect()
    assert sorted(first) == sorted(again)
    assert max(r.depth for r in first if r.conv_id == 778) >= 4  # the repeated turn counts again
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c not in (None, 778):
            own[c].append((turn, role or "", text or ""))
    stored = {(c, i): t[1:] for c, v in own.items() for i, t in enumerate(sorted(v), 1)}
    nodes = {(r.conv_id, r.depth): r for r in first}
    for r in first:
        if r.depth and r.ref_conv != 778:
            assert (r.ref_conv, r.ref_turn) in stored and (r.parent_conv_id, r.depth - 1) in nodes
        elif not r.depth:
            assert r.ref_conv is None and r.parent_conv_id is None


def test_conversation_over_many_tasks(spark):
    rows = [(5, t, "user", f"t{t % 7}") for t in range(3000)] + [(c, 0, "user", "t0") for c in range(6, 60)]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = prefix_trie.trie(frame(spark, rows), prefix_trie.hundred, lambda c: F.lit(0))
        assert sorted(tuple(r)[:8] for r in found.collect()) == brute(rows, heads=False)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


@pytest.mark.parametrize("piece", [1, 40, 1 << 20])
def test_digests_in_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr(prefix_trie, "PIECE_BYTES", piece)
    r = random.Random(1)
    rows = [(r.choice([1, 1, 1, 2, 3, r.randint(4, 90)]), r.randint(-500, 10**9)) for _ in range(4000)]
    want = defaultdict(list)
    for k, v in rows:
        want[k].append(v)
    found = prefix_trie.ordered_digests(spark.createDataFrame(rows, "k long, v long").repartition(5), ["k"], "v").collect()
    assert {x.k: x.sha256 for x in found} == {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in want.items()}
    assert len(found) == len(want)


def test_products_compose():
    r = np.random.default_rng(0)
    turns = r.integers(0, 2**63, 40).astype(np.uint64)

    def product(x):
        out = 0
        for t in x.tolist():
            out = (out * prefix_trie.BASE + t) % 2**64
        return np.array([out], np.uint64)

    for cut in range(41):
        head, tail = product(turns[:cut]), product(turns[cut:])
        assert prefix_trie.joined(head, tail, np.array([40 - cut])) == product(turns)
        assert prefix_trie.tail_of(product(turns), head, np.array([40 - cut])) == tail


def test_empty_table(spark):
    assert prefix_trie.trie(frame(spark, cases()).limit(0), prefix_trie.hundred, prefix_trie.head_length).count() == 0
