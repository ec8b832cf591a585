import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evidra.llm import packing


def best_fit(lengths, capacity):
    """One piece after the other, longest first, into the fullest bin that still holds it."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fitting = [i for i, r in enumerate(bins) if r >= n]
        if fitting:
            bins[min(fitting, key=lambda i: bins[i])] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=120), st.integers(24, 40))
def test_plan_is_best_fit_decreasing(lengths, capacity):
    histogram = {n: lengths.count(n) for n in set(lengths)}
    runs = packing.plan(histogram, capacity)
    used = defaultdict(list)
    order = list(zip(*[runs[f].tolist() for f in packing.RUN_FIELDS], strict=True))
    for i, (n, first, bin_, per, off) in enumerate(order):
        stop = order[i + 1][1] if i + 1 < len(order) and order[i + 1][0] == n else histogram[n]
        for k in range(stop - first):
            used[bin_ + k // per].append((off + k % per * n, n))
    left = []
    for places in used.values():
        at = 0
        for off, n in sorted(places):
            assert off == at
            at += n
        assert at <= capacity
        left.append(capacity - at)
    assert sorted(left) == best_fit(lengths, capacity)


def test_pack_on_awkward_rows(docs_of):
    source = [(1, "some words here"), (2, None), (3, ""), (None, "no id"), (5, "word " * 5000), (6, "same"), (6, "same"), (7, "0" * 9000)]
    got = packing.pack(docs_of(source), capacity=64, keep_ids=True).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = defaultdict(int)
    for key, text in source:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        first, start = len(ids) % 64 or 64, 0
        for i, end in enumerate(range(first, len(ids) + 1, 64)):
            part = np.array(ids[start:end], dtype="<u4").tobytes()
            want[(key, i, start, end - start, zlib.crc32(part), part)] += 1
            start = end
    have = defaultdict(int)
    for r in got:
        have[(r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids))] += 1
    assert have == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for off, n in sorted(places):
            assert off == at
            at += n
        assert at <= 64
    assert len(bins) == len(best_fit([r.length for r in got], 64))


def test_empty_table(docs_of):
    assert packing.pack(docs_of([])).count() == 0
