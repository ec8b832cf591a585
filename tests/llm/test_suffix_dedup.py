import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from evidra.llm import suffix_dedup
from tests.conftest import rows


def brute(source, width):
    first = {}
    for key, text in source:
        body = (text or "").encode()
        if key is not None:
            for i in range(len(body) - width + 1):
                part = body[i:i + width]
                first[part] = min(first.get(part, key), key)
    out = []
    for key, text in source:
        body = (text or "").encode()
        gone = np.zeros(len(body), bool)
        for i in range(len(body) - width + 1):
            if key is not None and first[body[i:i + width]] < key:
                gone[i:i + width] = True
        rest = bytes(b for b, g in zip(body, gone, strict=True) if not g)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((key, len(body), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    letters = "ab \nçé" if seed % 2 else "abcdefghij klm"
    passages = ["".join(rng.choice(letters) for _ in range(rng.choice([49, 50, 51, 80, 200]))) for _ in range(6)]
    out = []
    for i in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.6 else "".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(rng.randrange(6))]
        out.append((rng.randrange(-50, 1 << 40) if i % 7 else i, "".join(parts)))
    out += [(1, None), (2, ""), (None, passages[0]), (3, "a" * 400), (4, "a" * 300), (5, "\0" * 60), (6, "\0" * 61), out[5], out[5],
            (7, passages[1] * 40), (8, passages[1] * 40)]
    return list(dict(out).items()) + [out[5]]


COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(docs_of, monkeypatch, seed):
    source = corpus(seed)
    if seed > 1:
        monkeypatch.setattr(suffix_dedup._stretches, "__defaults__", (700,))
    assert rows(suffix_dedup.remove_repeats(docs_of(source)), *COLUMNS) == brute(source, 50)


def test_other_lengths_and_kept_columns(docs_of):
    source = corpus(9)
    got = suffix_dedup.remove_repeats(docs_of(source), min_length=30, trigger=12, keep=["length", "u"])
    assert rows(got, *COLUMNS) == brute(source, 30)
    assert {(r.length, r.u) for r in got.collect()} == {(1, 2)}


def test_empty_table(docs_of):
    assert suffix_dedup.remove_repeats(docs_of([])).count() == 0


def test_given_documents(spark):
    source = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = suffix_dedup.remove_repeats(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert rows(got, *COLUMNS) == brute(source, 50)


def test_every_window_lies_in_one_phrase():
    data = np.frombuffer(b"some words, and some words again, and then some more words that go on and on", np.uint8)
    found = suffix_dedup.Stretch(data, np.array([0, len(data)]), 20, 9)
    seen = defaultdict(int)
    for start, count in zip(found.start, found.count, strict=True):
        for i in range(count):
            seen[start + i] += 1
    assert dict(seen) == dict.fromkeys(range(len(data) - 19), 1)
