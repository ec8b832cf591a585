import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from evidra.llm import periodic_runs
from evidra.llm.registry import op13_periodic_runs

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, least_words=6, repeats=4):
    """Every maximal stretch with equal words q apart, once, under its smallest period."""
    found = {}
    n = len(words)
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least_words, repeats * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted((a, length, q) for (a, length), q in found.items())


def brute_row(doc, text):
    words = SPLIT.findall(text or "")
    n = len(words)
    if doc is not None:
        h = zlib.crc32(str(doc).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    dropped = {i for a, length, q in runs for i in range(a + q, a + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
            sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


@pytest.mark.parametrize("letters,seed", [("a", 0), ("ab", 1), ("ab", 2), ("abc", 3), ("abcd", 4), ("abcdefgh", 5)])
def test_runs_against_brute_force(letters, seed):
    r = random.Random(seed)
    for _ in range(150):
        parts = ["".join(r.choice(letters) for _ in range(r.randint(1, 7))) * r.randint(1, 9) for _ in range(r.randint(0, 6))]
        words = list("".join(parts))
        ids = np.array([ord(w) for w in words], np.int32)
        assert periodic_runs.runs_of(ids) == brute_runs(words)
        ids6 = periodic_runs.runs_of(ids, 10, 5)
        assert ids6 == brute_runs(words, 10, 5)


def test_long_periods_and_long_texts():
    r = np.random.default_rng(3)
    root = r.integers(0, 3, 5000).astype(np.int32)
    text = np.concatenate([r.integers(0, 3, 777), np.tile(root, 5)[:22000], r.integers(0, 3, 999)]).astype(np.int32)
    found = [x for x in periodic_runs.runs_of(text) if x[2] > 1000]
    assert len(found) == 1 and found[0][2] == 5000 and found[0][1] >= 22000 and found[0][0] <= 777
    ones = np.zeros(300_000, np.int32)
    assert periodic_runs.runs_of(ones) == [(0, 300_000, 1)]


def test_splitting_keeps_segments_of_frequent_words_only():
    ids = np.array([1, 1, 1, 1, 1, 1, 9, 2, 3, 2, 3, 2, 3, 2, 3, 8, 1, 1], np.int32)
    assert sorted(periodic_runs.segments(ids)) == [(0, 6), (7, 15)]


def test_slices_cut_no_word(monkeypatch):
    text = ("ab  c\t" * 500 + "x" * 900 + " \n d").encode()
    assert [w for part in periodic_runs.word_slices(text, 7) for w in part] == text.split()


TEXTS = [None, "", "   \t\n", "one", "x " * 7, "a b " * 5, "a b c " * 4 + "a b d", "ha\x85ha \x0bha\x1cha " * 9, "Ž ñ " * 6 + "tail",
         "w w " * 8, "a a a a a a b a a a a a a b " * 5, " ".join(f"w{i}" for i in range(4000)), "q " * 50_000]


def test_query_against_brute_force(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "a b " * 9), (4, "x " * 7), (4, "other text")]
    rows += [(i, " ".join(random.Random(i).choice("abcdefghij") for _ in range(i % 90))) for i in range(100, 400)]
    frame = spark.createDataFrame([(*r, 1, "k", []) for r in rows], "doc_id long, text string, runs int, key string, start array<int>").repartition(3)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    result = op13_periodic_runs(spark, str(tmp_path))
    assert result.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, result.collect()), key=repr) == sorted((brute_row(*r) for r in rows), key=repr)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(100, 400)) > 10


def test_empty_table_and_bad_limits(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert periodic_runs.digests(periodic_runs.find_runs(docs)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find_runs(docs, least_repeats=3)


def test_one_pass_without_a_shuffle(spark, docs_of):
    plan = periodic_runs.digests(periodic_runs.find_runs(docs_of([(1, "a")]).coalesce(1)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the fixture's own repartition
