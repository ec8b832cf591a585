import random
import re
from itertools import combinations

import numpy as np
import pytest

from evidra.llm import common, jaccard_join
from tests.conftest import rows


def shingles(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(found[i:i + words]) for i in range(len(found) - words + 1)} or ({tuple(found)} if found else set())


def brute(source, words, percent):
    sets = [shingles(t, words) for _, t in source]
    root = {k: k for k, _ in source}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for (i, a), (j, b) in combinations(enumerate(sets), 2):
        ka, kb = source[i][0], source[j][0]
        if a and ka is not None and kb is not None and 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((find(ka), find(kb)))
            root[y] = x
    return sorted(((k, len(s), find(k) if k is not None else None) for (k, _), s in zip(source, sets, strict=True)), key=repr)


def corpus(seed, copies=40):
    rng = random.Random(seed)
    word = lambda: rng.choice(["Tá", "b", "C", "dd", "E1", "f."]) + str(rng.randrange(40))
    texts = [[word() for _ in range(rng.choice([1, 2, 3, 5, 30, 60, 200]))] for _ in range(30)]
    base = [word() for _ in range(80)]
    line = [word() for _ in range(12)]
    for i in range(copies):
        near = list(base)
        for _ in range(rng.randrange(6)):
            near[rng.randrange(len(near))] = word()
        texts.append(near)
        texts.append(line + [word() for _ in range(rng.randrange(4))])
        near = list(texts[i % 30])
        near[rng.randrange(len(near))] = word()
        texts.append(near)
    out = [(rng.randrange(10**12) * 8, " ".join(t) if i % 5 else "\t ".join(t).upper()) for i, t in enumerate(texts)]
    return out + [(1, None), (2, ""), (3, " \n"), (None, out[0][1]), out[7], (5, out[7][1]), (6, "long " * 3000), (7, "long " * 3001)]


@pytest.mark.parametrize(("seed", "words", "percent", "short"), [(0, 3, 90, 8), (1, 5, 80, 8), (2, 3, 90, 2), (3, 2, 60, 3)])
def test_equals_brute_force(docs_of, monkeypatch, seed, words, percent, short):
    monkeypatch.setattr(jaccard_join, "SHORT_LIST", short)
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "WHOLE_FAMILY", 12)
    monkeypatch.setattr(jaccard_join, "LARGE_SET", 20 if seed % 2 else 1500)
    source = corpus(seed)
    got = jaccard_join.similarity_components(docs_of(source), words, percent)
    assert rows(got, "doc_id", "n_shingles", "component_id") == brute(source, words, percent)


def test_empty_table(docs_of):
    assert jaccard_join.similarity_components(docs_of([])).count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    source = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows(jaccard_join.similarity_components(docs, 3, 90), "doc_id", "n_shingles", "component_id") == brute(source, 3, 90)


@pytest.mark.parametrize("large", [50, 1500])
def test_bounds_never_refuse_a_link(monkeypatch, large):
    monkeypatch.setattr(jaccard_join, "LARGE_SET", large)
    rng = np.random.default_rng(1)
    refused = 0
    for _ in range(300):
        n = int(rng.integers(1, 4000))
        a = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
        b = a.copy()
        b[rng.random(len(b)) < rng.choice([0.05, 0.1, 0.3])] += np.uint64(1 << 17)
        b = np.unique(b)
        bits = [np.packbits((np.bincount((x & np.uint64(1023)).astype(np.int64), minlength=1024) & 1).astype(np.uint8)).view(np.uint64) for x in (a, b)]
        cells = [np.bincount(((x >> np.uint64(16)) % np.uint64(512)).astype(np.int64), minlength=512).astype(np.uint8) for x in (a, b) if len(x) > large]
        bounds = jaccard_join.Bounds(np.array([len(a), len(b)]), np.array(bits), np.concatenate([np.empty(0, np.uint8), *cells]), 80)
        may = bounds.may_link(np.array([0]), np.array([1]))[0]
        assert may or 100 * len(np.intersect1d(a, b)) < 80 * len(np.union1d(a, b))
        refused += not may
    assert refused > 50


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (50, 70), (70, 100), (5, 5), (None, 3), (200, 199)]
    got = common.components(spark.createDataFrame(edges, "a long, b long"))
    want = [(i, 1) for i in range(1, 41)] + [(50, 50), (70, 50), (100, 50), (199, 199), (200, 199)]
    assert rows(got, "node", "component") == sorted(want, key=repr)
