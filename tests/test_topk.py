import random
from collections import defaultdict

import pytest

from evidra.operators import topk


def case(seed, n_items=400, n_terms=40, n_queries=12):
    r = random.Random(seed)
    share = [r.choice([0.01, 0.05, 0.2, 0.6]) for _ in range(n_terms)]
    matches = [(i, f"t{t}", r.choice([1, 1, 2, 3])) for i in range(n_items) for t in range(n_terms) if r.random() < share[t]]
    idf = {f"t{t}": round(1 + (1 - share[t]) * 6 * r.random(), 3) for t in range(n_terms)}
    weights = [(q, t, idf[t]) for q in range(n_queries) for t in r.sample(sorted(idf), r.randint(1, 15))]
    return matches, weights, {i for i in range(n_items) if r.random() < 0.7}


def brute(matches, weights, first, k):
    idf = defaultdict(dict)
    for q, t, x in weights:
        idf[q][t] = x
    scores = defaultdict(float)
    for i, t, w in matches:
        for q in idf:
            if t in idf[q]:
                scores[q, i] += w * idf[q][t]
    best, counts = set(), defaultdict(int)
    for q in idf:
        rows = sorted(((i in first, round(s, 9), i) for (x, i), s in scores.items() if x == q), key=lambda x: (-x[0], -x[1], x[2]))
        counts[q] = len(rows)
        best |= {(q, i, s) for _, s, i in rows[:k]}
    return best, dict(counts), len(scores)


@pytest.mark.parametrize(("seed", "k"), [(1, 1), (2, 3), (3, 10), (4, 500)])
def test_best_items_and_counts_against_brute_force(spark, seed, k):
    matches, weights, first = case(seed)
    m = spark.createDataFrame(matches, "item_id long, term string, weight int")
    w = spark.createDataFrame(weights, "query_id long, term string, idf double")
    f = spark.createDataFrame([(i,) for i in first], "item_id long")
    best, counts, _ = brute(matches, weights, first, k)
    for limit in (0, topk.PLAIN_POSTINGS):
        found = [(r.query_id, r.item_id, round(r.score, 9)) for r in topk.top_scores(m, w, f, k, limit).collect()]
        assert best <= set(found) and len(found) == len(set(found))
    items = spark.createDataFrame([(i, 7 * i) for i in range(400)], "item_id long, ord int")
    assert {r.query_id: r.n for r in topk.positive_counts(m, w, items).collect()} == {q: n for q, n in counts.items() if n}


def test_few_pairs_are_formed_and_ties_stay(spark):
    matches = [(i, "common", 1) for i in range(3000)] + [(i, "usual", 1) for i in range(0, 3000, 2)]
    matches += [(i, f"rare{i // 30 % 40}", 3) for i in range(0, 3000, 30)]
    weights = [(q, t, x) for q in range(40) for t, x in (("common", 1.0), ("usual", 1.4), (f"rare{q}", 6.0))]
    m = spark.createDataFrame(matches, "item_id long, term string, weight int")
    w = spark.createDataFrame(weights, "query_id long, term string, idf double")
    f = spark.createDataFrame([(i,) for i in range(3000)], "item_id long")
    best, _, pairs = brute(matches, weights, set(range(3000)), 2)
    found = topk.candidates(m, w, f, 2)
    assert found.count() < pairs / 10
    assert {(q, i) for q, i, _ in best} <= {tuple(x) for x in found.collect()}


def test_empty_sides(spark):
    m = spark.createDataFrame([], "item_id long, term string, weight int")
    w = spark.createDataFrame([(1, "a", 1.0)], "query_id long, term string, idf double")
    f = spark.createDataFrame([], "item_id long")
    assert topk.top_scores(m, w, f, 3).count() == 0
    assert topk.positive_counts(m, w, spark.createDataFrame([], "item_id long, ord int")).count() == 0
