import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra.llm import graph_dedup, projection_forest

AWKWARD = [(9001, None), (9002, [0.0] * 16), (9003, [None] + [1.0] * 15), (9004, [float("nan")] * 16), (9005, [float("inf")] + [1.0] * 15),
           (None, [1.0] * 16), (9006, []), (9007, [1.0, 2.0])]
SCHEMA = "vec_id long, embedding array<float>, label int, v int, shard int, part int, id int"


def table(spark, vectors, extra=()):
    rows = [(i, v, 0, 1, 2, 3, 4) for i, v in [*vectors, *extra]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def vectors(seed, n=900, width=16):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, width))
    base[100:400] = base[7] + rng.standard_normal((300, width)) * 0.12  # a large group of near copies
    for i in range(400, 500, 2):
        base[i + 1] = base[i] + rng.standard_normal(width) * 0.1
    base[500:620] = base[3]
    base[620:640] = base[3] * 2.5
    return [(int(i), [float(x) for x in np.float32(v)]) for i, v in zip(rng.permutation(9000)[:n], base, strict=True)]


def nearest(rows, k):
    usable = {i: np.array(v, dtype=float) for i, v in rows}
    out = []
    for q in sorted(i for i in usable if i % 100 == 0):
        ranked = sorted((float(np.sqrt(((usable[i] - usable[q]) ** 2).sum())), i) for i in usable if i != q)[:k]
        out += [(q, r + 1, i, d) for r, (d, i) in enumerate(ranked)]
    return out


@pytest.mark.parametrize("part_rows", [4096, 3])
def test_forest_against_brute_force(spark, part_rows):
    rows = vectors(1)
    df = table(spark, [*rows, rows[0]], AWKWARD)
    whole = projection_forest.neighbours(df, F.col("vec_id") % 100 == 0, depth=4, search_share=1.0, part_rows=part_rows).collect()
    want = nearest(rows, 10)
    assert sorted((r.query_id, r.rank, r.vec_id) for r in whole) == [w[:3] for w in want]
    assert np.allclose(sorted(r.score for r in whole), sorted(w[3] for w in want), rtol=1e-12, atol=0)
    some = projection_forest.neighbours(df, F.col("vec_id") % 100 == 0, depth=4)
    hits = {(r.query_id, r.vec_id) for r in some.collect()} & {(q, i) for q, _, i, _ in want}
    assert len(hits) >= 0.9 * len(want)


def test_ragged_vectors_never_set_the_width(spark):
    rows = vectors(4, n=700)
    want = [w[:3] for w in nearest(rows, 10)]
    lowest = spark.range(20_000, 90_000).orderBy(F.xxhash64("id")).first().id
    rows_and_one = table(spark, rows, [(lowest, [1.0, 2.0])])
    assert rows_and_one.orderBy(F.xxhash64("vec_id")).first().vec_id == lowest
    found = projection_forest.neighbours(rows_and_one, F.col("vec_id") % 100 == 0, depth=4, search_share=1.0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in found) == want


def test_blocks_of_queries_and_one_hot_vector(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 3000)] + [(i, [float(i % 7), 1.0, float(i % 11)]) for i in range(3000, 3400)]
    found = projection_forest.neighbours(table(spark, rows), F.col("vec_id") % 100 == 0, depth=2, search_share=1.0, query_rows=5).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in found) == [w[:3] for w in nearest(rows, 10)]


def test_forest_on_few_rows(spark):
    assert projection_forest.neighbours(table(spark, []), F.col("vec_id") % 100 == 0).count() == 0
    assert projection_forest.neighbours(table(spark, [(100, [1.0] * 16)]), F.col("vec_id") % 100 == 0).count() == 0
    got = projection_forest.neighbours(table(spark, [(100, [1.0] * 16), (3, [2.0] * 16)]), F.col("vec_id") % 100 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(100, 1, 3, 4.0)]


def test_forest_recall_on_the_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    found = projection_forest.neighbours(df, F.col("vec_id") % 100 == 0)
    truth = spark.createDataFrame(nearest(rows, 10), "query_id long, rank int, vec_id long, score double")
    assert projection_forest.recall(found, truth) >= 0.9


def links(rows, threshold):
    ids = [i for i, _ in rows]
    unit = np.array([v for _, v in rows], dtype=float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= threshold
    np.fill_diagonal(near, False)
    root = {i: i for i in ids}
    for _ in range(len(ids)):
        new = {ids[r]: min([root[ids[r]], *[root[ids[c]] for c in np.flatnonzero(near[r])]]) for r in range(len(ids))}
        if new == root:
            break
        root = new
    return {i: (int(near[r].sum()), root[i], root[i] == i) for r, i in enumerate(ids)}


@pytest.mark.parametrize(("shard_rows", "part_rows"), [(2048, 4096), (150, 4096), (150, 60)])
def test_graph_against_brute_force(spark, shard_rows, part_rows):
    rows = vectors(2)
    found, audit = graph_dedup.near_duplicates(table(spark, [*rows, rows[0]], AWKWARD), shard_rows=shard_rows, part_rows=part_rows)
    got = found.collect()
    assert len(got) == len(rows) + 1 + len(AWKWARD)
    want = links(rows, 0.95)
    lone = {i: (0, i, True) for i, _ in AWKWARD if i is not None} | {None: (0, None, False)}
    have = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert {i: have[i] for i in lone} == lone
    total = sum(n for n, *_ in want.values())
    assert sum(abs(have[i][0] - want[i][0]) for i in want) <= 0.02 * total
    assert sum(have[i][1:] == want[i][1:] for i in want) >= 0.99 * len(want)
    a = audit.first()
    assert a.found_links >= 0.98 * a.true_links


def test_graph_on_few_rows(spark):
    assert graph_dedup.near_duplicates(table(spark, []))[0].count() == 0
    got = graph_dedup.near_duplicates(table(spark, [(7, [1.0] * 16)]))[0].collect()
    assert [tuple(r) for r in got] == [(7, 0, 7, True)]


def test_graph_on_the_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = links([(r.vec_id, r.embedding) for r in df.collect()], 0.95)
    have = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in graph_dedup.near_duplicates(df)[0].collect()}
    assert sum(have[i] == want[i] for i in want) >= 0.99 * len(want)


def family(n, others, width=64, seed=4):
    """Distinct near copies of one vector, pairs at a cosine of about 0.96, and as many others."""
    rng = np.random.default_rng(seed)
    base = rng.standard_normal(width)
    base /= np.linalg.norm(base)
    rows = np.concatenate((base + rng.standard_normal((n, width)) * 0.2 / np.sqrt(width), rng.standard_normal((others, width))))
    return [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(rows)]


def test_a_family_over_dozens_of_centroids(spark):
    rows = family(2000, 4000)
    found, audit = graph_dedup.near_duplicates(table(spark, rows), shard_rows=60, part_rows=400)
    have = {r.vec_id: r.n_links for r in found.collect()}
    unit = np.array([v for _, v in rows], dtype=float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    assert want.sum() > 2_000_000 and sum(have.values()) >= 0.99 * want.sum() and all(have[i] <= want[i] for i in have)
    true, hit = audit.first()
    assert hit >= 0.99 * true > 0


def test_the_audit_sees_links_across_shards(spark, monkeypatch):
    rows = family(600, 600)
    monkeypatch.setattr(graph_dedup, "merged", lambda centres, threshold: np.arange(len(centres)))  # tears the family apart
    found, audit = graph_dedup.near_duplicates(table(spark, rows), shard_rows=20, overlap=1)
    true, hit = audit.first()
    unit = np.array([v for _, v in rows], dtype=float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    assert len(rows) > graph_dedup.AUDITED and hit < 0.7 * true
    monkeypatch.setattr(graph_dedup, "AUDITED", len(rows))
    true, hit = graph_dedup.near_duplicates(table(spark, rows), shard_rows=20, overlap=1)[1].first()
    assert true == (unit @ unit.T >= 0.95).sum() - len(rows)
