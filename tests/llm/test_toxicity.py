import random

import numpy as np
import pytest

from evidra.llm import toxicity


def corpus(n, seed):
    """Toxic exactly when an insult meets a group: neither alone is."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 40))]
        kind = rng.randrange(4)
        words += ["insult"] * (kind in (1, 3)) + ["group"] * (kind in (2, 3))
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(kind == 3)))
    return rows


def test_pairs_of_terms_are_learnt():
    rows = corpus(3000, 1)
    model = toxicity.fit([toxicity.terms(t) for _, t, _ in rows], np.array([y for *_, y in rows], dtype=float), epochs=60)
    fresh = corpus(1000, 2)
    found = model.scores([toxicity.terms(t) for _, t, _ in fresh]) >= 0.5
    assert (found == np.array([y for *_, y in fresh], dtype=bool)).mean() > 0.97


def test_scores_on_awkward_rows(spark, docs_of):
    rows = corpus(800, 3)
    docs = docs_of([(i, t) for i, t, _ in rows] + [(None, "insult group"), (9001, None), (9002, ""), (9003, "word " * 200_000 + "insult group"), (5, rows[5][1])])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model, keep=["key"]).collect()
    assert len(got) == 805
    by_id = {r.doc_id: r for r in got}
    assert all(r.held_out == (r.doc_id is not None and toxicity.crc_held_out(r.doc_id)) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert by_id[9001].score == by_id[9002].score
    assert len({r.score for r in got if r.doc_id == 5}) == 1
    alone = model.scores([toxicity.terms(rows[5][1])])[0]
    assert by_id[5].score == pytest.approx(alone)


def test_without_labels_or_rows(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs_of([(1, "a")]), none)
    assert [r.predicted for r in toxicity.score(docs_of([(1, "a")]), model).collect()] == [0]
    assert toxicity.score(docs_of([]), model).count() == 0


def test_held_out_rows_of_the_given_table(spark):
    """Held-out accuracy on the driver's smallest whole table with enough labels."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scored = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    hit = ((scored.predicted == 1) & (scored.toxic == 1)).sum()
    assert hit / (scored.predicted == 1).sum() > 0.9 and hit / (scored.toxic == 1).sum() > 0.85


def test_score_is_the_double_loop_over_pairs():
    rng = np.random.default_rng(1)
    model = toxicity.Model(toxicity.BITS, 0.3, np.arange(40), rng.normal(size=40), rng.normal(size=(40, 8)))
    rows = [np.unique(rng.integers(0, 60, n)).astype(np.int32) for n in (0, 1, 2, 7, 25)]
    for row, found in zip(rows, model.scores(rows), strict=True):
        known = [t for t in row if t < 40]
        margin = model.bias + sum(model.weight[t] for t in known)
        margin += sum(float(model.factors[a] @ model.factors[b]) for i, a in enumerate(known) for b in known[i + 1:])
        assert found == pytest.approx(1 / (1 + np.exp(-margin)))


def test_repeated_ids_reach_the_driver_once(spark, docs_of, monkeypatch):
    docs = docs_of([(i, f"text {i} {n % 3}") for i in range(4) for n in range(500)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)] * 50, "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda rows, toxic, bits: seen.append(len(rows)))
    toxicity.train(docs, labels, sample_rows=2)
    assert seen == [2]
