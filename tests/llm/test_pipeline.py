from collections import Counter

import pytest

import corpus_pipeline
from evidra.llm import toxicity
from tests.llm import test_jaccard_join, test_suffix_dedup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def source(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in given.select(*corpus_pipeline.COLUMNS).collect()]
    long = max(rows, key=lambda r: len(r[1]))[1]
    rows += [(None, "no id at all", "en", None, 12), (90001, None, None, "s", None), (90002, "", "en", "s", 0), rows[0], rows[0],
             (90003, "é" * 30 + long[:300] + "ü" * 30, "de", "s", 360)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, u int, key int")
    return frame.repartition(4)


def test_stages_against_brute_force(spark, source):
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, source, SF)
    assert clean.columns == corpus_pipeline.COLUMNS
    model = toxicity.train(source, spark.read.parquet(f"{SF}/labels.parquet"))
    want = [tuple(r) for r in source.select(*corpus_pipeline.COLUMNS).collect() if model.scores([toxicity.terms(r.text or "")])[0] < 0.3]
    kept = [tuple(r) for r in clean.collect()]
    assert Counter(kept) == Counter(want) and len(kept) < source.count()

    single = stages["jaccard_join"](spark, clean, SF)
    assert single.columns == corpus_pipeline.COLUMNS
    groups = test_jaccard_join.brute([(r[0], r[1]) for r in kept], 5, 80)
    stays = {k for k, _, c in groups if k == c}
    left = [tuple(r) for r in single.collect()]
    assert Counter(left) == Counter(dict.fromkeys((r for r in kept if r[0] in stays), 1))

    cut = stages["suffix_dedup"](spark, single, SF)
    assert cut.columns == corpus_pipeline.COLUMNS
    removed = {k: (n, r) for k, n, r, *_ in test_suffix_dedup.brute([(r[0], r[1]) for r in left], 50)}
    got = {r.doc_id: r for r in cut.collect()}
    before = {r[0]: r for r in left}
    assert set(got) == set(before)
    for key, row in got.items():
        if removed[key][1] == 0:
            assert tuple(row) == before[key]
        else:
            assert removed[key][0] - removed[key][1] - 8 <= len(row.text.encode()) <= removed[key][0] - removed[key][1]
            assert row.n_chars == len(row.text) and "\N{REPLACEMENT CHARACTER}" not in row.text

    packed = stages["best_fit_packing"](spark, cut, SF).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(list(got))
    used = Counter()
    for r in packed:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, docs.select(*columns).collect())) == Counter(map(tuple, corpus_pipeline.run(spark, SF).select(*columns).collect()))


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
