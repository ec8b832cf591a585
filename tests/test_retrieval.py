import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from evidra.functions.embedding import hashing_embedding, select_backend
from evidra.functions.text import entity_token_variants, query_language
from evidra.operators import matching, retrieval, search, tokenize
from tests.conftest import rows

CJK = "zh string, en array<string>, canonical string, ord bigint"
ALIAS = "canonical string, zh array<string>, en array<string>"


def brute_token(token, text):
    if re.match(r"^[a-z0-9]{1,2}$", token):
        return re.search(rf"\b{re.escape(token)}\b", text) is not None
    return token in text


def brute_keyword(term, text):
    if re.fullmatch(r"[a-z0-9][a-z0-9\-]*", term):
        return re.search(rf"\b{re.escape(term)}\b", text) is not None
    return term in text


def random_texts(n, seed):
    rng = random.Random(seed)
    parts = ["ad", "adult", "il-31", "a b", "皮肤", "屏障 x", "gut-skin", "é", "th2", "foil 4", "-", "ab-", "x.y", "ad,", "(ad)"]
    return [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 7))) for _ in range(n)]


def test_matching_equals_brute_force(spark):
    texts = random_texts(120, 1)
    terms = ["ad", "a", "il", "il-31", "皮", "皮肤", "屏障 x", "il 4", "a b", "-", "b-", "th2", "x.y", "dul", "é", "4", "oil 4", "gut"]
    table = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    term_table = spark.createDataFrame([(t,) for t in terms], "term string")
    for matcher, brute in ((matching.TOKEN, brute_token), (matching.KEYWORD, brute_keyword), (matching.SUBSTRING, lambda t, x: t in x)):
        want = sorted((i, t) for i, x in enumerate(texts) for t in terms if brute(t, x))
        index = matching.build_index(table, ["id"], {"text": F.col("text")})
        got = matching.match_index(index, term_table, matcher)
        assert sorted((r.id, r.term) for r in got.collect()) == want
        short = matching.match_texts(table, term_table, ["id"], matcher=matcher)
        assert sorted((r.id, r.term) for r in short.collect()) == want


def test_tokenize_cjk_longest_first_and_bridge(spark):
    cjk = spark.createDataFrame(
        [("雷公藤多苷", ["tripterygium glycosides"], "twg", 0), ("雷公藤", ["tripterygium"], "", 1)], CJK)
    alias = spark.createDataFrame([("ad", ["特应性皮炎"], ["atopic dermatitis", "ad"])], ALIAS)
    formulas = spark.createDataFrame([("formula-1", "消风散", "Xiaofengsan", ["herb-1"])], "id string, name string, pinyin string, herb_ids array<string>")
    herbs = spark.createDataFrame([("herb-1", "黄芪", "huangqi", "Astragalus")], "id string, name string, pinyin string, latin_name string")
    entities = tokenize.entity_alias_table(formulas, herbs)
    queries = spark.createDataFrame([(1, "雷公藤多苷治"), (2, "AD in adults"), (3, "adult gradient"), (4, "消风散")], "query_id int, text string")
    tokens = {}
    for r in tokenize.tokenize_queries(queries, cjk, alias, entities).collect():
        tokens.setdefault(r.query_id, set()).add(r.token)
    # the shorter term's own cut finds nothing left, so only 治 remains
    assert tokens[1] == {"tripterygium glycosides", "twg", "tripterygium", "治"}
    assert tokens[2] == {"ad", "in", "adults", "特应性皮炎"}
    assert tokens[3] == {"adult", "gradient"}
    assert {"formula-1", "formula", "herb-1"} <= tokens[4]


def test_search_terms_and_broad_query(spark):
    queries = spark.createDataFrame([(1, "AD"), (2, "gut flora"), (3, "xyz")], "query_id int, text string")
    terms = tokenize.tokenize_searches(queries)
    assert ("atopic dermatitis",) in rows(terms.where("query_id = 1"), "term")
    assert ("gut-skin",) in rows(terms.where("query_id = 2"), "term")
    assert rows(tokenize.broad_disease_queries(terms)) == [(1,)]


def corpus(spark):
    schema = "item_id string, title string, abstract string, evidence_tags array<string>, source_type string, record_origin string, year int, ord int"
    return spark.createDataFrame([
        ("a", "Gut barrier", "filaggrin in skin", ["gut_skin_axis"], "pubmed", "pubmed_live", 2020, 0),
        ("b", "Skin", "gut gut gut", ["immune"], "pubmed", "seed_sample", 2024, 1),
        ("c", "Other", "nothing here", [], "cn_literature", "pubmed_live", 2022, 2),
    ], schema)


def test_keyword_ranking_real_first_and_max_weight(spark):
    queries = spark.createDataFrame([(1, "gut")], "query_id int, text string")
    tokens = spark.createDataFrame([(1, "gut")], "query_id int, token string")
    canonical = spark.createDataFrame([("gut",)], "token string")
    ranked = retrieval.rank_keyword(queries, corpus(spark), tokens, canonical=canonical)
    idf = np.log(4 / 3) + 1
    got = {r.item_id: (round(r.score, 6), r.rank) for r in ranked.collect()}
    # title weight 3 plus one canonical token inside a tag (x2); real evidence ranks first
    assert got == {"a": (round(3 * idf + 2, 6), 1), "b": (round(idf, 6), 2)}


def test_chunks_share_item_tokens(spark):
    chunks = spark.createDataFrame([("a1", "a", "cytokine"), ("a2", "a", "gut cytokine")], "chunk_id string, item_id string, text string")
    tokens = spark.createDataFrame([(1, "cytokine"), (1, "barrier")], "query_id int, token string")
    scores = retrieval.keyword_scores(corpus(spark), tokens, chunks)
    idf = np.log(4 / 2) + 1
    got = {(r.item_id, r.chunk_id): round(r.score, 6) for r in scores.collect()}
    assert got == {("a", "a1"): round(4 * idf, 6), ("a", "a2"): round(4 * idf, 6)}


def test_fallback_order_without_hits(spark):
    queries = spark.createDataFrame([(1, "zzz")], "query_id int, text string")
    none = spark.createDataFrame([], "query_id int")
    got = retrieval.fallback_candidates(corpus(spark), queries, none, 2)
    assert [r.item_id for r in got.orderBy("rank").collect()] == ["a", "c"]


def test_chinese_text_is_cut_at_its_marks(spark):
    texts = spark.createDataFrame([
        (1, "特应性皮炎，皮肤屏障受损。　黄芩苷抑制 IL-4、IL-13表达！"), (2, "皮肤，屏障"), (3, "长" * 5000 + "；黄芩苷"), (4, "，。"), (5, None)], "i int, text string")
    terms = spark.createDataFrame([(t,) for t in ("皮肤屏障", "皮肤，屏障", "黄芩苷", "il-13表达", "炎，皮", "，", "受损。")], "term string")
    index = matching.build_index(texts, ["i"], {"text": F.col("text")})
    assert max(len(r.unit) for r in index.vocabulary().collect() if r.unit[-1] == "c") == 3  # pairs of signs and their kind
    found = matching.match_index(index, terms, matching.SUBSTRING).collect()
    want = {(i, t.term) for i, x in texts.collect() for t in terms.collect() if x and t.term in x.lower() and t.term != "，"}
    assert {(r.i, r.term) for r in found} == want and len(want) == 7


def test_index_against_brute_force_over_fields(spark, monkeypatch):
    rng = random.Random(6)
    parts = ["ad", "adx", "ad治", "治疗", "皮肤屏障", "屏", "x y", "a,b", "-", "il-31", "。", "\n", "é", "foo", "皮"]
    make = lambda n: rng.choice(["", " "]).join(rng.choice(parts) + rng.choice(["", " ", "  "]) for _ in range(rng.randint(0, n)))
    docs = [(i, make(5), make(2), make(9)) for i in range(150)]
    terms = {make(3) for _ in range(150)} | {"ad", "治", "治疗", "肤屏障", "x", "ad 治", " ad", "ad ", "d治疗皮", "y a,b", "屏 屏", "  ", "foo ad"}
    table = spark.createDataFrame([(*d, 1, "z") for d in docs], "id int, a string, b string, c string, field int, unit string").repartition(3)
    term_table = spark.createDataFrame([(t,) for t in terms], "term string")
    for part_chars in (matching.PART_CHARS, 40):
        monkeypatch.setattr(matching, "PART_CHARS", part_chars)
        for matcher, brute in ((matching.TOKEN, brute_token), (matching.KEYWORD, brute_keyword)):
            index = matching.build_index(table, ["id"], {n: F.col(n) for n in "abc"})
            got = {(r.id, r.term): r.fields for r in matching.match_index(index, term_table, matcher).collect()}
            once = {(r.id, r.term): r.fields for r in matching.match_fields(table, ["id"], {n: F.col(n) for n in "abc"}, term_table, matcher).collect()}
            want = {}
            for i, *texts in docs:
                for t in terms:
                    if matching.UNIT.search(t) is None:
                        continue
                    inside = sum(brute(t, x) << n for n, x in enumerate(texts))
                    if inside or brute(t, " ".join(texts)):
                        want[i, t] = inside or 1 << matching.CROSSING
            assert got == want and once == want


def test_index_keeps_positions_gap_coded(spark):
    table = spark.createDataFrame([(1, "gut skin gut", "gut")], "id int, a string, b string")
    index = matching.build_index(table, ["id"], {"a": F.col("a"), "b": F.col("b")})
    entries = {(e.unit, e.field): e.gaps for e in index.postings.collect()}
    assert entries == {("gut0", 0): [0, 9], ("skin0", 0): [4], ("gut0", 1): [13]}


def test_document_frequency_of_phrases_over_fields_and_chunks(spark):
    schema = "item_id string, title string, keywords array<string>, abstract string"
    items = spark.createDataFrame([("a", "the skin", ["barrier", "gut"], "ends here"), ("b", "skin barrier", [], "x"), ("c", "no", [], "last")], schema)
    chunks = spark.createDataFrame([("a1", "a", "now begins"), ("a2", "a", "and stops"), ("c1", "c", "word")], "chunk_id string, item_id string, text string")
    tokens = spark.createDataFrame([(1, t) for t in (
        "skin barrier", "barrier gut", "gut ends", "here now", "here and", "begins the", "last word", "stops the", "begins   the")], "query_id int, token string")
    _, _, held = retrieval.match_candidates(items, chunks, tokens)
    # keywords, two empty fields and the snippet lie between gut and ends; a chunk's two empty fields before the next title
    assert {tuple(r) for r in held.distinct().collect()} == {
        ("a", "skin barrier"), ("b", "skin barrier"), ("a", "barrier gut"), ("a", "here now"), ("a", "here and"), ("c", "last word"), ("a", "begins   the")}


def test_stop_share_is_the_callers(spark):
    items = spark.createDataFrame([(i,) for i in range(6)], "item_id int")
    matched = spark.createDataFrame([(i, "all") for i in range(6)] + [(i, "half") for i in range(3)], "item_id int, term string")
    free = {r.token: r.idf for r in retrieval.token_idf(matched, items).collect()}
    stopped = {r.token: r.idf for r in retrieval.token_idf(matched, items, 0.5).collect()}
    assert free["all"] == 1.0 and stopped["all"] == 0.0 and free["half"] == stopped["half"] > 1


def test_fallback_names_every_chunk(spark):
    queries = spark.createDataFrame([(1, "zzz")], "query_id int, text string")
    none = spark.createDataFrame([], "query_id int")
    chunks = spark.createDataFrame([("a2", "a"), ("a1", "a")], "chunk_id string, item_id string")
    got = retrieval.fallback_candidates(corpus(spark), queries, none, 3, chunks)
    assert [(r.item_id, r.chunk_id) for r in got.orderBy("rank").collect()] == [("a", "a1"), ("a", "a2"), ("c", None)]


def test_vector_top_k_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "CELL_BYTES", 900)  # many cells
    monkeypatch.setattr(retrieval, "CELL_SCORES", 40)
    vectors = [(i, [float((i * 7) % 5), float((i * 3) % 4)] if i != 11 else None) for i in range(120)]
    df = spark.createDataFrame(vectors, "vec_id long, vec array<double>")
    found = retrieval.vector_top_k(df.where("vec_id % 9 = 0").select(F.col("vec_id").alias("query_id"), F.col("vec").alias("qvec")), df, 6)
    want = []
    for q, qv in vectors[::9]:
        scored = sorted((-sum(x * y for x, y in zip(qv, v)), i) for i, v in vectors if v is not None)
        want += [(q, i, -s, n + 1) for n, (s, i) in enumerate(scored[:6])]
    assert sorted((r.query_id, r.vec_id, r.score, r["rank"]) for r in found.collect()) == sorted(want)
    assert retrieval.vector_top_k(df.where("false").selectExpr("vec_id AS query_id", "vec AS qvec"), df, 6).count() == 0


def test_every_strategy_has_one_calling_convention(spark):
    queries = spark.createDataFrame([(1, "cytokine"), (2, "zzz")], "query_id int, text string")
    tokens = spark.createDataFrame([(1, "cytokine"), (2, "zzz")], "query_id int, token string")
    chunks = spark.createDataFrame([("a1", "a", "cytokine one"), ("a2", "a", "other")], "chunk_id string, item_id string, text string")
    n_items = corpus(spark).count()
    for name, rank in retrieval.STRATEGIES.items():
        found = rank(queries, corpus(spark), tokens, chunks, None, 50).collect()
        per_query = {q: [(r.item_id, r.chunk_id) for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] for q in (1, 2)}
        assert all(len(set(v)) == len(v) for v in per_query.values())
        if name == "vector":  # both chunks, then the items without any
            assert per_query[1][0] == ("a", "a1") and all(len(v) == n_items + 1 and v[2][1] is None for v in per_query.values())
        if name == "hybrid":  # a question without a hit still takes the first unscored candidates
            assert len(per_query[2]) == n_items + 1


def test_rank_fusion_arithmetic(spark):
    schema = "query_id int, item_id string, chunk_id string, score double, bonus int, year int"
    kw = spark.createDataFrame([(1, "a", "_", 5.0, 0, 2020), (1, "b", "_", 3.0, 0, 2020)], schema)
    vec = spark.createDataFrame([(1, "b", "_", 2.0, 0, 2020), (1, "c", "_", 1.0, 0, 2020)], schema)
    heads = [retrieval.list_heads(df, n, [F.desc("score")], 50) for n, df in enumerate((kw, vec))]
    got = [(r.item_id, r.score, round(r.rrf, 12)) for r in retrieval.fuse(heads).orderBy("rank").collect()]
    assert got == [("b", 3, round(1 / 62 + 1 / 61, 12)), ("a", 2, round(1 / 61, 12)), ("c", 1, round(1 / 62, 12))]


def test_vector_top_k_exact_and_empty(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(60, 8))
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id int, vec array<double>").repartition(3)
    queries = table.where("vec_id < 5").selectExpr("vec_id as query_id", "vec as qvec")
    got = {}
    for r in retrieval.vector_top_k(queries, table, 4).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    for q in range(5):
        want = sorted(range(60), key=lambda i: (-float(vectors[q] @ vectors[i]), i))[:4]
        assert [got[q][k] for k in range(1, 5)] == want
    assert retrieval.vector_top_k(queries, table, 0).count() == 0


def test_hashing_embedding_rule(spark):
    df = spark.createDataFrame([(1, "gut gut 屏"), (2, "  "), (3, "gut")], "id int, text string")
    got = {r.id: np.array(r.v) for r in df.select("id", select_backend("unknown")(F.col("text")).alias("v")).collect()}
    assert got[2][0] == 1 and got[2].sum() == 1
    assert abs(np.linalg.norm(got[1]) - 1) < 1e-6
    import hashlib

    total = np.zeros(128)
    for token, n in (("gut", 2), ("屏", 2)):  # a CJK character counts as a word and on its own
        digest = hashlib.md5(token.encode()).digest()
        total += n * np.array([1 if (digest[i % 16] >> (i % 8)) & 1 else -1 for i in range(128)])
    assert np.allclose(got[1], total / np.linalg.norm(total), atol=1e-6)
    assert select_backend(None) is hashing_embedding


def test_search_pages_and_empty_summary(spark):
    items = corpus(spark).withColumn("pdf_upload_id", F.when(F.col("item_id") == "a", "u"))
    queries = spark.createDataFrame([(1, "gut"), (2, "unknownword")], "query_id int, text string")
    page, summary = search.search_literature(queries, items)
    assert [r.item_id for r in page.where("query_id = 1").orderBy("position").collect()] == ["a", "b"]
    assert rows(summary, "query_id", "total", "total_pages") == [(1, 2, 1), (2, 0, 0)]
    only, _ = search.search_literature(queries, items, has_upload=True)
    assert rows(only, "item_id") == [("a",)]
    newest, _ = search.search_literature(queries, items, sort="year_desc", page_size=500)
    assert [r.item_id for r in newest.orderBy("position").collect()] == ["b", "a"]


def test_small_functions(spark):
    df = spark.createDataFrame([("formula-a-b", "皮"), ("plain", "x")], "t string, q string")
    got = [(r.v, r.l) for r in df.select(entity_token_variants(F.col("t")).alias("v"), query_language(F.col("q")).alias("l")).collect()]
    assert got == [(["formula-a-b", "formula:a-b"], "zh"), (["plain"], "en")]
    assert retrieval.select_strategy("Hybrid ") == "hybrid" and retrieval.select_strategy("x") == "keyword"


def test_pruned_vector_search_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 8)) * 6
    vecs = np.concatenate([c + rng.standard_normal((60, 8)) * 0.3 for c in centres] + [np.tile(centres[0], (90, 1)), rng.standard_normal((40, 8))])
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)] + [(9999, None)], "vec_id long, vec array<double>").repartition(3)
    asked = vecs[::7]
    queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(asked)] + [(777, None)], "query_id long, qvec array<double>")
    scores = asked @ vecs.T
    for k, cell_rows in ((5, 30), (5, 100_000), (100, 30), (2000, 50)):
        found, met = retrieval.pruned_top_k(queries, table, k, cell_rows)
        got = {}
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((round(r.score, 9), r.vec_id))
        for q, row in enumerate(scores):
            want = sorted(((-round(float(x), 9), i) for i, x in enumerate(row)))[:k]
            assert [(-a, b) for a, b in want] == got[q]
        assert len(got) == len(asked)
        rows = met.collect()
        if (k, cell_rows) == (5, 30):
            assert rows[0].cells > 10 and sum(r.met for r in rows) < 0.5 * sum(r.cells for r in rows)
    assert retrieval.pruned_top_k(queries, table.limit(0), 3)[0].count() == 0


def test_vector_blocks_send_queries_once_and_keep_k_rows(spark, monkeypatch):
    """Many small cells of vectors without clusters: a query goes once to each block, not once to each cell, and a block keeps k rows."""
    monkeypatch.setattr(retrieval, "CELL_BYTES", 16 * 1024)
    rng = np.random.default_rng(5)
    vecs = rng.standard_normal((600, 16)).astype(np.float32)
    vecs[300:310] = vecs[0]
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "vec_id long, vec array<float>")
    queries = table.selectExpr("vec_id as query_id", "vec as qvec")
    emitted = []
    ranked = retrieval._ranked_vectors
    monkeypatch.setattr(retrieval, "_ranked_vectors", lambda found, k: emitted.append(found.count()) or ranked(found, k))
    found, met = retrieval.pruned_top_k(queries, table, 5, cell_rows=8)
    n_cells, n_blocks = met.first().cells, -(-600 * 16 * 4 // (16 * 1024))
    assert n_cells > 20 and emitted[-1] <= 600 * 5 * (2 * n_blocks + 1) < 600 * 5 * n_cells
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    scores = np.round(vecs.astype(np.float64) @ vecs.astype(np.float64).T, 9)
    assert all(got[q] == sorted(range(600), key=lambda i: (-row[i], i))[:5] for q, row in enumerate(scores))


def test_token_idf_keeps_the_stop_rule_of_large_corpora(spark, tmp_path):
    """More than a hundred documents: a word in more than half of them weighs nothing; a hundred or fewer: every word does."""
    from evidra.plans import retrieval_queries

    spark.createDataFrame([(1, "common rarer")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for n, weighs in ((101, False), (100, True)):
        docs = spark.range(n).selectExpr("id AS doc_id", "if(id = 7, 'common rarer', 'common') AS text", "'en' AS lang", "'src1' AS source", "CAST(6 AS long) AS n_chars")
        docs.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        got = {r.token: (r.df, r.idf) for r in retrieval_queries.token_idf(spark, str(tmp_path)).collect()}
        assert got["rarer"] == (1, round(float(np.log((n + 1) / 2)) + 1, 6))
        assert got["common"] == (n, 1.0 if weighs else 0.0)


def test_tag_bonus_gathers_no_owners_by_tag(spark):
    """A tag that every owner has must not bring them into one task; tags that repeat count once."""
    owners = spark.createDataFrame([(i, ["the", "the", f"t{i}", None]) for i in range(50)], "item_id long, evidence_tags array<string>")
    tokens = spark.createDataFrame([(1, "he"), (1, "t7"), (2, "t4"), (2, "zz")], "query_id long, token string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = retrieval.tag_bonus(owners, "item_id", tokens, tokens.select("token").distinct(), 2)
        assert "SortMergeJoin [tag" not in found._jdf.queryExecution().executedPlan().toString()
        got = rows(found, "query_id", "item_id", "bonus")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == rows(spark.createDataFrame(
        [(1, i, 4.0 if i == 7 else 2.0) for i in range(50)] + [(2, i, 2.0) for i in [4, *range(40, 50)]], "a long, b long, c double"))


def test_hashing_embedding_holds_few_patterns(spark, monkeypatch):
    """Vectors do not depend on how many token patterns a task keeps."""
    from evidra.functions import embedding

    texts = pd.Series(["a b c d e a", "", None, "f g 皮炎 h", "d c b a"])
    whole = embedding._hash_vectors(texts)
    monkeypatch.setattr(embedding, "HELD_SIGNS", 2)
    few = embedding._hash_vectors(texts)
    assert all(v.dtype == np.float32 and len(v) == 128 and (v == w).all() for v, w in zip(whole, few))


def test_index_meets_common_parts_once(spark):
    """Thousands of phrases with one part in common: a unit meets the part, not every phrase."""
    docs = spark.createDataFrame([(i, f"w{i} en and en{i}") for i in range(40)], "item_id long, text string")
    index = matching.build_index(docs, ["item_id"], {"text": F.col("text")})
    terms = spark.createDataFrame([(f"w{i} en",) for i in range(300)] + [("en",)], "term string")
    numbered = matching._numbered(terms, matching.TOKEN)
    hits, parts = matching._unit_hits(index.vocabulary(), numbered)
    assert hits.count() < 1000 and parts.count() == 601
    found = rows(matching.match_index(index, terms), "item_id", "term")
    assert found == sorted([(i, "en") for i in range(40)] + [(i, f"w{i} en") for i in range(40)], key=repr)


def test_many_phrases_are_found_in_one_pass(spark, monkeypatch):
    """More longer terms than ``SCAN_TERMS`` give the rows of the positions, without a shuffle of texts; the index has a row per document."""
    rng = random.Random(8)
    parts = ["ad", "adx", "ad治", "治疗", "皮肤屏障", "屏", "x y", "a,b", "-", "il-31", "。", "\n", "é", "foo", "皮", "\u2003", "\x1f", "𝔸b"]
    make = lambda n: rng.choice(["", " "]).join(rng.choice(parts) + rng.choice(["", " ", "  "]) for _ in range(rng.randint(0, n)))
    docs = [(i, make(5), make(2), make(9)) for i in range(60)] + [(60, "", "ad " * 200 + "\u2003foo", "il-31\tx y " * 90), (61, None, "é　皮 " * 150, "a,b " * 150 + "。"), (60, "ad", "", "x y")]
    terms = {make(3) for _ in range(150)} | {"ad", "治", "治疗", "肤屏障", "x", "ad 治", " ad", "ad ", "ad foo", "foo il", "il-31\tx", "屏 屏", "  ", "，", "y il", "b 。"}
    table = spark.createDataFrame(docs, "id int, a string, b string, c string").repartition(3)
    term_table = spark.createDataFrame([(t,) for t in terms], "term string")
    index = matching.build_index(table, ["id"], {n: F.col(n) for n in "abc"})
    assert index.documents.count() == len(docs)
    at_positions = rows(matching.match_index(index, term_table))
    whole = {i: [" ".join(x or "" for x in d[1:]) for d in docs if d[0] == i] for i in range(62)}
    assert {(i, t) for i, t, _ in at_positions} == {(i, t) for i in whole for t in terms for x in whole[i] if matching.UNIT.search(t) and brute_token(t, x)}
    monkeypatch.setattr(matching, "SCAN_TERMS", 0)
    for part_chars in (matching.PART_CHARS, 40):
        monkeypatch.setattr(matching, "PART_CHARS", part_chars)
        # rows of one key that repeats are one row where postings are joined, and one for each document where texts are read
        assert sorted(set(rows(matching.match_index(index, term_table)))) == sorted(set(at_positions))
    phrases = matching.match_index(index, term_table.where("term like '% %'"))
    plan = phrases._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_arrow_batches_are_bounded_by_bytes(spark):
    """Long texts reach a Python worker in batches of bounded bytes."""
    from evidra.session import ARROW_BATCH_BYTES, prepare

    prepare(spark)
    sizes = spark.range(0, 400, 1, 1).selectExpr("repeat('x', 100000) AS text").mapInArrow(
        lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long")
    assert max(r.n for r in sizes.collect()) < 2 * ARROW_BATCH_BYTES
