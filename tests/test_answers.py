import hashlib
import hmac
import json

from pyspark.sql import functions as F

from evidra.functions import text as tx
from evidra.functions.canonical import valid_signature
from evidra.functions.embedding import select_backend
from evidra.operators import answers, evaluation, flow, grounding
from evidra.plans import ingest_queries
from tests.conftest import rows

RANKED = "query_id int, item_id string, chunk_id string, score double, bonus int, real int, year int, rank int"


def test_language_slot_swap(spark):
    ranked = spark.createDataFrame([
        (1, "a", "a1", 9.0, 1, 1, 2020, 1), (1, "b", "b1", 8.0, 1, 1, 2020, 2), (1, "c", "c1", 7.0, 1, 1, 2020, 3), (1, "d", None, 6.0, 0, 1, 2020, 4), (1, "e", "e1", 5.0, 0, 1, 2020, 5),
        (2, "a", "a1", 2.0, 1, 1, 2020, 1)], RANKED)
    tokens = spark.createDataFrame([(1, "gut"), (2, "gut")], "query_id int, token string")
    vocabulary = spark.createDataFrame([("gut",)], "token string")
    topical = answers.topical_queries(ranked, tokens, vocabulary)
    assert rows(topical) == [(1,)]  # the second question's best score is below three
    chosen, available = answers.select_citations(ranked, topical, None, top_k=3)
    assert rows(chosen, "item_id", "position", "match_score") == [("a", 1, 1.0), ("b", 2, 0.8889), ("e", 3, 0.5556)]
    assert rows(available) == [(1, 5)]


def test_entity_pool_and_generic_token(spark):
    ranked = spark.createDataFrame([(1, "a", None, 9.0, 0, 1, 2020, 1), (1, "b", None, 4.0, 0, 1, 2020, 2)], RANKED)
    items = spark.createDataFrame([("a", ["herb:x"]), ("b", ["Formula:1-2"])], "item_id string, related_entity_ids array<string>")
    tokens = spark.createDataFrame([(1, "formula-1-2"), (1, "therapy")], "query_id int, token string")
    entities = answers.entity_matches(ranked, tokens, items, None)
    assert rows(entities, "item_id") == [("b",)]
    vocab = spark.createDataFrame([("therapy",)], "token string")
    assert answers.topical_queries(ranked, tokens, vocab).count() == 0
    chosen, _ = answers.select_citations(ranked, spark.createDataFrame([(1,)], "query_id int"), entities, top_k=2)
    assert rows(chosen, "item_id", "position") == [("b", 1)]


def test_domain_order(spark):
    ranked = spark.createDataFrame([(1, "a", None, 9.0, 0, 0, 2020, 1), (1, "b", None, 1.0, 0, 1, 2020, 2), (2, "a", None, 9.0, 0, 0, 2020, 1), (2, "b", None, 1.0, 0, 1, 2020, 2)], RANKED)
    items = spark.createDataFrame([("a", ["network_pharmacology"]), ("b", ["x"])], "item_id string, evidence_tags array<string>")
    tokens = spark.createDataFrame([(1, "network")], "query_id int, token string")
    ordered = [(r.query_id, r.item_id) for r in answers.domain_order(ranked, items, tokens).orderBy("query_id", "rank").collect()]
    assert ordered == [(1, "b"), (1, "a"), (2, "a"), (2, "b")]


def test_claim_texts(spark):
    df = spark.createDataFrame([("- 甲[c1]。乙！\n1. third [c1] [c2]\n**[c3]**", 1)], "t string, i int")
    got = df.select(tx.bracketed_refs(F.col("t")).alias("r"), tx.claim_sentences(F.col("t")).alias("c")).first()
    assert got.r == ["c1", "c2", "c3"]
    assert got.c == ["甲[c1]。", "乙！", "third [c1] [c2]"]


def test_structured_claims_parsing(spark):
    cases = [
        '{"claims": [{"text": " a ", "evidence_refs": ["x", "x", "y"]}]}', '```json\n{"claims": []}\n```', '{"claims": [{"text": 1, "evidence_refs": []}]}',
        '{"claims": [{"text": "a", "evidence_refs": [1]}]}', '{"claims": "x"}', "[1]", "oops", '{"claims": [5]}', '{"claims": [{"text": "a", "evidence_refs": []}]}']
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    got = {r.i: r.c for r in df.select("i", tx.parse_structured_claims(F.col("t")).alias("c")).collect()}
    assert [tuple(c) for c in got[0]] == [("a", ["x", "y"])]
    assert got[1] == [] and [tuple(c) for c in got[8]] == [("a", [])]
    assert all(got[i] is None for i in (2, 3, 4, 5, 6, 7))


def test_gate_reasons_in_order(spark):
    answers_df = spark.createDataFrame([
        (1, "deterministic", "structured_claim_refs_v3", False, None, True), (2, "anthropic", "anthropic_tool_use_v1", False, None, True), (3, "anthropic", "structured_claim_refs_v3", False, None, False),
        (4, "anthropic", "structured_claim_refs_v3", False, None, True), (5, "anthropic", "structured_claim_refs_v3", False, None, True), (6, "anthropic", "structured_claim_refs_v3", False, None, True),
        (7, "anthropic", "structured_claim_refs_v3", False, None, True), (8, "anthropic", "structured_claim_refs_v3", False, None, True)],
        "answer_id int, provider_name string, policy string, has_tool_claims boolean, blocked_reason string, claims_parsed boolean")
    claims = spark.createDataFrame([(1, 0, "x", ["c"]), (5, 0, "", []), (6, 0, "x", []), (7, 0, "x", ["zz"]), (8, 0, "good text", ["c"]), (8, 1, "other", ["c"])],
                                   "answer_id int, claim_no int, text string, evidence_refs array<string>")
    citations = spark.createDataFrame([(i, 0, "c", "l", "good text", "s") for i in range(1, 9)] + [(8, 1, "c", "l", "late", "s")],
                                      "answer_id int, position int, chunk_id string, literature_id string, quote string, snippet string")
    refs = grounding.claim_refs(claims, citations)
    scored = refs.withColumn("semantic_score", F.when(F.col("text") == F.col("reference_text"), 1.0).otherwise(0.1))
    got = {r.answer_id: (r.status, r.reason) for r in grounding.gate(answers_df, claims, scored, semantic_threshold=0.4).collect()}
    assert got == {
        1: ("skipped", None), 2: ("blocked", "missing_tool_use"), 3: ("blocked", "structured_claims_parse_error"), 4: ("blocked", "empty_structured_claims"),
        5: ("blocked", "blank_claim_text"), 6: ("blocked", "claim_without_evidence_ref"), 7: ("blocked", "unsupported_evidence_ref"), 8: ("blocked", "semantic_low_support")}
    relaxed = {r.answer_id: r.status for r in grounding.gate(answers_df, claims, scored, semantic_threshold=0.05).collect()}
    assert relaxed[8] == "passed"
    both = scored.withColumn("entailment_score", F.when(F.col("answer_id") == 8, F.lit(0.3)))
    least = {r.answer_id: (r.min_semantic, r.min_entailment, r.reason) for r in grounding.gate(answers_df, claims, both, 0.05, 0.5).collect()}
    assert least.pop(8) == (0.1, 0.3, "nli_low_entailment")
    assert all(v[:2] == (None, None) for v in least.values())  # never got as far as scoring
    early = {r.answer_id: (r.min_semantic, r.min_entailment) for r in grounding.gate(answers_df, claims, both, 0.4, 0.5).collect()}
    assert early[8] == (0.1, None)


def test_retrieval_metrics_formulas(spark):
    questions = spark.createDataFrame([("q", "zh"), ("e", "en")], "query_id string, lang string")
    expected = spark.createDataFrame([("q", "cn-1", "cn"), ("q", "cn-2", "cn"), ("q", "pmid-1", "pubmed")], "query_id string, item_id string, item_lang string")
    retrieved = spark.createDataFrame([("q", "x", "unknown", 1), ("q", "cn-1", "cn", 2), ("q", "pmid-1", "pubmed", 3)], "query_id string, item_id string, item_lang string, rank int")
    got = {r.query_id: r for r in evaluation.retrieval_metrics(questions, retrieved, expected, 10).collect()}
    q = got["q"]
    assert (q.monolingual_recall, q.cross_lingual_recall, q.language_diversity, q.mean_reciprocal_rank, q.precision_at_k) == (0.5, 1.0, 1.0, 0.5, 0.2)
    assert got["e"].mean_reciprocal_rank == 0 and got["e"].monolingual_recall == 0
    assert evaluation.retrieval_summary(evaluation.retrieval_metrics(questions.limit(0), retrieved, expected, 10)).first().avg_precision_at_k == 0


def test_blind_scores_hold_back_incomplete(spark):
    worksheet = spark.createDataFrame([("q", "a", True), ("q", "b", None)], "query_id string, candidate_id string, relevant boolean")
    manifest = spark.createDataFrame([("q", "a", 2), ("q", "b", 1)], "query_id string, candidate_id string, retrieval_rank int")
    published, summary = evaluation.blind_scores(worksheet, manifest, 5)
    assert published.count() == 0 and summary.first().mrr_at_k is None
    done, summary = evaluation.blind_scores(worksheet.na.fill(False), manifest, 5)
    assert rows(done, "precision_at_k", "first_relevant_rank", "reciprocal_rank_at_k") == [(0.2, 2, 0.5)]
    assert summary.first().mrr_at_k == 0.5


def test_extractive_answer_wording(spark):
    queries = spark.createDataFrame([(1, "瘙痒？"), (2, "x")], "query_id int, text string")
    cards = spark.createDataFrame([(1, 1, "T", "S", "snip", "quote", "pruritus, review")], "query_id int, position int, title string, source string, snippet string, quote string, reason string")
    got = {r.query_id: r for r in answers.extractive_answers(queries, cards).collect()}
    assert got[1].answer.startswith("针对「瘙痒？」，在当前样本文献中检索到 1 条相关证据片段，按相关度排序：\n1.《T》（S）：quote\n涉及主题：瘙痒、证据综述。")
    assert got[2].citation_count == 0 and "没有检索到足够匹配" in got[2].answer
    cost = spark.createDataFrame([(1000, 500), (None, None)], "a int, b int").select(answers.estimated_cost(F.col("a"), F.col("b"), 1.0, 2.0).alias("c"))
    assert [r.c for r in cost.collect()] == [0.002, None]


def test_text_quality_rules(spark):
    df = spark.createDataFrame([("\x00\x00\x00abc",), ("((((((((((((a",), ("正文内容" * 40,), ("",)], "t string")
    got = df.select(tx.spike_flags(F.col("t")).alias("f"), tx.low_text_density(F.col("t")).alias("d")).collect()
    assert got[0].f == ["nul_warning", "short_text", "low_cjk_ratio"] and got[1].d and got[2].f == [] and got[3].f == ["empty_text"]
    page = spark.createDataFrame([("\n".join(f"l{i}" for i in range(10)),), ("a\nb",)], "t string").select(tx.trim_header_footer(F.col("t")).alias("x"))
    assert [r.x for r in page.collect()] == ["\n".join(f"l{i}" for i in range(1, 9)), "a\nb"]


def test_text_quality_summary_of_empty_texts(spark, tmp_path):
    """An empty text has no NUL and no Chinese characters and counts as a document; a missing one has no NUL ratio."""
    docs = [(1, "a", "\x00中bc"), (2, "a", ""), (3, "b", ""), (4, "c", None), (5, "c", "\x00b")]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(ingest_queries.text_quality_summary(spark, str(tmp_path)), "source", "nul_ratio", "cjk_ratio", "warnings", "n_docs")
    assert got == [("a", 0.125, 0.125, 0, 2), ("b", 0.0, 0.0, 0, 1), ("c", 0.5, 0.0, 0, 2)]


CLAIMS = "array<struct<text:string,evidence_refs:array<string>>>"
CARDS = "answer_id int, position int, chunk_id string, literature_id string, quote string, snippet string"


def test_ground_lists_and_shown_text(spark):
    cards = spark.createDataFrame([(i, p, c, "l", q, "abstract") for i in range(8) for p, c, q in ((1, "c1", "alpha beta"), (2, None, ""), (3, "c1", "later"))], CARDS)
    tool = "anthropic_tool_use_v1"
    json_of = lambda *claims: '{"claims":[' + ",".join(f'{{"text":"{t}","evidence_refs":[{r}]}}' for t, r in claims) + "]}"
    drafts = spark.createDataFrame([
        (0, "deterministic", "structured_claim_refs_v3", "as written", None, None),
        (1, "anthropic", "structured_claim_refs_v3", json_of((" alpha beta。", '"c1","c1"'), ("x", '"l"')), None, None),
        (2, "anthropic", "structured_claim_refs_v3", json_of(("alpha", '"z","c1"'), ("x", '"y","z"')), None, None),
        (3, "anthropic", tool, json_of(("alpha", '"c1"')), None, "tool_refused"),
        (4, "opencode_go", tool, None, [("alpha beta", ["c1"])], None),
        (5, "anthropic", "structured_claim_refs_v3", json_of(("  ", '"c1"'), ("x", "")), None, None),
        (6, "anthropic", tool, None, [], None),
        (7, "anthropic", "structured_claim_refs_v3", None, None, None)],
        f"answer_id int, provider_name string, policy string, text string, tool_claims {CLAIMS}, blocked_reason string")
    got = {r.answer_id: r for r in grounding.ground(drafts, cards).collect()}
    assert [got[i].status for i in range(8)] == ["skipped", "passed", "blocked", "blocked", "passed", "blocked", "blocked", "blocked"]
    assert [got[i].reason for i in range(8)] == [
        None, None, "unsupported_evidence_ref", "tool_refused", None, "blank_claim_text", "empty_tool_claims", "structured_claims_parse_error"]
    assert got[0].answer == "as written" and got[1].answer == "alpha beta [c1]。x [l]。" and got[3].answer == grounding.BLOCKED_TEXT
    assert all(got[i].allowed_refs == ["c1", "l"] for i in range(8))
    assert (got[2].matched_refs, got[2].unsupported_refs, got[2].claim_count, got[2].cited_claim_count) == (["c1"], ["z", "y"], 2, 0)
    assert (got[1].matched_refs, got[1].cited_claim_count) == (["c1", "l"], 2) and got[0].matched_refs == got[7].unsupported_refs == []


def test_ground_scores_in_two_stages(spark):
    cards = spark.createDataFrame([(i, 1, "c1", "l", "alpha beta gamma", "") for i in range(3)] + [(3, 1, "c1", "l", "", "")], CARDS)
    rows_ = [(i, "anthropic", "anthropic_tool_use_v1", None, [(t, ["c1"])], None) for i, t in enumerate(("alpha beta gamma", "delta", "alpha beta", "alpha"))]
    drafts = spark.createDataFrame(rows_, f"answer_id int, provider_name string, policy string, text string, tool_claims {CLAIMS}, blocked_reason string")
    same = lambda premise, claim: F.when(premise == claim, 1.0).otherwise(0.25)
    got = {r.answer_id: r for r in grounding.ground(drafts, cards, select_backend("hashing"), 0.5, same, 0.5).collect()}
    assert (got[0].status, got[0].min_entailment) == ("passed", 1.0) and abs(got[0].min_semantic - 1) < 1e-9
    assert (got[1].reason, got[1].min_entailment) == ("semantic_low_support", None)
    assert (got[2].reason, got[2].min_entailment) == ("nli_low_entailment", 0.25)
    assert (got[3].reason, got[3].min_semantic) == ("semantic_low_support", 0.0)  # nothing to score against
    only = {r.answer_id: r for r in grounding.ground(drafts, cards, entail=same, entailment_threshold=0.5).collect()}
    assert (only[1].reason, only[3].status, only[3].min_entailment) == ("nli_low_entailment", "passed", None)


def test_answer_flow_signs_each_response(spark):
    questions = spark.createDataFrame([(1, " gut? "), (2, "other"), (3, None)], "query_id int, text string")
    ranked = spark.createDataFrame([(1, "a", "a1", 9.0, 1, 1, 2020, 1), (1, "b", None, 4.0, 1, 1, 2020, 2)], RANKED)
    items = spark.createDataFrame(
        [("a", "A", "s", "sa", ["review"], "pubmed", []), ("b", "B", "s", "sb", ["pruritus"], "pubmed", [])],
        "item_id string, title string, source string, snippet string, evidence_tags array<string>, source_type string, related_entity_ids array<string>")
    chunks = spark.createDataFrame([("a1", " quoted ", [])], "chunk_id string, source_quote string, evidence_tags array<string>")
    tokens = spark.createDataFrame([(1, "gut")], "query_id int, token string")
    done = flow.answer_flow(questions, ranked, items, chunks, tokens, tokens.select("token"), b"k", "now").cache()
    got = {r.query_id: r for r in done.collect()}
    assert set(got) == {1, 2, 3} and [c.literature_id for c in got[1].citations] == ["a", "b"] and got[2].citations == []
    assert got[1].question == "gut?" and "1.《A》（s）：quoted\n2.《B》（s）：sb" in got[1].answer and got[2].answer == answers._NO_EVIDENCE
    assert got[1].grounding.status == "skipped" and got[1].grounding.allowed_evidence_refs == ["a1", "b"] and got[1].sli.estimated_cost_usd is None
    payload = json.loads(done.where("query_id = 1").select(F.to_json(F.struct(*flow.SIGNED), {"ignoreNullFields": "false"})).first()[0])
    payload["citations"][0]["match_score"] = 1  # an integral score is signed as an integer
    text = json.dumps(payload, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert got[1].integrity_token == hmac.new(b"k", text.encode(), hashlib.sha256).hexdigest()
    edited = done.withColumn("answer", F.lit("edited"))
    valid = lambda df: [r[0] for r in df.select(valid_signature(F.col("integrity_token"), F.struct(*flow.SIGNED), b"k")).collect()]
    assert valid(done) == [True] * 3 and valid(edited) == [False] * 3


def test_retrieval_metrics_expect_the_whole_label(spark, tmp_path):
    """Rows of one label are expected wherever their ids lie, not only in the query's hundred; the query itself is not."""
    from evidra.plans import evaluation_queries

    table = [(0, [1.0, 0.0], 1), (150, [0.9, 0.1], 1), (970, [-0.5, 0.2], 1), (5, [0.8, 0.0], 2), (6, [0.1, 0.3], None)]
    spark.createDataFrame(table, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.query_id: r for r in evaluation_queries.retrieval_metrics(spark, str(tmp_path)).collect()}
    assert (got[0].monolingual_recall, got[0].cross_lingual_recall, got[0].precision_at_k) == (1.0, 1.0, 0.2)
    assert (got[970].cross_lingual_recall, got[970].monolingual_recall, got[970].precision_at_k) == (1.0, 0.0, 0.2)
    assert got[0].mean_reciprocal_rank == 0.5 and got[5].mean_reciprocal_rank == got[6].mean_reciprocal_rank == 0.0


def test_group_expectations_equal_pairs(spark):
    """Queries with several groups and items in several of them count each expected item once, as with all pairs."""
    lang = lambda i: "cn" if i % 3 else "pubmed"
    members = [(g, i, lang(i)) for i in range(12) for g in range(5) if (i * 7 + g) % 3 == 0]
    named = [(q, g) for q in range(12) for g in range(5) if (q + g) % 4 == 0] + [(3, None), (3, 99)]
    pairs = sorted({(q, i, n) for q, g in named for h, i, n in members if g == h and i != q})
    questions = spark.createDataFrame([(q, "zh" if q % 2 else "en") for q in range(12)], "query_id int, lang string")
    retrieved = spark.createDataFrame([(q, (q + r) % 12, lang((q + r) % 12), r + 1) for q in range(12) for r in range(4)], "query_id int, item_id int, item_lang string, rank int")
    pairs = spark.createDataFrame(pairs, "query_id int, item_id int, item_lang string")
    named, members = spark.createDataFrame(named, "query_id int, group int"), spark.createDataFrame(members, "group int, item_id int, item_lang string")
    assert rows(evaluation.retrieval_metrics(questions, retrieved, named, 4, members)) == rows(evaluation.retrieval_metrics(questions, retrieved, pairs, 4))
