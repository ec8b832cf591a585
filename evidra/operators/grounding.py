"""Claim and answer grounding: evidence join, support scores, ordered gate.

answers:   answer_id, provider_name, policy, has_tool_claims, blocked_reason
claims:    answer_id, claim_no, text, evidence_refs
citations: answer_id, position, chunk_id, literature_id, quote, snippet
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions.text import parse_structured_claims, strip_space, structured_answer
from evidra.operators.retrieval import cosine

# Providers whose drafts are checked, and policies that need a tool call.
EXTERNAL_PROVIDERS = ["anthropic", "opencode_go"]
TOOL_POLICIES = ["anthropic_tool_use_v1", "opencode_go_tool_use_v1"]
# Fixed value: shown in place of a blocked draft.
BLOCKED_TEXT = "当前模型草稿未通过引用证据校验，系统已拦截展示。请核对下方引用卡片，或调整问题、来源与引用数量后重试。"


def _with_ref(citations: DataFrame) -> DataFrame:
    return citations.withColumn("ref", F.coalesce(F.when(F.length("chunk_id") > 0, F.col("chunk_id")), F.col("literature_id")))


def reference_texts(citations: DataFrame) -> DataFrame:
    """(answer_id, ref, reference_text): the first citation of a ref wins, quote before snippet."""
    quote = F.when(F.length("quote") > 0, F.col("quote"))
    rows = _with_ref(citations).select("answer_id", "position", "ref", F.coalesce(quote, F.col("snippet")).alias("reference_text"))
    return rows.groupBy("answer_id", "ref").agg(F.min_by("reference_text", "position").alias("reference_text"))


def claim_refs(claims: DataFrame, citations: DataFrame) -> DataFrame:
    """One row per claim and ref with the cited text (null for refs nobody cited)."""
    refs = claims.select("answer_id", "claim_no", "text", F.explode("evidence_refs").alias("ref"))
    return refs.join(reference_texts(citations), ["answer_id", "ref"], "left")


def support_scores(
    pairs: DataFrame, encode: Callable[[Column], Column] | None = None,
    entail: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """Adds semantic_score (cosine) and entailment_score for pairs with a reference text."""
    has_text = F.length("reference_text") > 0
    if encode is not None:
        pairs = pairs.withColumn(
            "semantic_score", F.when(has_text, cosine(encode(F.col("text")), encode(F.col("reference_text"))))
        )
    if entail is not None:
        pairs = pairs.withColumn("entailment_score", F.when(has_text, entail(F.col("reference_text"), F.col("text"))))
    return pairs


def gate(
    answers: DataFrame,
    claims: DataFrame,
    scored_refs: DataFrame,
    semantic_threshold: float | None = None,
    entailment_threshold: float | None = None,
) -> DataFrame:
    """Grounding status and the first failing reason per answer.

    ``scored_refs`` is claim_refs with optional score columns. Answers whose claims could not
    be parsed carry ``claims_parsed`` = false. The least scores are set only where the check got as far as
    scoring with them, the entailment one only where a cited text could be scored.
    """
    score_cols = [c for c in ("semantic_score", "entailment_score") if c in scored_refs.columns]
    per_claim = scored_refs.groupBy("answer_id", "claim_no").agg(
        F.bool_or(F.col("reference_text").isNull()).alias("unsupported"),
        F.count_if(F.length("reference_text") > 0).alias("n_scored"),
        *[F.max(c).alias(c) for c in score_cols],
    )
    merged = claims.join(per_claim, ["answer_id", "claim_no"], "left")
    floor = lambda c: F.min(F.coalesce(F.greatest(F.col(c), F.lit(0.0)), F.lit(0.0)))
    none = F.lit(None).cast("double")
    per_answer = merged.groupBy("answer_id").agg(
        F.count("*").alias("claim_count"),
        F.bool_or(F.length("text") == 0).alias("blank"),
        F.bool_or(F.size("evidence_refs") == 0).alias("unreferenced"),
        F.bool_or(F.coalesce("unsupported", F.lit(False))).alias("unsupported"),
        F.sum(F.coalesce("n_scored", F.lit(0))).alias("n_scored"),
        (floor("semantic_score") if "semantic_score" in score_cols else none).alias("min_semantic"),
        (floor("entailment_score") if "entailment_score" in score_cols else none).alias("min_entailment"),
    )
    rows = answers.join(per_answer, "answer_id", "left")
    tool = F.col("policy").isin(TOOL_POLICIES)
    early = (
        F.when(tool & ~F.col("has_tool_claims"), F.coalesce("blocked_reason", F.lit("missing_tool_use")))
        .when(~F.col("claims_parsed"), F.lit("structured_claims_parse_error"))
        .when(F.coalesce("claim_count", F.lit(0)) == 0,
              F.when(tool, F.lit("empty_tool_claims")).otherwise(F.lit("empty_structured_claims")))
        .when(F.col("blank"), F.lit("blank_claim_text"))
        .when(F.col("unreferenced"), F.lit("claim_without_evidence_ref"))
        .when(F.col("unsupported"), F.lit("unsupported_evidence_ref"))
    )
    external = F.col("provider_name").isin(EXTERNAL_PROVIDERS)
    scored = external & early.isNull()
    semantic = F.when(scored, F.col("min_semantic")) if semantic_threshold is not None else none
    low_semantic = F.coalesce(semantic < F.lit(semantic_threshold), F.lit(False))
    entailment = F.when(scored & ~low_semantic & (F.col("n_scored") > 0), F.col("min_entailment")) if entailment_threshold is not None else none
    reason = F.coalesce(
        early, F.when(low_semantic, F.lit("semantic_low_support")),
        F.when(entailment < F.lit(entailment_threshold), F.lit("nli_low_entailment")),
    )
    return rows.select(
        "answer_id", F.coalesce("claim_count", F.lit(0)).alias("claim_count"),
        semantic.alias("min_semantic"), entailment.alias("min_entailment"),
        F.when(external, reason).alias("reason"),
        F.when(~external, F.lit("skipped")).when(reason.isNull(), F.lit("passed")).otherwise(F.lit("blocked")).alias("status"),
    )


def ground(
    drafts: DataFrame,
    citations: DataFrame,
    encode: Callable[[Column], Column] | None = None,
    semantic_threshold: float | None = None,
    entail: Callable[[Column, Column], Column] | None = None,
    entailment_threshold: float | None = None,
) -> DataFrame:
    """Every draft with its shown text, gate outcome and evidence references.

    drafts: answer_id, provider_name, policy, text, tool_claims (array of text and evidence_refs, null without a
    tool call), blocked_reason. Claims come from the tool call or from the draft's JSON. Lists of references are in
    order of first mention; they are empty where the check ended before it read claims, and for drafts of local
    providers, which are shown unchecked. A draft's claims and citations are lists in its own row.
    """
    external, tool = F.col("provider_name").isin(EXTERNAL_PROVIDERS), F.col("policy").isin(TOOL_POLICIES)
    called = F.transform("tool_claims", lambda c: F.struct(strip_space(c["text"]).alias("text"), F.array_distinct(c["evidence_refs"]).alias("evidence_refs")))
    parsed = F.coalesce(called, F.when(~tool, parse_structured_claims(F.col("text"))))
    rows = drafts.withColumn("claims", F.when(external, parsed))
    claims = rows.select("answer_id", F.posexplode("claims").alias("claim_no", "c")).select("answer_id", "claim_no", "c.text", "c.evidence_refs")
    scored = support_scores(
        claim_refs(claims, citations), encode if semantic_threshold is not None else None, entail if entailment_threshold is not None else None)
    heads = rows.select(
        "answer_id", "provider_name", "policy", F.col("tool_claims").isNotNull().alias("has_tool_claims"), "blocked_reason",
        F.col("claims").isNotNull().alias("claims_parsed"))
    gated = gate(heads, claims, scored, semantic_threshold, entailment_threshold)
    places = _with_ref(citations).groupBy("answer_id", "ref").agg(F.min("position").alias("position"))
    allowed = places.groupBy("answer_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("position", "ref"))), lambda s: s["ref"]).alias("allowed_refs"))
    none = F.array().cast("array<string>")
    named = F.coalesce(F.array_distinct(F.flatten(F.transform("claims", lambda c: c["evidence_refs"]))), none)
    whole = rows.join(gated, "answer_id").join(allowed, "answer_id", "left").withColumn("allowed_refs", F.coalesce("allowed_refs", none))
    shown = F.when(F.col("status") == "skipped", F.col("text")).when(F.col("status") == "passed", structured_answer("claims")).otherwise(F.lit(BLOCKED_TEXT))
    return whole.select(
        "answer_id", "provider_name", "policy", shown.alias("answer"), "status", "reason", "claim_count",
        F.when(F.col("status") == "passed", F.col("claim_count")).otherwise(F.lit(0)).alias("cited_claim_count"),
        "allowed_refs", F.array_intersect(named, "allowed_refs").alias("matched_refs"), F.array_except(named, "allowed_refs").alias("unsupported_refs"),
        "min_semantic", "min_entailment")
