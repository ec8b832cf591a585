"""From ranked candidates to signed answers: selection, drafts, grounding and signature of a batch of questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.functions.canonical import export_signature
from evidra.operators import answers, grounding
from evidra.operators.documents import DISCLAIMER
from evidra.session import materialize

#: Columns that a signature covers, in any order (the signed text sorts its keys).
SIGNED = [
    "question", "answer", "disclaimer", "retrieval", "citations", "answered_at", "provider_name", "grounding", "input_tokens", "output_tokens", "sli",
]
CARD = ["literature_id", "chunk_id", "title", "source", "snippet", "quote", "reason", "confidence", "match_score"]


def extractive_drafts(evidence: DataFrame, cards: DataFrame) -> DataFrame:
    """Drafts without a language model: the numbered evidence lines themselves, not checked further."""
    text, number = F.lit(None).cast("string"), F.lit(None).cast("long")
    claims = F.lit(None).cast("array<struct<text:string,evidence_refs:array<string>>>")
    return evidence.select(
        "query_id", F.lit("deterministic").alias("provider_name"), F.lit("structured_claim_refs_v3").alias("policy"), F.col("answer").alias("text"),
        claims.alias("tool_claims"), text.alias("blocked_reason"), number.alias("input_tokens"), number.alias("output_tokens"))


def answer_flow(
    questions: DataFrame,
    ranked: DataFrame,
    items: DataFrame,
    chunks: DataFrame | None,
    tokens: DataFrame,
    vocabulary: DataFrame,
    key: bytes,
    answered_at: str,
    write: Callable[[DataFrame, DataFrame], DataFrame] = extractive_drafts,
    top_k: int = 2,
    source: str = "all",
    strategy: str = "keyword",
    price_in: float = 0.0,
    price_out: float = 0.0,
    totals: DataFrame | None = None,
    **check,
) -> DataFrame:
    """Signed responses, one row per question.

    ``write`` turns evidence (query_id, text, answer, evidence_text, ...) and citation cards into drafts with the columns
    of ``extractive_drafts``; a draft must be written once, so its rows are staged before they are checked and signed.
    ``totals`` goes to ``answers.answer_questions``, ``check`` to ``grounding.ground``; scores are given to six places. Questions off the corpus' topics have no cards
    and say so.
    """
    found, cards = answers.answer_questions(questions, ranked, items, chunks, tokens, vocabulary, top_k, source, totals)
    cards = materialize(cards)
    evidence = materialize(questions.select("query_id", F.trim("text").alias("question")).join(found, "query_id").join(
        answers.evidence_packs(cards), "query_id", "left"))
    drafts = materialize(write(evidence, cards))
    checked = grounding.ground(drafts.withColumnRenamed("query_id", "answer_id"), cards.withColumnRenamed("query_id", "answer_id"), **check)
    usage = drafts.select("query_id", "input_tokens", "output_tokens")
    # at most top_k cards a question
    shown = cards.groupBy("query_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("position", F.struct(*CARD).alias("card")))), lambda s: s["card"]).alias("citations"))
    rows = (
        evidence.select("query_id", "question", "available_citation_count")
        .join(checked.withColumnRenamed("answer_id", "query_id"), "query_id").join(usage, "query_id").join(shown, "query_id", "left"))
    outcome = F.struct(
        "status", "policy", "reason", (F.col("status") != "skipped").alias("checked"), "claim_count", "cited_claim_count",
        F.col("allowed_refs").alias("allowed_evidence_refs"), F.col("matched_refs").alias("matched_evidence_refs"),
        F.col("unsupported_refs").alias("unsupported_evidence_refs"), F.round("min_semantic", 6).alias("min_semantic_score"),
        F.round("min_entailment", 6).alias("min_entailment_score"))
    used = F.struct(F.lit(source).alias("applied_source"), F.lit(top_k).alias("applied_top_k"), "available_citation_count", F.lit(strategy).alias("strategy"))
    cost = answers.estimated_cost(F.col("input_tokens"), F.col("output_tokens"), price_in, price_out)
    response = rows.select(
        "query_id", "question", "answer", F.lit(DISCLAIMER).alias("disclaimer"), used.alias("retrieval"),
        F.coalesce("citations", F.array().cast(shown.schema["citations"].dataType)).alias("citations"), F.lit(answered_at).alias("answered_at"),
        "provider_name", outcome.alias("grounding"), "input_tokens", "output_tokens", F.struct(cost.alias("estimated_cost_usd")).alias("sli"))
    return response.withColumn("integrity_token", export_signature(F.struct(*SIGNED), key))
