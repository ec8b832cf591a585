"""Retrieval, answer and grounding evaluation as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.session import union_all

METRICS = [
    "monolingual_recall", "cross_lingual_recall", "language_diversity", "mean_reciprocal_rank",
    "precision_at_k",
]


def bilingual_questions(questions: DataFrame) -> DataFrame:
    """Questions whose expected ids name both source languages."""
    has = lambda prefix: F.exists("expected_literature_ids", lambda i: i.startswith(prefix))
    return questions.where(has("cn-") & has("pmid-"))


def _group_expectations(retrieved: DataFrame, expected: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(expected pairs among the retrieved, totals per query) without forming all pairs of queries and members: members are counted once per
    set of groups that some query names, and the query's own row is taken off again."""
    asked = expected.where("group is not null").groupBy("query_id").agg(F.array_sort(F.collect_set("group")).alias("groups"))
    held = members.select("group", "item_id", F.col("item_lang").alias("want_lang"))
    by_set = asked.select("groups").distinct().withColumn("group", F.explode("groups")).join(held, "group").select("groups", "item_id", "want_lang").distinct()
    count = lambda lang: F.count_if(F.col("want_lang") == lang)
    sizes = by_set.groupBy("groups").agg(count("cn").alias("cn"), count("pubmed").alias("pubmed"))
    grouped = asked.withColumn("group", F.explode("groups"))
    itself = grouped.join(held.withColumnRenamed("item_id", "query_id"), ["group", "query_id"]).select("query_id", "want_lang").distinct().groupBy(
        "query_id").agg(count("cn").alias("own_cn"), count("pubmed").alias("own_pubmed"))
    totals = asked.join(sizes, "groups").join(itself, "query_id", "left").select(
        "query_id", *[(F.col(c) - F.coalesce(f"own_{c}", F.lit(0))).alias(f"all_{c}") for c in ("cn", "pubmed")])
    want = retrieved.where("query_id <> item_id").select("query_id", "item_id").distinct().join(grouped.select("query_id", "group"), "query_id").join(
        held, ["group", "item_id"]).select("query_id", "item_id", "want_lang").distinct()
    return want, totals


def retrieval_metrics(
    questions: DataFrame, retrieved: DataFrame, expected: DataFrame, top_k: int, members: DataFrame | None = None
) -> DataFrame:
    """Per question: recall in the own and the other language, diversity, MRR, precision@k.

    questions: query_id, lang ('zh'/'en')     retrieved: query_id, item_id, item_lang, rank
    expected:  query_id, item_id, item_lang ('cn'/'pubmed'); or, with members (group, item_id, item_lang): query_id, group, every member of
    the query's groups but an item with the query's own id
    """
    own = F.when(F.col("lang") == "zh", F.lit("cn")).otherwise(F.lit("pubmed"))
    if members is None:
        want = expected.select("query_id", "item_id", F.col("item_lang").alias("want_lang")).distinct()
        totals = want.groupBy("query_id").agg(
            F.count_if(F.col("want_lang") == "cn").alias("all_cn"),
            F.count_if(F.col("want_lang") == "pubmed").alias("all_pubmed"),
        )
    else:
        want, totals = _group_expectations(retrieved, expected, members)
    hits = retrieved.join(want, ["query_id", "item_id"], "left").groupBy("query_id").agg(
        F.count_if(F.col("item_lang") == "cn").alias("cn_hits"),
        F.count_if(F.col("item_lang") == "pubmed").alias("pubmed_hits"),
        F.count_if(F.col("want_lang") == "cn").alias("hit_cn"),
        F.count_if(F.col("want_lang") == "pubmed").alias("hit_pubmed"),
        F.min(F.when(F.col("want_lang").isNotNull(), F.col("rank"))).alias("first_rank"),
    )
    joined = questions.join(hits, "query_id", "left").join(totals, "query_id", "left").na.fill(
        0, ["cn_hits", "pubmed_hits", "hit_cn", "hit_pubmed", "all_cn", "all_pubmed"]
    )
    is_cn = own == "cn"
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    pick = lambda cond, a, b: F.when(cond, F.col(a)).otherwise(F.col(b))
    return joined.select(
        "query_id", "lang", "cn_hits", "pubmed_hits",
        F.round(ratio(pick(is_cn, "hit_cn", "hit_pubmed"), pick(is_cn, "all_cn", "all_pubmed")), 4).alias("monolingual_recall"),
        F.round(ratio(pick(is_cn, "hit_pubmed", "hit_cn"), pick(is_cn, "all_pubmed", "all_cn")), 4).alias("cross_lingual_recall"),
        F.round(F.least("cn_hits", "pubmed_hits") / F.greatest("cn_hits", "pubmed_hits", F.lit(1)), 4).alias("language_diversity"),
        F.round(F.coalesce(F.lit(1.0) / F.col("first_rank"), F.lit(0.0)), 4).alias("mean_reciprocal_rank"),
        F.round((F.col("hit_cn") + F.col("hit_pubmed")) / F.lit(top_k), 4).alias("precision_at_k"),
    )


def retrieval_summary(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Averages of the rounded values; zeros (not nulls) without any question."""
    return metrics.groupBy(*(by or [])).agg(
        F.count("*").alias("total_questions"),
        *[F.round(F.coalesce(F.avg(m), F.lit(0.0)), 4).alias(f"avg_{m}") for m in METRICS],
    )


def answer_evaluation(answers: DataFrame) -> DataFrame:
    """Hits, missing and violating terms and the pass rule per answered question.

    answers: id, response_text (answer, disclaimer and citation texts), citation_literature_ids,
    citation_chunk_ids, expected_literature_ids, expected_chunk_ids, must_include,
    must_not_include, disclaimer_present, grounding_status
    """
    text = F.lower("response_text")
    rows = answers.select(
        "*",
        F.filter("expected_literature_ids", lambda i: F.array_contains("citation_literature_ids", i)).alias("literature_hits"),
        F.filter("expected_chunk_ids", lambda i: F.array_contains("citation_chunk_ids", i)).alias("chunk_hits"),
        F.filter("must_include", lambda t: ~F.contains(text, F.lower(t))).alias("missing_must_include"),
        F.filter("must_not_include", lambda t: F.contains(text, F.lower(t))).alias("violated_must_not_include"),
    )
    passed = (
        (F.size("literature_hits") > 0)
        & ((F.size("expected_chunk_ids") == 0) | (F.size("chunk_hits") > 0))
        & F.col("disclaimer_present")
        & (F.size("missing_must_include") == 0)
        & (F.size("violated_must_not_include") == 0)
    )
    return rows.withColumn("passed", passed)


def answer_summary(evaluated: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts and pass rate, per strategy where ``by`` names it."""
    n = F.count("*")
    return evaluated.groupBy(*(by or [])).agg(
        n.alias("total_questions"), F.count_if("passed").alias("passed_questions"),
        F.coalesce(F.round(F.count_if("passed") / n, 3), F.lit(0.0)).alias("pass_rate"),
        F.count_if(F.size("literature_hits") > 0).alias("citation_hit_count"),
        F.count_if(F.size("chunk_hits") > 0).alias("chunk_hit_count"),
        F.count_if("disclaimer_present").alias("disclaimer_coverage_count"),
        F.count_if(F.size("violated_must_not_include") > 0).alias("must_not_violation_count"),
        F.count_if(F.col("grounding_status") == "blocked").alias("grounding_blocked_count"),
    )


# --- separation of faithful and hallucinated claims -----------------------------------------


def paired_separation(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Faithful claims scoring above their hallucinated twin (id with the suffix replaced)."""
    by = by or []
    twins = pairs.select(*by, F.col("id").alias("twin"), F.col("score").alias("twin_score"))
    faithful = pairs.where("supported").withColumn(
        "twin", F.replace("id", F.lit("-faithful"), F.lit("-hallucinated"))
    )
    joined = faithful.join(twins, by + ["twin"])
    return joined.groupBy(*by).agg(F.count_if(F.col("score") > F.col("twin_score")).alias("paired_separation"))


def separation(pairs: DataFrame, thresholds: list[float], by: list[str] | None = None) -> DataFrame:
    """Confusion counts and score bounds of (id, supported, score) at every threshold.

    Scores are binned against the thresholds once, so a sweep reads the pairs a single time.
    """
    by = by or []
    rows = pairs.select(
        *by, "supported", "score", F.explode(F.lit([float(t) for t in thresholds])).alias("threshold")
    )
    accepted = F.col("score") >= F.col("threshold")
    counts = rows.groupBy(*by, "threshold").agg(
        F.count_if("supported").alias("faithful_total"),
        F.count_if(~F.col("supported")).alias("hallucinated_total"),
        F.count_if(F.col("supported") & accepted).alias("accepted_faithful"),
        F.count_if(~F.col("supported") & ~accepted).alias("rejected_hallucinated"),
        F.round(F.min(F.when(F.col("supported"), F.col("score"))), 3).alias("min_faithful_score"),
        F.round(F.max(F.when(~F.col("supported"), F.col("score"))), 3).alias("max_hallucinated_score"),
    )
    return counts.withColumn(
        "false_rejected_faithful", F.col("faithful_total") - F.col("accepted_faithful")
    ).withColumn("false_accepted_hallucinated", F.col("hallucinated_total") - F.col("rejected_hallucinated"))


def threshold_recommendation(report: DataFrame) -> DataFrame:
    """First rule that fits: keep, tighten to the midpoint, keep on overlap, or lower."""
    clean = (F.col("false_rejected_faithful") == 0) & (F.col("false_accepted_hallucinated") == 0)
    no_reject = F.col("false_rejected_faithful") == 0
    gap = F.col("min_faithful_score") > F.col("max_hallucinated_score")
    verdict = (
        F.when(clean, F.lit("keep"))
        .when(no_reject & gap, F.lit("tighten"))
        .when(no_reject, F.lit("keep_overlap"))
        .otherwise(F.lit("lower"))
    )
    value = (
        F.when(verdict == "tighten", F.round((F.col("min_faithful_score") + F.col("max_hallucinated_score")) / 2, 2))
        .when(verdict == "lower", F.round("min_faithful_score", 2))
        .otherwise(F.col("threshold"))
    )
    return report.withColumn("verdict", verdict).withColumn("recommended_threshold", value)


def labelled_score_summary(pairs: DataFrame, threshold: float) -> DataFrame:
    """Strict confusion of supported against unsupported; partial labels stand apart."""
    is_ = lambda label: F.col("support_label") == label
    ok = F.col("score") >= F.lit(threshold)
    agg = pairs.agg(
        F.count("*").alias("total_pairs"),
        F.count_if(is_("supported")).alias("supported_total"),
        F.count_if(is_("unsupported")).alias("unsupported_total"),
        F.count_if(is_("supported") & ok).alias("accepted_supported"),
        F.count_if(is_("unsupported") & ~ok).alias("rejected_unsupported"),
        F.count_if(is_("partial") & ok).alias("partial_accepted"),
        F.count_if(is_("partial") & ~ok).alias("partial_rejected"),
    )
    judged = F.greatest(F.col("supported_total") + F.col("unsupported_total"), F.lit(1))
    return agg.select(
        "*",
        (F.col("supported_total") - F.col("accepted_supported")).alias("false_rejects"),
        (F.col("unsupported_total") - F.col("rejected_unsupported")).alias("false_accepts"),
        F.round((F.col("accepted_supported") + F.col("rejected_unsupported")) / judged, 4).alias("accuracy"),
    )


def labelled_score_stats(pairs: DataFrame) -> DataFrame:
    """Min, max and mean score per label; all three labels appear."""
    labels = pairs.sparkSession.createDataFrame([("supported",), ("partial",), ("unsupported",)], "support_label string")
    stats = pairs.groupBy("support_label").agg(
        F.count("*").alias("n"), F.round(F.min("score"), 4).alias("min_score"),
        F.round(F.max("score"), 4).alias("max_score"), F.round(F.avg("score"), 4).alias("mean_score"),
    )
    return F.broadcast(labels).join(stats, "support_label", "left").na.fill(0, ["n"])


def labelled_score_rows(pairs: DataFrame, threshold: float) -> DataFrame:
    return pairs.select(
        "*", F.round("score", 4).alias("entailment_score"), (F.col("score") >= threshold).alias("accepted"),
        F.substring("claim", 1, 80).alias("claim_preview"), F.substring("premise", 1, 80).alias("premise_preview"),
    )


# --- comparing runs -------------------------------------------------------------------------


def run_comparison(runs: DataFrame, metrics: list[str], base: str, other: str) -> DataFrame:
    """(config, metrics...) side by side: one row per metric with both values and the delta.
    A configuration that failed keeps its row with null values."""
    long = runs.unpivot("config", metrics, "metric", "value")
    pivoted = long.groupBy("metric").pivot("config", [base, other]).agg(F.first("value"))
    return pivoted.withColumn("delta", F.col(other) - F.col(base))


def run_differences(a: DataFrame, b: DataFrame, metric: str) -> DataFrame:
    """Items whose metric differs between two runs, or that one run lacks, with both lists."""
    left = a.select("item_id", F.col(metric).alias("a_value"), F.col("retrieved_ids").alias("a_ids"))
    right = b.select("item_id", F.col(metric).alias("b_value"), F.col("retrieved_ids").alias("b_ids"))
    joined = left.join(right, "item_id", "full_outer")
    return joined.where(~F.col("a_value").eqNullSafe(F.col("b_value")))


def capture_counts(results: DataFrame) -> DataFrame:
    """Histogram rows (facet, value, n) over status, reason and provider; blanks are skipped."""
    facets = ["grounding_status", "blocked_reason", "provider_name"]
    return (
        results.unpivot([], facets, "facet", "value").where("value is not null and value <> ''")
        .groupBy("facet", "value").agg(F.count("*").alias("n"))
    )


def claim_ref_shapes(claims: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Claims with no, one and several references."""
    n = F.size("evidence_refs")
    return claims.groupBy(*(by or [])).agg(
        F.count("*").alias("total_claims"), F.count_if(n == 0).alias("claims_with_zero_refs"),
        F.count_if(n == 1).alias("claims_with_one_ref"), F.count_if(n > 1).alias("claims_with_multi_refs"),
    )


def enrich_claims(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """(claim_id, evidence_refs) -> one row per ref with the chunk's text or CHUNK_NOT_FOUND."""
    refs = claims.select("claim_id", F.posexplode("evidence_refs").alias("ref_no", "chunk_id"))
    known = chunks.select("chunk_id", "text", F.col("item_id").alias("literature_id"))
    return refs.join(known, "chunk_id", "left").withColumn(
        "text", F.coalesce("text", F.lit("CHUNK_NOT_FOUND"))
    )


# --- blind labelling --------------------------------------------------------------------------


def normalized_query_set(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean queries, issues): trimmed fields with defaults; empty or repeated ids and
    repeated questions (white space and case folded) are issues."""
    optional = ["language", "topic", "user_role", "provenance"]
    clean = queries.select(
        F.trim("query_id").alias("query_id"), F.trim("question").alias("question"),
        *[F.coalesce(F.trim(c), F.lit("unspecified")).alias(c) if c in queries.columns
          else F.lit("unspecified").alias(c) for c in optional],
    ).withColumn("question_key", F.trim(F.regexp_replace(F.lower("question"), "\\s+", " ")))
    dup = lambda key, rule: (
        clean.where(F.col(key) != "").groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
        .select(F.lit(rule).alias("rule"), F.col(key).alias("detail"))
    )
    empty = lambda key, rule: clean.where(F.col(key) == "").select(F.lit(rule).alias("rule"), F.col("question").alias("detail"))
    issues = union_all([
        empty("query_id", "empty_query_id"), empty("question_key", "empty_question"),
        dup("query_id", "duplicate_query_id"), dup("question_key", "duplicate_question"),
    ])
    return clean.drop("question_key"), issues


def payload_fingerprint(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


PAYLOAD_FIELDS = ["candidate_id", "item_id", "record_origin", "title", "source", "abstract", "snippet"]


def labelling_bundle(ranked: DataFrame, items: DataFrame, worksheet_key: str, secret: str, top_k: int):
    """(worksheet, manifest): candidates in a secret order without rank, and the hidden rank
    with a fingerprint of what the reviewer sees."""
    picked = ranked.where(F.col("rank") <= top_k)
    rows = picked.join(items, "item_id").withColumn(
        "candidate_id",
        F.substring(F.sha2(F.concat_ws("|", F.lit(worksheet_key), "query_id", "item_id", "rank"), 256), 1, 16),
    )
    for name in PAYLOAD_FIELDS:
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    rows = rows.withColumn("review_payload_sha256", payload_fingerprint(PAYLOAD_FIELDS))
    shuffled = Window.partitionBy("query_id").orderBy(F.sha2(F.concat_ws(":", F.lit(secret), "query_id", "candidate_id"), 256))
    worksheet = rows.select(
        "query_id", *PAYLOAD_FIELDS, F.row_number().over(shuffled).alias("position"),
        F.lit(None).cast("boolean").alias("relevant"), F.lit("").alias("reviewer_notes"),
    )
    manifest = rows.select(
        "query_id", "candidate_id", "item_id", F.col("rank").alias("retrieval_rank"), "review_payload_sha256"
    )
    return worksheet, manifest


def worksheet_issues(worksheet: DataFrame, manifest: DataFrame) -> DataFrame:
    """Candidates only one side knows, and payloads changed since the bundle was made."""
    seen = worksheet.select("query_id", "candidate_id", payload_fingerprint(PAYLOAD_FIELDS).alias("now"), F.lit(True).alias("w"))
    hidden = manifest.select("query_id", "candidate_id", "review_payload_sha256", F.lit(True).alias("m"))
    joined = seen.join(hidden, ["query_id", "candidate_id"], "full_outer")
    rule = (
        F.when(F.col("m").isNull(), F.lit("candidate_not_in_manifest"))
        .when(F.col("w").isNull(), F.lit("candidate_missing_from_worksheet"))
        .when(F.col("now") != F.col("review_payload_sha256"), F.lit("review_payload_modified"))
    )
    return joined.select("query_id", "candidate_id", rule.alias("rule")).where("rule is not null")


def blind_scores(worksheet: DataFrame, manifest: DataFrame, top_k: int) -> tuple[DataFrame, DataFrame]:
    """(per query, summary). Numbers are published only when every query is fully labelled."""
    joined = worksheet.select("query_id", "candidate_id", "relevant").join(
        manifest.select("query_id", "candidate_id", "retrieval_rank"), ["query_id", "candidate_id"]
    )
    per_query = joined.groupBy("query_id").agg(
        F.count("*").alias("returned_candidates"),
        F.bool_and(F.col("relevant").isNotNull()).alias("labelled"),
        (F.count_if("relevant") / F.lit(top_k)).alias("precision"),
        F.min(F.when(F.col("relevant"), F.col("retrieval_rank"))).alias("first_relevant_rank"),
    ).withColumn("reciprocal", F.coalesce(F.lit(1.0) / F.col("first_relevant_rank"), F.lit(0.0)))
    done = F.bool_and("labelled")
    summary = per_query.agg(
        F.count("*").alias("total_queries"), F.count_if("labelled").alias("labelled_queries"),
        F.count_if(~F.col("labelled")).alias("unlabelled_queries"),
        F.count_if(F.col("returned_candidates") == top_k).alias("queries_returning_full_k"),
        F.round(F.avg("returned_candidates"), 3).alias("mean_returned_candidates"),
        F.when(done, F.round(F.avg("precision"), 3)).alias("mean_precision_at_k"),
        F.when(done, F.round(F.avg("reciprocal"), 3)).alias("mrr_at_k"),
        done.alias("complete"),
    )
    complete = summary.select("complete")
    published = per_query.join(F.broadcast(complete)).where("complete").select(
        "query_id", "returned_candidates", F.round("precision", 3).alias("precision_at_k"),
        "first_relevant_rank", F.round("reciprocal", 3).alias("reciprocal_rank_at_k"),
    )
    return published, summary.drop("complete")


def corpus_guard(items: DataFrame, chunks: DataFrame, min_live: int) -> DataFrame:
    """Violations of a real-only corpus: (rule, subject)."""
    foreign_items = items.where("record_origin <> 'pubmed_live'").select(
        F.lit("item_not_live").alias("rule"), F.col("item_id").cast("string").alias("subject"))
    foreign_chunks = chunks.join(items.select("item_id"), "item_id", "left_anti").select(
        F.lit("chunk_of_unknown_item").alias("rule"), F.col("chunk_id").cast("string").alias("subject"))
    too_few = items.agg(F.count_if(F.col("record_origin") == "pubmed_live").alias("n")).where(
        F.col("n") < min_live).select(F.lit("too_few_live_items").alias("rule"), F.col("n").cast("string").alias("subject"))
    return union_all([foreign_items, foreign_chunks, too_few])


def table_fingerprint(df: DataFrame, key: str, by: list[str] | None = None) -> DataFrame:
    """Order-independent fingerprint in two steps: rows hash in their place, bucket hashes of
    the ordered rows, then the ordered bucket hashes. No list holds more than one bucket."""
    by = by or []
    row_hash = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    hashed = df.select(*by, F.col(key).alias("_k"), row_hash.alias("_h"))
    buckets = hashed.withColumn("_b", F.substring("_h", 1, 4)).groupBy(*by, "_b").agg(
        F.sha2(F.array_join(F.sort_array(F.collect_list("_h")), "\n"), 256).alias("_bh"), F.count("*").alias("_n"))
    return buckets.groupBy(*by).agg(
        F.sum("_n").alias("n_rows"),
        F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_b", "_bh"))), lambda s: s["_bh"]), "\n"), 256).alias("fingerprint"),
    )
