"""Audit jobs: recompute what is stored and list every difference as (task_id, rule, subject)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions.canonical import content_id
from evidra.operators import lineage as lin
from evidra.operators.review import backed_intersections, latest_decisions
from evidra.session import materialize, union_all


def _rules(df: DataFrame, key: str, subject: Column, checks: list[tuple[str, Column]]) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks]))
    return df.select(key, F.explode(found).alias("rule"), subject.cast("string").alias("subject"))


def set_differences(declared: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Rows only one side has: (columns..., side)."""
    return union_all([
        declared.subtract(recomputed).withColumn("side", F.lit("declared_only")),
        recomputed.subtract(declared).withColumn("side", F.lit("recomputed_only")),
    ])


PROVENANCE_FIELDS = [
    "source_database", "database_version", "source_query", "query_date", "retrieved_at", "species", "applied_threshold",
    "threshold_operator", "score_name", "identifier_mapping", "identifier_mapping_version",
]


def lineage_issues(
    rows: DataFrame, intersections: DataFrame, declared_counts: DataFrame, protocols: DataFrame,
    provenance: DataFrame, readiness: DataFrame,
) -> DataFrame:
    """Everything the stored lineage of a task must satisfy.

    rows: lineage rows of both sides with adjudication_status, decision
    intersections: task_id, lineage_row_id, canonical_symbol, derivation, automatic_status,
      adjudication_status, decision and the two id arrays
    declared_counts: task_id, disease_target_count, compound_target_count, intersection_target_count
    protocols: task_id, species, query_date, phenotype, evidence_policy, as_of
    provenance: task_id, set_kind, record_count, verification_status, source_artifact_sha256,
      artifact_sha256_now, and the provenance fields
    readiness: task_id, formal_network_ready, blocking_reasons
    """
    disease = rows.where("set_kind = 'disease'")
    compound = rows.where("set_kind = 'compound'")
    parts = []

    derived = lin.with_row_ids(rows.withColumnRenamed("lineage_row_id", "stored_id"))
    row_id = F.col("stored_id")
    parts.append(_rules(derived, "task_id", row_id, [
        ("row_id_missing", row_id.isNull() | ~row_id.rlike("^(disease|compound)-[0-9a-f]{64}$")),
        ("row_id_mismatch", row_id != F.col("lineage_row_id")),
        ("row_not_pending", (F.col("adjudication_status") != "pending") | (F.col("decision") != "unreviewed")),
        ("below_threshold", F.col("source_score") < F.col("applied_threshold")),
        ("record_id_count", (F.col("set_kind") == "disease") & (F.size("source_record_ids") != 1)),
    ]))
    parts.append(rows.groupBy("task_id", "lineage_row_id").agg(F.count("*").alias("n")).where("n > 1").select(
        "task_id", F.lit("row_id_not_unique").alias("rule"), F.col("lineage_row_id").alias("subject")))

    expected = lin.intersections(disease, compound).select(
        "task_id", "canonical_symbol", F.col("lineage_row_id").alias("want_id"), F.col("disease_lineage_row_ids").alias("want_d"),
        F.col("compound_lineage_row_ids").alias("want_c"))
    both = intersections.join(expected, ["task_id", "canonical_symbol"], "full_outer")
    parts.append(_rules(both, "task_id", F.col("canonical_symbol"), [
        ("intersection_missing", F.col("lineage_row_id").isNull()),
        ("intersection_not_derivable", F.col("want_id").isNull()),
        ("intersection_disease_refs", F.sort_array("disease_lineage_row_ids") != F.col("want_d")),
        ("intersection_compound_refs", F.sort_array("compound_lineage_row_ids") != F.col("want_c")),
        ("intersection_id_mismatch", F.col("lineage_row_id") != F.col("want_id")),
        ("intersection_derivation", F.col("derivation") != "canonical_symbol_exact_match_v1"),
        ("intersection_status", F.col("automatic_status") != "derived"),
        ("intersection_not_pending", (F.col("adjudication_status") != "pending") | (F.col("decision") != "unreviewed")),
    ]))
    parts.append(intersections.groupBy("task_id", "canonical_symbol").agg(F.count("*").alias("n")).where("n > 1").select(
        "task_id", F.lit("intersection_repeated").alias("rule"), F.col("canonical_symbol").alias("subject")))

    counted = lin.lineage_counts(declared_counts, disease, compound, lin.shared_symbols(disease, compound)).select(
        "task_id", *[F.col(f"{s}_target_count").alias(f"now_{s}") for s in ("disease", "compound", "intersection")])
    parts.append(_rules(declared_counts.join(counted, "task_id"), "task_id", F.lit(None), [
        (f"{s}_count_mismatch", F.col(f"{s}_target_count") != F.col(f"now_{s}")) for s in ("disease", "compound", "intersection")]))

    parts.append(_rules(protocols, "task_id", F.lit(None), [
        ("protocol_species", F.col("species") != "Homo sapiens"),
        ("protocol_phenotype", ~F.length(F.trim("phenotype")).between(4, 200)),
        ("protocol_query_date", F.col("query_date").try_cast("date").isNull()),
        ("protocol_date_in_future", F.col("query_date").try_cast("date") > F.col("as_of")),
    ]))

    n_rows = rows.groupBy("task_id", "set_kind").agg(F.count("*").alias("n_rows"))
    with_rows = provenance.join(n_rows, ["task_id", "set_kind"], "left")
    verified = F.col("verification_status") == "server_verified_raw_artifact"
    parts.append(_rules(with_rows, "task_id", F.col("set_kind"), [
        ("provenance_record_count", F.col("record_count") != F.coalesce("n_rows", F.lit(0))),
        ("provenance_status", ~F.col("verification_status").isin("server_verified_raw_artifact", "unverified_client_import")),
        ("provenance_artifact_hash", verified & ~F.coalesce(F.col("source_artifact_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))),
        ("provenance_artifact_bytes", verified & (F.col("artifact_sha256_now") != F.col("source_artifact_sha256"))),
    ]))
    fields = [f for f in PROVENANCE_FIELDS if f in rows.columns and f in provenance.columns]
    if fields:
        header = provenance.select("task_id", "set_kind", *[F.col(f).alias(f"p_{f}") for f in fields])
        parts.append(_rules(rows.join(header, ["task_id", "set_kind"]), "task_id", F.col("lineage_row_id"), [
            (f"row_{f}_differs", ~F.col(f).eqNullSafe(F.col(f"p_{f}"))) for f in fields]))
    parts.append(_rules(readiness, "task_id", F.lit(None), [
        ("formal_ready_too_early", F.col("formal_network_ready")), ("no_blocking_reason", F.size("blocking_reasons") == 0)]))
    return union_all(parts)


def plan_issues(
    plans: DataFrame, selected: DataFrame, intersections: DataFrame, rows: DataFrame, events: DataFrame,
    outputs: DataFrame, chains: DataFrame, consumptions: DataFrame,
) -> DataFrame:
    """Everything a sealed plan, its outputs and its consumptions must satisfy.

    plans: task_id, source_task_id, plan_id, plan_sequence, canonical_plan_input_sha256,
      assembly_input_ready, formal_network_ready
    selected: task_id, plan_id, lineage_row_id, canonical_symbol, disease_ids, compound_ids
    outputs: plan_id, output_id, task_id, source_task_id, plan_sequence,
      canonical_plan_input_sha256, output_sha256
    chains: plan_id, output_id, chain_no, herb, formula, target, selection, target_evidence_type,
      evidence_level, compound_row_id
    """
    parts = []
    parts.append(_rules(plans, "task_id", F.col("plan_id"), [
        ("plan_id_derivation", F.col("plan_id") != F.concat(F.lit("assembly-plan-"), "canonical_plan_input_sha256")),
        ("plan_not_ready", ~F.col("assembly_input_ready")), ("plan_formal_ready", F.col("formal_network_ready")),
    ]))
    latest = materialize(latest_decisions(events, rows))
    undecided = rows.select("task_id", "lineage_row_id").distinct().join(
        latest.where("decision <> 'needs_review'"), ["task_id", "lineage_row_id"], "left_anti")
    parts.append(undecided.join(plans.select("task_id").distinct(), "task_id", "left_semi").select(
        "task_id", F.lit("row_undecided").alias("rule"), F.col("lineage_row_id").alias("subject")))
    truth = materialize(backed_intersections(intersections, rows, latest))
    parts.append(truth.where("not backed").join(plans.select("task_id").distinct(), "task_id", "left_semi").select(
        "task_id", F.lit("included_without_backing").alias("rule"), F.col("lineage_row_id").alias("subject")))
    want = truth.where("backed").select(
        "task_id", "lineage_row_id", F.col("selected_disease_lineage_row_ids").alias("want_d"), F.col("selected_compound_lineage_row_ids").alias("want_c"))
    plan_want = want.join(plans.select("task_id", "plan_id"), "task_id")
    both = selected.join(plan_want, ["task_id", "plan_id", "lineage_row_id"], "full_outer")
    parts.append(_rules(both, "task_id", F.col("lineage_row_id"), [
        ("selection_missing", F.col("disease_ids").isNull()), ("selection_not_included", F.col("want_d").isNull()),
        ("selection_disease_ids", F.sort_array("disease_ids") != F.col("want_d")),
        ("selection_compound_ids", F.sort_array("compound_ids") != F.col("want_c")),
    ]))

    bound = ["task_id", "source_task_id", "plan_sequence", "canonical_plan_input_sha256"]
    body = F.struct("task_id", "source_task_id", "plan_id", "plan_sequence", "canonical_plan_input_sha256", "output_sha256")
    with_plan = outputs.withColumn("want_id", content_id("assembly-output", body)).join(
        plans.select("plan_id", *[F.col(c).alias(f"p_{c}") for c in bound]), "plan_id", "left")
    parts.append(_rules(with_plan, "task_id", F.col("output_id"), [
        *[(f"output_{c}", ~F.col(c).eqNullSafe(F.col(f"p_{c}"))) for c in bound],
        ("output_id_derivation", F.col("output_id") != F.col("want_id")),
    ]))
    n_expected = selected.groupBy("plan_id").agg(F.sum(F.size("compound_ids")).alias("n_want"))
    n_chains = chains.groupBy("output_id").agg(F.count("*").alias("n_have"))
    sized = outputs.join(n_expected, "plan_id", "left").join(n_chains, "output_id", "left")
    parts.append(_rules(sized, "task_id", F.col("output_id"), [
        ("chain_count", F.coalesce("n_want", F.lit(0)) != F.coalesce("n_have", F.lit(0)))]))
    chosen = selected.select("plan_id", "task_id", F.col("lineage_row_id").alias("selection"), F.col("canonical_symbol").alias("want_symbol"), "compound_ids")
    checked = chains.join(chosen, ["plan_id", "selection"], "left").join(outputs.select("output_id", F.col("task_id").alias("o_task")), "output_id", "left")
    kind, level = F.col("target_evidence_type"), F.col("evidence_level")
    parts.append(_rules(checked.drop("task_id").withColumnRenamed("o_task", "task_id"), "task_id", F.concat_ws("#", "output_id", "chain_no"), [
        ("chain_herb", F.col("herb") != ""), ("chain_formula", F.col("formula").isNotNull()),
        ("chain_evidence_type", ~kind.isin("predicted", "mock")),
        ("chain_grading", ((kind == "mock") & (level != "mock_inferred")) | ((kind == "predicted") & (level != "predicted"))),
        ("chain_selection", F.col("want_symbol").isNull()), ("chain_target", F.col("target") != F.col("want_symbol")),
        ("chain_compound_row", F.col("want_symbol").isNotNull() & ~F.array_contains("compound_ids", F.col("compound_row_id"))),
    ]))

    with_output = consumptions.join(outputs.select("output_id", F.col("output_sha256").alias("o_sha")), "output_id", "left")
    parts.append(_rules(with_output, "task_id", F.col("consumption_id"), [
        ("consumption_id_malformed", ~F.col("consumption_id").rlike("^assembly-consumption-[0-9a-f]{64}$")),
        ("consumption_owner", F.coalesce("owner_id", F.lit("")) == ""),
        ("consumption_output", F.col("o_sha").isNull()), ("consumption_output_hash", F.col("o_sha") != F.col("output_sha256")),
    ]))
    parts.append(consumptions.groupBy("task_id", "owner_id", "plan_id").agg(F.count("*").alias("n")).where("n > 1").select(
        "task_id", F.lit("consumed_more_than_once").alias("rule"), F.col("plan_id").alias("subject")))
    parts.append(outputs.join(consumptions.select("output_id"), "output_id", "left_anti").select(
        "task_id", F.lit("output_without_consumption").alias("rule"), F.col("output_id").alias("subject")))
    return union_all(parts)
