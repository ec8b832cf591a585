"""Landed responses to graded live chains: candidates of known and predicted targets, normalization, merge, steps.

tasks:          task_id, query, analysis_type
compounds:      task_id, name, herb, ord
identities:     compound, payload (compound lookups)      activities: compound, payload (activity lookups)
predictions:    compound, target_symbol, score, source, source_record_id, retrieved_at, ord
normalizations: query, payload (target lookups)           pathways:   task_id, pathway_id, name
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.operators import network
from evidra.session import union_all
from evidra.sources import connectors

_CANDIDATE = ["task_id", "compound", "symbol", "evidence_type", "score", "source", "source_record_id", "retrieved_at", "ord"]
# Steps in order, and the status of a step that yields nothing.
STEPS = [
    ("tcmsp-compound-resolution", "degraded"), ("known-activity-targets", "degraded"), ("predicted-target-import", "skipped"),
    ("uniprot-target-normalization", "skipped"), ("kegg-pathway-resolution", "degraded"), ("live-result-assembly", "failed"),
]


def task_candidates(compounds: DataFrame, identities: DataFrame, activities: DataFrame, predictions: DataFrame) -> DataFrame:
    """Known targets of every task's compounds, then the predicted ones whose compound (whatever its case) a task has. A lookup is parsed once
    per compound, however many tasks share it; a compound without identity keeps its activities."""
    found = connectors.compound_identities(identities).groupBy("compound").agg(F.min("source_record_id").alias("identity_record_id"))
    targets = connectors.activity_targets(activities.join(found, "compound", "left"))
    none, lower = F.lit(None).cast("string"), F.lower("compound").alias("_c")
    named = compounds.select("task_id", F.col("name").alias("compound"), F.col("ord").cast("long").alias("place"))
    known = targets.join(named, "compound").withColumn("retrieved_at", none).withColumn(
        "ord", F.struct(F.lit(0).alias("kind"), "place", F.col("activity_no").cast("long").alias("no")))
    asked = named.select("task_id", lower).distinct()
    predicted = connectors.prediction_candidates(predictions).withColumn("_c", F.lower("compound")).join(asked, "_c").withColumn(
        "ord", F.struct(F.lit(1).alias("kind"), F.col("ord").cast("long").alias("place"), F.lit(0).cast("long").alias("no")))
    return union_all([known.select(_CANDIDATE), predicted.select(_CANDIDATE)])


def normalize(candidates: DataFrame, normalizations: DataFrame) -> DataFrame:
    """Candidates under the symbol of their lookup, whose accession joins the references; without a record they stay as they are."""
    records = connectors.normalized_targets(normalizations).select(F.col("query").alias("symbol"), F.col("symbol").alias("_symbol"), "accession")
    accession = F.when(F.length("accession") > 0, F.concat(F.lit("UniProt:"), "accession"))
    ref = F.when(F.length("source_record_id") > 0, F.col("source_record_id"))
    refs = F.concat_ws(";", ref, accession)
    rows = candidates.join(records, "symbol", "left")
    hit = F.col("_symbol").isNotNull()
    return rows.withColumn("source_record_id", F.when(hit, F.when(refs != "", refs)).otherwise(F.col("source_record_id"))).withColumn(
        "source", F.when(hit, F.concat("source", F.lit("+UniProt"))).otherwise(F.col("source"))).withColumn(
        "symbol", F.coalesce("_symbol", "symbol")).select(_CANDIDATE)


def live_network(
    tasks: DataFrame, compounds: DataFrame, identities: DataFrame, activities: DataFrame, predictions: DataFrame, normalizations: DataFrame, pathways: DataFrame,
) -> DataFrame:
    """Chains of every task with their evidence level."""
    candidates = normalize(task_candidates(compounds, identities, activities, predictions), normalizations)
    chains = network.live_chains(tasks, network.merge_task_targets(candidates), compounds, pathways)
    return chains.withColumn("evidence_level", network.evidence_level(F.lit("live"), F.col("target_evidence_type"), F.size("evidence_refs") > 0))


def step_states(tasks: DataFrame, compounds: DataFrame, candidates: DataFrame, pathways: DataFrame) -> DataFrame:
    """(task_id, step_no, step, n, status): a step without items has the status of its kind. Candidates are those of ``task_candidates``; every one
    passes normalization, and a task has chains if it has candidates."""
    known = F.col("evidence_type") == "known_activity"
    count = lambda df, name: df.groupBy("task_id").agg(F.count("*").alias(name))
    per = candidates.groupBy("task_id").agg(F.count_if(known).alias("n1"), F.count_if(~known).alias("n2"), F.count("*").alias("n3"))
    rows = tasks.select("task_id").join(count(compounds, "n0"), "task_id", "left").join(per, "task_id", "left").join(count(pathways, "n4"), "task_id", "left").na.fill(0)
    n = F.array("n0", "n1", "n2", "n3", "n4", "n3")
    table = F.array(*[F.struct(F.lit(name).alias("step"), F.lit(empty).alias("empty")) for name, empty in STEPS])
    steps = rows.select("task_id", F.posexplode(F.arrays_zip(table.alias("s"), n.alias("n"))).alias("step_no", "z"))
    return steps.select("task_id", "step_no", "z.s.step", "z.n", F.when(F.col("z.n") > 0, F.lit("completed")).otherwise(F.col("z.s.empty")).alias("status"))
