import json

from pyspark.sql import functions as F

from evidra.operators import live, network
from tests.conftest import rows


def test_references_keep_their_digits(spark):
    text = ";".join(["10", " 111 ", "", "222"] + [str(n) * 2 for n in range(12)])
    got = spark.range(1).select(network.split_refs(F.lit(text)).alias("r"), network.split_refs(F.lit(None).cast("string")).alias("n")).first()
    assert got.r == ["10", "111", "222"] + [str(n) * 2 for n in range(12)] and got.n == []


def landed(spark):
    tasks = spark.createDataFrame([("t", "decoction", "formula"), ("u", "herb u", "herb"), ("v", "none", "herb")], "task_id string, query string, analysis_type string")
    compounds = spark.createDataFrame([("t", "Rutin", "A", 1), ("t", "Oleic", "B", 2), ("u", "Rutin", "C", 1)], "task_id string, name string, herb string, ord int")
    identities = spark.createDataFrame([("Rutin", json.dumps({"IdentifierList": {"CID": [7, 8]}})), ("Oleic", "not json"), ("Other", None)], "compound string, payload string")
    acts = [
        {"target_organism": "Homo sapiens", "target_pref_name": "tnf", "pchembl_value": "6"}, {"target_organism": "Mus musculus", "target_pref_name": "IL6"},
        {"target_pref_name": "Il4", "assay_chembl_id": "X1"}]
    activities = spark.createDataFrame([("Rutin", json.dumps({"activities": acts})), ("Oleic", json.dumps({"activities": acts[2:]})), ("Other", None)], "compound string, payload string")
    predictions = spark.createDataFrame(
        [("RUTIN", "TNF", "0.9", "", "p1", "2024", 1), ("unknown", "TNF", "0.9", "", None, None, 2), ("Oleic", "JAK1", "bad", "S", None, None, 3), (None, "JAK1", "1", "S", None, None, 4)],
        "compound string, target_symbol string, score string, source string, source_record_id string, retrieved_at string, ord int")
    gene = lambda g, a: {"genes": [{"geneName": {"value": g}}], "primaryAccession": a}
    normalizations = spark.createDataFrame(
        [("Il4", json.dumps({"results": [gene("IL4", "P1")]})), ("tnf", json.dumps({"results": [gene("TNF", None)]})), ("JAK1", json.dumps({"results": []}))], "query string, payload string")
    pathways = spark.createDataFrame([("t", 2, "late"), ("t", 1, "first")], "task_id string, pathway_id int, name string")
    return tasks, compounds, identities, activities, predictions, normalizations, pathways


def test_landed_responses_become_chains(spark):
    got = {(r.task_id, r.compound, r.target): r for r in live.live_network(*landed(spark)).collect()}
    assert set(got) == {("t", "RUTIN", "TNF"), ("u", "RUTIN", "TNF"), ("t", "Rutin", "IL4"), ("u", "Rutin", "IL4"), ("t", "Oleic", "IL4"), ("t", "Oleic", "JAK1")}
    mixed = got["t", "RUTIN", "TNF"]  # the prediction's spelling comes last, so the herb is not found
    assert (mixed.herb, mixed.score, mixed.evidence_refs, mixed.evidence_level) == (network.UNKNOWN_HERB, 0.9, ["CID:7", "p1"], "literature_supported")
    known = got["u", "Rutin", "IL4"]
    assert (known.herb, known.formula, known.pathway, known.score, known.evidence_refs, known.evidence_level) == (
        "C", None, network.UNKNOWN_PATHWAY, 0.5, ["X1", "UniProt:P1"], "experimental")
    assert (got["t", "Oleic", "JAK1"].score, got["t", "Oleic", "JAK1"].pathway, got["t", "Oleic", "JAK1"].evidence_level) == (0.0, "first", "predicted")


def test_steps_and_sources(spark):
    tasks, compounds, identities, activities, predictions, normalizations, pathways = landed(spark)
    found = live.task_candidates(compounds, identities, activities, predictions)
    assert rows(live.normalize(found, normalizations).where("task_id = 'u'"), "symbol", "source") == [
        ("IL4", "ChEMBL+UniProt"), ("TNF", "ChEMBL+UniProt"), ("TNF", "target-prediction-import")]
    states = {(r.task_id, r.step_no): (r.n, r.status) for r in live.step_states(tasks, compounds, found, pathways).collect()}
    assert [states["u", i] for i in range(6)] == [(1, "completed"), (2, "completed"), (1, "completed"), (3, "completed"), (0, "degraded"), (3, "completed")]
    assert [states["v", i][1] for i in range(6)] == ["degraded", "degraded", "skipped", "skipped", "degraded", "failed"]
    nothing = live.live_network(*[df.limit(0) for df in (tasks, compounds, identities, activities, predictions, normalizations, pathways)])
    assert nothing.count() == 0
