from pyspark.sql import functions as F

from evidra.operators import audits, documents, review
from tests.conftest import rows

EVENT = "task_id string, seq bigint, adjudication_id string, lineage_row_id string, decision string, reason string, decided_at string, reviewer_id string"


def events(spark):
    return spark.createDataFrame([
        ("t", 0, "a0", "d1", "excluded", "r", "2024", "u"), ("t", 1, "a1", "d1", "included", "r", "2024", "u"), ("t", 2, "a2", "c1", "included", "r", "2024", "u"),
        ("t", 3, "a3", "i1", "included", "r", "2024", "u"), ("t", 4, "a4", "ghost", "included", "r", "2024", "u")], EVENT)


def lineage_rows(spark):
    return spark.createDataFrame([("t", "d1", "disease"), ("t", "c1", "compound"), ("t", "i1", "intersection"), ("t", "d2", "disease")], "task_id string, lineage_row_id string, set_kind string")


def test_latest_wins_and_summary(spark):
    latest = review.latest_decisions(events(spark), lineage_rows(spark))
    assert rows(latest, "lineage_row_id", "decision") == [("c1", "included"), ("d1", "included"), ("i1", "included")]
    summary = review.adjudication_summary(events(spark), lineage_rows(spark)).first()
    assert (summary.included, summary.pending) == (3, 1)


def test_audit_chain_tampering(spark):
    key = b"k"
    tagged = review.tag_events(events(spark), key)
    assert review.audit_chain_issues(tagged, key).count() == 0
    assert review.audit_chain_issues(tagged, b"other").where("rule = 'tag_mismatch'").count() == 5
    edited = tagged.withColumn("decision", F.when(F.col("seq") == 2, "excluded").otherwise(F.col("decision")))
    assert rows(review.audit_chain_issues(edited, key), "seq", "rule") == [(2, "tag_mismatch")]
    dropped = tagged.where("seq <> 2")
    assert rows(review.audit_chain_issues(dropped, key), "seq", "rule") == [(3, "tag_mismatch")]
    malformed = tagged.withColumn("audit_hmac", F.when(F.col("seq") == 4, "zz").otherwise(F.col("audit_hmac")))
    assert rows(review.audit_chain_issues(malformed, key), "seq", "rule") == [(4, "malformed_tag")]
    doubled = tagged.unionByName(tagged.where("seq = 4").withColumn("seq", F.lit(5).cast("bigint")))
    assert ("duplicate_adjudication_id",) in rows(review.audit_chain_issues(doubled, key), "rule")


def consumption_tables(spark):
    tasks = spark.createDataFrame([("p", "o", None, "completed", "ph", "lp"), ("t", "o", "p", "completed", "ph", "lt")],
                                  "task_id string, owner_id string, source_task_id string, status string, protocol_sha256 string, target_lineage_sha256 string")
    plans = spark.createDataFrame([("t", f"assembly-plan-h{i}", i, f"h{i}", "lt", "s", "ph", "ph") for i in (1, 2)],
                                  "task_id string, plan_id string, plan_sequence int, canonical_plan_input_sha256 string, target_lineage_sha256 string, adjudication_selection_sha256 string, parent_protocol_sha256 string, child_protocol_sha256 string")
    selection = spark.createDataFrame([("t", "s")], "task_id string, adjudication_selection_sha256 string")
    return tasks, plans, selection


REQUEST = "request_seq bigint, task_id string, plan_id string, owner_id string, writer_id string, canonical_plan_input_sha256 string, output_sha256 string"
STORED = "task_id string, plan_id string, writer_id string, output_sha256 string, consumed_at timestamp"


def test_consumption_order_of_checks(spark):
    tasks, plans, selection = consumption_tables(spark)
    requests = spark.createDataFrame([
        (1, "t", "assembly-plan-h1", "o", "w", None, "out"), (2, "t", "assembly-plan-h2", "x", "w", None, "out"), (3, "t", "assembly-plan-h2", "o", "w", "bad", "out"),
        (4, "t", "assembly-plan-h2", "o", "w", "h2", "out"), (5, "t", "assembly-plan-h2", "o", "w", None, "out"), (6, "t", "assembly-plan-h2", "o", "v", None, "out")], REQUEST)
    none = spark.createDataFrame([], STORED)
    states = {r.request_seq: r.state for r in review.consumption_states(requests, tasks, plans, none, selection).collect()}
    assert states == {1: "superseded", 2: "not_found", 3: "invalid_request", 4: "created", 5: "existing", 6: "already_consumed"}
    moved = selection.withColumn("adjudication_selection_sha256", F.lit("z"))
    again = {r.request_seq: r.state for r in review.consumption_states(requests, tasks, plans, none, moved).collect()}
    assert again[4] == "conflict"
    import datetime

    used = spark.createDataFrame([("t", "assembly-plan-h1", "w", "out", datetime.datetime(2024, 1, 1))], STORED)
    replay = {r.request_seq: r.state for r in review.consumption_states(requests, tasks, plans, used, moved).collect()}
    assert replay[1] == "existing"  # a consumed plan is replayed whatever happened to the revision
    full = {r.request_seq: r.state for r in review.consumption_states(requests, tasks, plans, used, selection, limit=1).collect()}
    assert full[4] == "capacity_exceeded"


def test_consumption_reads_requests_once(spark, tmp_path):
    """Requests meet their plans in one exchange, and repeated records of a task or its selection give as many rows as a join would, also where
    the plan is unknown."""
    tasks, plans, selection = consumption_tables(spark)
    digest = "ab" * 32
    long = plans.where("plan_sequence = 2").withColumn("plan_sequence", F.lit(3)).withColumn("canonical_plan_input_sha256", F.lit(digest)).withColumn(
        "plan_id", F.lit(f"assembly-plan-{digest}"))
    table = [(1, "t", f"assembly-plan-{digest}", "o", "w", digest, "out"), (2, "t", f"assembly-plan-{digest}", "o", "w", digest.upper(), "out"), (3, "t", "unknown", "o", "w", None, "out"),
             (4, "t", "unknown", "x", "w", None, "out"), (5, "t", None, "o", "w", None, "out"), (6, None, "assembly-plan-h1", "o", "w", None, "out"), (7, "t", "assembly-plan-h1", None, "w", None, "out")]
    spark.createDataFrame(table, REQUEST).write.parquet(f"{tmp_path}/requests")
    requests = spark.read.parquet(f"{tmp_path}/requests")
    found = review.consumption_states(requests, tasks.union(tasks.where("task_id = 't'")), plans.union(long), spark.createDataFrame([], STORED), selection.union(selection))
    counts = {(r.request_seq, r.plan_id, r.plan_sequence, r.state): r.n for r in found.groupBy("request_seq", "plan_id", "plan_sequence", "state").agg(F.count("*").alias("n")).collect()}
    assert counts == {
        (1, f"assembly-plan-{digest}", 3, "created"): 4, (2, f"assembly-plan-{digest}", 3, "invalid_request"): 4, (3, "unknown", None, "not_found"): 4,
        (4, "unknown", None, "not_found"): 2, (5, None, None, "not_found"): 4, (6, "assembly-plan-h1", None, "not_found"): 1, (7, "assembly-plan-h1", 1, "not_found"): 2}
    plan = found.groupBy("state").agg(F.count_distinct("plan_id"))._jdf.queryExecution().executedPlan().toString()
    assert len([line for line in plan.splitlines() if "FileScan" in line and "request_seq" in line]) == 1
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 2  # by plan, and by state for the counts


def test_sealing_states(spark):
    plans = spark.createDataFrame([("t", "h1", 1)], "task_id string, canonical_plan_input_sha256 string, plan_sequence int")
    candidates = spark.createDataFrame([("t", "h1", 1, True), ("t", "h2", 2, True), ("t", "h2", 3, True), ("t", "h3", 4, False), ("u", "h9", 5, True)], "task_id string, input_sha256 string, ord int, events_unchanged boolean")
    got = rows(review.seal_plans(candidates, plans), "task_id", "input_sha256", "state", "plan_sequence")
    assert got == [("t", "h1", "existing", 1), ("t", "h2", "created", 2), ("t", "h2", "created", 2), ("t", "h3", "conflict", None), ("u", "h9", "created", 1)]


def test_sealing_shuffles_its_candidates_once(spark, tmp_path):
    plans = spark.createDataFrame([("a", "h1", 4), ("a", "h1", 5), ("a", None, 7), (None, "h1", 9)], "task_id string, canonical_plan_input_sha256 string, plan_sequence int")
    asked = [("a", "h1", 1, False), ("a", "h3", 2, True), ("a", "h2", 3, False), ("a", "h2", 4, True), ("a", "h3", 5, True), ("a", None, 1, True), (None, "h1", 1, True),
             ("b", "h1", 9, True)]
    candidates = spark.createDataFrame(asked, "task_id string, input_sha256 string, ord int, events_unchanged boolean")
    for name, table in (("p", plans), ("c", candidates)):
        table.write.parquet(str(tmp_path / name))
    sealed = review.seal_plans(spark.read.parquet(str(tmp_path / "c")), spark.read.parquet(str(tmp_path / "p")))
    assert rows(sealed, "task_id", "input_sha256", "state", "plan_sequence") == sorted([
        ("a", "h1", "existing", 4), ("a", "h1", "existing", 5), ("a", "h3", "created", 9), ("a", "h3", "created", 9), ("a", "h2", "conflict", None),
        ("a", "h2", "created", 10), ("a", None, "created", None), (None, "h1", "created", None), ("b", "h1", "created", 1)], key=repr)
    assert sealed._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1

def test_plan_chains_fail_closed(spark):
    selected = spark.createDataFrame([("p1", "t", "i1", "IL6", ["d1"], ["c1"]), ("p2", "t", "i2", "TNF", ["gone"], ["c2"])], "plan_id string, task_id string, lineage_row_id string, canonical_symbol string, disease_ids array<string>, compound_ids array<string>")
    frozen = spark.createDataFrame([("t", "disease", "d1", "E1", "IL6", 0.9, "association_score", "disease_association"), ("t", "compound", "c1", "T1", "IL6", 6.4, "pchembl_value", "known_activity"), ("t", "compound", "c2", "T2", "TNF", 5.0, "pchembl_value", "mock")],
                                   "task_id string, set_kind string, lineage_row_id string, raw_identifier string, canonical_symbol string, source_score double, score_name string, evidence_origin string")
    pathways = spark.createDataFrame([("IL6", "JAK")], "symbol string, pathway string")
    meta = spark.createDataFrame([("t", "AD", "mock")], "task_id string, disease string, data_mode string")
    got = {r.plan_id: r for r in review.assemble_from_plans(selected, frozen, pathways, meta).collect()}
    assert (got["p1"].state, got["p1"].pathway, round(got["p1"].score, 3), got["p1"].evidence_level) == ("ok", "JAK", 0.64, "predicted")
    assert (got["p2"].state, got["p2"].evidence_level) == ("integrity_failed", "mock_inferred")


def test_owner_scope_and_projection(spark):
    records = spark.createDataFrame([("a", "o", "2024-01", None, False, "completed"), ("b", None, "2024-02", None, True, "completed"), ("c", "o", "2024-03", "a", True, "completed")],
                                    "task_id string, owner_id string, created_at string, source_task_id string, has_compound_import boolean, status string")
    assert [r.task_id for r in review.task_list(records, "o").collect()] == ["c", "a"]
    assert {r.task_id: r.status for r in review.task_projection(records).collect()} == {"a": "completed", "b": "failed", "c": "completed"}


def test_set_differences(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "x int"), spark.createDataFrame([(2,), (3,)], "x int")
    assert rows(audits.set_differences(a, b)) == [(1, "declared_only"), (3, "recomputed_only")]


def test_documents_escape_and_redact(spark):
    df = spark.createDataFrame([("a|b <i> \\ x://y",), ("",), (None,)], "v string").select(documents.table_cell(F.col("v")).alias("c"))
    assert [r.c for r in df.collect()] == ["a\\|b &lt;i&gt; \\\\\\\\ x&#58;//y", "无", "无"]
    questions = spark.createDataFrame([("q1", "why?", "MY_API_KEY=abc", "passed"), ("q2", "x", "y", "blocked")], "question_id string, question string, answer string, grounding_status string")
    chosen, problems = documents.selected_questions(questions, ["q1", "q2", "q9"])
    assert rows(chosen, "question_id") == [("q1",)] and rows(problems) == [("q2", "not_passed"), ("q9", "missing")]
    claims = spark.createDataFrame([("q1", 1, "t", ["c1", "c2"])], "question_id string, claim_no int, text string, evidence_refs array<string>")
    cited = spark.createDataFrame([("q1", 1, 0, "c1", "sk-12345678abc")], "question_id string, claim_no int, ref_no int, chunk_id string, text string")
    text = documents.render(documents.reviewer_packet_lines(chosen, claims, cited)).first().text
    assert text.startswith("- WARNING: q1 claim has 2 evidence refs (claim 1); expected exactly 1.") and "[REDACTED]" in text and "abc" not in text.replace("[REDACTED]", "")
