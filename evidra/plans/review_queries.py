"""Registered queries: review decisions, gate, plans, audits, streams.

customer = lineage rows (ten per task), events = decisions on them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evidra.functions import canonical
from evidra.operators import audits, latency, ordering, review
from evidra.session import load_table, materialize, release, work_folder
from evidra.streaming import jobs

KEY = b"registered-query-key"


def _task(c: str):
    return F.concat(F.lit("task-"), F.floor(F.col(c) / 10).cast("string"))


def decisions(spark, sf):
    decision = F.when(F.col("event_type").isin("click", "signup"), "included").when(F.col("event_type") == "view", "excluded").when(
        F.col("event_type") == "error", "needs_review").otherwise("omics_confirmed")
    return load_table(spark, sf, "events").select(
        _task("user_id").alias("task_id"), F.col("event_id").alias("seq"), F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("adjudication_id"),
        F.col("user_id").cast("string").alias("lineage_row_id"), decision.alias("decision"), F.col("props").alias("reason"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("decided_at"), F.concat(F.lit("rev"), (F.col("event_id") % 7).cast("string")).alias("reviewer_id"))


_DECISIONS = """
ev AS (SELECT 'task-' || (user_id // 10) AS task_id, event_id AS seq, CAST(user_id AS VARCHAR) AS row_id, CASE WHEN event_type IN ('click','signup') THEN 'included' WHEN event_type = 'view' THEN 'excluded'
  WHEN event_type = 'error' THEN 'needs_review' ELSE 'omics_confirmed' END AS decision, props AS reason FROM events),
latest AS (SELECT task_id, row_id, max(seq) AS seq, arg_max(decision, seq) AS decision, arg_max(reason, seq) AS reason FROM ev GROUP BY 1, 2),
rw AS (SELECT 'task-' || (c_custkey // 10) AS task_id, CAST(c_custkey AS VARCHAR) AS row_id, CASE WHEN c_acctbal > 6000 THEN 'intersection' WHEN c_nationkey < 12 THEN 'disease' ELSE 'compound' END AS kind, c_mktsegment AS sym FROM customer)"""


def lineage_rows(spark, sf):
    kind = F.when(F.col("c_acctbal") > 6000, "intersection").when(F.col("c_nationkey") < 12, "disease").otherwise("compound")
    return load_table(spark, sf, "customer").select(
        _task("c_custkey").alias("task_id"), F.col("c_custkey").cast("string").alias("lineage_row_id"), kind.alias("set_kind"),
        F.col("c_mktsegment").alias("canonical_symbol"))


def intersections(spark, sf):
    """Rich customers as intersections backed by all other rows of their task (at most ten)."""
    rows = lineage_rows(spark, sf)
    ids = lambda k: F.sort_array(F.collect_list(F.when(F.col("set_kind") == k, F.col("lineage_row_id"))))
    backing = rows.groupBy("task_id").agg(ids("disease").alias("disease_lineage_row_ids"), ids("compound").alias("compound_lineage_row_ids"))
    return rows.where("set_kind = 'intersection'").select("task_id", "lineage_row_id", "canonical_symbol").join(backing, "task_id")


def tasks(spark, sf):
    """One task per ten customers; odd ones are children of the task before them."""
    k = F.col("k")
    base = load_table(spark, sf, "customer").select(F.floor(F.col("c_custkey") / 10).alias("k")).distinct()
    child = k % 2 == 1
    return base.select(
        F.concat(F.lit("task-"), k.cast("string")).alias("task_id"), F.concat(F.lit("owner-"), (F.floor(k / 2) % 5).cast("string")).alias("owner_id"),
        F.when(child, F.concat(F.lit("task-"), (k - 1).cast("string"))).alias("source_task_id"),
        F.when(k % 11 == 10, "running").otherwise("completed").alias("status"), child.alias("has_compound_import"),
        F.when(k % 7 == 3, "p1").otherwise("p0").alias("protocol_sha256"), F.when(k % 5 == 4, "unverified_client_import").otherwise("server_verified_raw_artifact").alias("disease_status"),
        F.lit("d").alias("disease_sha256"), F.when(k % 6 == 5, None).otherwise("server_verified_raw_artifact").alias("compound_status"), F.lit("c").alias("compound_sha256"),
        (k % 9 == 1).alias("has_computed_parts"), F.concat(F.lit("l"), k.cast("string")).alias("target_lineage_sha256"), k.alias("created_at"))


_TASKS = """
tk AS (SELECT DISTINCT c_custkey // 10 AS k FROM customer),
ts AS (SELECT k, 'task-' || k AS task_id, k % 2 = 1 AS child, k % 11 = 10 AS running, CASE WHEN k % 7 = 3 THEN 'p1' ELSE 'p0' END AS proto, k % 5 = 4 AS d_bad, k % 6 = 5 AS c_bad, k % 9 = 1 AS parts FROM tk),
tp AS (SELECT t.*, p.task_id IS NULL OR p.running AS broken, p.proto AS p_proto FROM ts t LEFT JOIN ts p ON t.child AND p.k = t.k - 1),
li AS (SELECT task_id, row_id FROM rw SEMI JOIN latest ON rw.task_id = latest.task_id AND rw.row_id = latest.row_id AND latest.decision = 'included'),
inc AS (SELECT rw.* FROM rw SEMI JOIN li ON rw.task_id = li.task_id AND rw.row_id = li.row_id),
bk AS (SELECT i.task_id, i.row_id, i.sym, list_sort(coalesce(list(o.row_id) FILTER (o.kind = 'disease'), [])) AS d, list_sort(coalesce(list(o.row_id) FILTER (o.kind = 'compound'), [])) AS c
  FROM inc i LEFT JOIN inc o ON o.task_id = i.task_id AND o.kind <> 'intersection' WHERE i.kind = 'intersection' GROUP BY ALL)"""


def owned_tasks(spark, sf):
    return review.task_list(tasks(spark, sf), "owner-3").select("task_id", "source_task_id", "status")


def task_projection(spark, sf):
    rows = tasks(spark, sf).withColumn("source_task_id", F.when(F.col("created_at") % 4 != 1, F.col("source_task_id")))
    return review.task_projection(rows).select("task_id", "status")


def latest_decisions(spark, sf):
    return review.latest_decisions(decisions(spark, sf), lineage_rows(spark, sf)).select("task_id", "lineage_row_id", "decision", "reason", "seq")


def adjudication_summary(spark, sf):
    return review.adjudication_summary(decisions(spark, sf), lineage_rows(spark, sf))


def adjudication_ids(spark, sf):
    rows = decisions(spark, sf).withColumn("nonce", F.lit("n"))
    return review.adjudication_ids(rows.drop("adjudication_id")).select("seq", "adjudication_id")


def backed_intersections(spark, sf):
    latest = review.latest_decisions(decisions(spark, sf), lineage_rows(spark, sf))
    rows = review.backed_intersections(intersections(spark, sf), lineage_rows(spark, sf), latest)
    return rows.select(
        "task_id", "lineage_row_id", F.coalesce(F.array_join("selected_disease_lineage_row_ids", ","), F.lit("")).alias("disease_ids"),
        F.coalesce(F.array_join("selected_compound_lineage_row_ids", ","), F.lit("")).alias("compound_ids"), "backed")


def assembly_gate(spark, sf):
    gate = review.assembly_gate(tasks(spark, sf), lineage_rows(spark, sf), decisions(spark, sf), intersections(spark, sf))
    return gate.select("task_id", F.array_join("blockers", ",").alias("blockers"), "state")


GATE_SQL = f"""WITH {_DECISIONS}, {_TASKS},
nr AS (SELECT rw.task_id, count(*) AS n, count(*) FILTER (latest.decision IS NOT NULL AND latest.decision <> 'needs_review') AS done FROM rw LEFT JOIN latest USING (task_id, row_id) GROUP BY 1),
nb AS (SELECT task_id, count(*) FILTER (len(d) > 0 AND len(c) > 0) AS good, count(*) FILTER (len(d) = 0 OR len(c) = 0) AS bad FROM bk GROUP BY 1),
g AS (SELECT task_id, CASE WHEN running THEN 'task_not_completed' ELSE concat_ws(',',
  CASE WHEN done < n THEN 'adjudication_incomplete' END, CASE WHEN broken THEN 'broken_parent_link' END, CASE WHEN c_bad THEN 'compound_provenance_unverified' END,
  CASE WHEN d_bad THEN 'disease_provenance_unverified' END, CASE WHEN coalesce(bad, 0) > 0 THEN 'included_intersection_missing_backing' END,
  CASE WHEN coalesce(good, 0) = 0 THEN 'no_included_intersection' END, CASE WHEN NOT child THEN 'not_compound_child' END,
  CASE WHEN NOT broken AND p_proto <> proto THEN 'protocol_mismatch' END, CASE WHEN parts THEN 'snapshot_only_boundary_violated' END) END AS blockers
  FROM tp JOIN nr USING (task_id) LEFT JOIN nb USING (task_id))
SELECT task_id, blockers, CASE WHEN blockers = '' THEN 'assembly_input_ready' ELSE 'blocked' END AS state FROM g"""


def _plan_sequence(spark, sf):
    """Orders as a sequence of plans per customer's task, staged without their digests."""
    orders = load_table(spark, sf, "orders")
    w_task = _task("o_custkey")
    keys = orders.select(w_task.alias("task_id"), "o_orderkey").withColumn("_n", F.lit(1))
    sequence = ordering.cumulative_count(ordering.with_blocks(keys, ["task_id"], "o_orderkey"), ["task_id"], "o_orderkey", "plan_sequence")
    return materialize(sequence.select("task_id", F.col("plan_sequence").cast("int").alias("plan_sequence"), "o_orderkey"))


def _sealed(sequence, *columns):
    return sequence.select(
        "task_id", F.sha2(F.col("o_orderkey").cast("string"), 256).alias("canonical_plan_input_sha256"), "plan_sequence", "o_orderkey", *columns,
    ).withColumn("plan_id", F.concat(F.lit("assembly-plan-"), "canonical_plan_input_sha256"))


def _plans(spark, sf):
    """Orders as sealed plans: one sequence per customer's task."""
    return _sealed(_plan_sequence(spark, sf))


_PLANS = """
pl AS (SELECT 'task-' || (o_custkey // 10) AS task_id, sha256(CAST(o_orderkey AS VARCHAR)) AS h, o_orderkey,
  CAST(row_number() OVER (PARTITION BY o_custkey // 10 ORDER BY o_orderkey) AS INTEGER) AS plan_sequence FROM orders)"""


def sealed_plans(spark, sf):
    """Line items as sealing requests on top of the stored plans."""
    plans = _plans(spark, sf)
    requests = load_table(spark, sf, "lineitem").select(
        _task("l_suppkey").alias("task_id"), F.sha2(F.col("l_orderkey").cast("string"), 256).alias("input_sha256"),
        F.struct("l_orderkey", "l_linenumber").alias("ord"), (F.col("l_tax") < 0.07).alias("events_unchanged"))
    states = review.seal_plans(requests, plans)
    return states.groupBy("task_id", "state").agg(F.count("*").alias("n"), F.max("plan_sequence").alias("last_sequence"))


SEAL_SQL = f"""WITH {_PLANS},
rq AS (SELECT 'task-' || (l_suppkey // 10) AS task_id, sha256(CAST(l_orderkey AS VARCHAR)) AS h, l_orderkey AS o, l_tax < 0.07 AS ok FROM lineitem),
st AS (SELECT rq.*, pl.plan_sequence AS known, CASE WHEN pl.h IS NOT NULL THEN 'existing' WHEN NOT ok THEN 'conflict' ELSE 'created' END AS state FROM rq LEFT JOIN pl USING (task_id, h)),
nw AS (SELECT task_id, h, row_number() OVER (PARTITION BY task_id ORDER BY min(o)) AS n FROM st WHERE state = 'created' GROUP BY task_id, h),
lt AS (SELECT task_id, max(plan_sequence) AS last FROM pl GROUP BY 1)
SELECT task_id, state, count(*) AS n, CAST(max(CASE state WHEN 'existing' THEN known WHEN 'created' THEN coalesce(last, 0) + nw.n END) AS BIGINT) AS last_sequence
FROM st LEFT JOIN nw USING (task_id, h) LEFT JOIN lt USING (task_id) GROUP BY 1, 2""".replace(
    "nw AS (SELECT task_id, h, row_number() OVER (PARTITION BY task_id ORDER BY min(o)) AS n FROM st WHERE state = 'created' GROUP BY task_id, h)",
    "nf AS (SELECT task_id, h, min(o) AS o FROM st WHERE state = 'created' GROUP BY ALL), nw AS (SELECT task_id, h, row_number() OVER (PARTITION BY task_id ORDER BY o) AS n FROM nf)")


def plan_audit(spark, sf):
    used = load_table(spark, sf, "orders").where("o_orderstatus = 'F'").select(
        _task("o_custkey").alias("task_id"), F.concat(F.lit("assembly-plan-"), F.sha2(F.col("o_orderkey").cast("string"), 256)).alias("plan_id"))
    return review.plan_audit(_plans(spark, sf), used)


def plan_chains(spark, sf):
    """Chains of one plan per task from its backed intersections."""
    latest = review.latest_decisions(decisions(spark, sf), lineage_rows(spark, sf))
    backed = review.backed_intersections(intersections(spark, sf), lineage_rows(spark, sf), latest).where("backed")
    selected = backed.select(
        F.concat(F.lit("plan-"), "task_id").alias("plan_id"), "task_id", "lineage_row_id", "canonical_symbol",
        F.col("selected_disease_lineage_row_ids").alias("disease_ids"), F.col("selected_compound_lineage_row_ids").alias("compound_ids"))
    rows = load_table(spark, sf, "customer").select(
        _task("c_custkey").alias("task_id"), F.when(F.col("c_nationkey") < 12, "disease").otherwise("compound").alias("set_kind"), F.col("c_custkey").cast("string").alias("lineage_row_id"),
        F.col("c_name").alias("raw_identifier"), F.col("c_mktsegment").alias("canonical_symbol"), (F.col("c_acctbal") / 500).alias("source_score"),
        F.lit("pchembl_value").alias("score_name"), F.when(F.col("c_nationkey") == 3, "mock").otherwise("known_activity").alias("evidence_origin"))
    names = load_table(spark, sf, "orders").join(load_table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(
        F.col("c_mktsegment").alias("symbol")).agg(F.min_by("o_orderpriority", "o_orderkey").alias("pathway"))
    meta = tasks(spark, sf).select("task_id", F.lit("Atopic dermatitis").alias("disease"), F.lit("live").alias("data_mode"))
    chains = review.assemble_from_plans(selected, rows, names, meta)
    return chains.select("plan_id", "selection", "state", "compound", "target", "pathway", F.round("score", 6).alias("score"), "target_evidence_type", "evidence_level")


CHAINS_SQL = f"""WITH {_DECISIONS}, {_TASKS},
sl AS (SELECT * FROM bk WHERE len(d) > 0 AND len(c) > 0),
ref AS (SELECT task_id, row_id, sym, 'disease' AS kind, unnest(d) AS ref FROM sl UNION ALL SELECT task_id, row_id, sym, 'compound', unnest(c) FROM sl),
rs AS (SELECT ref.*, c_name, c_mktsegment, c_acctbal, c_nationkey FROM ref LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = ref),
fl AS (SELECT task_id, bool_or(kind = 'compound' AND c_mktsegment <> sym) AS bad, bool_or(c_nationkey = 3) AS mock FROM rs GROUP BY 1),
pn AS (SELECT c_mktsegment AS sym, arg_min(o_orderpriority, o_orderkey) AS pathway FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT 'plan-' || task_id AS plan_id, row_id AS selection, CASE WHEN bad THEN 'integrity_failed' ELSE 'ok' END AS state, c_name AS compound, sym AS target, coalesce(pathway, '') AS pathway,
  round(greatest(0.0, least(1.0, c_acctbal / 500 / 10)), 6) AS score, CASE WHEN mock THEN 'mock' ELSE 'predicted' END AS target_evidence_type, 'predicted' AS evidence_level
FROM rs JOIN fl USING (task_id) LEFT JOIN pn USING (sym) WHERE kind = 'compound'"""


def _consumption_inputs(spark, sf):
    t = tasks(spark, sf)
    of_task = t.select("task_id", "protocol_sha256", "target_lineage_sha256", "owner_id")
    sequence = materialize(_plan_sequence(spark, sf).join(of_task, "task_id"))  # a task id has one record
    lines = load_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity", "l_returnflag")
    closed = load_table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    asked, consumed = (materialize(df, "zstd") for df in (
        sequence.drop("protocol_sha256", "target_lineage_sha256").join(lines, "o_orderkey"),
        sequence.select("task_id", "plan_sequence", "o_orderkey").join(closed, "o_orderkey", "left_semi")))
    release(spark)  # only staged tables go on from here; they hold no digests, which would be most of them
    plans = _sealed(sequence, "target_lineage_sha256", F.lit("s").alias("adjudication_selection_sha256"), F.lit("p0").alias("parent_protocol_sha256"),
                    F.col("protocol_sha256").alias("child_protocol_sha256"))
    requests = _sealed(asked, F.col("o_orderkey").alias("l_orderkey"), "owner_id", "l_linenumber", "l_quantity", "l_returnflag").select(
        F.struct("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag").alias("request_seq"), "task_id", "plan_id",
        F.when(F.col("l_quantity") > 45, "stranger").otherwise(F.col("owner_id")).alias("owner_id"), F.col("l_returnflag").alias("writer_id"),
        F.when(F.col("l_quantity") < 4, "wrong").otherwise(F.col("canonical_plan_input_sha256")).alias("canonical_plan_input_sha256"), F.lit("out").alias("output_sha256"))
    used = _sealed(consumed).select("task_id", "plan_id", F.lit("A").alias("writer_id"), F.lit("out").alias("output_sha256"), F.lit(1).alias("consumed_at"))
    selection = t.select("task_id", F.when(F.col("created_at") % 8 == 7, "moved").otherwise("s").alias("adjudication_selection_sha256"))
    return requests, t, plans, used, selection


def consumption_states(spark, sf):
    states = review.consumption_states(*_consumption_inputs(spark, sf))
    return states.groupBy("state").agg(F.count("*").alias("n"), F.count_distinct("plan_id").alias("n_plans"))


def consumption_stream(spark, sf):
    """The same requests as a stream in two runs, the second from the first one's state: lines up to the third of each order, then the rest."""
    requests, *static, used, selection = _consumption_inputs(spark, sf)
    t, plans, used, selection = (materialize(df) for df in (*static, used, selection))
    line, part = F.col("request_seq.l_linenumber"), F.col("request_seq")
    number = ((part["l_orderkey"] * 16 + line) * 64 + part["l_quantity"].cast("int")) * 128 + F.ascii(part["l_returnflag"])
    asked = materialize(requests.withColumn("late", line > 3).withColumn("request_seq", number.cast("long")))
    folder = work_folder(spark, "consumption")
    for run, late in enumerate((False, True)):
        asked.where(F.col("late") == late).drop("late").write.mode("overwrite").parquet(f"{folder}/in/run={run}")
        stream = spark.readStream.schema(asked.drop("late").schema).parquet(f"{folder}/in/run=*")
        jobs.consume_batches(stream, t, plans, selection, f"{folder}/store", f"{folder}/out", f"{folder}/checkpoint", used).awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("state").agg(F.count("*").alias("n"), F.count_distinct("plan_id").alias("n_plans"))


CONSUME_SQL = f"""WITH {_DECISIONS}, {_TASKS}, {_PLANS},
nw AS (SELECT *, max(plan_sequence) OVER (PARTITION BY task_id) AS m FROM pl),
us AS (SELECT task_id, h FROM nw JOIN orders USING (o_orderkey) WHERE o_orderstatus = 'F'),
rq AS (SELECT nw.task_id, h, plan_sequence, m, l_orderkey, l_linenumber, l_quantity, l_returnflag AS writer, us.h IS NOT NULL AS used, tp.*EXCLUDE(task_id)
  FROM nw JOIN lineitem ON o_orderkey = l_orderkey JOIN tp USING (task_id) LEFT JOIN us USING (task_id, h)),
rj AS (SELECT *, CASE WHEN l_quantity > 45 THEN 'not_found' WHEN l_quantity < 4 THEN 'invalid_request' WHEN NOT used AND plan_sequence <> m THEN 'superseded'
  WHEN NOT used AND k % 8 = 7 THEN 'conflict' WHEN broken THEN 'broken_parent_link' WHEN running OR p_proto <> 'p0' THEN 'integrity_failed' END AS rej FROM rq),
fi AS (SELECT *, row_number() OVER (PARTITION BY task_id, h ORDER BY rej IS NOT NULL, l_orderkey, l_linenumber, l_quantity, writer) AS r,
  first_value(writer) OVER (PARTITION BY task_id, h ORDER BY rej IS NOT NULL, l_orderkey, l_linenumber, l_quantity, writer) AS fw FROM rj),
st AS (SELECT h, CASE WHEN rej IS NOT NULL THEN rej WHEN used THEN CASE WHEN writer = 'A' THEN 'existing' ELSE 'already_consumed' END WHEN r = 1 THEN 'created'
  WHEN writer = fw THEN 'existing' ELSE 'already_consumed' END AS state FROM fi)
SELECT state, count(*) AS n, count(DISTINCT h) AS n_plans FROM st GROUP BY 1"""


def confirmation_states(spark, sf):
    """Orders ask for confirmation of their customer's row."""
    rows = lineage_rows(spark, sf).where("set_kind = 'disease'")
    requests = load_table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("request_id"), _task("o_custkey").alias("task_id"), F.col("o_custkey").cast("string").alias("lineage_row_id"),
        F.col("o_orderpriority").alias("accession"), F.when(F.col("o_totalprice") > 100000, "AUTOMOBILE").otherwise("BUILDING").alias("canonical_symbol"))
    snapshots = load_table(spark, sf, "orders").where("o_orderpriority <> '5-LOW'").select(
        F.col("o_orderpriority").alias("accession"), (F.col("o_orderpriority") != "2-HIGH").alias("verified")).distinct()
    candidates = rows.groupBy("task_id", "canonical_symbol").agg(F.collect_list("lineage_row_id").alias("lineage_row_ids")).select(
        "task_id", F.lit("1-URGENT").alias("accession"), "canonical_symbol", "lineage_row_ids", F.lit(2.5).alias("log2fc"), F.lit(0.01).alias("adj_p_value"))
    states = review.confirmation_states(requests, rows, snapshots, candidates)
    return states.groupBy("state").agg(F.count("*").alias("n"), F.sum("omics_log2fc").alias("log2fc"))


CONFIRM_SQL = f"""WITH {_DECISIONS}, r AS (SELECT o_orderpriority AS acc, CASE WHEN o_totalprice > 100000 THEN 'AUTOMOBILE' ELSE 'BUILDING' END AS sym, rw.sym AS row_sym
  FROM orders LEFT JOIN rw ON rw.row_id = CAST(o_custkey AS VARCHAR) AND rw.kind = 'disease'),
s AS (SELECT CASE WHEN row_sym IS NULL OR row_sym <> sym THEN 'omics_row_symbol_mismatch' WHEN acc = '5-LOW' THEN 'omics_snapshot_missing' WHEN acc = '2-HIGH' THEN 'omics_unverified'
  WHEN acc <> '1-URGENT' THEN 'omics_not_confirmed' ELSE 'ok' END AS state FROM r)
SELECT state, count(*) AS n, CASE WHEN state = 'ok' THEN 2.5 * count(*) END::DOUBLE AS log2fc FROM s GROUP BY 1"""


# --- audit chain and signatures -----------------------------------------------------------------


def _tagged(spark, sf):
    counts = decisions(spark, sf).select("task_id", "adjudication_id", "lineage_row_id", "decision", "reason", "decided_at", "reviewer_id", F.col("seq").alias("eid"))
    ranked = counts.groupBy("task_id").agg(F.sort_array(F.collect_list("eid")).alias("ids"))
    numbered = ranked.select("task_id", F.posexplode("ids").alias("seq", "eid")).join(counts, ["task_id", "eid"])
    return review.tag_events(numbered.withColumn("seq", F.col("seq").cast("bigint")), KEY)


def audit_chain(spark, sf):
    """Edited reasons and dropped tags in a tagged stream must be found, nothing else."""
    tagged = _tagged(spark, sf)
    edited = tagged.withColumn("reason", F.when(F.col("eid") % 500 == 3, F.lit("edited")).otherwise(F.col("reason"))).withColumn(
        "audit_hmac", F.when(F.col("eid") % 700 == 5, None).when(F.col("eid") % 900 == 7, "short").otherwise(F.col("audit_hmac")))
    return review.audit_chain_issues(edited, KEY).groupBy("rule").agg(F.count("*").alias("n"))


# an event after a stripped or shortened tag links to nothing and mismatches as well
AUDIT_SQL = """WITH e AS (SELECT event_id AS i, lag(event_id) OVER (PARTITION BY user_id // 10 ORDER BY event_id) AS p FROM events),
r AS (SELECT CASE WHEN i % 700 = 5 THEN 'unaudited' WHEN i % 900 = 7 THEN 'malformed_tag' WHEN i % 500 = 3 OR p % 700 = 5 OR p % 900 = 7 THEN 'tag_mismatch' END AS rule FROM e)
SELECT rule, count(*) AS n FROM r WHERE rule IS NOT NULL GROUP BY 1"""


def export_signatures(spark, sf):
    """Signed conversations: intact, edited and malformed tokens."""
    rows = load_table(spark, sf, "conversations")
    payload = F.struct("conv_id", "turn", "role", "text")
    signed = rows.withColumn("token", canonical.export_signature(payload, KEY))
    edited = signed.withColumn("text", F.when(F.col("role") == "system", F.lit("edited")).otherwise(F.col("text"))).withColumn(
        "token", F.when(F.col("turn") == 1, F.upper("token")).otherwise(F.col("token")))
    return edited.select("conv_id", "turn", canonical.valid_signature(F.col("token"), payload, KEY).alias("valid"))


SIGN_SQL = "SELECT conv_id, turn, role <> 'system' AND turn <> 1 AS valid FROM conversations WHERE true"


def plan_audit_issues(spark, sf):
    """Sealed plans, outputs and consumptions of all tasks with planted edits."""
    rows, events, inter = lineage_rows(spark, sf), decisions(spark, sf), intersections(spark, sf)
    latest = review.latest_decisions(events, rows)
    backed = materialize(review.backed_intersections(inter, rows, latest).where("backed"))
    digest = F.sha2("task_id", 256)
    plans = backed.select("task_id").distinct().select(
        "task_id", F.lit("parent").alias("source_task_id"), F.concat(F.lit("assembly-plan-"), digest).alias("plan_id"), F.lit(1).alias("plan_sequence"),
        digest.alias("canonical_plan_input_sha256"), F.lit(True).alias("assembly_input_ready"), F.lit(False).alias("formal_network_ready"))
    selected = backed.join(plans.select("task_id", "plan_id"), "task_id").select(
        "task_id", "plan_id", "lineage_row_id", "canonical_symbol", F.col("selected_disease_lineage_row_ids").alias("disease_ids"),
        F.when(F.col("canonical_symbol") == "MACHINERY", F.slice("selected_compound_lineage_row_ids", 1, 1)).otherwise(F.col("selected_compound_lineage_row_ids")).alias("compound_ids"))
    outputs = review.output_ids(plans.withColumn("output_sha256", F.sha2("plan_id", 256))).drop("assembly_input_ready", "formal_network_ready")
    chains = selected.join(outputs.select("plan_id", "output_id"), "plan_id").select(
        "plan_id", "output_id", "lineage_row_id", "canonical_symbol", F.posexplode("compound_ids").alias("chain_no", "compound_row_id")).select(
        "plan_id", "output_id", "chain_no", F.lit("").alias("herb"), F.lit(None).cast("string").alias("formula"), F.col("canonical_symbol").alias("target"),
        F.col("lineage_row_id").alias("selection"), F.lit("predicted").alias("target_evidence_type"), F.lit("predicted").alias("evidence_level"), "compound_row_id")
    used = outputs.select(
        F.concat(F.lit("assembly-consumption-"), F.sha2("output_id", 256)).alias("consumption_id"), "task_id", F.lit("owner").alias("owner_id"), "plan_id", "output_id", "output_sha256")
    issues = audits.plan_issues(plans, selected, inter, rows, events, outputs, chains, used)
    return issues.groupBy("rule").agg(F.count("*").alias("n"))


PLAN_AUDIT_SQL = f"""WITH {_DECISIONS}, {_TASKS}, good AS (SELECT * FROM bk WHERE len(d) > 0 AND len(c) > 0), pt AS (SELECT DISTINCT task_id FROM good),
v AS (SELECT 'row_undecided' AS rule FROM rw SEMI JOIN pt ON rw.task_id = pt.task_id LEFT JOIN latest ON latest.task_id = rw.task_id AND latest.row_id = rw.row_id WHERE coalesce(decision, 'needs_review') = 'needs_review'
  UNION ALL SELECT 'included_without_backing' FROM bk SEMI JOIN pt ON bk.task_id = pt.task_id WHERE len(d) = 0 OR len(c) = 0
  UNION ALL SELECT 'selection_compound_ids' FROM good WHERE sym = 'MACHINERY' AND len(c) > 1)
SELECT rule, count(*) AS n FROM v GROUP BY 1"""


def declared_intersections(spark, sf):
    """Symbols both account signs of a nation share, against a declared list of all symbols."""
    customers = load_table(spark, sf, "customer").select(F.col("c_nationkey").alias("task_id"), F.col("c_mktsegment").alias("symbol"), "c_acctbal")
    shared = customers.where("c_acctbal < 500").select("task_id", "symbol").intersect(customers.where("c_acctbal > 9000").select("task_id", "symbol"))
    declared = customers.where("c_acctbal < 800").select("task_id", "symbol").distinct()
    return audits.set_differences(declared, shared)


# --- streams over the events table -------------------------------------------------------------------


def _event_stream(spark, sf):
    schema = load_table(spark, sf, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]")


def latency_stats(spark, sf):
    samples = load_table(spark, sf, "events").select(F.col("event_type").alias("endpoint"), "ts", F.col("event_id"), F.col("value").alias("elapsed_ms"))
    return latency.latency_stats(samples, ["ts", "event_id"]).withColumn("avg_ms", F.round("avg_ms", 6))


LATENCY_SQL = """WITH r AS (SELECT event_type AS endpoint, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events),
s AS (SELECT endpoint, list_sort(list(value)) AS s FROM r WHERE r <= 1000 GROUP BY 1),
t AS (SELECT event_type AS endpoint, count(*) AS count, round(avg(value), 6) AS avg_ms, min(value) AS min_ms, max(value) AS max_ms FROM events GROUP BY 1)
SELECT endpoint, count, avg_ms, min_ms, max_ms, s[len(s) // 2 + 1] AS p50_ms, s[least(CAST(floor(len(s) * 0.95) AS BIGINT), len(s) - 1) + 1] AS p95_ms,
  s[least(CAST(floor(len(s) * 0.99) AS BIGINT), len(s) - 1) + 1] AS p99_ms FROM t JOIN s USING (endpoint)"""


def _last_per_key(spark, stream, keys, name):
    """Runs an update-mode stream to its end and keeps each key's last emitted row."""
    folder = work_folder(spark, name)

    def write(batch, batch_id):
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{folder}/out")
    rest = [c for c in rows.columns if c not in (*keys, "batch", "_batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select(*keys, "r.*")


def latency_stream(spark, sf):
    samples = _event_stream(spark, sf).select(F.col("event_type").alias("endpoint"), "ts", F.col("value").alias("elapsed_ms"))
    return _last_per_key(spark, jobs.latency_stream(samples), ["endpoint"], "latency").withColumn("avg_ms", F.round("avg_ms", 6))


def decision_stream(spark, sf):
    events = _event_stream(spark, sf).select(
        F.concat(F.lit("task-"), F.floor(F.col("user_id") / 10).cast("string")).alias("task_id"), F.col("user_id").cast("string").alias("lineage_row_id"),
        F.col("event_id").alias("seq"), F.col("event_type").alias("decision"))
    latest = _last_per_key(spark, jobs.latest_decision_stream(events), ["task_id", "lineage_row_id"], "decisions")
    return latest.select("task_id", "lineage_row_id", "latest.decision", "latest.seq")


QUERIES = {
    "owned_tasks": (
        owned_tasks,
        f"WITH {_DECISIONS}, {_TASKS} SELECT task_id, CASE WHEN child THEN 'task-' || (k - 1) END AS source_task_id, CASE WHEN running THEN 'running' ELSE 'completed' END AS status FROM ts WHERE (k // 2) % 5 = 3",
    ),
    "task_projection": (
        task_projection,
        f"WITH {_DECISIONS}, {_TASKS} SELECT task_id, CASE WHEN child AND k % 4 = 1 THEN 'failed' WHEN running THEN 'running' ELSE 'completed' END AS status FROM ts",
    ),
    "latest_decisions": (
        latest_decisions,
        f"WITH {_DECISIONS} SELECT latest.task_id, latest.row_id AS lineage_row_id, decision, reason, seq FROM latest SEMI JOIN rw ON rw.task_id = latest.task_id AND rw.row_id = latest.row_id",
    ),
    "adjudication_summary": (
        adjudication_summary,
        f"""WITH {_DECISIONS} SELECT rw.task_id, count(*) FILTER (decision = 'included') AS included, count(*) FILTER (decision = 'excluded') AS excluded,
        count(*) FILTER (decision = 'needs_review') AS needs_review, count(*) FILTER (decision = 'omics_confirmed') AS omics_confirmed, count(*) FILTER (decision IS NULL) AS pending
        FROM rw LEFT JOIN latest USING (task_id, row_id) GROUP BY 1""",
    ),
    "adjudication_ids": (
        adjudication_ids,
        f"""WITH {_DECISIONS} SELECT seq, 'adjudication-' || sha256('{{"decided_at":"' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '","decision":"' || decision || '","lineage_row_id":"' || row_id || '","nonce":"n","sequence":' || seq || ',"task_id":"' || task_id || '"}}') AS adjudication_id
        FROM ev JOIN events ON event_id = seq""",
    ),
    "backed_intersections": (
        backed_intersections,
        f"WITH {_DECISIONS}, {_TASKS} SELECT task_id, row_id AS lineage_row_id, array_to_string(d, ',') AS disease_ids, array_to_string(c, ',') AS compound_ids, len(d) > 0 AND len(c) > 0 AS backed FROM bk",
    ),
    "assembly_gate": (assembly_gate, GATE_SQL),
    "sealed_plans": (sealed_plans, SEAL_SQL),
    "plan_audit": (
        plan_audit,
        f"""WITH {_PLANS}, m AS (SELECT task_id, arg_max(h, plan_sequence) AS top FROM pl GROUP BY 1) SELECT task_id, 'assembly-plan-' || h AS plan_id, plan_sequence, h = top AS is_latest_plan,
        o_orderstatus = 'F' AS is_consumed, CASE WHEN h <> top THEN 'assembly-plan-' || top END AS is_superseded_by FROM pl JOIN m USING (task_id) JOIN orders USING (o_orderkey)""",
    ),
    "plan_chains": (plan_chains, CHAINS_SQL),
    "consumption_states": (consumption_states, CONSUME_SQL),
    "consumption_stream": (consumption_stream, CONSUME_SQL),
    "confirmation_states": (confirmation_states, CONFIRM_SQL),
    "audit_chain": (audit_chain, AUDIT_SQL),
    "export_signatures": (export_signatures, SIGN_SQL),
    "plan_audit_issues": (plan_audit_issues, PLAN_AUDIT_SQL),
    "declared_intersections": (
        declared_intersections,
        """WITH s AS (SELECT c_nationkey AS task_id, c_mktsegment AS symbol FROM customer WHERE c_acctbal < 500 INTERSECT SELECT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 9000),
        d AS (SELECT DISTINCT c_nationkey AS task_id, c_mktsegment AS symbol FROM customer WHERE c_acctbal < 800)
        SELECT *, 'declared_only' AS side FROM (SELECT * FROM d EXCEPT SELECT * FROM s) UNION ALL SELECT *, 'recomputed_only' FROM (SELECT * FROM s EXCEPT SELECT * FROM d)""",
    ),
    "latency_stats": (latency_stats, LATENCY_SQL),
    "latency_stream": (latency_stream, LATENCY_SQL),
    "decision_stream": (
        decision_stream,
        "SELECT 'task-' || (user_id // 10) AS task_id, CAST(user_id AS VARCHAR) AS lineage_row_id, arg_max(event_type, event_id) AS decision, max(event_id) AS seq FROM events GROUP BY user_id",
    ),
}
