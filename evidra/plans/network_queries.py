"""Registered queries: entity network, targets, lineage, enrichment, expression, graph.

nation = herbs, region = formulas, supplier = compounds, part = targets, line number =
pathways, lineitem = edges.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evidra.functions import text as tx
from evidra.operators import enrichment, expression, lineage, network
from evidra.session import load_table, materialize, union_all


def herbs(spark, sf):
    return load_table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("herb_id"), F.col("n_name").alias("name"), F.lower("n_name").alias("pinyin"), F.col("n_nationkey").alias("ord"))


def formulas(spark, sf):
    regions = load_table(spark, sf, "region")
    members = load_table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(
        F.sort_array(F.collect_list("n_nationkey")).alias("herb_ids"))
    return regions.join(members, "r_regionkey").select(
        F.col("r_regionkey").alias("formula_id"), F.col("r_name").alias("name"), F.lower("r_name").alias("pinyin"),
        "herb_ids", F.col("r_regionkey").alias("ord"))


def compounds(spark, sf):
    return load_table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("compound_id"), F.col("s_name").alias("name"),
        F.array("s_nationkey", ((F.col("s_nationkey") + 7) % 25).cast("int")).alias("herb_ids"))


def targets(spark, sf):
    return load_table(spark, sf, "part").select(F.col("p_partkey").alias("target_id"), F.col("p_name").alias("symbol"))


def edges(spark, sf):
    return load_table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("compound_id"), F.col("l_partkey").alias("target_id"), F.col("l_linenumber").alias("pathway_id"),
        F.col("l_returnflag").alias("disease"), (F.col("l_extendedprice") / 1e6).alias("score"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))


def pathways(spark, sf):
    """Line numbers as pathways, named by number, listing the parts on that line."""
    return load_table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("pathway_id")).agg(F.count("*").alias("n")).select(
        "pathway_id", F.concat(F.lit("line "), F.col("pathway_id").cast("string")).alias("name"))


def requests(spark, sf):
    regions = load_table(spark, sf, "region").select(
        F.concat(F.lit("f"), F.col("r_regionkey").cast("string")).alias("query_id"), F.col("r_name").alias("text"), F.lit("formula").alias("analysis_type"))
    nations = load_table(spark, sf, "nation").select(
        F.concat(F.lit("h"), F.col("n_nationkey").cast("string")).alias("query_id"), F.lower("n_name").alias("text"), F.lit("herb").alias("analysis_type"))
    unknown = load_table(spark, sf, "customer").select(F.col("c_mktsegment").alias("text")).distinct().select(
        F.col("text").alias("query_id"), "text", F.lit("formula").alias("analysis_type"))
    return union_all([regions, nations, unknown])


def chain_assembly(spark, sf):
    chains = network.assemble_chains(
        requests(spark, sf), edges(spark, sf), compounds(spark, sf), targets(spark, sf), pathways(spark, sf), herbs(spark, sf), formulas(spark, sf))
    return chains.select("query_id", "herb", "formula", "compound", "target", "pathway", "disease", F.round("score", 6).alias("score"), "rank")


_REQ = """
req AS (SELECT 'f' || r_regionkey AS query_id, r_name AS text, 'formula' AS kind FROM region UNION ALL
  SELECT 'h' || n_nationkey, lower(n_name), 'herb' FROM nation UNION ALL SELECT DISTINCT c_mktsegment, c_mktsegment, 'formula' FROM customer)"""

CHAIN_SQL = f"""WITH {_REQ},
allowed AS (SELECT query_id, n_nationkey AS herb_id, r_name AS formula FROM req JOIN region ON kind = 'formula' AND (text = r_name OR lower(text) = lower(r_name)) JOIN nation ON n_regionkey = r_regionkey
  UNION ALL SELECT query_id, n_nationkey, NULL FROM req JOIN nation ON kind = 'herb' AND (text = n_name OR lower(text) = lower(n_name))),
ch AS (SELECT l_extendedprice / 1e6 AS score, l_orderkey * 10 + l_linenumber AS ord, s_name AS compound, p_name AS target, 'line ' || l_linenumber AS pathway, l_returnflag AS disease,
  s_nationkey AS a, (s_nationkey + 7) % 25 AS b FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey),
ex AS (SELECT *, a AS herb_id, 0 AS herb_no FROM ch UNION ALL SELECT *, b, 1 FROM ch)
SELECT query_id, herb, formula, compound, target, pathway, disease, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord, herb_no) AS rank
  FROM (SELECT ex.*, query_id, formula, n_name AS herb FROM ex JOIN allowed USING (herb_id) JOIN nation ON n_nationkey = herb_id)) WHERE rank <= 5"""


def formula_herbs(spark, sf):
    return network.herb_names(requests(spark, sf), formulas(spark, sf), herbs(spark, sf))


FORMULA_SQL = f"""WITH {_REQ}
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n_nationkey) - 1 AS INTEGER) AS position, n_name AS herb
  FROM req JOIN region ON kind = 'formula' AND text = r_name JOIN nation ON n_regionkey = r_regionkey
UNION ALL SELECT query_id, 0, n_name FROM req JOIN nation ON kind = 'herb' AND text = lower(n_name)
UNION ALL SELECT query_id, 0, text FROM req WHERE kind = 'formula' AND text NOT IN (SELECT r_name FROM region)"""


def entity_listing(spark, sf):
    return network.entity_listing(herbs(spark, sf), formulas(spark, sf), compounds(spark, sf), targets(spark, sf), pathways(spark, sf))


# --- targets ----------------------------------------------------------------------------------


def candidates(spark, sf):
    """Line items as target candidates: supplier x part name, flag as evidence type."""
    return load_table(spark, sf, "lineitem").join(load_table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat(F.lit("Cpd "), F.col("l_suppkey").cast("string")).alias("compound"), F.col("p_name").alias("symbol"),
        F.when(F.col("l_returnflag") == "A", "known_activity").otherwise("predicted").alias("evidence_type"),
        F.col("l_discount").alias("score"), F.col("l_linestatus").alias("source"),
        F.when(F.col("l_tax") > 0.02, F.concat(F.lit("r"), F.col("l_orderkey").cast("string"))).alias("source_record_id"),
        F.when(F.col("l_tax") < 0.05, F.col("l_shipdate").cast("date").cast("string")).alias("retrieved_at"),
        F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity").alias("ord"),
    )


def merged_targets(spark, sf):
    merged = network.merge_targets(candidates(spark, sf))
    return merged.select("compound", "symbol", "evidence_type", "score", F.md5("source").alias("source_md5"), F.md5("source_record_id").alias("refs_md5"), "retrieved_at")


MERGED_SQL = """WITH c AS (SELECT 'Cpd ' || l_suppkey AS compound, p_name AS symbol, CASE WHEN l_returnflag = 'A' THEN 'known_activity' ELSE 'predicted' END AS ev, l_discount AS score,
  l_linestatus AS source, CASE WHEN l_tax > 0.02 THEN 'r' || l_orderkey END AS ref, CASE WHEN l_tax < 0.05 THEN CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS ra,
  row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_quantity) AS ord FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT arg_max(compound, ord) AS compound, arg_max(symbol, ord) AS symbol, CASE WHEN count(DISTINCT ev) > 1 THEN 'mixed' ELSE min(ev) END AS evidence_type, max(score) AS score,
  md5(string_agg(source, '+' ORDER BY ord)) AS source_md5, md5(string_agg(ref, ';' ORDER BY ord)) AS refs_md5, arg_max(ra, ord) FILTER (ra IS NOT NULL) AS retrieved_at
FROM c GROUP BY lower(compound), upper(symbol)"""


def deduped_compounds(spark, sf):
    """First order per (customer segment, priority) as (herb, name)."""
    rows = load_table(spark, sf, "orders").join(load_table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_mktsegment").alias("herb"), F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("ord"), "o_totalprice")
    return network.dedupe_compounds(rows)


def deduped_sources(spark, sf):
    rows = load_table(spark, sf, "events").select(
        F.col("event_type").alias("name"), F.when(F.col("user_id") < 100, F.col("user_id").cast("string")).alias("source_record_id"),
        F.lit(None).cast("string").alias("cache_key"), F.col("event_id").alias("ord"))
    return network.dedupe_sources(rows).select("name", "source_record_id", "ord")


def predictions_for_compounds(spark, sf):
    some = compounds(spark, sf).join(load_table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("compound_id")), "compound_id")
    rows = load_table(spark, sf, "lineitem").select(
        F.concat(F.lit("SUPPLIER#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")).alias("compound"), "l_partkey", "l_quantity")
    return network.predictions_for(rows, some).groupBy("compound").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


def herb_of_compound(spark, sf):
    """First supplier nation per account band stands as herb of a customer's band."""
    band = lambda c: F.concat(F.lit("b"), F.floor(F.col(c) / 500).cast("string"))
    first = load_table(spark, sf, "supplier").where("s_acctbal > 2000").select(band("s_acctbal").alias("name"), F.col("s_nationkey").cast("string").alias("herb"), F.col("s_suppkey").alias("ord"))
    rows = load_table(spark, sf, "customer").select("c_custkey", band("c_acctbal").alias("compound"))
    return network.herb_of_compound(rows, first)


def activity_scores(spark, sf):
    rows = load_table(spark, sf, "events")
    text = F.when(F.col("event_type") == "error", F.lit("n/a")).when(F.col("event_type") == "view", F.lit(None)).otherwise(F.col("value").cast("string"))
    organism = F.when(F.col("event_type") == "click", "Mus musculus").when(F.col("event_type") == "signup", "").otherwise("Homo sapiens")
    kept = network.human_activities(rows.withColumn("target_organism", organism))
    return kept.select("event_id", F.round(network.activity_score(text), 6).alias("score"))


def pathway_by_gene(spark, sf):
    """First line number (as pathway) each part name is listed on."""
    rows = load_table(spark, sf, "lineitem").join(load_table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    sets = rows.groupBy("l_linenumber").agg(F.collect_set("p_name").alias("genes")).select(
        F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("name"), F.col("l_linenumber").alias("ord"), "genes")
    return network.pathway_by_gene(sets)


def pathway_gene_mapping(spark, sf):
    """Part keys of every brand, replaced by part names where the part is cheap."""
    parts = load_table(spark, sf, "part")
    sets = parts.groupBy("p_brand").agg(F.sort_array(F.collect_list("p_partkey")).cast("array<string>").alias("genes")).select(
        F.col("p_brand").alias("pathway_id"), F.col("p_brand").alias("name"), "genes")
    symbols = parts.where("p_retailprice < 950").select(F.col("p_partkey").cast("string").alias("gene_id"), F.col("p_name").alias("symbol"))
    return network.map_pathway_genes(sets, symbols).select("pathway_id", F.md5(F.array_join("genes", ",")).alias("genes_md5"))


def live_target_network(spark, sf):
    """Known and predicted candidates of every nation's task merged into chains."""
    rows = load_table(spark, sf, "lineitem").join(load_table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(
        load_table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    found = rows.select(
        F.col("s_nationkey").cast("string").alias("task_id"), F.col("s_name").alias("compound"), F.col("p_name").alias("symbol"),
        F.when(F.col("l_returnflag") == "A", "known_activity").otherwise("predicted").alias("evidence_type"), F.col("l_discount").alias("score"),
        F.col("l_linestatus").alias("source"), F.when(F.col("l_tax") > 0.06, F.concat(F.lit("r"), F.col("l_orderkey").cast("string"))).alias("source_record_id"),
        F.lit(None).cast("string").alias("retrieved_at"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity").alias("ord"))
    tasks = load_table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("task_id"), F.col("n_name").alias("query"), F.lit("formula").alias("analysis_type"))
    comp = load_table(spark, sf, "supplier").select(F.col("s_nationkey").cast("string").alias("task_id"), F.col("s_name").alias("name"), F.concat(F.lit("herb "), F.col("s_nationkey").cast("string")).alias("herb"), F.col("s_suppkey").alias("ord"))
    paths = load_table(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("task_id"), F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("pathway_id"))
    chains = network.live_chains(tasks, network.merge_task_targets(found), comp, paths)
    level = network.evidence_level(F.lit("live"), F.col("target_evidence_type"), F.size("evidence_refs") > 0)
    return chains.select("task_id", "herb", "formula", "compound", "target", "pathway", "score", F.size("evidence_refs").alias("n_refs"), level.alias("evidence_level"))


LIVE_SQL = """WITH c AS (SELECT s_nationkey AS t, s_name AS compound, p_name AS target, CASE WHEN l_returnflag = 'A' THEN 'known_activity' ELSE 'predicted' END AS ev, l_discount AS score,
  CASE WHEN l_tax > 0.06 THEN 1 END AS ref FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey),
m AS (SELECT t, compound, target, CASE WHEN count(DISTINCT ev) > 1 THEN 'mixed' ELSE min(ev) END AS ev, max(score) AS score, CAST(count(ref) AS INTEGER) AS n_refs FROM c GROUP BY ALL)
SELECT CAST(t AS VARCHAR) AS task_id, 'herb ' || t AS herb, n_name AS formula, compound, target, coalesce(pathway, '未匹配 KEGG 通路') AS pathway, score, n_refs,
  CASE WHEN ev = 'known_activity' THEN 'experimental' WHEN ev = 'mixed' OR n_refs > 0 THEN 'literature_supported' ELSE 'predicted' END AS evidence_level
FROM m JOIN nation ON n_nationkey = t LEFT JOIN (SELECT c_nationkey, arg_min(c_mktsegment, c_custkey) AS pathway FROM customer GROUP BY 1) ON c_nationkey = t"""


def _graded(spark, sf):
    items = load_table(spark, sf, "lineitem")
    mode = F.when(F.col("l_linestatus") == "O", "live").otherwise("mock")
    kind = F.when(F.col("l_returnflag") == "A", "known_activity").when(F.col("l_returnflag") == "N", "mixed").otherwise("predicted")
    return items.select(
        F.col("l_suppkey").alias("task_id"), F.col("l_partkey").alias("target"), mode.alias("data_mode"),
        network.evidence_level(mode, kind, F.col("l_tax") > 0.05).alias("evidence_level"))


def evidence_levels(spark, sf):
    tasks = load_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("task_id"))
    return network.level_counts(_graded(spark, sf), tasks).select("task_id", "evidence_level", "n")


_LEVEL = """CASE WHEN l_linestatus <> 'O' THEN 'mock_inferred' WHEN l_returnflag = 'A' THEN 'experimental' WHEN l_returnflag = 'N' OR l_tax > 0.05 THEN 'literature_supported' ELSE 'predicted' END"""


def confirmed_levels(spark, sf):
    """Parts of 30 or more units on one line confirm their (supplier, part) target."""
    confirmed = load_table(spark, sf, "lineitem").where("l_quantity >= 45").select(F.col("l_suppkey").alias("task_id"), F.col("l_partkey").alias("target"))
    return network.confirmation_overlay(_graded(spark, sf), confirmed).groupBy("evidence_level").agg(F.count("*").alias("n"))


def step_metrics(spark, sf):
    rows = load_table(spark, sf, "events").select(
        F.col("user_id").alias("task_id"), F.col("event_type").alias("step"),
        F.when(F.col("event_type") == "error", "optional").when(F.col("event_type") == "view", "final").otherwise("fetch").alias("kind"),
        F.lit(1).alias("request_count"), (F.col("value") > 20).cast("int").alias("cache_hit"), F.floor("value").cast("bigint").alias("duration_ms"),
        (F.col("value") > 60).cast("int").alias("items"))
    return network.step_metrics(rows)


# --- graph -------------------------------------------------------------------------------------


def _chain_table(spark, sf):
    """Line items as chains of their supplier's nation: one task per nation."""
    rows = load_table(spark, sf, "lineitem").join(load_table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(
        load_table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        F.col("s_nationkey").alias("task_id"), F.col("s_name").alias("herb"), F.col("p_name").alias("compound"), F.col("p_brand").alias("target"),
        F.col("p_type").alias("pathway"), F.col("l_returnflag").alias("disease"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity").alias("ord"))


_CHAIN_TABLE_SQL = """
ch AS (SELECT s_nationkey AS task_id, s_name AS herb, p_name AS compound, p_brand AS target, p_type AS pathway, l_returnflag AS disease,
  row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_quantity) AS ord
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey),
lay AS (SELECT task_id, 0 AS layer_no, 'herb' AS layer, herb AS label, ord FROM ch UNION ALL SELECT task_id, 1, 'compound', compound, ord FROM ch UNION ALL
  SELECT task_id, 2, 'target', target, ord FROM ch UNION ALL SELECT task_id, 3, 'pathway', pathway, ord FROM ch UNION ALL SELECT task_id, 4, 'disease', disease, ord FROM ch),
nodes AS (SELECT *, CAST(row_number() OVER (PARTITION BY task_id, layer_no ORDER BY seen, label) - 1 AS INTEGER) AS position FROM (SELECT task_id, layer_no, layer, label, min(ord) AS seen FROM lay GROUP BY ALL)),
edges AS (SELECT task_id, 0 AS layer_no, herb AS source, compound AS tgt FROM ch UNION ALL SELECT task_id, 1, compound, target FROM ch UNION ALL
  SELECT task_id, 2, target, pathway FROM ch UNION ALL SELECT task_id, 3, pathway, disease FROM ch)"""


def graph_nodes(spark, sf):
    return network.graph_nodes(_chain_table(spark, sf)).select("task_id", "layer", "label", "position")


def node_degrees(spark, sf):
    return network.node_degree(network.graph_edges(_chain_table(spark, sf)))


def edge_crossings(spark, sf):
    chains = _chain_table(spark, sf)
    return network.edge_crossings(network.graph_edges(chains), network.graph_nodes(chains))


def ego_neighbourhood(spark, sf):
    return network.ego_nodes(network.graph_edges(_chain_table(spark, sf)), "Brand#1")


# --- lineage -----------------------------------------------------------------------------------


def _lineage_chains(spark, sf):
    rows = load_table(spark, sf, "lineitem").join(load_table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(
        load_table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    none = F.array().cast("array<string>")
    return rows.select(
        F.col("s_nationkey").alias("task_id"), F.col("p_brand").alias("target"), F.col("l_discount").alias("score"),
        F.when(F.col("l_tax") > 0.04, F.array("l_returnflag", "l_linestatus")).otherwise(none).alias("evidence_refs"),
        F.when(F.col("l_tax") > 0.02, F.array(F.concat(F.lit("target-"), F.col("p_size").cast("string")), F.lit("herb-1"))).otherwise(none).alias("related_entity_ids"),
        F.when(F.col("s_nationkey") < 5, "mock").otherwise("live").alias("data_mode"),
        F.when(F.col("l_returnflag") == "A", "known_activity").otherwise("predicted").alias("target_evidence_type"),
        F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity").alias("ord"))


def lineage_rows(spark, sf):
    rows = lineage.rows_from_chains(_lineage_chains(spark, sf))
    return rows.select("task_id", "canonical_symbol", "source_database", F.array_join("source_record_ids", ",").alias("records"), "source_score")


_LINEAGE_SQL = """
lc AS (SELECT s_nationkey AS task_id, p_brand AS canonical_symbol, l_discount AS score,
  CASE WHEN s_nationkey < 5 THEN 'sample_network' WHEN l_returnflag = 'A' THEN 'ChEMBL' ELSE 'network_live_provider' END AS source_database,
  CASE WHEN l_tax > 0.04 THEN [l_returnflag, l_linestatus] WHEN l_tax > 0.02 THEN ['target-' || p_size] ELSE [''] END AS refs
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey),
lr AS (SELECT task_id, canonical_symbol, source_database, records, max(score) AS source_score
  FROM (SELECT *, unnest(refs) AS records FROM lc) GROUP BY task_id, canonical_symbol, source_database, records)"""


def _sides(spark, sf):
    """Customers as disease rows, suppliers' parts as compound rows, keyed by nation."""
    disease = load_table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("task_id"), F.concat(F.lit("S"), F.floor(F.col("c_acctbal") / 100).cast("string")).alias("canonical_symbol"),
        F.concat(F.lit("disease-"), F.sha2("c_name", 256)).alias("lineage_row_id"))
    compound = load_table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("task_id"), F.concat(F.lit("S"), F.floor(F.col("s_acctbal") / 100).cast("string")).alias("canonical_symbol"),
        F.concat(F.lit("compound-"), F.sha2("s_name", 256)).alias("lineage_row_id"))
    return disease, compound


def target_intersections(spark, sf):
    rows = lineage.intersection_ids(*_sides(spark, sf))
    return rows.select("task_id", "canonical_symbol", "lineage_row_id", F.col("n_disease").cast("int").alias("n_disease"), F.col("n_compound").cast("int").alias("n_compound"))


_SIDES_SQL = """
d AS (SELECT c_nationkey AS task_id, 'S' || CAST(floor(c_acctbal / 100) AS BIGINT) AS sym, 'disease-' || sha256(c_name) AS id FROM customer),
c AS (SELECT s_nationkey AS task_id, 'S' || CAST(floor(s_acctbal / 100) AS BIGINT) AS sym, 'compound-' || sha256(s_name) AS id FROM supplier),
dd AS (SELECT task_id, sym, list_sort(list(id)) AS ids FROM d GROUP BY ALL), cc AS (SELECT task_id, sym, list_sort(list(id)) AS ids FROM c GROUP BY ALL),
x AS (SELECT task_id, sym, dd.ids AS a, cc.ids AS b FROM dd JOIN cc USING (task_id, sym))"""


def lineage_counts(spark, sf):
    disease, compound = _sides(spark, sf)
    tasks = load_table(spark, sf, "nation").select(F.col("n_nationkey").alias("task_id"))
    return lineage.lineage_counts(tasks, disease, compound, lineage.shared_symbols(disease, compound))


def network_readiness(spark, sf):
    """Readiness of every nation's task from its customers and suppliers."""
    disease, compound = _sides(spark, sf)
    nations = load_table(spark, sf, "nation").select(F.col("n_nationkey").alias("task_id"), "n_regionkey")
    counts = lineage.lineage_counts(nations, disease, compound, lineage.shared_symbols(disease, compound))
    k = F.col("n_regionkey")
    tasks = nations.join(counts, "task_id").select(
        "task_id", (k != 4).alias("has_protocol"), (k != 3).alias("has_lineage"), F.when(k == 0, "mock").otherwise("live").alias("data_mode"),
        F.when(k == 1, "unverified_client_import").when(k == 2, "server_verified_raw_artifact").alias("disease_status"),
        (F.col("task_id") % 2 == 0).alias("has_compound_import"), F.col("disease_row_count").alias("n_disease"), F.col("intersection_row_count").alias("n_shared"),
        F.col("compound_row_count").alias("compound_without_version"), F.col("compound_row_count").alias("pending_compound"),
        F.col("disease_row_count").alias("pending_disease"), F.col("intersection_row_count").alias("pending_shared"))
    rows = lineage.readiness(tasks)
    return rows.select("task_id", "protocol_complete", F.array_join("blocking_reasons", "|").alias("reasons"))


def _readiness_sql() -> str:
    r = lineage.REASONS
    when = lambda cond, key: f"CASE WHEN {cond} THEN '{r[key]}' END"
    imp, lin = "task_id % 2 = 0", "k <> 3"
    parts = [
        when("k = 0", "mock"), when(f"NOT ({lin}) OR NOT ({imp})", "compound_unfrozen"), f"'{r['edges']}'", when(f"{lin} AND {imp}", "no_loop"),
        when(f"{lin} AND k NOT IN (1, 2)", "no_disease"), when("k = 1", "client_import"), when("k = 1 AND nd = 0", "client_empty"),
        when(f"k = 2 AND NOT ({imp})", "disease_verified"), when(f"k = 2 AND {imp}", "both_verified"), when("k IN (1, 2) AND nd = 0", "disease_empty"),
        when(f"k IN (1, 2) AND {imp} AND nx = 0", "shared_empty"), when(f"{lin} AND nc > 0", "no_version"), when(f"{lin} AND nc > 0", "compound_pending"),
        when(f"{lin} AND nd > 0", "disease_pending"), when(f"{lin} AND nx > 0", "shared_pending"),
    ]
    return f"""WITH {_SIDES_SQL}, n AS (SELECT n_nationkey AS task_id, n_regionkey AS k, (SELECT count(*) FROM d WHERE d.task_id = n_nationkey) AS nd,
      (SELECT count(*) FROM c WHERE c.task_id = n_nationkey) AS nc, (SELECT count(*) FROM x WHERE x.task_id = n_nationkey) AS nx FROM nation)
      SELECT task_id, k <> 4 AS protocol_complete, CASE WHEN k = 4 THEN '' ELSE concat_ws('|', {', '.join(parts)}) END AS reasons FROM n"""


def import_violations(spark, sf):
    """Order lines as import records of their order."""
    rows = load_table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("import_id"), F.col("l_partkey").cast("string").alias("raw_identifier"),
        F.when(F.col("l_tax") < 0.01, "bad symbol").otherwise(F.concat(F.lit("S"), F.col("l_partkey").cast("string"))).alias("canonical_symbol"),
        F.concat_ws(":", "l_orderkey", "l_linenumber").alias("source_record_id"), F.col("l_discount").alias("source_score"), F.lit(0.02).alias("applied_threshold"),
        F.col("l_shipdate").alias("query_date"), F.col("l_shipdate").alias("retrieved_at"), F.to_date(F.lit("2001-06-01")).alias("as_of"))
    return lineage.import_violations(rows).groupBy("rule").agg(F.count("*").alias("n"), F.count_distinct("import_id").alias("n_imports"))


IMPORT_SQL = """WITH r AS (SELECT l_orderkey AS i, l_partkey AS raw, CASE WHEN l_tax < 0.01 THEN 'bad symbol' ELSE 'S' || l_partkey END AS sym, l_linenumber AS rec, l_discount AS s, CAST(l_shipdate AS DATE) AS dt FROM lineitem),
v AS (SELECT i, 'symbol_malformed' AS rule FROM r WHERE sym = 'bad symbol' UNION ALL SELECT i, 'below_threshold' FROM r WHERE s < 0.02
  UNION ALL SELECT i, 'query_date_in_future' FROM r WHERE dt > DATE '2001-06-01' UNION ALL SELECT i, 'retrieved_at_in_future' FROM r WHERE dt > DATE '2001-06-01'
  UNION ALL SELECT i, 'observation_not_unique' FROM r GROUP BY i, rec, raw, sym HAVING count(*) > 1 UNION ALL SELECT i, 'record_id_ambiguous' FROM r GROUP BY i, rec HAVING count(DISTINCT sym) > 1)
SELECT rule, count(*) AS n, count(DISTINCT i) AS n_imports FROM v GROUP BY 1"""


def landed_imports(spark, sf):
    """Orders as landed imports, even ones of diseases, odd ones of compounds; their lines are the records. Remainders of the keys plant the faults."""
    k, j = F.col("l_orderkey"), lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    lines = load_table(spark, sf, "lineitem")
    odd = k % 2 == 1
    score = F.when((F.col("l_linenumber") == 5) & (F.col("l_partkey") % 10 == 0), "true").when(odd, (F.col("l_quantity") / 2).cast("string")).otherwise(F.col("l_discount").cast("string"))
    record = F.concat(
        F.lit('{"raw_identifier":'), j(F.concat(F.when(F.col("l_linenumber") == 7, "X").otherwise("CHEMBL"), F.col("l_partkey").cast("string"))),
        F.lit(',"canonical_symbol":'), j(F.concat(F.when(F.col("l_tax") < 0.01, "s ").otherwise("S"), F.col("l_partkey").cast("string"))),
        F.lit(',"source_record_id":'), j(F.when(F.col("l_quantity") > 45, F.lit(0)).otherwise(F.col("l_linenumber"))), F.lit(',"source_score":'), score, F.lit("}"))
    per = lines.groupBy(k.alias("k")).agg(F.array_join(F.sort_array(F.collect_list(record)), ",").alias("records"))  # the lines of one order
    k = F.col("k")
    minimum = F.when(k % 13 == 0, "true").when(k % 11 == 0, "6").otherwise("5")
    body = F.concat(
        F.lit('{"applied_threshold":'), F.when(k % 9 == 0, "false").when(k % 2 == 1, "5").otherwise("0.02"), F.lit(',"query_date":"'), F.when(k % 15 == 1, "2031-01-01").otherwise("2020-05-05"),
        F.lit('","retrieved_at":"'), F.when(k % 8 == 3, "2020-05-05T10:00:00").when(k % 8 == 4, "2031-05-05T10:00:00+02:00").otherwise("2020-05-05T10:00:00Z"),
        F.lit('","compound_id":"CHEMBL1","source_query_id":"'), F.when(k % 7 == 0, "CHEMBL2").otherwise("CHEMBL1"), F.lit('","species":"Homo sapiens","phenotype":"skin","disease":"ad","source_query_parameters":'),
        F.when((k % 2 == 0) & (k % 10 == 2), F.lit("{}")).otherwise(F.concat(F.lit('{"assay_organism":"'), F.when(k % 5 == 0, "Mus musculus").otherwise("Homo sapiens"), F.lit('","pchembl_value_min":'), minimum, F.lit("}"))),
        F.lit(',"records":['), F.col("records"), F.lit("]}"))
    body = F.when(k % 97 == 0, F.lit("{broken")).otherwise(body)
    protocol = F.concat(F.lit('{"disease":"ad","phenotype":"'), F.when(k % 6 == 0, "itch").otherwise("skin"), F.lit('","species":"Homo sapiens","query_date":"2020-05-05"}'))
    imports = per.select(k.alias("import_id"), F.when(k % 2 == 1, "compound").otherwise("disease").alias("kind"), body.alias("body"), protocol.alias("protocol"), F.lit("2025-01-01 00:00:00").cast("timestamp").alias("as_of"))
    return lineage.landed_import_violations(imports).groupBy("rule").agg(F.count("*").alias("n"), F.count_distinct("import_id").alias("n_imports"), F.max("detail").alias("detail"))


LANDED_SQL = """WITH l AS (SELECT l_orderkey AS k, l_orderkey % 2 = 1 AS odd, CASE WHEN l_linenumber = 7 THEN 'X' ELSE 'CHEMBL' END || l_partkey AS raw, CASE WHEN l_tax < 0.01 THEN 's ' ELSE 'S' END || l_partkey AS sym,
  CAST(CASE WHEN l_quantity > 45 THEN 0 ELSE l_linenumber END AS VARCHAR) AS rec, l_linenumber = 5 AND l_partkey % 10 = 0 AS flag, CASE WHEN l_orderkey % 2 = 1 THEN l_quantity / 2 ELSE l_discount END AS s FROM lineitem WHERE l_orderkey % 97 <> 0),
o AS (SELECT DISTINCT l_orderkey AS k, l_orderkey % 2 = 1 AS odd FROM lineitem), g AS (SELECT * FROM o WHERE k % 97 <> 0),
v AS (SELECT k, 'body_unreadable' AS rule, '' AS detail FROM o WHERE k % 97 = 0
  UNION ALL SELECT k, 'query_id_mismatch', '' FROM g WHERE odd AND k % 7 = 0 UNION ALL SELECT k, 'minimum_not_numeric', '' FROM g WHERE odd AND k % 13 = 0
  UNION ALL SELECT k, 'threshold_not_numeric', '' FROM g WHERE k % 9 = 0 UNION ALL SELECT k, 'query_date_in_future', '' FROM g WHERE k % 15 = 1
  UNION ALL SELECT k, 'retrieved_at_without_zone', '' FROM g WHERE k % 8 = 3 UNION ALL SELECT k, 'retrieved_at_in_future', '' FROM g WHERE k % 8 = 4
  UNION ALL SELECT k, 'parameters_missing', '' FROM g WHERE NOT odd AND k % 10 = 2 UNION ALL SELECT k, 'organism_mismatch', '' FROM g WHERE odd AND k % 5 = 0
  UNION ALL SELECT k, 'minimum_mismatch', '' FROM g WHERE odd AND k % 13 <> 0 AND (k % 11 = 0 OR k % 9 = 0)
  UNION ALL SELECT k, 'protocol_mismatch', concat_ws(',', CASE WHEN k % 6 = 0 THEN 'phenotype' END, CASE WHEN k % 15 = 1 THEN 'query_date' END) FROM g WHERE NOT odd AND (k % 6 = 0 OR k % 15 = 1)
  UNION ALL SELECT k, 'score_not_numeric', rec || ':' || raw || ':' || sym FROM l WHERE flag
  UNION ALL SELECT k, 'score_out_of_range', rec || ':' || raw || ':' || sym FROM l WHERE NOT flag AND odd AND s > 20
  UNION ALL SELECT k, 'below_threshold', rec || ':' || raw || ':' || sym FROM l WHERE NOT flag AND k % 9 <> 0 AND s < CASE WHEN odd THEN 5 ELSE 0.02 END
  UNION ALL SELECT k, 'symbol_malformed', rec || ':' || raw || ':' || sym FROM l WHERE sym LIKE 's %'
  UNION ALL SELECT k, 'identifier_malformed', rec || ':' || raw || ':' || sym FROM l WHERE odd AND raw LIKE 'X%'
  UNION ALL SELECT k, 'observation_not_unique', rec || ':' || raw || ':' || sym FROM l GROUP BY k, rec, raw, sym HAVING count(*) > 1
  UNION ALL SELECT k, CASE WHEN odd THEN 'record_id_not_unique' ELSE 'record_id_ambiguous' END, rec FROM l GROUP BY k, odd, rec HAVING CASE WHEN odd THEN count(*) > 1 ELSE count(DISTINCT sym) > 1 END)
SELECT rule, count(*) AS n, count(DISTINCT k) AS n_imports, max(detail) AS detail FROM v GROUP BY rule"""


def protocol_mismatch(spark, sf):
    """First against last order of every customer: fields that differ, in order."""
    orders = load_table(spark, sf, "orders")
    fields = ["o_orderstatus", "o_orderpriority", "o_orderdate"]
    row = F.struct(*fields)
    pairs = orders.groupBy("o_custkey").agg(F.min_by(row, "o_orderkey").alias("a"), F.max_by(row, "o_orderkey").alias("b")).select(
        "o_custkey", *[F.col(f"a.{f}").alias(f"import_{f}") for f in fields], *[F.col(f"b.{f}").alias(f"protocol_{f}") for f in fields])
    return pairs.select("o_custkey", F.array_join(lineage.protocol_mismatches(pairs, fields), ",").alias("differing"))


# --- enrichment and expression --------------------------------------------------------------------


def _enrichment_inputs(spark, sf):
    """Parts of each supplier against brands and sizes of a type, all as long tables."""
    parts = load_table(spark, sf, "part")
    inputs = load_table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("task_id"), F.col("l_partkey").alias("symbol")).distinct()
    size = F.concat_ws("/", "p_type", F.col("p_size").cast("string"))
    genes = union_all([parts.select(F.lit(c).alias("collection"), of.alias("term_id"), F.col("p_partkey").alias("symbol")) for c, of in (("GO", F.col("p_brand")), ("KEGG", size))])
    terms = genes.select("collection", "term_id", F.col("term_id").alias("ord")).distinct()
    return inputs, terms, genes, parts.count()


def _enriched(spark, sf):
    inputs, terms, genes, background = _enrichment_inputs(spark, sf)
    return inputs, terms, genes, background, enrichment.enrich(inputs, terms, background, genes=genes)


def enrichment_terms(spark, sf):
    rows = _enriched(spark, sf)[-1]
    return rows.select("task_id", "collection", "term_id", F.col("gene_count").cast("int").alias("gene_count"), "overlap_count", F.round("p_value", 9).alias("p_value"), F.round("adjusted_p_value", 7).alias("adjusted_p_value"), "rank")


def enrichment_symbols(spark, sf):
    """The shared symbols of every kept term, one row each."""
    inputs, terms, genes, background = _enrichment_inputs(spark, sf)
    inputs = materialize(inputs)  # read three times
    rows = materialize(enrichment.enrich(inputs, terms, background, genes=genes))
    return enrichment.shared_symbols(rows, inputs, terms, genes)


def combined_enrichment(spark, sf):
    rows = enrichment.combined(_enriched(spark, sf)[-1], ["GO", "KEGG"])
    return rows.select("task_id", "collection", "term_id", F.round("p_value", 9).alias("p_value"), "combined_rank")


def enrichment_totals(spark, sf):
    inputs, _, _, background, rows = _enriched(spark, sf)
    return enrichment.enrichment_summary(inputs, enrichment.combined(rows, ["GO", "KEGG"]), background)


_ENRICH_SQL = """
inp AS (SELECT l_suppkey AS task_id, l_partkey AS sym FROM lineitem GROUP BY ALL), ni AS (SELECT task_id, count(*) AS n_in FROM inp GROUP BY 1),
term AS (SELECT 'GO' AS collection, p_brand AS term_id, p_partkey AS sym FROM part UNION ALL SELECT 'KEGG', p_type || '/' || p_size, p_partkey FROM part),
sz AS (SELECT collection, term_id, count(*) AS gene_count FROM term GROUP BY ALL), nt AS (SELECT collection, count(*) AS n_terms FROM sz GROUP BY 1),
ov AS (SELECT task_id, collection, term_id, count(*) AS k FROM inp JOIN term USING (sym) GROUP BY ALL),
q AS (SELECT *, (SELECT count(*) FROM part) AS m FROM ov JOIN sz USING (collection, term_id) JOIN ni USING (task_id) JOIN nt USING (collection) WHERE k >= 2 AND n_in >= 2),
tail AS (SELECT *, unnest(range(k, least(gene_count, n_in) + 1)) AS i FROM q),
p AS (SELECT task_id, collection, term_id, gene_count, k AS overlap_count, n_terms, least(1.0, sum(CASE WHEN n_in - i > m - gene_count THEN 0 ELSE
  exp(lgamma(gene_count + 1) - lgamma(i + 1) - lgamma(gene_count - i + 1) + lgamma(m - gene_count + 1) - lgamma(n_in - i + 1) - lgamma(m - gene_count - n_in + i + 1)
  - lgamma(m + 1) + lgamma(n_in + 1) + lgamma(m - n_in + 1)) END)) AS p_value FROM tail GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY task_id, collection ORDER BY round(p_value, 12), term_id) AS rank FROM p WHERE p_value < 0.05),
top AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY round(p_value, 12), collection, rank) AS combined_rank FROM r WHERE rank <= 20)"""


def _expression_tables(spark, sf):
    """Parts as probes measured per supplier; the part name is the symbol."""
    items = load_table(spark, sf, "lineitem")
    values = items.select(F.col("l_linestatus").alias("dataset"), F.col("l_partkey").alias("probe"), F.col("l_suppkey").alias("sample_idx"), F.col("l_quantity").alias("value"))
    sides = load_table(spark, sf, "supplier").select(
        F.explode(F.array(F.lit("O"), F.lit("F"))).alias("dataset"), F.col("s_suppkey").alias("sample_idx"),
        F.when(F.col("s_acctbal") > 4500, "case").otherwise("control").alias("grp"))
    annotation = load_table(spark, sf, "part").select(
        F.explode(F.array(F.lit("O"), F.lit("F"))).alias("dataset"), F.col("p_partkey").alias("probe"),
        F.concat_ws(" ", "p_name", F.floor(F.col("p_retailprice") / 5).cast("string")).alias("symbol"))
    return values, sides, annotation


def probe_collapse(spark, sf):
    values, _, annotation = _expression_tables(spark, sf)
    return expression.collapse_probes(values, annotation)


def welch_statistics(spark, sf):
    values, groups, annotation = _expression_tables(spark, sf)
    tests = expression.differential_expression(values, groups, annotation, "case", "control")
    return tests.select("dataset", "symbol", F.round("mean_case", 6).alias("mean_case"), F.round("mean_control", 6).alias("mean_control"), F.round("log2fc", 6).alias("log2fc"), F.round("t", 6).alias("t"), F.round("df", 6).alias("df"))


def differential_expression(spark, sf):
    values, groups, annotation = _expression_tables(spark, sf)
    tests = expression.differential_expression(values, groups, annotation, "case", "control")
    return tests.select("dataset", "symbol", F.round("p_value", 10).alias("p_value"), F.round("adj_p_value", 10).alias("adj_p_value"))


_EXPR_SQL = """
v AS (SELECT l_linestatus AS dataset, l_partkey AS probe, l_suppkey AS s, l_quantity AS value FROM lineitem),
a AS (SELECT p_partkey AS probe, p_name || ' ' || CAST(floor(p_retailprice / 5) AS BIGINT) AS symbol FROM part),
mean AS (SELECT dataset, probe, symbol, avg(value) AS m FROM v JOIN a USING (probe) GROUP BY ALL),
best AS (SELECT dataset, symbol, probe FROM (SELECT *, row_number() OVER (PARTITION BY dataset, symbol ORDER BY m DESC, probe DESC) AS r FROM mean) WHERE r = 1)"""

_WELCH_SQL = f"""WITH {_EXPR_SQL}, g AS (SELECT dataset, symbol, s_acctbal > 4500 AS cs, value FROM v JOIN best USING (dataset, probe) JOIN supplier ON s_suppkey = s),
st AS (SELECT dataset, symbol, count(*) FILTER (cs) AS n1, count(*) FILTER (NOT cs) AS n0, avg(value) FILTER (cs) AS m1, avg(value) FILTER (NOT cs) AS m0,
  var_samp(value) FILTER (cs) / count(*) FILTER (cs) AS a, var_samp(value) FILTER (NOT cs) / nullif(count(*) FILTER (NOT cs), 0) AS b FROM g GROUP BY ALL),
ok AS (SELECT *, n1 > 1 AND n0 > 1 AND a + b > 0 AS t_ok FROM st WHERE n1 > 0 AND n0 > 0)
SELECT dataset, symbol, round(m1, 6) AS mean_case, round(m0, 6) AS mean_control, round(m1 - m0, 6) AS log2fc, CASE WHEN t_ok THEN round((m1 - m0) / sqrt(a + b), 6) END AS t,
  CASE WHEN t_ok THEN round(pow(a + b, 2) / (a * a / (n1 - 1) + b * b / (n0 - 1)), 6) END AS df FROM ok"""


# two-sided tail as the incomplete beta function by its power series, from the side where it converges
_DIFF_SQL = _WELCH_SQL.split("SELECT dataset, symbol, round(m1, 6)")[0] + """,
td AS (SELECT dataset, symbol, m1 - m0 AS fc, CASE WHEN t_ok THEN pow(m1 - m0, 2) / (a + b) END AS tt,
  CASE WHEN t_ok THEN pow(a + b, 2) / (a * a / (n1 - 1) + b * b / (n0 - 1)) END AS df FROM ok),
side AS (SELECT *, df / (df + tt) > (df / 2 + 1) / (df / 2 + 2.5) AS swap FROM td WHERE tt IS NOT NULL),
pq AS (SELECT *, CASE WHEN swap THEN 0.5::DOUBLE ELSE df / 2 END AS p, CASE WHEN swap THEN df / 2 ELSE 0.5::DOUBLE END AS q,
  CASE WHEN swap THEN tt / (df + tt) ELSE df / (df + tt) END AS z FROM side),
term AS (SELECT dataset, symbol, sum(exp(lgamma(p + q + n) - lgamma(p + q) - lgamma(p + 1 + n) + lgamma(p + 1)) * pow(z, n)) AS s
  FROM pq, (SELECT unnest(range(400)) AS n) GROUP BY ALL),
tail AS (SELECT dataset, symbol, swap, CASE WHEN z <= 0 THEN 0.0 ELSE exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * ln(greatest(z, 1e-300)) + q * ln(1 - z)) * s / p END AS v
  FROM pq JOIN term USING (dataset, symbol)),
pv AS (SELECT dataset, symbol, fc, v IS NOT NULL AS tt_known, least(1.0, greatest(0.0, CASE WHEN swap THEN 1 - v ELSE v END)) AS p FROM td LEFT JOIN tail USING (dataset, symbol)),
rk AS (SELECT dataset, symbol, p, rank() OVER (PARTITION BY dataset ORDER BY p) + count(*) OVER (PARTITION BY dataset, p) - 1 AS r,
  count(*) OVER (PARTITION BY dataset) AS m FROM pv WHERE tt_known),
adj AS (SELECT dataset, symbol, least(1.0, min(p * m / r) OVER (PARTITION BY dataset ORDER BY p DESC)) AS adj FROM rk),
de AS (SELECT dataset, symbol, fc, CASE WHEN tt_known THEN p END AS p, coalesce(adj, 1.0) AS adj FROM pv LEFT JOIN adj USING (dataset, symbol))"""


def fdr_adjustment(spark, sf):
    """Benjamini-Hochberg over event values as p-values, one family per event type."""
    tests = load_table(spark, sf, "events").select("event_id", "event_type", F.when(F.col("value") <= 100, F.col("value") / 100).alias("p_value"))
    rows = expression.benjamini_hochberg(tests, ["event_type"])
    return rows.select("event_id", F.round("adj_p_value", 9).alias("adj_p_value"))


FDR_SQL = """WITH t AS (SELECT event_id, event_type, CASE WHEN value <= 100 THEN value / 100 END AS p FROM events),
r AS (SELECT *, rank() OVER w + count(*) OVER (PARTITION BY event_type, p) - 1 AS rk, count(*) OVER (PARTITION BY event_type) AS m FROM t WHERE p IS NOT NULL WINDOW w AS (PARTITION BY event_type ORDER BY p)),
q AS (SELECT event_id, least(1.0, min(p * m / rk) OVER (PARTITION BY event_type ORDER BY p DESC)) AS adj FROM r)
SELECT event_id, round(coalesce(adj, 1.0), 9) AS adj_p_value FROM t LEFT JOIN q USING (event_id)"""


def sample_group_mismatches(spark, sf):
    """Segments per nation against a declared even spread."""
    groups = load_table(spark, sf, "customer").select(F.col("c_nationkey").alias("dataset"), F.col("c_mktsegment").alias("grp"))
    declared = load_table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("dataset")).agg(F.count("*").alias("n")).withColumn("grp", F.lit("FURNITURE"))
    return expression.group_count_mismatches(groups, declared)


def sample_groups(spark, sf):
    """Segments and comparisons of all customers as group labels: canonical names and the labels that are none."""
    label = F.when(F.col("c_mktsegment") == "BUILDING", " AL ").when(F.col("c_mktsegment") == "MACHINERY", "Non-Lesional").when(
        F.col("c_mktsegment") == "FURNITURE", "Healthy").otherwise(F.col("c_mktsegment"))
    comparison = F.when(F.col("c_acctbal") > 0, F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit("  vs normal"))).otherwise(F.lit("normal against all"))
    case, control = expression.comparison_groups(comparison)
    rows = load_table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("dataset"), expression.canonical_group(label).alias("grp"), case.alias("case_group"), control.alias("control_group"))
    unknown = expression.unknown_groups(rows).withColumn("unknown", F.lit(True))
    counted = rows.groupBy("dataset", "grp", "case_group", "control_group").agg(F.count("*").alias("n"))
    return counted.join(unknown, ["dataset", "grp"], "left").withColumn("unknown", F.coalesce("unknown", F.lit(False)))


_GROUPS_SQL = """WITH g AS (SELECT c_nationkey AS dataset, CASE c_mktsegment WHEN 'BUILDING' THEN 'atopic_lesional' WHEN 'MACHINERY' THEN 'atopic_nonlesional' WHEN 'FURNITURE' THEN 'normal' ELSE lower(c_mktsegment) END AS grp,
  CASE WHEN c_acctbal > 0 THEN lower(c_mktsegment) END AS case_group, CASE WHEN c_acctbal > 0 THEN 'normal' END AS control_group FROM customer)
SELECT dataset, grp, case_group, control_group, count(*) AS n, grp NOT IN ('atopic_lesional', 'atopic_nonlesional', 'normal') AS unknown FROM g GROUP BY ALL"""


def normalized_symbols(spark, sf):
    """Symbol lists of all orders, one symbol per line."""
    raw = F.when(F.col("l_returnflag") == "N", " gene-a\t").when(F.col("l_linestatus") == "F", "  ").otherwise(F.concat(F.lit(" s"), (F.col("l_suppkey") % 9).cast("string")))
    lists = load_table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(raw).alias("symbols"))
    return lists.select("l_orderkey", F.array_join(tx.normalized_symbols("symbols"), ",").alias("symbols"))


_SYMBOLS_SQL = """SELECT l_orderkey, coalesce(array_to_string(list_sort(list_distinct(list(CASE WHEN l_returnflag = 'N' THEN 'GENE-A' WHEN l_linestatus = 'F' THEN NULL
  ELSE 'S' || (l_suppkey % 9) END))), ','), '') AS symbols FROM lineitem GROUP BY 1"""


def expression_candidates(spark, sf):
    """Genes over a wide fold change at a false discovery rate with the part rows that name them. The tables hold no
    effect, so the rate is a high one."""
    values, groups, annotation = _expression_tables(spark, sf)
    tests = expression.differential_expression(values, groups, annotation, "case", "control")
    passed = expression.passing(tests, 0.9, 5.0)
    lineage_rows = load_table(spark, sf, "part").select(
        F.col("p_size").alias("task_id"), F.concat_ws(" ", "p_name", F.floor(F.col("p_retailprice") / 5).cast("string")).alias("canonical_symbol"), F.col("p_partkey").alias("lineage_row_id"))
    found = expression.lineage_candidates(passed, lineage_rows)
    return found.select(
        "task_id", "dataset", "symbol", F.size("lineage_row_ids").alias("n_rows"), F.round("log2fc", 6).alias("log2fc"), F.round("adj_p_value", 8).alias("adj_p_value"))


def candidate_summaries(spark, sf):
    rows = load_table(spark, sf, "part").select(F.col("p_brand").alias("task_id"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("symbol"))
    return expression.candidate_summary(rows)


QUERIES = {
    "chain_assembly": (chain_assembly, CHAIN_SQL),
    "formula_herbs": (formula_herbs, FORMULA_SQL),
    "entity_listing": (
        entity_listing,
        """SELECT 'herb' AS kind, CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation UNION ALL SELECT 'formula', CAST(r_regionkey AS VARCHAR), r_name FROM region
        UNION ALL SELECT 'compound', CAST(s_suppkey AS VARCHAR), s_name FROM supplier UNION ALL SELECT 'target', CAST(p_partkey AS VARCHAR), p_name FROM part
        UNION ALL SELECT DISTINCT 'pathway', CAST(l_linenumber AS VARCHAR), 'line ' || l_linenumber FROM lineitem""",
    ),
    "merged_targets": (merged_targets, MERGED_SQL),
    "deduped_compounds": (
        deduped_compounds,
        "SELECT c_mktsegment AS herb, o_orderpriority AS name, min(o_orderkey) AS ord, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2",
    ),
    "deduped_sources": (
        deduped_sources,
        "SELECT event_type AS name, CASE WHEN user_id < 100 THEN CAST(user_id AS VARCHAR) END AS source_record_id, min(event_id) AS ord FROM events GROUP BY 1, 2",
    ),
    "predictions_for_compounds": (
        predictions_for_compounds,
        "SELECT 'SUPPLIER#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS compound, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem SEMI JOIN (SELECT s_suppkey AS l_suppkey FROM supplier WHERE s_acctbal > 5000) USING (l_suppkey) GROUP BY 1",
    ),
    "herb_of_compound": (
        herb_of_compound,
        """SELECT c_custkey, 'b' || CAST(floor(c_acctbal / 500) AS BIGINT) AS compound, coalesce(herb, '未识别中药') AS herb FROM customer LEFT JOIN
        (SELECT CAST(floor(s_acctbal / 500) AS BIGINT) AS b, arg_min(CAST(s_nationkey AS VARCHAR), s_suppkey) AS herb FROM supplier WHERE s_acctbal > 2000 GROUP BY 1) ON b = CAST(floor(c_acctbal / 500) AS BIGINT)""",
    ),
    "activity_scores": (
        activity_scores,
        "SELECT event_id, round(CASE WHEN event_type IN ('error', 'view') THEN 0.5 ELSE greatest(0.0, least(1.0, value / 10)) END, 6)::DOUBLE AS score FROM events WHERE event_type <> 'click'",
    ),
    "pathway_by_gene": (
        pathway_by_gene, "SELECT p_name AS symbol, 'line ' || min(l_linenumber) AS pathway FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"),
    "pathway_gene_mapping": (
        pathway_gene_mapping,
        "SELECT p_brand AS pathway_id, md5(string_agg(CASE WHEN p_retailprice < 950 THEN p_name ELSE CAST(p_partkey AS VARCHAR) END, ',' ORDER BY p_partkey)) AS genes_md5 FROM part GROUP BY 1",
    ),
    "live_target_network": (live_target_network, LIVE_SQL),
    "evidence_levels": (
        evidence_levels,
        f"""WITH c AS (SELECT l_suppkey AS task_id, {_LEVEL} AS evidence_level, count(*) AS n FROM lineitem GROUP BY ALL)
        SELECT s_suppkey AS task_id, evidence_level, coalesce(n, 0) AS n FROM supplier, (SELECT unnest(['experimental','omics_validated','literature_supported','predicted','mock_inferred']) AS evidence_level) l
        LEFT JOIN c ON c.task_id = s_suppkey AND c.evidence_level = l.evidence_level""".replace("evidence_level, coalesce", "l.evidence_level, coalesce"),
    ),
    "confirmed_levels": (
        confirmed_levels,
        f"""WITH k AS (SELECT DISTINCT l_suppkey, l_partkey, true AS ok FROM lineitem WHERE l_quantity >= 45), c AS (SELECT l_suppkey, l_partkey, l_linestatus, {_LEVEL} AS lv FROM lineitem)
        SELECT CASE WHEN ok AND l_linestatus = 'O' AND lv IN ('predicted', 'literature_supported') THEN 'omics_validated' ELSE lv END AS evidence_level, count(*) AS n FROM c LEFT JOIN k USING (l_suppkey, l_partkey) GROUP BY 1""",
    ),
    "step_metrics": (
        step_metrics,
        """SELECT user_id AS task_id, event_type AS step, count(*) AS external_request_count, CAST(count(*) FILTER (value > 20) AS BIGINT) AS cache_hit_count, CAST(sum(floor(value)) AS BIGINT) AS duration_ms,
        CASE WHEN count(*) FILTER (value > 60) > 0 THEN 'completed' WHEN event_type = 'error' THEN 'skipped' WHEN event_type = 'view' THEN 'failed' ELSE 'degraded' END AS status FROM events GROUP BY 1, 2""",
    ),
    "graph_nodes": (graph_nodes, f"WITH {_CHAIN_TABLE_SQL} SELECT task_id, layer, label, position FROM nodes"),
    "node_degrees": (
        node_degrees,
        f"WITH {_CHAIN_TABLE_SQL} SELECT task_id, node_layer, node, count(*) AS degree FROM (SELECT task_id, layer_no AS node_layer, source AS node FROM edges UNION ALL SELECT task_id, layer_no + 1, tgt FROM edges) GROUP BY ALL",
    ),
    "edge_crossings": (
        edge_crossings,
        f"""WITH {_CHAIN_TABLE_SQL}, cell AS (SELECT e.task_id, e.layer_no, a.position AS s, b.position AS t, count(*) AS n FROM edges e JOIN nodes a ON a.task_id = e.task_id AND a.layer_no = e.layer_no AND a.label = source
        JOIN nodes b ON b.task_id = e.task_id AND b.layer_no = e.layer_no + 1 AND b.label = tgt GROUP BY ALL)
        SELECT x.task_id, x.layer_no, CAST(sum(CASE WHEN x.s < y.s AND x.t > y.t THEN x.n * y.n ELSE 0 END) AS BIGINT) AS crossings FROM cell x JOIN cell y ON x.task_id = y.task_id AND x.layer_no = y.layer_no GROUP BY ALL""",
    ),
    "ego_neighbourhood": (
        ego_neighbourhood, f"WITH {_CHAIN_TABLE_SQL} SELECT source AS node FROM edges WHERE source = 'Brand#1' OR tgt = 'Brand#1' UNION SELECT tgt FROM edges WHERE source = 'Brand#1' OR tgt = 'Brand#1'"),
    "lineage_rows": (lineage_rows, f"WITH {_LINEAGE_SQL} SELECT * FROM lr"),
    "target_intersections": (
        target_intersections,
        f"""WITH {_SIDES_SQL} SELECT task_id, sym AS canonical_symbol, 'intersection-' || sha256('{{"canonical_symbol":"' || sym || '","compound_lineage_row_ids":["' || array_to_string(b, '","') || '"],"derivation":"canonical_symbol_exact_match_v1","disease_lineage_row_ids":["'
        || array_to_string(a, '","') || '"]}}') AS lineage_row_id, CAST(len(a) AS INTEGER) AS n_disease, CAST(len(b) AS INTEGER) AS n_compound FROM x""",
    ),
    "lineage_counts": (
        lineage_counts,
        f"""WITH {_SIDES_SQL} SELECT n_nationkey AS task_id, (SELECT count(DISTINCT sym) FROM d WHERE d.task_id = n_nationkey) AS disease_target_count, (SELECT count(*) FROM d WHERE d.task_id = n_nationkey) AS disease_row_count,
        (SELECT count(DISTINCT sym) FROM c WHERE c.task_id = n_nationkey) AS compound_target_count, (SELECT count(*) FROM c WHERE c.task_id = n_nationkey) AS compound_row_count,
        (SELECT count(*) FROM x WHERE x.task_id = n_nationkey) AS intersection_target_count, (SELECT count(*) FROM x WHERE x.task_id = n_nationkey) AS intersection_row_count FROM nation""",
    ),
    "network_readiness": (network_readiness, _readiness_sql()),
    "import_violations": (import_violations, IMPORT_SQL),
    "landed_imports": (landed_imports, LANDED_SQL),
    "protocol_mismatch": (
        protocol_mismatch,
        """WITH p AS (SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS a1, arg_max(o_orderstatus, o_orderkey) AS b1, arg_min(o_orderpriority, o_orderkey) AS a2, arg_max(o_orderpriority, o_orderkey) AS b2,
        arg_min(o_orderdate, o_orderkey) AS a3, arg_max(o_orderdate, o_orderkey) AS b3 FROM orders GROUP BY 1)
        SELECT o_custkey, concat_ws(',', CASE WHEN a1 <> b1 THEN 'o_orderstatus' END, CASE WHEN a2 <> b2 THEN 'o_orderpriority' END, CASE WHEN a3 <> b3 THEN 'o_orderdate' END) AS differing FROM p""",
    ),
    "enrichment_terms": (
        enrichment_terms,
        f"WITH {_ENRICH_SQL} SELECT task_id, collection, term_id, CAST(gene_count AS INTEGER) AS gene_count, overlap_count, round(p_value, 9) AS p_value, round(least(1.0, p_value * n_terms), 7) AS adjusted_p_value, rank FROM r WHERE rank <= 20",
    ),
    "enrichment_symbols": (
        enrichment_symbols,
        f"WITH {_ENRICH_SQL} SELECT task_id, collection, term_id, sym AS symbol FROM r JOIN term USING (collection, term_id) JOIN inp USING (task_id, sym) WHERE rank <= 20",
    ),
    "combined_enrichment": (combined_enrichment, f"WITH {_ENRICH_SQL} SELECT task_id, collection, term_id, round(p_value, 9) AS p_value, combined_rank FROM top WHERE combined_rank <= 20"),
    "enrichment_totals": (
        enrichment_totals,
        f"WITH {_ENRICH_SQL} SELECT task_id, CAST(n_in AS INTEGER) AS input_gene_count, CAST((SELECT count(*) FROM part) AS INTEGER) AS background_gene_count, (SELECT count(*) FROM top WHERE top.task_id = ni.task_id AND combined_rank <= 20) AS n_terms FROM ni WHERE n_in >= 2",
    ),
    "probe_collapse": (probe_collapse, f"WITH {_EXPR_SQL} SELECT dataset, symbol, probe FROM best"),
    "welch_statistics": (welch_statistics, _WELCH_SQL),
    "differential_expression": (differential_expression, f"{_DIFF_SQL} SELECT dataset, symbol, round(p, 10) AS p_value, round(adj, 10) AS adj_p_value FROM de"),
    "fdr_adjustment": (fdr_adjustment, FDR_SQL),
    "sample_group_mismatches": (
        sample_group_mismatches,
        """WITH o AS (SELECT c_nationkey AS dataset, c_mktsegment AS grp, count(*) AS observed FROM customer GROUP BY ALL), d AS (SELECT s_nationkey AS dataset, 'FURNITURE' AS grp, count(*) AS declared FROM supplier GROUP BY ALL)
        SELECT dataset, grp, observed, declared FROM o FULL JOIN d USING (dataset, grp) WHERE observed IS DISTINCT FROM declared""",
    ),
    "sample_groups": (sample_groups, _GROUPS_SQL),
    "normalized_symbols": (normalized_symbols, _SYMBOLS_SQL),
    "expression_candidates": (
        expression_candidates,
        f"""{_DIFF_SQL},
        ln AS (SELECT p_size AS task_id, p_name || ' ' || CAST(floor(p_retailprice / 5) AS BIGINT) AS symbol, CAST(count(*) AS INTEGER) AS n_rows FROM part GROUP BY ALL)
        SELECT task_id, dataset, symbol, n_rows, round(fc, 6) AS log2fc, round(adj, 8) AS adj_p_value FROM de JOIN ln USING (symbol) WHERE p IS NOT NULL AND adj < 0.9 AND abs(fc) > 5""",
    ),
    "candidate_summaries": (
        candidate_summaries,
        """WITH s AS (SELECT p_brand AS task_id, p_name || ' ' || p_partkey AS symbol, row_number() OVER (PARTITION BY p_brand ORDER BY p_name || ' ' || p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
        SELECT task_id, n, '候选基因 ' || n || ' 个：' || string_agg(symbol, '、' ORDER BY r) || CASE WHEN n > 6 THEN ' 等' ELSE '' END AS summary FROM s WHERE r <= 6 GROUP BY 1, 2""",
    ),
}
