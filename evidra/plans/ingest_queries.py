"""Registered queries: artifact parsing, upserts, caches, text quality, page tables, documents.

Artifacts and responses are built by Spark from the driver tables and parsed back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evidra.functions import canonical
from evidra.functions import text as tx
from evidra.operators import answers, audits, documents, lineage, live
from evidra.plans import review_queries as rq
from evidra.plans.evaluation_queries import _CLAIMS_SQL, _turn_claims
from evidra.session import load_table, materialize, union_all, work_folder
from evidra.sources import buckets, connectors, literature, omics

J = lambda *cols: F.to_json(F.struct(*cols))


# --- artifacts ----------------------------------------------------------------------------------


def _associations(spark, sf, key="l_orderkey", faulty="true", lift=0.0):
    """One artifact per order (or other key): its lines as associated targets, some of them faulty."""
    lines = load_table(spark, sf, "lineitem")
    row = F.struct(
        F.struct(F.concat(F.lit("ENSG"), F.col("l_partkey").cast("string")).alias("id"), F.when(F.expr(faulty) & (F.col("l_tax") > 0.075), "").otherwise(F.concat(F.lit("S"), F.col("l_partkey").cast("string"))).alias("approvedSymbol")).alias("target"),
        (F.col("l_discount") + lift).alias("score"))
    docs = lines.groupBy(key).agg(F.collect_list(row).alias("rows"))
    count = F.when(F.col(key) % 10 == 3, F.size("rows") + 1).otherwise(F.size("rows"))
    content = J(F.struct(F.struct(F.lit("D1").alias("id"), F.when(F.col(key) % 10 == 7, "other").otherwise("disease").alias("name"),
                                  F.struct(count.alias("count"), F.col("rows")).alias("associatedTargets")).alias("disease")).alias("data"))
    content = F.when(F.col(key) % 10 == 9, F.lit("{broken")).otherwise(content)
    return docs.select(
        F.col(key).alias("artifact_id"), content.alias("content"), F.lit("D1").alias("source_query_id"), F.lit("disease").alias("source_query_label"),
        F.lit("genetic").alias("datatype"), F.lit(0.01).alias("applied_threshold"))


_ASSOC_SQL = """
a AS (SELECT l_orderkey AS id, count(*) AS n, count(*) FILTER (l_tax > 0.075) AS blank, count(*) FILTER (l_discount < 0.01) AS low FROM lineitem GROUP BY 1),
bad AS (SELECT *, id % 10 = 9 AS broken FROM a)"""


def association_records(spark, sf):
    records, _ = connectors.parse_associations(_associations(spark, sf))
    return records.groupBy("artifact_id").agg(
        F.count("*").alias("n"), F.round(F.sum("source_score"), 6).alias("score"), F.min("source_record_id").alias("first_record"), F.min("canonical_symbol").alias("first_symbol"))


def large_artifacts(spark, sf):
    """One artifact per supplier, each of several hundred lines: size alone rejects none."""
    artifacts = _associations(spark, sf, "l_suppkey", "l_suppkey % 10 = 5", 0.02)
    records, _ = connectors.parse_associations(artifacts)
    return records.groupBy("artifact_id").agg(F.count("*").alias("n"), F.min("source_record_id").alias("first_record"), F.max("row_no").alias("last_row"))


def association_violations(spark, sf):
    _, violations = connectors.parse_associations(_associations(spark, sf))
    return violations.groupBy("rule").agg(F.count("*").alias("n"), F.count_distinct("artifact_id").alias("n_artifacts"))


def activity_violations(spark, sf):
    """One artifact per supplier and year, activities from its lines."""
    lines = load_table(spark, sf, "lineitem")
    row = F.struct(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("activity_id"), F.concat(F.lit("CHEMBL"), F.col("l_suppkey").cast("string")).alias("molecule_chembl_id"),
        F.concat(F.lit("T"), F.col("l_partkey").cast("string")).alias("target_chembl_id"), F.concat(F.lit("S"), F.col("l_partkey").cast("string")).alias("target_gene_symbol"),
        F.when(F.col("l_tax") > 0.075, "Mus musculus").otherwise("Homo sapiens").alias("target_organism"), F.col("l_quantity").alias("pchembl_value"))
    docs = lines.groupBy("l_suppkey", F.date_format("l_shipdate", "yyyyMM").alias("m")).agg(F.collect_list(row).alias("activities")).select(
        F.concat_ws("/", "l_suppkey", "m").alias("artifact_id"), J("activities").alias("content"), F.concat(F.lit("CHEMBL"), F.col("l_suppkey").cast("string")).alias("compound_id"),
        F.lit("Homo sapiens").alias("species"), F.lit(2.0).alias("applied_threshold"))
    records, violations = connectors.parse_activities(docs)
    counts = violations.groupBy("rule").agg(F.count("*").alias("n"), F.count_distinct("artifact_id").alias("n_artifacts"))
    clean = records.agg(F.count("*").alias("n"), F.count_distinct("artifact_id").alias("n_artifacts")).select(F.lit("clean_records").alias("rule"), "n", "n_artifacts")
    return counts.unionByName(clean)


ACTIVITY_SQL = """WITH l AS (SELECT l_suppkey || '/' || strftime(l_shipdate, '%Y%m') AS id, l_orderkey || '-' || l_linenumber AS act, l_tax > 0.075 AS mouse, l_quantity < 2.0 AS low FROM lineitem),
v AS (SELECT 'species_mismatch' AS rule, id FROM l WHERE mouse UNION ALL SELECT 'below_threshold', id FROM l WHERE low UNION ALL SELECT 'activity_id_not_unique', id FROM l GROUP BY id, act HAVING count(*) > 1)
SELECT rule, count(*) AS n, count(DISTINCT id) AS n_artifacts FROM v GROUP BY 1
UNION ALL SELECT 'clean_records', count(*), count(DISTINCT id) FROM l WHERE id NOT IN (SELECT id FROM v)"""


def trusted_artifacts(spark, sf):
    """Pages as artifacts; a manifest that lacks some and misstates others."""
    pages = load_table(spark, sf, "pages").select(F.col("page_id").alias("artifact_id"), F.encode("html", "UTF-8").alias("content"), F.col("url").alias("metadata"))
    manifest = pages.where("artifact_id % 5 <> 2").select(F.sha2("content", 256).alias("sha256"), F.when(F.col("artifact_id") % 7 == 1, "other").otherwise(F.col("metadata")).alias("metadata"))
    return connectors.trust_states(pages, manifest)


def interaction_edges(spark, sf):
    lines = load_table(spark, sf, "lineitem").select(
        F.when(F.col("l_returnflag") == "A", F.concat(F.lit("P"), F.col("l_partkey").cast("string"))).alias("preferredName_A"),
        F.when(F.col("l_returnflag") != "N", F.concat(F.lit("9606."), F.col("l_partkey").cast("string"))).alias("stringId_A"),
        F.concat(F.lit("Q"), F.col("l_suppkey").cast("string")).alias("preferredName_B"), F.lit("").alias("stringId_B"),
        F.when(F.col("l_tax") > 0.01, F.col("l_discount").cast("string")).alias("score"))
    return connectors.interaction_edges(lines)


def pathway_parsing(spark, sf):
    """Part-of-brand link lines and brand names as a pathway database's text responses."""
    parts = load_table(spark, sf, "part")
    links = connectors.pathway_links(parts.select(
        F.concat(F.lit("hsa:"), F.col("p_partkey").cast("string")).alias("left"), F.concat(F.lit("path:"), "p_brand").alias("right"), F.col("p_partkey").alias("ord")))
    names = parts.where("p_size < 40").select(
        F.concat(F.lit("path:"), "p_brand").alias("pathway"), F.concat("p_type", F.lit(" set - Homo sapiens (human)")).alias("name"), F.col("p_partkey").alias("ord"))
    rows = connectors.pathways_from_links(links, names)
    return rows.select("pathway_id", "name", F.md5(F.array_join("genes", ",")).alias("genes_md5"), "source_record_id")


def first_gene_ids(spark, sf):
    """Orders as lookup texts; only part of them hold a human gene id."""
    orders = load_table(spark, sf, "orders")
    text = F.concat(F.lit("\n"), F.when(F.col("o_orderstatus") == "F", "mmu:1\tx").otherwise(F.concat(F.lit("hsa:"), F.col("o_custkey").cast("string"), F.lit("\tAKT1; kinase"))), F.lit("\nhsa:77\ty"))
    return orders.select("o_orderkey", connectors.first_gene_id(text).alias("gene_id"))


def prediction_candidates(spark, sf):
    rows = load_table(spark, sf, "lineitem").select(
        F.when(F.col("l_tax") > 0, F.concat(F.lit("c"), F.col("l_suppkey").cast("string"))).alias("compound"), F.concat(F.lit("s"), F.col("l_partkey").cast("string")).alias("target_symbol"),
        F.when(F.col("l_discount") > 0.02, F.col("l_discount").cast("string")).otherwise("none").alias("score"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("source"),
        F.lit(None).cast("string").alias("source_record_id"), F.lit(None).cast("string").alias("retrieved_at"))
    return connectors.prediction_candidates(rows).groupBy("source", "compound").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("score"))


def lookup_responses(spark, sf):
    """Compound, molecule and target lookups landed as JSON, parsed back per supplier and part."""
    supplier = load_table(spark, sf, "supplier")
    identity = connectors.compound_identities(supplier.select(
        F.col("s_name").alias("compound"), J(F.struct(F.when(F.col("s_acctbal") > 0, F.array("s_suppkey", "s_nationkey")).otherwise(F.array().cast("array<bigint>")).alias("CID")).alias("IdentifierList")).alias("payload")))
    molecule = connectors.molecule_ids(supplier.select(
        F.col("s_name").alias("compound"), J(F.array(F.struct(F.concat(F.lit("CHEMBL"), F.col("s_suppkey").cast("string")).alias("molecule_chembl_id"))).alias("molecules")).alias("payload")))
    return supplier.select(F.col("s_name").alias("compound")).join(identity, "compound", "left").join(molecule, "compound", "left")


def activity_responses(spark, sf):
    lines = load_table(spark, sf, "lineitem")
    row = F.struct(
        F.when(F.col("l_returnflag") == "A", "Mus musculus").when(F.col("l_returnflag") == "N", "").otherwise("Homo sapiens").alias("target_organism"),
        F.when(F.col("l_tax") > 0.02, F.concat(F.lit("Target "), F.col("l_partkey").cast("string"))).alias("target_pref_name"), F.concat(F.lit("CHEMBL"), F.col("l_partkey").cast("string")).alias("target_chembl_id"),
        F.when(F.col("l_discount") > 0.03, F.col("l_discount") * 100).alias("pchembl_value"), F.col("l_orderkey").alias("activity_id"))
    docs = lines.groupBy("l_orderkey").agg(F.collect_list(row).alias("activities")).select(
        F.col("l_orderkey").cast("string").alias("compound"), F.lit("CID:1").alias("identity_record_id"), J("activities").alias("payload"))
    rows = connectors.activity_targets(docs)
    return rows.groupBy("compound", "symbol").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("score"), F.min("source_record_id").alias("record"))


ACTIVITY_TARGET_SQL = """SELECT CAST(l_orderkey AS VARCHAR) AS compound, CASE WHEN l_tax > 0.02 THEN 'Target ' || l_partkey ELSE 'CHEMBL' || l_partkey END AS symbol, count(*) AS n,
  round(sum(CASE WHEN l_discount > 0.03 THEN least(1.0, greatest(0.0, l_discount * 100 / 10)) ELSE 0.5 END), 6)::DOUBLE AS score, CAST(l_orderkey AS VARCHAR) AS record FROM lineitem WHERE l_returnflag <> 'A' GROUP BY ALL"""


def target_normalization(spark, sf):
    """Brand lookups: the exact symbol is preferred over the first result."""
    parts = load_table(spark, sf, "part")
    record = F.struct(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("primaryAccession"), F.array(F.struct(F.struct(F.col("p_name").alias("value")).alias("geneName"))).alias("genes"),
        F.struct(F.struct(F.struct(F.col("p_type").alias("value")).alias("fullName")).alias("recommendedName")).alias("proteinDescription"))
    docs = parts.groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("p_partkey", record.alias("r")))).alias("l")).select(
        F.when(F.col("p_brand") < "Brand#2", F.lit("RED WIDGET")).otherwise(F.col("p_brand")).alias("kind"), "p_brand", F.transform("l", lambda s: s["r"]).alias("results"))
    rows = docs.select(F.concat_ws("|", "kind", "p_brand").alias("full"), F.col("kind").alias("query"), J("results").alias("payload"))
    # one response per brand; the query text of several brands is the same symbol
    keyed = rows.select(F.col("full"), "query", "payload")
    found = connectors.normalized_targets(keyed.withColumn("query", F.col("query")).groupBy("query").agg(F.min_by("payload", "full").alias("payload")))
    return found


NORMAL_SQL = """WITH b AS (SELECT *, CASE WHEN p_brand < 'Brand#2' THEN 'RED WIDGET' ELSE p_brand END AS query FROM part),
f AS (SELECT query, min(p_brand) AS brand FROM b GROUP BY 1), r AS (SELECT b.*, row_number() OVER (PARTITION BY b.query ORDER BY upper(p_name) <> upper(b.query), p_partkey) AS k FROM b JOIN f ON f.query = b.query AND f.brand = b.p_brand)
SELECT query, p_name AS symbol, 'P' || p_partkey AS accession, p_type AS protein_name FROM r WHERE k = 1"""


def _landed(spark, sf):
    """Nations as tasks, suppliers as compounds, lines as activities (returned ones of another species) and large open ones as predictions, brands
    as targets, of which those below Brand#3 are records under their least type."""
    supplier, part = load_table(spark, sf, "supplier"), load_table(spark, sf, "part")
    name = F.col("s_name").alias("compound")
    lines = load_table(spark, sf, "lineitem").join(supplier.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey")).join(
        part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    tasks = load_table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("task_id"), F.col("n_name").alias("query"), F.lit("formula").alias("analysis_type"))
    compounds = supplier.select(
        F.col("s_nationkey").cast("string").alias("task_id"), F.col("s_name").alias("name"), F.concat(F.lit("herb "), F.col("s_nationkey").cast("string")).alias("herb"),
        F.col("s_suppkey").alias("ord"))
    identities = supplier.select(name, J(F.struct(F.when(F.col("s_acctbal") > 0, F.array("s_suppkey")).otherwise(F.array().cast("array<bigint>")).alias("CID")).alias("IdentifierList")).alias("payload"))
    activity = F.struct(
        F.when(F.col("l_returnflag") == "A", "Mus musculus").otherwise("Homo sapiens").alias("target_organism"), F.col("p_brand").alias("target_pref_name"),
        F.when(F.col("l_discount") > 0.03, F.col("l_discount") * 100).alias("pchembl_value"), F.when(F.col("l_tax") > 0.02, F.col("l_orderkey")).alias("activity_id"))
    # one landed response per compound and line number holds the lines of a supplier
    activities = lines.groupBy(name, "l_linenumber").agg(F.sort_array(F.collect_list(F.struct("l_orderkey", activity.alias("a")))).alias("l")).select(
        "compound", J(F.transform("l", lambda s: s["a"]).alias("activities")).alias("payload"))
    predictions = lines.where("l_quantity > 40 and l_linestatus = 'O'").select(
        F.when(F.col("l_linenumber") == 7, "unknown").otherwise(F.upper("s_name")).alias("compound"), F.col("p_brand").alias("target_symbol"),
        F.col("l_discount").cast("string").alias("score"), F.lit("").alias("source"), F.when(F.col("l_tax") > 0.06, F.concat(F.lit("r"), F.col("l_orderkey").cast("string"))).alias("source_record_id"),
        F.lit(None).cast("string").alias("retrieved_at"), F.col("l_orderkey").alias("ord"))
    record = F.struct(F.array(F.struct(F.struct(F.col("p_type").alias("value")).alias("geneName"))).alias("genes"), F.col("p_type").alias("primaryAccession"))
    types = part.groupBy("p_brand").agg(F.min("p_type").alias("p_type"))
    normalizations = types.select(F.col("p_brand").alias("query"), J(F.when(F.col("p_brand") < "Brand#3", F.array(record)).otherwise(F.array().cast(
        "array<struct<genes:array<struct<geneName:struct<value:string>>>,primaryAccession:string>>")).alias("results")).alias("payload"))
    pathways = load_table(spark, sf, "customer").where("c_nationkey % 5 > 0").select(
        F.col("c_nationkey").cast("string").alias("task_id"), F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("pathway_id"))
    return tasks, compounds, identities, activities, predictions, normalizations, pathways


def landed_network(spark, sf):
    """Landed lookups of all tasks composed into graded chains."""
    chains = live.live_network(*_landed(spark, sf))
    return chains.select("task_id", "herb", "formula", "compound", "target", "pathway", F.round("score", 6).alias("score"), F.size("evidence_refs").alias("n_refs"), "evidence_level")


def landed_steps(spark, sf):
    """The steps of the same tasks."""
    tasks, compounds, identities, activities, predictions, _, pathways = _landed(spark, sf)
    return live.step_states(tasks, compounds, live.task_candidates(compounds, identities, activities, predictions), pathways)


_LANDED = """WITH mk AS (SELECT p_brand, min(p_type) AS type FROM part GROUP BY 1),
l AS (SELECT *, p.p_brand AS brand FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part p ON l_partkey = p_partkey),
c AS (SELECT s_nationkey AS t, s_name AS c, brand, 'known_activity' AS ev, CASE WHEN l_discount > 0.03 THEN least(1.0, greatest(0.0, l_discount * 100 / 10)) ELSE 0.5 END AS score,
    CASE WHEN l_tax > 0.02 THEN CAST(l_orderkey AS VARCHAR) WHEN s_acctbal > 0 THEN 'CID' END AS ref FROM l WHERE l_returnflag <> 'A'
  UNION ALL SELECT s_nationkey, s_name, brand, 'predicted', l_discount, CASE WHEN l_tax > 0.06 THEN 'r' END FROM l WHERE l_quantity > 40 AND l_linestatus = 'O' AND l_linenumber <> 7)"""
LANDED_SQL = f"""{_LANDED},
n AS (SELECT t, c, ev, score, CASE WHEN brand < 'Brand#3' THEN type ELSE brand END AS target, (ref IS NOT NULL)::INT + (brand < 'Brand#3')::INT AS refs FROM c JOIN mk ON p_brand = brand),
m AS (SELECT t, CASE WHEN bool_or(ev = 'predicted') THEN upper(c) ELSE c END AS compound, bool_or(ev = 'predicted') AS loud, c, target, CASE WHEN count(DISTINCT ev) > 1 THEN 'mixed' ELSE min(ev) END AS ev,
  max(score) AS score, CAST(sum(refs) AS INTEGER) AS n_refs FROM n GROUP BY t, c, target)
SELECT CAST(t AS VARCHAR) AS task_id, CASE WHEN compound = c THEN 'herb ' || t ELSE '{live.network.UNKNOWN_HERB}' END AS herb, n_name AS formula, compound, target,
  coalesce(pathway, '{live.network.UNKNOWN_PATHWAY}') AS pathway, round(score, 6) AS score, n_refs,
  CASE WHEN ev = 'known_activity' THEN 'experimental' WHEN ev = 'mixed' OR n_refs > 0 THEN 'literature_supported' ELSE 'predicted' END AS evidence_level
FROM m JOIN nation ON n_nationkey = t LEFT JOIN (SELECT c_nationkey, arg_min(c_mktsegment, c_custkey) AS pathway FROM customer WHERE c_nationkey % 5 > 0 GROUP BY 1) ON c_nationkey = t"""
LANDED_STEPS_SQL = f"""{_LANDED},
k AS (SELECT n_nationkey AS t, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n0, (SELECT count(*) FROM c WHERE t = n_nationkey AND ev = 'known_activity') AS n1,
  (SELECT count(*) FROM c WHERE t = n_nationkey AND ev = 'predicted') AS n2, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_nationkey % 5 > 0) AS n4 FROM nation),
s(step_no, step, empty) AS (VALUES {', '.join(f"({i}, '{step}', '{empty}')" for i, (step, empty) in enumerate(live.STEPS))}),
z AS (SELECT t, CAST(step_no AS INTEGER) AS step_no, step, empty, CASE step_no WHEN 0 THEN n0 WHEN 1 THEN n1 WHEN 2 THEN n2 WHEN 4 THEN n4 ELSE n1 + n2 END AS n FROM k CROSS JOIN s)
SELECT CAST(t AS VARCHAR) AS task_id, step_no, step, n, CASE WHEN n > 0 THEN 'completed' ELSE empty END AS status FROM z"""


def pending_requests(spark, sf):
    """Customers as lookups of which the suppliers' nations have landed."""
    asked = load_table(spark, sf, "customer").select(F.lit("PubChem API").alias("provider"), F.col("c_nationkey").cast("string").alias("query"), F.struct(F.col("c_mktsegment").alias("segment")).alias("params")).distinct()
    landed = load_table(spark, sf, "supplier").select(F.lit("PubChem API").alias("provider"), F.col("s_nationkey").cast("string").alias("query"), F.struct(F.lit("BUILDING").alias("segment")).alias("params")).distinct().select(
        canonical.request_key(F.col("provider"), F.col("query"), F.col("params")).alias("cache_key"), F.lit("{}").alias("payload"))
    _, pending = connectors.split_requests(asked, landed)
    return pending.select("query", F.col("params.segment").alias("segment"), "cache_key")


PENDING_SQL = """WITH a AS (SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS query, c_mktsegment AS segment FROM customer)
SELECT query, segment, 'pubchem-api-v1-' || substring(sha256('{"params":{"segment":"' || segment || '"},"provider":"PubChem API","query":"' || query || '","schema_version":"v1"}'), 1, 24) AS cache_key
FROM a WHERE NOT (segment = 'BUILDING' AND query IN (SELECT CAST(s_nationkey AS VARCHAR) FROM supplier))"""


# --- pages, articles, text --------------------------------------------------------------------------


def page_compounds(spark, sf):
    """List items of every page as table rows under its heading."""
    pages = load_table(spark, sf, "pages")
    html = F.regexp_replace(F.regexp_replace("html", "(?s)<title>.*?</title>", "<tr><th>No</th><th>Molecule name</th></tr>"), "(?s)<li>(.*?)</li>", "<tr><td>7</td><td>$1</td></tr>")
    rows = connectors.compounds_from_pages(pages.withColumn("html", html), F.lit("herb"))
    return rows.select("page_id", "row_no", "name", F.col("properties")["No"].alias("no"))


PAGE_SQL = """WITH c AS (SELECT page_id, regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1) AS cells FROM pages),
u AS (SELECT page_id, generate_subscripts(cells, 1) AS i, unnest(cells) AS cell FROM c)
SELECT page_id, CAST(i AS INTEGER) AS row_no, trim(regexp_replace(regexp_replace(cell, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) AS name, '7' AS no FROM u
WHERE trim(regexp_replace(regexp_replace(cell, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) <> ''"""


def article_records(spark, sf):
    """Documents written as article XML and parsed back."""
    docs = load_table(spark, sf, "documents")
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    line = F.split_part("text", F.lit("\n"), F.lit(1))
    title = F.regexp_replace(line, "[^\\p{L}\\p{N} .,]", "")
    xml = F.concat(
        F.lit("<PubmedArticle><MedlineCitation><PMID>"), F.col("doc_id").cast("string"), F.lit("</PMID><Article><ArticleTitle>The <i>"), title, F.lit("</i> case</ArticleTitle><Abstract>"),
        F.lit("<AbstractText Label=\"AIM\">"), F.col("lang"), F.lit(" study</AbstractText><AbstractText>"), F.col("source"), F.lit("</AbstractText></Abstract><AuthorList><Author><LastName>"), F.col("source"),
        F.lit("</LastName><ForeName>"), F.col("lang"), F.lit("</ForeName></Author><Author><CollectiveName>Group A</CollectiveName></Author></AuthorList><Journal><JournalIssue><PubDate><MedlineDate>"),
        (F.lit(1990) + F.col("n_chars") % 30).cast("string"), F.lit(" Jan-Feb</MedlineDate></PubDate></JournalIssue><ISOAbbreviation>"), esc(F.col("source")), F.lit("</ISOAbbreviation></Journal></Article>"),
        F.lit("<KeywordList><Keyword>a</Keyword><Keyword>"), F.col("lang"), F.lit("</Keyword><Keyword>a</Keyword></KeywordList></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType=\"doi\">10.1/"),
        F.col("doc_id").cast("string"), F.lit("</ArticleId></ArticleIdList></PubmedData></PubmedArticle>"))
    rows = literature.parse_articles(docs.select(xml.alias("xml")))
    items = literature.records_to_items(rows)
    return items.join(rows.select(F.col("pmid").alias("pubmed_id"), "journal"), "pubmed_id").select(
        "id", F.md5("title").alias("title_md5"), "abstract", F.array_join("authors", ";").alias("authors"), F.array_join("keywords", ";").alias("keywords"), "year", "journal", "doi", "citation_url")


ARTICLE_SQL = """SELECT 'pmid-' || doc_id AS id, md5(trim('The ' || regexp_replace(split_part(text, chr(10), 1), '[^\\p{L}\\p{N} .,]', '', 'g') || ' case')) AS title_md5, 'AIM: ' || lang || ' study ' || source AS abstract,
  source || ' ' || lang || ';Group A' AS authors, 'a;' || lang AS keywords, CAST(1990 + n_chars % 30 AS INTEGER) AS year, source AS journal, '10.1/' || doc_id AS doi, 'https://pubmed.ncbi.nlm.nih.gov/' || doc_id || '/' AS citation_url FROM documents"""


def text_quality(spark, sf):
    docs = load_table(spark, sf, "documents")
    text = F.col("text")
    hits = F.size(F.filter(F.lit(["license", "the", "password", "skin barrier"]), lambda t: F.contains(F.lower(text), t)))
    return docs.select(
        "doc_id", F.length(text).alias("chars"), tx.char_count(text, tx.NUL).alias("nul_count"), F.regexp_count(text, F.lit("\\(cid:\\d+\\)")).alias("cid_count"),
        tx.char_count(text, "�").alias("replacement_count"), F.round(tx.cjk_ratio(text), 6).alias("cjk_ratio"), hits.alias("term_hits"),
        F.array_join(tx.spike_flags(text), ",").alias("flags"), F.substring(F.sha2(text, 256), 1, 12).alias("digest"), tx.low_text_density(text).alias("low_density"))


QUALITY_SQL = """SELECT doc_id, CAST(length(text) AS INTEGER) AS chars, CAST(length(text) - length(replace(text, chr(0), '')) AS INTEGER) AS nul_count, CAST(len(regexp_extract_all(text, '\\(cid:\\d+\\)')) AS INTEGER) AS cid_count,
  CAST(length(text) - length(replace(text, chr(65533), '')) AS INTEGER) AS replacement_count, round((length(text) - length(regexp_replace(text, '[一-鿿]', '', 'g'))) / length(text), 6) AS cjk_ratio,
  CAST(len(list_filter(['license', 'the', 'password', 'skin barrier'], lambda t: contains(lower(text), t))) AS INTEGER) AS term_hits,
  concat_ws(',', CASE WHEN regexp_matches(text, '\\(cid:\\d+\\)') THEN 'cid_tokens' END, CASE WHEN contains(text, chr(65533)) THEN 'replacement_chars' END,
    CASE WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 120 THEN 'short_text' END, 'low_cjk_ratio') AS flags, substring(sha256(text), 1, 12) AS digest,
  length(text) >= 10 AND length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) / length(text) < 0.2 AS low_density FROM documents"""


def text_quality_summary(spark, sf):
    text = F.col("text")
    rows = load_table(spark, sf, "documents").select(
        "source", tx.nul_ratio(text).alias("nul"), tx.cjk_ratio(text).alias("cjk"), tx.low_text_density(text).alias("low"))
    ratios = [F.round(F.avg(c), 9).alias(f"{c}_ratio") for c in ("nul", "cjk")]
    return rows.groupBy("source").agg(*ratios, F.count_if("low").alias("warnings"), F.count("*").alias("n_docs"))


def trimmed_pages(spark, sf):
    docs = load_table(spark, sf, "documents")
    trimmed = tx.trim_header_footer(F.col("text"))
    return docs.select("doc_id", F.md5(trimmed).alias("md5"), F.length(trimmed).alias("n"))


TRIM_SQL = """WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls, len(string_split(text, chr(10))) AS n FROM documents),
t AS (SELECT doc_id, regexp_replace(CASE WHEN n <= 3 THEN text ELSE array_to_string(ls[greatest(1, CAST(floor(n * 0.15) AS BIGINT)) + 1 : n - greatest(1, CAST(floor(n * 0.15) AS BIGINT))], chr(10)) END, '^\\s+|\\s+$', '', 'g') AS x FROM l)
SELECT doc_id, md5(x) AS md5, CAST(length(x) AS INTEGER) AS n FROM t"""


def preview_windows(spark, sf):
    """Most readable lines of every document, up to 300 characters."""
    docs = load_table(spark, sf, "documents")
    return literature.with_preview(docs, "text").select("doc_id", F.md5("preview").alias("preview_md5"), F.length("preview").alias("n"))


PREVIEW_SQL = """WITH l AS (SELECT doc_id, text, unnest(regexp_split_to_array(text, '[\\r\\n]+')) AS raw, generate_subscripts(regexp_split_to_array(text, '[\\r\\n]+'), 1) AS pos FROM documents),
k AS (SELECT *, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS s FROM l),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM k WHERE length(s) > 0 AND NOT regexp_matches(s, '^\\d+$') AND NOT regexp_matches(s, '(?i)^references$') AND NOT regexp_matches(s, '^\\[\\d+\\]')
  AND NOT (length(s) >= 10 AND length(regexp_replace(s, '[^\\p{L}\\p{N}]', '', 'g')) / length(s) < 0.2)),
sc AS (SELECT *, 4 * len(list_filter(['atopic dermatitis', 'methods', 'results', 'conclusion', 'skin barrier'], lambda x: contains(lower(s), x))) + CASE WHEN length(s) >= 24 THEN 1 ELSE 0 END AS score FROM c),
st AS (SELECT doc_id, arg_min(r, -score * 1000000 + r) AS r0 FROM sc GROUP BY 1),
w AS (SELECT sc.*, sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY r) - 1 AS run, sc.r = r0 AS first FROM sc JOIN st USING (doc_id) WHERE sc.r >= r0),
p AS (SELECT doc_id, string_agg(s, chr(10) ORDER BY r) AS x FROM w WHERE first OR run <= 300 GROUP BY 1),
f AS (SELECT doc_id, regexp_replace(substring(coalesce(x, text), 1, 300), '^\\s+|\\s+$', '', 'g') AS x FROM documents LEFT JOIN p USING (doc_id))
SELECT doc_id, md5(x) AS preview_md5, CAST(length(x) AS INTEGER) AS n FROM f"""


def redacted_texts(spark, sf):
    docs = load_table(spark, sf, "documents")
    marked = F.concat("text", F.lit(" MY_API_KEY = abc123 sk-ABCDEFGH12"), F.col("doc_id").cast("string"))
    clean = tx.redact(marked)
    return docs.select("doc_id", F.regexp_count(clean, F.lit("\\[REDACTED\\]")).alias("n_redacted"), F.contains(clean, F.lit("sk-ABCDEFGH12")).alias("leaks"))


def _redacted_sql(text: str) -> str:
    for pattern in ("(?i)[a-z0-9_]*API_KEY\\s*=\\s*\\S+", "(?i)[a-z0-9_]+_API_KEY", "sk-[A-Za-z0-9_-]{8,}"):
        text = f"regexp_replace({text}, '{pattern}', '[REDACTED]', 'g')"
    return f"regexp_replace({text}, '^[\\s\\x0b\\x{{85}}\\p{{Z}}]+|[\\s\\x0b\\x{{85}}\\p{{Z}}]+$', '', 'g')"


REDACTED_SQL = f"""WITH r AS (SELECT doc_id, {_redacted_sql("text || ' MY_API_KEY = abc123 sk-ABCDEFGH12' || doc_id")} AS x FROM documents)
SELECT doc_id, CAST((length(x) - length(replace(x, '[REDACTED]', ''))) // 10 AS INTEGER) AS n_redacted, contains(x, 'sk-ABCDEFGH12') AS leaks FROM r"""


def upload_ids(spark, sf):
    docs = load_table(spark, sf, "documents")
    name = F.concat(F.when(F.col("lang") == "fr", "中文.pdf").when(F.col("lang") == "de", F.repeat(F.lit("Long name "), 12)).otherwise("My Paper (v2).PDF"))
    return docs.select(
        "doc_id", canonical.upload_id(F.concat(F.lit("cn-"), F.col("doc_id").cast("string")), name).alias("upload_id"),
        canonical.upload_id(F.concat(F.lit("cn-"), F.col("doc_id").cast("string")), name, F.sha2("text", 256)).alias("bound_id"))


UPLOAD_SQL = """WITH d AS (SELECT doc_id, 'cn-' || doc_id AS lit, CASE lang WHEN 'fr' THEN '中文.pdf' WHEN 'de' THEN repeat('Long name ', 12) ELSE 'My Paper (v2).PDF' END AS nm, lang, sha256(text) AS h FROM documents)
SELECT doc_id, CASE lang WHEN 'fr' THEN 'pdf-' || lit || '-pdf-' || substring(sha1(nm), 1, 8) WHEN 'de' THEN 'pdf-' || sha256('["' || lit || '", "' || nm || '"]') ELSE 'pdf-' || lit || '-my-paper-v2-pdf' END AS upload_id,
  'pdf-' || sha256('["' || lit || '", "' || nm || '", "' || h || '"]') AS bound_id FROM d"""


# --- upserts ---------------------------------------------------------------------------------------


def corpus_upsert(spark, sf):
    """English documents exist; labelled documents of any language come in."""
    docs = load_table(spark, sf, "documents").select(
        F.concat(F.lit("pmid-"), F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("title"), F.col("n_chars").cast("int").alias("year"), F.lit("kept").alias("pdf_upload_id"), "doc_id", "lang")
    existing = docs.where("lang = 'en'").drop("doc_id", "lang")
    incoming = docs.join(load_table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select("id", F.lit("fresh").alias("title"), (F.col("year") + 1).alias("year"))
    return literature.upsert_items(existing, incoming)


def corpus_versions(spark, sf):
    """A bucketed corpus of the English documents after two batches: the labelled documents, then those of benchmark-sized ids."""
    docs = load_table(spark, sf, "documents").select(
        F.concat(F.lit("pmid-"), F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("title"), F.col("n_chars").cast("int").alias("year"), "doc_id", "lang")
    table, schema = work_folder(spark, "corpus"), "id string, title string, year int"
    buckets.create(docs.where("lang = 'en'").select("id", "title", "year"), table)
    labelled = docs.join(load_table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    asked = docs.join(load_table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id")), "doc_id", "left_semi")
    buckets.merge(labelled.select("id", F.lit("labelled").alias("title"), (F.col("year") + 1).alias("year")), table, schema, 1)
    buckets.merge(asked.select("id", F.lit("asked").alias("title"), (F.col("year") + 2).alias("year")), table, schema, 2)
    versions = [buckets.read(spark, table, schema, v).withColumn("version", F.lit(v)) for v in range(3)]
    return union_all(versions)


VERSIONS_SQL = """WITH d AS (SELECT 'pmid-' || doc_id AS id, source AS title, CAST(n_chars AS INTEGER) AS year, lang = 'en' AS old, doc_id IN (SELECT doc_id FROM labels) AS labelled,
  doc_id IN (SELECT item_id FROM benchmark) AS asked FROM documents)
SELECT id, title, year, 0 AS version FROM d WHERE old
UNION ALL SELECT id, CASE WHEN labelled THEN 'labelled' ELSE title END, CASE WHEN labelled THEN CAST(year + 1 AS INTEGER) ELSE year END, 1 FROM d WHERE old OR labelled
UNION ALL SELECT id, CASE WHEN asked THEN 'asked' WHEN labelled THEN 'labelled' ELSE title END, CASE WHEN asked THEN CAST(year + 2 AS INTEGER) WHEN labelled THEN CAST(year + 1 AS INTEGER) ELSE year END, 2
FROM d WHERE old OR labelled OR asked"""


UPSERT_SQL = """WITH d AS (SELECT 'pmid-' || doc_id AS id, source AS title, CAST(n_chars AS INTEGER) AS year, lang = 'en' AS old, doc_id IN (SELECT doc_id FROM labels) AS fresh FROM documents)
SELECT id, CASE WHEN fresh THEN 'fresh' ELSE title END AS title, CASE WHEN fresh THEN CAST(year + 1 AS INTEGER) ELSE year END AS year, CASE WHEN old THEN 'kept' END AS pdf_upload_id,
  CASE WHEN old AND fresh THEN 'updated' WHEN fresh THEN 'created' ELSE 'kept' END AS sync_state FROM d WHERE old OR fresh"""


def chunk_upsert(spark, sf):
    """User turns exist; events upload new texts for some keys, the last one wins."""
    turns = load_table(spark, sf, "conversations").where("role = 'user'").select(
        F.col("conv_id").cast("string").alias("chunk_id"), "turn", "text").groupBy("chunk_id").agg(F.min_by("text", "turn").alias("text")).withColumn("related_entity_ids", F.array(F.lit("old")))
    uploads = load_table(spark, sf, "events").where("event_type = 'purchase'").select(
        F.col("user_id").cast("string").alias("chunk_id"), F.col("props").alias("text"), F.when(F.col("value") > 10, F.array(F.lit("e1"))).otherwise(F.array().cast("array<string>")).alias("related_entity_ids"), F.col("event_id").alias("seq"))
    rows = literature.upsert_chunks(turns, uploads)
    return rows.select("chunk_id", F.md5("text").alias("text_md5"), F.array_join("related_entity_ids", ",").alias("entities"))


CHUNK_UPSERT_SQL = """WITH old AS (SELECT CAST(conv_id AS VARCHAR) AS chunk_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY 1),
up AS (SELECT CAST(user_id AS VARCHAR) AS chunk_id, arg_max(props, event_id) AS text, arg_max(value > 10, event_id) AS rich FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT chunk_id, md5(text) AS text_md5, 'old' AS entities FROM old ANTI JOIN up USING (chunk_id) UNION ALL SELECT chunk_id, md5(text), CASE WHEN rich THEN 'e1' ELSE 'disease:atopic-dermatitis' END FROM up"""


def parse_status_updates(spark, sf):
    """Events as status updates of customers' uploads."""
    items = load_table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_acctbal") > 1000, F.concat(F.lit("up-"), "c_mktsegment")).alias("pdf_upload_id"), F.lit("f.pdf").alias("pdf_file_name"),
        F.lit("pending").alias("pdf_parse_status"), F.lit(None).cast("string").alias("last_parse_trigger"), F.lit(0).alias("parse_attempt_count"))
    updates = load_table(spark, sf, "events").select(
        (F.col("user_id") * 11).cast("string").alias("id"), F.when(F.col("event_type") == "click", "up-BUILDING").alias("expected_pdf_upload_id"), F.lit(None).cast("string").alias("expected_file_name"),
        F.when(F.col("value") > 30, "failed").otherwise("parsed").alias("pdf_parse_status"), F.col("event_type").alias("trigger"), F.col("event_id").alias("seq"))
    states = literature.parse_status_states(items, updates).groupBy("state").agg(F.count("*").alias("n"))
    after = literature.apply_parse_status(items, updates).groupBy(F.concat(F.lit("after "), "pdf_parse_status").alias("state")).agg(F.sum("parse_attempt_count").alias("n"))
    return states.unionByName(after)


STATUS_SQL = """WITH i AS (SELECT c_custkey AS id, CASE WHEN c_acctbal > 1000 THEN 'up-' || c_mktsegment END AS up FROM customer),
s AS (SELECT e.*, i.id AS hit, CASE WHEN i.id IS NULL THEN 'not_found' WHEN up IS NULL THEN 'missing_metadata' WHEN event_type = 'click' AND up <> 'up-BUILDING' THEN 'conflict' ELSE 'ok' END AS state
  FROM events e LEFT JOIN i ON i.id = e.user_id * 11),
o AS (SELECT hit AS id, arg_max(CASE WHEN value > 30 THEN 'failed' ELSE 'parsed' END, event_id) AS st, count(*) AS n FROM s WHERE state = 'ok' GROUP BY 1)
SELECT state, count(*) AS n FROM s GROUP BY 1 UNION ALL SELECT 'after ' || coalesce(st, 'pending'), CAST(sum(coalesce(n, 0)) AS BIGINT) FROM i LEFT JOIN o USING (id) GROUP BY 1"""


def sealed_snapshots(spark, sf):
    """Pages as raw artifacts sealed per page; every third was sealed before, some differently."""
    pages = load_table(spark, sf, "pages")
    manifest = F.concat(F.lit('{"a":"'), F.col("page_id").cast("string"), F.lit('"}'))
    manifests = pages.select(
        F.col("page_id").alias("accession"), manifest.alias("manifest"), (F.octet_length("html") + F.when(F.col("page_id") % 10 == 4, 1).otherwise(0)).alias("size_bytes"),
        F.lit(False).alias("declares_annotation"), F.lit(None).cast("int").alias("annotation_size"))
    bytes_ = pages.select(F.col("page_id").alias("accession"), F.encode("html", "UTF-8").alias("content"))
    candidates = omics.snapshot_candidates(manifests, bytes_)
    before = candidates.where("accession % 3 = 0").select("accession", F.when(F.col("accession") % 2 == 0, F.lit("omics-snapshot-x")).otherwise(F.col("snapshot_id")).alias("snapshot_id"))
    return omics.seal_states(candidates, before).select("accession", "artifact_sha256", "snapshot_id", "problem", "state")


SEALED_SQL = """WITH s AS (SELECT page_id AS accession, sha256(html) AS artifact_sha256, 'omics-snapshot-' || sha256('{"client_manifest":{"a":"' || page_id || '"},"platform_annotation_sha256":null,"raw_artifact_sha256":"' || sha256(html) || '"}') AS snapshot_id FROM pages)
SELECT *, CASE WHEN accession % 10 = 4 THEN 'artifact_size_mismatch' END AS problem, CASE WHEN accession % 10 = 4 THEN 'rejected' WHEN accession % 3 <> 0 THEN 'created' WHEN accession % 2 = 0 THEN 'conflict' ELSE 'existing' END AS state FROM s"""


def snapshot_store_issues(spark, sf):
    pages = load_table(spark, sf, "pages")
    manifests = pages.select(F.col("page_id").alias("accession"), F.concat(F.lit('{"a":'), F.col("page_id").cast("string"), F.lit("}")).alias("manifest"), F.octet_length("html").alias("size_bytes"), F.lit(False).alias("declares_annotation"), F.lit(None).cast("int").alias("annotation_size"))
    bytes_ = pages.select(F.col("page_id").alias("accession"), F.encode("html", "UTF-8").alias("content"))
    sealed = omics.snapshot_candidates(manifests, bytes_).withColumn("manifest", F.when(F.col("accession") % 10 == 1, F.lit('{"a":0}')).otherwise(F.col("manifest")))
    now = bytes_.where("accession % 10 <> 2").withColumn("content", F.when(F.col("accession") % 10 == 3, F.encode(F.lit("x"), "UTF-8")).otherwise(F.col("content")))
    return omics.store_issues(sealed, now).groupBy("rule").agg(F.count("*").alias("n"))


STORE_SQL = """SELECT rule, count(*) AS n FROM (SELECT CASE page_id % 10 WHEN 1 THEN 'snapshot_id_mismatch' WHEN 2 THEN 'artifact_missing' WHEN 3 THEN 'artifact_hash_mismatch' END AS rule FROM pages) WHERE rule IS NOT NULL GROUP BY 1"""


def _written_lines(spark, rows):
    """(dataset, line_no, line) as text files, one per dataset, read back by the splitting reader."""
    folder = work_folder(spark, "lines")
    ordered = rows.withColumnRenamed("dataset", "of").repartition("of").sortWithinPartitions("of", "line_no")
    ordered.select("of", F.col("line").alias("value")).write.partitionBy("of").text(folder)
    return omics.read_lines(spark, folder).withColumn("dataset", F.regexp_extract("dataset", "of=([^/]*)/", 1))


def _matrix_lines(spark, sf):
    """Orders as expression matrices of fifty datasets: each order a probe of two samples, text before and after the table; every
    dataset of a multiple of ten lacks the begin marker, every fiftieth order has a cell that is no number."""
    orders = load_table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("dataset"), "o_orderkey", "o_totalprice")
    price = F.when(F.col("o_orderkey") % 50 == 7, F.lit("n/a")).otherwise(F.col("o_orderkey").cast("string"))
    probe = F.concat(F.lit("p"), (F.col("o_orderkey") % 1000).cast("string"))
    late = F.col("o_orderkey") % 4 == 3  # after the end marker
    body = orders.select("dataset", (F.col("o_orderkey") + F.when(late, 1 << 40).otherwise(10)).alias("line_no"), F.concat_ws("\t", probe, price, F.lit("1.5")).alias("line"))
    frame = [(0, "!Sample_characteristics_ch1\tcondition:AL\tcondition:normal"), (1, "loose\ttext"), (2, "!series_matrix_table_begin"), (3, "\"ID_REF\"\ta\tb"),
             (4, ""), (1 << 39, "!series_matrix_table_end")]
    marks = orders.select("dataset").distinct().select("dataset", F.explode(F.array(*[F.struct(F.lit(n).cast("long").alias("line_no"), F.lit(t).alias("line")) for n, t in frame])).alias("m"))
    marks = marks.select("dataset", "m.line_no", "m.line").where("not (dataset % 10 = 0 and line_no = 2)")
    return _written_lines(spark, body.unionByName(marks))


def matrix_violations(spark, sf):
    return omics.matrix_violations(_matrix_lines(spark, sf)).groupBy("dataset", "rule").agg(F.count("*").alias("n"), F.max("detail").alias("detail"))


def matrix_values(spark, sf):
    values = omics.expression_values(_matrix_lines(spark, sf))
    return values.groupBy("dataset", "sample_idx").agg(F.count("*").alias("n"), F.count("value").alias("n_numbers"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))


_MATRIX_SQL = """WITH o AS (SELECT o_custkey % 50 AS d, o_orderkey AS k, 'p' || o_orderkey % 1000 AS probe FROM orders WHERE o_orderkey % 4 <> 3 AND o_custkey % 50 % 10 <> 0),
alld AS (SELECT DISTINCT o_custkey % 50 AS d FROM orders)"""

MATRIX_RULES_SQL = f"""{_MATRIX_SQL}
SELECT CAST(d AS VARCHAR) AS dataset, rule, count(*) AS n, max(detail) AS detail FROM (
  SELECT d, 'non_numeric_value' AS rule, probe AS detail FROM o WHERE k % 50 = 7
  UNION ALL SELECT d, 'no_expression_rows', '' FROM alld WHERE d NOT IN (SELECT d FROM o)) GROUP BY ALL"""

MATRIX_VALUES_SQL = f"""{_MATRIX_SQL}, last AS (SELECT d, probe, max(k) AS k FROM o GROUP BY ALL)
SELECT CAST(d AS VARCHAR) AS dataset, CAST(0 AS INTEGER) AS sample_idx, count(*) AS n, count(*) FILTER (k % 50 <> 7) AS n_numbers,
  sum(CASE WHEN k % 50 <> 7 THEN CAST(k AS DECIMAL(18,2)) END) AS total FROM last GROUP BY d
UNION ALL SELECT CAST(d AS VARCHAR), 1, count(*), count(*), sum(CAST(1.5 AS DECIMAL(18,2))) FROM last GROUP BY d"""


def annotation_symbols(spark, sf):
    """Parts as platform annotations per size: type as symbol with an alternative, blanks for every seventh part, loose lines outside the markers."""
    parts = load_table(spark, sf, "part").select(F.col("p_size").alias("dataset"), "p_partkey", "p_type")
    symbol = F.when(F.col("p_partkey") % 7 == 0, F.lit("  ")).otherwise(F.concat("p_type", F.lit(" /// other")))
    body = parts.select("dataset", (F.col("p_partkey") + 10).alias("line_no"), F.concat_ws("\t", (F.col("p_partkey") % 300).cast("string"), F.lit("x"), symbol).alias("line"))
    frame = [(0, "^Annotation"), (1, "loose\tx\tSYM"), (2, "!platform_table_begin"), (3, "ID\tx\tGene symbol"), (1 << 39, "!platform_table_end"), (1 << 40, "late\tx\tSYM")]
    marks = parts.select("dataset").distinct().select("dataset", F.explode(F.array(*[F.struct(F.lit(n).cast("long").alias("line_no"), F.lit(t).alias("line")) for n, t in frame])).alias("m"))
    return omics.annotation_symbols(_written_lines(spark, body.unionByName(marks.select("dataset", "m.line_no", "m.line"))))


ANNOTATION_SQL = """SELECT CAST(p_size AS VARCHAR) AS dataset, CAST(p_partkey % 300 AS VARCHAR) AS probe, max_by(p_type, p_partkey) AS symbol
FROM part WHERE p_partkey % 7 <> 0 GROUP BY ALL"""


# --- documents --------------------------------------------------------------------------------------


def transcript_documents(spark, sf):
    """Conversations rendered as line-table documents with table cells and percentages."""
    turns = load_table(spark, sf, "conversations")
    heads = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    lines = documents.fixed_lines(heads, "conv_id", 1, 0, ["# Transcript", ""]).unionByName(
        documents.field_lines(heads, "conv_id", 1, [("turns", F.col("n")), ("empty", F.lit(None).cast("string"))])).unionByName(
        documents.row_lines(turns, "conv_id", 2, [documents.padded(F.col("turn"))], documents.table_row(F.col("role"), F.col("turn"), documents.percent(F.col("turn") / 8))))
    return documents.render(lines).select("doc_id", F.md5("text").alias("text_md5"), "n_lines")


TRANSCRIPT_SQL = """WITH b AS (SELECT conv_id, count(*) AS n, string_agg('| ' || role || ' | ' || turn || ' | ' || CAST(round(turn / 8 * 100) AS INTEGER) || '% |', chr(10) ORDER BY turn) AS t FROM conversations GROUP BY 1)
SELECT CAST(conv_id AS VARCHAR) AS doc_id, md5('# Transcript' || chr(10) || chr(10) || '- turns：' || n || chr(10) || '- empty：无' || chr(10) || t) AS text_md5, n + 4 AS n_lines FROM b"""


def network_reports(spark, sf):
    """Full report per task from decisions, gate, lineage and chains."""
    rows, events, inter = rq.lineage_rows(spark, sf), rq.decisions(spark, sf), rq.intersections(spark, sf)
    gate = materialize(rq.review.assembly_gate(rq.tasks(spark, sf), rows, events, inter))
    counts = rows.groupBy("task_id").agg(*[F.count_if(F.col("set_kind") == k).alias(f"{k}_target_count") for k in ("disease", "compound", "intersection")])
    tasks = rq.tasks(spark, sf).join(gate, "task_id").join(counts, "task_id").select(
        "task_id", F.col("owner_id").alias("query"), F.lit("herb").alias("analysis_type"), F.when(F.col("has_compound_import"), "live").otherwise("mock").alias("data_mode"),
        F.col("state").alias("gate_state"), "blockers", F.array(F.lit(lineage.REASONS["edges"])).alias("blocking_reasons"), "disease_target_count", "compound_target_count", "intersection_target_count")
    lin = rows.select("task_id", "set_kind", "lineage_row_id", "canonical_symbol", F.lit("ChEMBL").alias("source_database"), F.lit(0.5).alias("source_score"), F.array("lineage_row_id").alias("source_record_ids"))
    latest = materialize(rq.review.latest_decisions(events, rows))
    customers = load_table(spark, sf, "customer")
    chains = customers.select(
        rq._task("c_custkey").alias("task_id"), F.col("c_custkey").alias("chain_no"), F.lit(None).cast("string").alias("formula"), F.col("c_mktsegment").alias("herb"), F.col("c_name").alias("compound"),
        F.lit("T").alias("target"), F.lit("P").alias("pathway"), F.lit("AD").alias("disease"), F.least(F.lit(1.0), F.abs("c_acctbal") / 10000).alias("score"))
    levels = tasks.select("task_id", F.lit(0).alias("level_no"), F.lit("predicted").alias("evidence_level"), F.lit(10).alias("n"))
    sources = customers.select(rq._task("c_custkey").alias("task_id"), F.col("c_custkey").alias("ord"), F.col("c_mktsegment").alias("name"), F.col("c_name").alias("source_record_id"), F.lit("k").alias("cache_key"))
    steps = customers.groupBy(rq._task("c_custkey").alias("task_id"), F.col("c_mktsegment").alias("step")).agg(F.count("*").alias("duration_ms")).select("*", F.lit("completed").alias("status"), F.lit(1).alias("external_request_count"), F.lit(0).alias("cache_hit_count"))
    terms = customers.select(
        rq._task("c_custkey").alias("task_id"), F.col("c_custkey").alias("combined_rank"), F.col("c_name").alias("term_id"), F.lit("GO").alias("collection"), F.lit(2).alias("overlap_count"), F.lit(9).alias("gene_count"),
        F.lit(0.001).alias("p_value"), F.lit(0.01).alias("adjusted_p_value"))
    summary = materialize(rq.review.adjudication_summary(events, rows))
    return documents.render(documents.network_report_lines(tasks, lin, inter, summary, latest, sources, steps, chains, levels, terms))


def reviewer_packets(spark, sf):
    """Conversations as captured answers, assistant turns as claims."""
    from evidra.operators import evaluation
    from evidra.plans.shapes import conversation_chunks

    turns = load_table(spark, sf, "conversations")
    questions = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"), F.max_by("text", "turn").alias("answer"), F.count("*").alias("n")).select(
        F.col("conv_id").cast("string").alias("question_id"), "question", "answer", F.when(F.col("n") % 4 == 3, "blocked").otherwise("passed").alias("grounding_status"))
    passed, _ = documents.selected_questions(questions)
    claims = _turn_claims(spark, sf)
    cited = evaluation.enrich_claims(claims, conversation_chunks(spark, sf)).join(claims.select("claim_id", F.col("answer_id").cast("string").alias("question_id"), "claim_no"), "claim_id")
    lines = documents.reviewer_packet_lines(passed, claims.select(F.col("answer_id").cast("string").alias("question_id"), "claim_no", "text", "evidence_refs"), cited)
    return documents.render(lines)


def answer_briefs(spark, sf):
    """Briefs of all conversations: questions, answers, claims and user turns as citations."""
    turns = load_table(spark, sf, "conversations")
    heads = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"), F.max_by("text", "turn").alias("answer"), F.count("*").alias("available_citation_count")).select(
        F.col("conv_id").alias("query_id"), "question", "answer", F.lit("all").alias("source"), F.lit("keyword").alias("strategy"), "available_citation_count", F.lit("passed").alias("status"), F.lit(None).cast("string").alias("reason"))
    cards = turns.where("role = 'user'").select(
        F.col("conv_id").alias("query_id"), F.col("turn").alias("position"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("role").alias("source"), F.col("turn").cast("string").alias("literature_id"),
        F.lit(None).cast("string").alias("chunk_id"), F.col("text").alias("snippet"), F.lit(None).cast("string").alias("quote"), F.col("role").alias("reason"), F.lit(0.5).alias("match_score"), F.lit(0.74).alias("confidence"))
    claims = _turn_claims(spark, sf).select(F.col("answer_id").alias("query_id"), "claim_no", "text", "evidence_refs", F.lit(None).cast("double").alias("semantic_score"), F.lit(0.9).alias("entailment_score"))
    return documents.render(documents.answer_brief_lines(heads, cards, claims))


def _quoted_sql(text: str) -> str:
    filled = _redacted_sql(f"coalesce({text}, 'null')")
    return f"'> ' || regexp_replace({filled}, '\\r?\\n', chr(10) || '> ', 'g')"


PACKET_SQL = f"""WITH {_CLAIMS_SQL},
q AS (SELECT answer_id, question, answer FROM (SELECT conv_id AS answer_id, arg_min(text, turn) AS question, arg_max(text, turn) AS answer, count(*) AS n FROM conversations GROUP BY 1) WHERE n % 4 <> 3),
mine AS (SELECT * FROM claims SEMI JOIN q USING (answer_id)),
cited AS (SELECT answer_id, claim_no, i, ref, text FROM (SELECT answer_id, claim_no, generate_subscripts(refs, 1) AS i, unnest(refs) AS ref FROM mine) LEFT JOIN (SELECT id, text FROM tid) ON id = ref),
lines AS (
  SELECT answer_id, 1 AS section, claim_no AS a, 0 AS b, '- WARNING: ' || {_redacted_sql("answer_id || ' claim has ' || len(refs) || ' evidence refs (claim ' || claim_no || '); expected exactly 1.'")} AS line FROM mine WHERE len(refs) <> 1
  UNION ALL SELECT answer_id, 2, 0, 0, '## ' || answer_id || chr(10) || chr(10) || '- Question: ' || {_redacted_sql("question")} || chr(10) || chr(10) || {_quoted_sql("answer")} FROM q
  UNION ALL SELECT answer_id, 3, claim_no, 0, '### Claim ' || claim_no || chr(10) || chr(10) || {_quoted_sql("text")} || chr(10) || chr(10) || '- Evidence refs: `'
    || {_redacted_sql("CASE WHEN len(refs) > 0 THEN array_to_string(refs, ', ') ELSE 'none' END")} || '`' || chr(10) || '- Reviewer verdict: `[ ] supported` / `[ ] unsupported` / `[ ] unclear`' || chr(10) FROM mine
  UNION ALL SELECT answer_id, 3, claim_no, i, '- Chunk: `' || {_redacted_sql("ref")} || '`' || chr(10) || chr(10) || {_quoted_sql("coalesce(text, 'CHUNK_NOT_FOUND')")} || chr(10) FROM cited)
SELECT CAST(answer_id AS VARCHAR) AS doc_id, string_agg(line, chr(10) ORDER BY section, a, b, line) AS text, count(*) AS n_lines FROM lines GROUP BY 1"""

BRIEF_SQL = f"""WITH {_CLAIMS_SQL},
h AS (SELECT conv_id, arg_min(text, turn) AS question, arg_max(text, turn) AS answer, count(*) AS n FROM conversations GROUP BY 1),
c AS (SELECT answer_id AS conv_id, count(*) AS n_claims, string_agg('### Claim ' || (claim_no + 1) || chr(10) || chr(10) || text || chr(10) || chr(10) || 'evidence_refs：'
  || CASE WHEN len(refs) > 0 THEN array_to_string(refs, '、') ELSE '无' END || chr(10) || 'semantic_score：未计算' || chr(10) || 'entailment_score：90%' || chr(10) || chr(10), '' ORDER BY claim_no) AS body FROM claims GROUP BY 1),
k AS (SELECT conv_id, count(*) AS n_cards, string_agg('### 引用 ' || turn || ' — ' || split_part(text, chr(10), 1) || chr(10) || '来源：user · literature_id：' || turn || ' · 检索匹配度：50% · 来源类型先验：74%'
  || chr(10) || chr(10) || '> ' || text || chr(10) || chr(10) || '命中证据标签：user' || chr(10) || chr(10), '' ORDER BY turn) AS body FROM conversations WHERE role = 'user' GROUP BY 1)
SELECT CAST(conv_id AS VARCHAR) AS doc_id, 31 + coalesce(n_claims, 0) + coalesce(n_cards, 0) AS n_lines, replace('# 答案导出||## 证据简报||- 证据范围：all|- 检索策略：keyword|- 可用引用数：' || n
  || '|- Grounding 状态：passed|- 拦截原因：无||## 问题||', '|', chr(10)) || question || replace('||## 回答||', '|', chr(10)) || answer || replace('||## 结构化声明||', '|', chr(10))
  || coalesce(c.body, '') || replace('|## 引用证据||', '|', chr(10)) || coalesce(k.body, '')
  || replace('## Reviewer 核对清单||- [ ] 已核对免责声明：非诊断结论、需结合临床。|- [ ] 已逐条打开引用文献详情或原文 PDF||---||非诊断结论、需结合临床。', '|', chr(10)) AS text
FROM h LEFT JOIN c USING (conv_id) LEFT JOIN k USING (conv_id)"""


def answer_costs(spark, sf):
    docs = load_table(spark, sf, "documents")
    tokens_in = F.when(F.col("lang") != "fr", F.col("n_chars"))
    return docs.select("doc_id", answers.estimated_cost(tokens_in, F.when(F.col("lang") == "en", F.lit(500)), 3.0, 15.0).alias("cost"))


def lineage_audit(spark, sf):
    """Stored lineage of every nation with planted edits."""
    customers = load_table(spark, sf, "customer")
    side = F.when(F.col("c_acctbal") > 4000, "disease").otherwise("compound")
    rows = lineage.with_row_ids(customers.select(
        F.col("c_nationkey").alias("task_id"), side.alias("set_kind"), F.col("c_name").alias("raw_identifier"), F.concat(F.col("c_mktsegment"), F.floor(F.col("c_acctbal") / 1000).cast("string")).alias("canonical_symbol"),
        F.lit("db").alias("source_database"), F.abs("c_acctbal").alias("source_score"), F.lit(100.0).alias("applied_threshold"), F.array("c_name").alias("source_record_ids"), F.col("c_custkey")))
    rows = rows.withColumn("lineage_row_id", F.when(F.col("c_custkey") % 50 == 7, F.concat("lineage_row_id", F.lit("x"))).otherwise(F.col("lineage_row_id"))).withColumn(
        "adjudication_status", F.when(F.col("c_custkey") % 60 == 9, "done").otherwise("pending")).withColumn("decision", F.lit("unreviewed"))
    disease, compound = rows.where("set_kind = 'disease'"), rows.where("set_kind = 'compound'")
    inter = lineage.intersections(disease, compound).select(
        "*", F.lit("canonical_symbol_exact_match_v1").alias("derivation"), F.lit("derived").alias("automatic_status"), F.lit("pending").alias("adjudication_status"), F.lit("unreviewed").alias("decision"))
    nations = load_table(spark, sf, "nation").select(F.col("n_nationkey").alias("task_id"), "n_regionkey")
    shared = lineage.shared_symbols(disease, compound)
    declared = lineage.lineage_counts(nations, disease, compound, shared).select("task_id", *[(F.col(f"{s}_target_count") + F.when(F.col("task_id") == 3, 1).otherwise(0)).alias(f"{s}_target_count") for s in ("disease", "compound", "intersection")])
    protocols = nations.select("task_id", F.when(F.col("n_regionkey") == 2, "Mus musculus").otherwise("Homo sapiens").alias("species"), F.lit("2024-01-01").alias("query_date"), F.lit("adult eczema").alias("phenotype"), F.to_date(F.lit("2024-06-01")).alias("as_of"))
    provenance = rows.groupBy("task_id", "set_kind").agg(F.count("*").alias("record_count")).select(
        "task_id", "set_kind", "record_count", F.lit("server_verified_raw_artifact").alias("verification_status"), F.sha2(F.lit("a"), 256).alias("source_artifact_sha256"),
        F.when(F.col("task_id") == 5, F.sha2(F.lit("b"), 256)).otherwise(F.sha2(F.lit("a"), 256)).alias("artifact_sha256_now"), F.when(F.col("task_id") == 6, "other").otherwise("db").alias("source_database"))
    ready = nations.select("task_id", (F.col("task_id") == 8).alias("formal_network_ready"), F.array(F.lit("x")).alias("blocking_reasons"))
    issues = audits.lineage_issues(rows, inter, declared, protocols, provenance, ready)
    return issues.groupBy("rule").agg(F.count("*").alias("n"))


LINEAGE_AUDIT_SQL = """WITH r AS (SELECT *, c_acctbal > 4000 AS dis FROM customer),
v AS (SELECT unnest(['row_id_missing', 'row_id_mismatch']) AS rule FROM r WHERE c_custkey % 50 = 7 UNION ALL SELECT 'row_not_pending' FROM r WHERE c_custkey % 60 = 9
  UNION ALL SELECT 'below_threshold' FROM r WHERE abs(c_acctbal) < 100 UNION ALL SELECT unnest(['disease_count_mismatch', 'compound_count_mismatch', 'intersection_count_mismatch'])
  UNION ALL SELECT 'protocol_species' FROM nation WHERE n_regionkey = 2 UNION ALL SELECT DISTINCT 'provenance_artifact_bytes' || CASE WHEN dis THEN '' ELSE '' END FROM r WHERE c_nationkey = 5 AND dis
  UNION ALL SELECT DISTINCT 'provenance_artifact_bytes' FROM r WHERE c_nationkey = 5 AND NOT dis UNION ALL SELECT 'row_source_database_differs' FROM r WHERE c_nationkey = 6 UNION ALL SELECT 'formal_ready_too_early')
SELECT rule, count(*) AS n FROM v GROUP BY 1"""


QUERIES = {
    "association_records": (
        association_records,
        f"""WITH {_ASSOC_SQL} SELECT l_orderkey AS artifact_id, count(*) AS n, round(sum(l_discount), 6) AS score, min('D1:ENSG' || l_partkey || ':genetic') AS first_record, min('S' || l_partkey) AS first_symbol
        FROM lineitem JOIN bad ON id = l_orderkey WHERE NOT broken AND id % 10 NOT IN (3, 7) AND blank = 0 AND low = 0 GROUP BY 1""",
    ),
    "large_artifacts": (
        large_artifacts,
        """SELECT l_suppkey AS artifact_id, count(*) AS n, min('D1:ENSG' || l_partkey || ':genetic') AS first_record, CAST(count(*) - 1 AS INTEGER) AS last_row
        FROM lineitem WHERE l_suppkey % 10 NOT IN (3, 7, 9) GROUP BY 1 HAVING count(*) FILTER (l_suppkey % 10 = 5 AND l_tax > 0.075) = 0""",
    ),
    "association_violations": (
        association_violations,
        f"""WITH {_ASSOC_SQL}, v AS (SELECT id, 'invalid_json' AS rule FROM bad WHERE broken UNION ALL SELECT id, 'count_mismatch' FROM bad WHERE id % 10 = 3 UNION ALL SELECT id, 'query_mismatch' FROM bad WHERE id % 10 = 7
        UNION ALL SELECT l_orderkey, 'symbol_empty' FROM lineitem WHERE l_tax > 0.075 AND l_orderkey % 10 <> 9 UNION ALL SELECT l_orderkey, 'below_threshold' FROM lineitem WHERE l_discount < 0.01 AND l_orderkey % 10 <> 9)
        SELECT rule, count(*) AS n, count(DISTINCT id) AS n_artifacts FROM v GROUP BY 1""",
    ),
    "activity_violations": (activity_violations, ACTIVITY_SQL),
    "trusted_artifacts": (
        trusted_artifacts,
        "SELECT page_id AS artifact_id, sha256(html) AS sha256, CASE WHEN page_id % 5 = 2 THEN 'unregistered' WHEN page_id % 7 = 1 THEN 'metadata_mismatch' ELSE 'trusted' END AS state FROM pages",
    ),
    "interaction_edges": (
        interaction_edges,
        """WITH e AS (SELECT CASE WHEN l_returnflag = 'A' THEN 'P' || l_partkey WHEN l_returnflag <> 'N' THEN '9606.' || l_partkey END AS source, 'Q' || l_suppkey AS target, CASE WHEN l_tax > 0.01 THEN l_discount ELSE 0.0 END AS score FROM lineitem)
        SELECT source, target, score::DOUBLE AS score, 'STRING:' || source || '-' || target AS source_record_id FROM e WHERE source IS NOT NULL""",
    ),
    "pathway_parsing": (
        pathway_parsing,
        """SELECT p_brand AS pathway_id, coalesce(arg_max(p_type || ' set', p_partkey) FILTER (p_size < 40), p_brand) AS name, md5(string_agg(p_partkey, ',' ORDER BY p_partkey)) AS genes_md5, 'path:' || p_brand AS source_record_id FROM part GROUP BY p_brand""",
    ),
    "first_gene_ids": (first_gene_ids, "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'hsa:77' ELSE 'hsa:' || o_custkey END AS gene_id FROM orders"),
    "prediction_candidates": (
        prediction_candidates,
        """SELECT CASE WHEN l_returnflag <> 'N' THEN l_returnflag ELSE 'target-prediction-import' END AS source, 'c' || l_suppkey AS compound, count(*) AS n, round(sum(CASE WHEN l_discount > 0.02 THEN l_discount ELSE 0 END), 6) AS score
        FROM lineitem WHERE l_tax > 0 GROUP BY 1, 2""",
    ),
    "lookup_responses": (
        lookup_responses,
        "SELECT s_name AS compound, CASE WHEN s_acctbal > 0 THEN CAST(s_suppkey AS VARCHAR) END AS pubchem_cid, CASE WHEN s_acctbal > 0 THEN 'CID:' || s_suppkey END AS source_record_id, 'CHEMBL' || s_suppkey AS molecule_id FROM supplier",
    ),
    "activity_responses": (activity_responses, ACTIVITY_TARGET_SQL),
    "target_normalization": (target_normalization, NORMAL_SQL),
    "landed_network": (landed_network, LANDED_SQL),
    "landed_steps": (landed_steps, LANDED_STEPS_SQL),
    "pending_requests": (pending_requests, PENDING_SQL),
    "page_compounds": (page_compounds, PAGE_SQL),
    "article_records": (article_records, ARTICLE_SQL),
    "text_quality": (text_quality, QUALITY_SQL),
    "text_quality_summary": (
        text_quality_summary,
        """SELECT source, round(avg((length(text) - length(replace(text, chr(0), ''))) / length(text)), 9) AS nul_ratio,
        round(avg((length(text) - length(regexp_replace(text, '[一-鿿]', '', 'g'))) / length(text)), 9) AS cjk_ratio,
        count(*) FILTER (length(text) >= 10 AND length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) / length(text) < 0.2) AS warnings, count(*) AS n_docs FROM documents GROUP BY 1""",
    ),
    "trimmed_pages": (trimmed_pages, TRIM_SQL),
    "preview_windows": (preview_windows, PREVIEW_SQL),
    "redacted_texts": (redacted_texts, REDACTED_SQL),
    "upload_ids": (upload_ids, UPLOAD_SQL),
    "corpus_upsert": (corpus_upsert, UPSERT_SQL),
    "corpus_versions": (corpus_versions, VERSIONS_SQL),
    "chunk_upsert": (chunk_upsert, CHUNK_UPSERT_SQL),
    "parse_status_updates": (parse_status_updates, STATUS_SQL),
    "sealed_snapshots": (sealed_snapshots, SEALED_SQL),
    "snapshot_store_issues": (snapshot_store_issues, STORE_SQL),
    "matrix_violations": (matrix_violations, MATRIX_RULES_SQL),
    "matrix_values": (matrix_values, MATRIX_VALUES_SQL),
    "annotation_symbols": (annotation_symbols, ANNOTATION_SQL),
    "transcript_documents": (transcript_documents, TRANSCRIPT_SQL),
    "network_reports": (network_reports, None),
    "reviewer_packets": (reviewer_packets, PACKET_SQL),
    "answer_briefs": (answer_briefs, BRIEF_SQL),
    "answer_costs": (
        answer_costs,
        "SELECT doc_id, CASE WHEN lang = 'en' THEN round(n_chars / 1e6 * 3.0 + 500 / 1e6 * 15.0, 6) WHEN lang <> 'fr' THEN round(n_chars / 1e6 * 3.0, 6) END AS cost FROM documents",
    ),
    "lineage_audit": (lineage_audit, LINEAGE_AUDIT_SQL),
}
