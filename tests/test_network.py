import datetime

from pyspark.sql import functions as F

from evidra.functions.canonical import canonical_json, request_key, upload_id
from evidra.operators import lineage, network
from tests.conftest import rows


def test_evidence_level_truth_table(spark):
    cases = [("mock", "known_activity", True, "mock_inferred"), ("live", "known_activity", False, "experimental"), ("live", "mixed", False, "literature_supported"),
             ("live", "predicted", True, "literature_supported"), ("live", "predicted", False, "predicted")]
    df = spark.createDataFrame(cases, "mode string, kind string, refs boolean, want string")
    assert df.where(network.evidence_level(F.col("mode"), F.col("kind"), F.col("refs")) != F.col("want")).count() == 0


def test_chain_assembly_first_match_and_limit(spark):
    herbs = spark.createDataFrame([("h1", "黄芪", "Huangqi", 0), ("h2", "甘草", "gancao", 1)], "herb_id string, name string, pinyin string, ord int")
    formulas = spark.createDataFrame([("f1", "消风散", "Xiaofengsan", ["h2", "h1"], 0)], "formula_id string, name string, pinyin string, herb_ids array<string>, ord int")
    compounds = spark.createDataFrame([("c1", "Q", ["h1", "h2"])], "compound_id string, name string, herb_ids array<string>")
    targets = spark.createDataFrame([("t1", "IL6")], "target_id string, symbol string")
    pathways = spark.createDataFrame([("p1", "JAK")], "pathway_id string, name string")
    edges = spark.createDataFrame([("c1", "t1", "p1", "AD", 0.5 + i / 10, i) for i in range(4)] + [("cX", "t1", "p1", "AD", 1.0, 9)],
                                  "compound_id string, target_id string, pathway_id string, disease string, score double, ord int")
    queries = spark.createDataFrame([(1, "xiaofengsan", "formula"), (2, "huangqi", "herb"), (3, "none", "herb")], "query_id int, text string, analysis_type string")
    chains = network.assemble_chains(queries, edges, compounds, targets, pathways, herbs, formulas)
    assert [(r.herb, r.formula, round(r.score, 1)) for r in chains.where("query_id = 1").orderBy("rank").collect()] == [
        ("黄芪", "消风散", 0.8), ("甘草", "消风散", 0.8), ("黄芪", "消风散", 0.7), ("甘草", "消风散", 0.7), ("黄芪", "消风散", 0.6)]
    assert chains.where("query_id = 2").count() == 4 and chains.where("query_id = 3").count() == 0
    assert rows(network.herb_names(queries, formulas, herbs)) == [(1, 0, "甘草"), (1, 1, "黄芪"), (2, 0, "黄芪"), (3, 0, "none")]


def test_merge_targets_rules(spark):
    schema = "compound string, symbol string, evidence_type string, score double, source string, source_record_id string, retrieved_at string, ord int"
    df = spark.createDataFrame([
        ("Q", "il6", "known_activity", 0.4, "ChEMBL", "r1", "t1", 0), ("q", "IL6", "predicted", 0.9, "SEA", None, None, 1), ("z", "TNF", "predicted", 0.1, "SEA", "", None, 2)], schema)
    got = {r.symbol: r for r in network.merge_targets(df).collect()}
    assert (got["IL6"].compound, got["IL6"].evidence_type, got["IL6"].score, got["IL6"].source, got["IL6"].source_record_id, got["IL6"].retrieved_at) == (
        "q", "mixed", 0.9, "ChEMBL+SEA", "r1", "t1")
    assert got["TNF"].source_record_id is None
    values = spark.createDataFrame([("7.5",), ("x",), (None,), ("50",), ("-1",)], "v string").select(network.activity_score(F.col("v")).alias("s"))
    assert [r.s for r in values.collect()] == [0.75, 0.5, 0.5, 1.0, 0.0]


def test_lineage_rows_and_intersection_ids(spark):
    schema = "task_id string, target string, score double, evidence_refs array<string>, related_entity_ids array<string>, data_mode string, target_evidence_type string, ord int"
    chains = spark.createDataFrame([
        ("t", " IL6 ", 0.5, ["r1", "r2"], [], "live", "known_activity", 0), ("t", "IL6", 0.7, ["r1"], [], "live", "known_activity", 1),
        ("t", "TNF", 0.2, [], ["herb-1", "target-9"], "live", "predicted", 2), ("t", "", 0.9, [], [], "live", "predicted", 3), ("t", "X", 0.1, [], [], "mock", None, 4)], schema)
    made = lineage.with_row_ids(lineage.rows_from_chains(chains))
    assert rows(made, "canonical_symbol", "source_database", "source_record_ids", "source_score") == [
        ("IL6", "ChEMBL", ["r1"], 0.7), ("IL6", "ChEMBL", ["r2"], 0.5), ("TNF", "network_live_provider", ["target-9"], 0.2), ("X", "sample_network", [], 0.1)]
    assert made.where(~F.col("lineage_row_id").rlike("^compound-[0-9a-f]{64}$")).count() == 0
    disease = spark.createDataFrame([("t", "IL6", "disease-b"), ("t", "IL6", "disease-a"), ("t", "EGFR", "disease-c")], "task_id string, canonical_symbol string, lineage_row_id string")
    inter = lineage.intersections(disease, made).collect()
    assert len(inter) == 1 and inter[0].disease_lineage_row_ids == ["disease-a", "disease-b"] and len(inter[0].compound_lineage_row_ids) == 2
    counts = lineage.lineage_counts(spark.createDataFrame([("t",), ("u",)], "task_id string"), disease, made, lineage.shared_symbols(disease, made))
    assert rows(counts, "task_id", "disease_target_count", "disease_row_count", "intersection_target_count") == [("t", 2, 3, 1), ("u", 0, 0, 0)]


def test_readiness_order(spark):
    schema = ("task_id string, has_protocol boolean, has_lineage boolean, data_mode string, disease_status string, has_compound_import boolean, n_disease int, n_shared int, "
              "compound_without_version int, pending_compound int, pending_disease int, pending_shared int")
    tasks = spark.createDataFrame([("a", True, True, "mock", None, False, 0, 0, 1, 1, 0, 0), ("b", False, True, "live", None, False, 0, 0, 0, 0, 0, 0)], schema)
    got = {r.task_id: r.blocking_reasons for r in lineage.readiness(tasks).collect()}
    r = lineage.REASONS
    assert got["a"] == [r["mock"], r["compound_unfrozen"], r["edges"], r["no_disease"], r["no_version"], r["compound_pending"]]
    assert got["b"] == []


def test_overlay_levels_and_degree(spark):
    chains = spark.createDataFrame([("t", "IL6", "predicted", "live"), ("t", "TNF", "experimental", "live"), ("t", "IL6", "mock_inferred", "mock")], "task_id string, target string, evidence_level string, data_mode string")
    confirmed = spark.createDataFrame([("t", "IL6"), ("t", "TNF")], "task_id string, target string")
    assert [r[0] for r in rows(network.confirmation_overlay(chains, confirmed), "evidence_level")] == ["experimental", "mock_inferred", "omics_validated"]
    tasks = spark.createDataFrame([("t",), ("u",)], "task_id string")
    assert network.level_counts(chains, tasks).count() == 10
    table = spark.createDataFrame([("t", 0, "h", "F", "c", "x", "p", "d"), ("t", 1, "h2", "F", "c", "y", "p", "d")], "task_id string, ord int, herb string, formula string, compound string, target string, pathway string, disease string")
    degree = {r.node: r.degree for r in network.node_degree(network.graph_edges(table)).collect()}
    assert degree == {"F": 2, "c": 4, "x": 2, "y": 2, "p": 4, "d": 2}
    assert rows(network.ego_nodes(network.graph_edges(table), "x")) == [("c",), ("p",), ("x",)]


def test_canonical_json_matches_python(spark):
    import hashlib
    import json

    df = spark.createDataFrame([("é\"", 1e-7, None, [2, 1])], "b string, a double, n string, l array<int>")
    got = df.select(canonical_json(F.struct("b", "a", "n", "l")).alias("j")).first().j
    assert got == json.dumps({"b": "é\"", "a": 1e-7, "n": None, "l": [2, 1]}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    key = spark.range(1).select(request_key(F.lit("KEGG API"), F.lit("IL6"), F.create_map(F.lit("g"), F.lit("IL6"))).alias("k")).first().k
    body = json.dumps({"provider": "KEGG API", "query": "IL6", "params": {"g": "IL6"}, "schema_version": "v1"}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert key == "kegg-api-v1-" + hashlib.sha256(body.encode()).hexdigest()[:24]
    ids = spark.createDataFrame([("cn-1", "My File.pdf"), ("cn-1", "中文.pdf"), ("cn-1", "x" * 120)], "l string, n string").select(upload_id(F.col("l"), F.col("n")).alias("u"))
    got = [r.u for r in ids.collect()]
    assert got[0] == "pdf-cn-1-my-file-pdf"
    assert got[1] == "pdf-cn-1-pdf-" + hashlib.sha1("中文.pdf".encode()).hexdigest()[:8]
    assert got[2] == "pdf-" + hashlib.sha256(json.dumps(["cn-1", "x" * 120]).encode()).hexdigest()


def test_landed_imports_show_types_zones_and_agreement(spark):
    import json

    def body(**change):
        whole = {"applied_threshold": 0.1, "query_date": "2020-01-01", "retrieved_at": "2020-01-01T00:00:00Z", "species": "Homo sapiens", "phenotype": "skin", "disease": "ad",
                 "source_query_parameters": {"q": 1}, "records": [{"raw_identifier": "E1", "canonical_symbol": "IL6", "source_record_id": "r1", "source_score": 0.5}]}
        return json.dumps(whole | change)

    record = {"raw_identifier": "E1", "canonical_symbol": "IL6", "source_record_id": "r1", "source_score": 0.5}
    plan = json.dumps({"disease": "ad", "phenotype": "skin", "species": "Homo sapiens", "query_date": "2020-01-01"})
    compound = {"compound_id": "CHEMBL1", "source_query_id": "CHEMBL1", "applied_threshold": 5, "source_query_parameters": {"assay_organism": "Homo sapiens", "pchembl_value_min": 5.0},
                "records": [{"raw_identifier": "CHEMBL7", "canonical_symbol": "IL6", "source_record_id": "a", "source_score": 6}]}
    cases = [
        ("disease", body(), plan, set()), ("disease", "{", plan, {"body_unreadable"}), ("disease", body(applied_threshold=True), None, {"threshold_not_numeric"}),
        ("disease", body(applied_threshold=1.5), None, {"threshold_out_of_range", "below_threshold"}), ("disease", body(retrieved_at="2020-01-01T00:00:00"), None, {"retrieved_at_without_zone"}),
        ("disease", body(retrieved_at="2025-01-01T01:00:00+02:00"), None, set()), ("disease", body(retrieved_at="2025-01-01T01:00:00-02:00"), None, {"retrieved_at_in_future"}),
        ("disease", body(source_query_parameters={}), None, {"parameters_missing"}), ("disease", body(phenotype="itch", query_date="2020-01-02"), plan, {"protocol_mismatch"}),
        ("disease", body(records=[record | {"source_score": False}]), None, {"score_not_numeric"}), ("disease", body(records=[record, record]), None, {"observation_not_unique"}),
        ("disease", body(records=[record, record | {"canonical_symbol": "TNF"}]), None, {"record_id_ambiguous"}), ("disease", body(records=[]), None, set()),
        ("compound", body(**compound), None, set()), ("compound", body(**compound | {"source_query_id": "X"}), None, {"query_id_mismatch"}),
        ("compound", body(**compound | {"source_query_parameters": {"assay_organism": "Mus", "pchembl_value_min": True}}), None, {"organism_mismatch", "minimum_not_numeric"}),
        ("compound", body(**compound | {"applied_threshold": 5.5}), None, {"minimum_mismatch"}),
        ("compound", body(**compound | {"records": [compound["records"][0], compound["records"][0] | {"raw_identifier": "E2", "source_score": 21}]}), None,
         {"identifier_malformed", "score_out_of_range", "record_id_not_unique"}),
    ]
    table = spark.createDataFrame([(i, k, b, p, datetime.datetime(2025, 1, 1)) for i, (k, b, p, _) in enumerate(cases)],
                                  "import_id int, kind string, body string, protocol string, as_of timestamp")
    found = {i: set() for i in range(len(cases))}
    details = {}
    for r in lineage.landed_import_violations(table).collect():
        found[r.import_id].add(r.rule)
        details[r.import_id, r.rule] = r.detail
    assert [found[i] for i in range(len(cases))] == [want for *_, want in cases]
    assert details[8, "protocol_mismatch"] == "phenotype,query_date"
