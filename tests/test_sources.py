import json

from pyspark.sql import functions as F

from evidra.sources import connectors, entities, literature, omics
from tests.conftest import rows


def artifact(rows_, count=None, **extra):
    body = {"data": {"disease": {"id": "D", "name": "AD", "associatedTargets": {"count": len(rows_) if count is None else count, "rows": rows_}}}}
    body.update(extra)
    return json.dumps(body)


def row(symbol="IL6", score=0.9, **extra):
    return {"target": {"id": f"E-{symbol}", "approvedSymbol": symbol}, "score": score, **extra}


def test_associations_accept_or_reject_whole(spark):
    contents = {
        "ok": artifact([row(), row("EGFR", 0.78)]), "count": artifact([row()], count=5), "low": artifact([row(), row("X", 0.1)]), "bool": artifact([row(score=True)]),
        "text": artifact([row(score="0.9")]), "extra": artifact([row(other=1)]), "root": artifact([row()], more=1), "dup": '{"data": 1, "data": 2}', "empty": "  ", "blank": artifact([row("")])}
    df = spark.createDataFrame([(k, v, "D", "AD", "genetic", 0.5) for k, v in contents.items()], "artifact_id string, content string, source_query_id string, source_query_label string, datatype string, applied_threshold double")
    records, violations = connectors.parse_associations(df)
    assert rows(records, "artifact_id", "canonical_symbol", "source_record_id", "source_score") == [("ok", "EGFR", "D:E-EGFR:genetic", 0.78), ("ok", "IL6", "D:E-IL6:genetic", 0.9)]
    got = {}
    for r in violations.collect():
        got.setdefault(r.artifact_id, set()).add(r.rule)
    assert "ok" not in got
    assert got["count"] == {"count_mismatch"} and got["low"] == {"below_threshold"} and got["bool"] == got["text"] == {"score_not_numeric"}
    assert got["extra"] == {"unexpected_row_fields"} and got["root"] == {"unexpected_root_fields"} and got["blank"] == {"symbol_empty"}
    assert got["dup"] == {"invalid_json"} and "empty_artifact" in got["empty"]


def test_activities(spark):
    item = {"activity_id": "1", "molecule_chembl_id": "C", "target_chembl_id": "T", "target_gene_symbol": "IL6", "target_organism": "Homo sapiens", "pchembl_value": 6.4}
    contents = {"ok": [item], "twice": [item, item], "mouse": [{**item, "target_organism": "Mus"}], "gone": [{k: v for k, v in item.items() if k != "pchembl_value"}]}
    df = spark.createDataFrame([(k, json.dumps({"activities": v}), "C", "Homo sapiens", 6.0) for k, v in contents.items()], "artifact_id string, content string, compound_id string, species string, applied_threshold double")
    records, violations = connectors.parse_activities(df)
    assert rows(records, "artifact_id", "raw_identifier", "source_score") == [("ok", "T", 6.4)]
    got = rows(violations.distinct(), "artifact_id", "rule")
    assert ("twice", "activity_id_not_unique") in got and ("mouse", "species_mismatch") in got and ("gone", "unexpected_row_fields") in got


def test_article_xml(spark):
    xml = """<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>039</PMID><Article><ArticleTitle>T <i>it</i> x</ArticleTitle>
    <Abstract><AbstractText Label="AIM">a &lt; b</AbstractText><AbstractText></AbstractText><AbstractText>c</AbstractText></Abstract>
    <AuthorList><Author><LastName>Li</LastName><ForeName>W</ForeName></Author><Author><ForeName>Only</ForeName></Author><Author><CollectiveName>Grp</CollectiveName></Author></AuthorList>
    <Journal><JournalIssue><PubDate><MedlineDate>2019 Jan-Feb</MedlineDate></PubDate></JournalIssue><Title>J</Title></Journal></Article>
    <KeywordList><Keyword>k1</Keyword><Keyword>k1</Keyword><Keyword>k2</Keyword></KeywordList></MedlineCitation>
    <PubmedData><ArticleIdList><ArticleId IdType="pubmed">1</ArticleId><ArticleId IdType="doi">10.1/x</ArticleId></ArticleIdList></PubmedData></PubmedArticle>
    <PubmedArticle><MedlineCitation><PMID>2</PMID><Article><ArticleTitle></ArticleTitle></Article></MedlineCitation></PubmedArticle></PubmedArticleSet>"""
    docs = spark.createDataFrame([(xml,)], "xml string")
    records = literature.parse_articles(literature.split_articles(docs))
    r = records.collect()
    assert len(r) == 1
    r = r[0]
    assert (r.pmid, r.title, r.abstract, r.authors, r.keywords, r.year, r.journal, r.doi) == ("039", "T it x", "AIM: a < b c", ["Li W", "Only", "Grp"], ["k1", "k2"], 2019, "J", "10.1/x")
    item = literature.records_to_items(records).first()
    assert (item.id, item.snippet, item.citation_url) == ("pmid-039", "AIM: a < b c", "https://pubmed.ncbi.nlm.nih.gov/039/")
    ids = literature.search_ids(spark.createDataFrame([("<eSearchResult><IdList><Id>5</Id><Id>4</Id></IdList></eSearchResult>",)], "xml string"))
    assert rows(ids) == [(0, "5"), (1, "4")]


def test_corpus_files_and_upserts(spark, tmp_path):
    (tmp_path / "items.json").write_text(json.dumps([
        {"id": "pmid-1", "title": "old", "source": "PubMed live sync", "year": 2000, "pdf_upload_id": "u1"}, {"id": "cn-1", "title": "seed", "source": "book", "year": 1999}]))
    items = literature.read_items(spark, str(tmp_path / "items.json"))
    assert rows(items, "id", "record_origin") == [("cn-1", "seed_sample"), ("pmid-1", "pubmed_live")]
    incoming = spark.createDataFrame([("pmid-1", "new", 2001), ("pmid-2", "fresh", 2002)], "id string, title string, year int")
    merged = literature.upsert_items(items, incoming)
    assert rows(merged, "id", "title", "pdf_upload_id", "sync_state") == [("cn-1", "seed", None, "kept"), ("pmid-1", "new", "u1", "updated"), ("pmid-2", "fresh", None, "created")]
    assert tuple(literature.sync_counts(merged).first()) == (1, 1)
    (tmp_path / "terms.json").write_text('{"terms": [{"zh": "神经酰胺", "en": ["ceramide"]}, {"en": []}]}')
    assert rows(literature.read_terms(spark, str(tmp_path / "terms.json")), "zh", "en") == [("神经酰胺", ["ceramide"])]
    (tmp_path / "bad.json").write_text("{oops")
    assert literature.read_terms(spark, str(tmp_path / "bad.json")).count() == 0
    assert literature.read_alias_map(spark, str(tmp_path / "bad.json")).count() == 0
    assert entities.read_gene_sets(spark, str(tmp_path / "missing.json")).count() == 0
    uploads = spark.createDataFrame([("cn-1", "u9", "f.pdf", 1)], "id string, pdf_upload_id string, pdf_file_name string, seq int")
    attached = literature.attach_uploads(items, uploads)
    assert rows(attached.where("id = 'cn-1'"), "pdf_upload_id", "pdf_parse_status", "parse_attempt_count") == [("u9", "pending", 0)]
    updates = spark.createDataFrame([("cn-1", "u9", "parsed", "manual", 1), ("cn-1", "uX", "failed", "manual", 2), ("pmid-1", None, "parsed", "manual", 3), ("zz", None, "parsed", "manual", 4)],
                                    "id string, expected_pdf_upload_id string, pdf_parse_status string, trigger string, seq int").withColumn("expected_file_name", F.lit(None).cast("string"))
    assert [r.state for r in literature.parse_status_states(attached, updates).orderBy("seq").collect()] == ["ok", "conflict", "missing_metadata", "not_found"]


def test_page_tables(spark):
    html = "<table><tr><th>MOL ID</th><th>Molecule <b>Name</b></th><th>OB</th></tr><tr><td>M1</td><td>quer&amp;cetin</td><td> 46 </td></tr><tr><td>M2</td><td></td><td>1</td></tr></table>"
    pages = spark.createDataFrame([(1, html), (2, "<p>no table</p>"), (3, "<TR><TD>solo</TD></TR>")], "page_id int, html string")
    got = connectors.compounds_from_pages(pages, F.lit("黄芪")).collect()
    assert sorted((r.page_id, r.name, r.source_record_id) for r in got) == [(1, "quer&cetin", "tcmsp:黄芪:quer&cetin"), (3, "solo", "tcmsp:黄芪:solo")]
    assert [r.properties for r in got if r.page_id == 1] == [{"MOL ID": "M1", "OB": "46"}]


def test_small_parsers(spark, tmp_path):
    (tmp_path / "p.csv").write_text("compound,target_symbol,score,source\nQ,IL6,0.5,\n,TNF,1,SEA\n")
    predictions = connectors.prediction_candidates(connectors.read_predictions(spark, str(tmp_path / "p.csv")))
    assert rows(predictions, "compound", "symbol", "score", "source") == [("Q", "IL6", 0.5, "target-prediction-import")]
    (tmp_path / "n.tsv").write_text("stringId_A\tstringId_B\tpreferredName_A\tpreferredName_B\tscore\n9606.1\t9606.2\tIL6\t\t0.7\n\t9606.2\t\tX\t1\n")
    edges = connectors.interaction_edges(connectors.read_interactions(spark, str(tmp_path / "n.tsv")))
    assert rows(edges, "source", "target", "score") == [("IL6", "9606.2", 0.7)]
    text = spark.createDataFrame([("mmu:1\tx\nhsa:77\ty",), ("none",)], "t string").select(connectors.first_gene_id(F.col("t")).alias("g"))
    assert [r.g for r in text.collect()] == ["hsa:77", None]
    payload = json.dumps({"results": [{"primaryAccession": "P1", "genes": [{"geneName": {"value": "OTHER"}}]}, {"primaryAccession": "P2", "genes": [{"geneName": {"value": "il6"}}]}]})
    found = connectors.normalized_targets(spark.createDataFrame([("IL6", payload), ("ZZ", payload), ("NO", "{}")], "query string, payload string"))
    assert rows(found, "query", "symbol", "accession") == [("IL6", "il6", "P2"), ("ZZ", "OTHER", "P1")]


def test_seal_idempotent_and_conflict(spark, tmp_path):
    manifests = spark.createDataFrame([("G1", '{"a":1}', 3, False, None), ("G2", '{"a":2}', 9, False, None)], "accession string, manifest string, size_bytes int, declares_annotation boolean, annotation_size int")
    raw = spark.createDataFrame([("G1", b"abc"), ("G2", b"abc")], "accession string, content binary")
    sealed = spark.createDataFrame([], "accession string, snapshot_id string")
    first = omics.seal_states(omics.snapshot_candidates(manifests, raw), sealed)
    assert rows(first, "accession", "state") == [("G1", "created"), ("G2", "rejected")]
    omics.append_sealed(first, str(tmp_path / "store"))
    stored = spark.read.parquet(str(tmp_path / "store"))
    assert rows(omics.seal_states(omics.snapshot_candidates(manifests, raw), stored), "accession", "state") == [("G1", "existing"), ("G2", "rejected")]
    other = raw.withColumn("content", F.lit(b"xyz"))
    assert ("G1", "conflict") in rows(omics.seal_states(omics.snapshot_candidates(manifests, other), stored), "accession", "state")
    assert omics.store_issues(stored, raw).count() == 0
    assert rows(omics.store_issues(stored, other), "rule") == [("artifact_hash_mismatch",)]


def test_an_artifact_is_judged_before_its_records_are_taken_apart(spark, monkeypatch):
    ok = {"target": {"id": "E1", "approvedSymbol": "IL6"}, "score": 0.5}
    odd = [ok, ok | {"score": 1}, ok | {"datatypeScores": []}, ok | {"more": 1}, ok | {"score": "0.5"}, ok | {"target": {"id": 5, "approvedSymbol": ""}},
           {"target": {"id": "E1"}, "score": 0.01}, None]
    rules = [[], [], [], ["unexpected_row_fields"], ["score_not_numeric"], ["symbol_empty", "target_id_empty"], ["below_threshold", "symbol_empty", "unexpected_target_fields"],
             ["score_not_numeric", "symbol_empty", "target_id_empty", "unexpected_row_fields", "unexpected_target_fields"]]
    body = lambda *r: json.dumps({"data": {"disease": {"id": "D", "name": "d", "associatedTargets": {"count": len(r), "rows": r}}}})
    table = spark.createDataFrame([(i, body(r), "D", "d", "genetic", 0.1) for i, r in enumerate(odd)] + [(99, body(ok, ok), "D", "other", "genetic", 0.1)],
                                  "artifact_id int, content string, source_query_id string, source_query_label string, datatype string, applied_threshold double")
    monkeypatch.setattr(connectors, "materialize", lambda df: df)
    records, violations = connectors.parse_associations(table)
    found = [(r.artifact_id, r.rule) for r in violations.collect()]
    assert sorted(found) == sorted([(i, n) for i, names in enumerate(rules) for n in names] + [(99, "query_mismatch")])
    assert sorted(r.artifact_id for r in records.collect()) == [0, 1, 2]
    # the rules of an artifact stand below the step that makes rows of its records, so they are not run per record
    above = violations._jdf.queryExecution().optimizedPlan().toString().split("Generate posexplode")[0]
    assert "symbol_empty" in above and "count_mismatch" not in above
