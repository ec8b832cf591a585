"""External database artifacts and landed lookup responses as tables.

Nothing here fetches: raw files and responses are landed by the operator, and parsing marks a
whole artifact rejected (with its violations) rather than loading part of it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.functions.canonical import request_key
from evidra.operators.network import activity_score, dedupe_first
from evidra.session import materialize, union_all


def _kind(v: Column) -> Column:
    """text / number / other, by the variant's own type."""
    schema = F.schema_of_variant(v)
    return (
        F.when(schema == "STRING", F.lit("text"))
        .when(schema.isin("BIGINT", "DOUBLE", "FLOAT") | schema.startswith("DECIMAL"), F.lit("number"))
        .otherwise(F.lit("other"))
    )


def _get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _bad_keys(v: Column, allowed: list[str], required: list[str], path: str = "$") -> Column:
    keys = F.map_keys(_get(v, path, "map<string,variant>"))
    extra = F.size(F.array_except(keys, F.lit(allowed))) > 0
    missing = F.size(F.array_except(F.lit(required), keys)) > 0
    return keys.isNull() | extra | missing


def _rules(checks: list[tuple[str, Column]]) -> Column:
    """Names of the checks that hold. Nulls are left out by set difference: a lambda (``array_compact``) has all checks below it
    interpreted, value by value, and parts that they share computed anew in each."""
    named = F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in checks])
    return F.array_except(named, F.array(F.lit(None).cast("string")))


def _too_many(size: Column, max_records: int | None) -> list[tuple[str, Column]]:
    return [] if max_records is None else [("too_many_rows", size > max_records)]


_NUMBER = r"(BIGINT|DOUBLE|FLOAT|DECIMAL\([0-9]+,\s?[0-9]+\))"


def _judged(
    parsed: DataFrame, header: list[tuple[str, Column]], row_checks: list[tuple[str, Column]], shape: str, values: dict[str, Column], fields: list[Column],
) -> DataFrame:
    """One staged row per record, or per artifact without records: artifact_id, row_no, rules, fields.

    The content is parsed once; rules of the artifact stand at its first record. ``values`` are taken out of a record once, as columns that checks
    and fields read. ``_plain`` marks records whose type as a whole is ``shape``: names and types need no look at each field there. Each step is
    a projection of its own, outside of any condition, so that checks share what they read.
    """
    judged = parsed.withColumn("_header", _rules(header)).drop("doc", "content")  # before its records are taken apart
    rows = judged.select("*", F.posexplode_outer("_items").alias("row_no", "row")).drop("_items")
    rows = rows.select("*", F.coalesce(F.schema_of_variant("row").rlike(shape), F.lit(False)).alias("_plain"), *[c.alias(n) for n, c in values.items()])
    rows = rows.withColumn("_own", _rules(row_checks))
    own = F.when(F.col("row_no").isNotNull(), F.col("_own")).otherwise(F.array().cast("array<string>"))
    rules = F.when(F.coalesce("row_no", F.lit(0)) == 0, F.concat("_header", own)).otherwise(own)
    return materialize(rows.select("artifact_id", "row_no", rules.alias("rules"), *fields))


def _clean(judged: DataFrame, violations: DataFrame) -> DataFrame:
    rows = judged.where("row_no is not null").drop("rules")
    return rows.join(violations.select("artifact_id").distinct(), "artifact_id", "left_anti")


def parse_associations(artifacts: DataFrame, max_records: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Disease association artifacts -> (records of clean artifacts, violations).

    artifacts: artifact_id, content, source_query_id, source_query_label, datatype,
    applied_threshold. Artifacts may be of any size unless the caller sets ``max_records``.
    """
    doc, disease, row, items = F.col("doc"), "$.data.disease", F.col("row"), F.col("_items")
    parsed = artifacts.withColumn("doc", F.try_parse_json("content")).withColumn("_items", _get(doc, f"{disease}.associatedTargets.rows", "array<variant>"))
    header = [
        ("empty_artifact", F.length(F.trim("content")) == 0),
        ("invalid_json", doc.isNull()),
        ("unexpected_root_fields", doc.isNotNull() & _bad_keys(doc, ["data", "extensions"], ["data"])),
        ("unexpected_disease_fields", doc.isNotNull() & _bad_keys(doc, *[["id", "name", "associatedTargets"]] * 2, path=disease)),
        ("query_mismatch", (_get(doc, f"{disease}.id", "string") != F.col("source_query_id"))
         | (_get(doc, f"{disease}.name", "string") != F.col("source_query_label"))),
        ("rows_not_array", doc.isNotNull() & items.isNull()),
        *_too_many(F.size(items), max_records),
        ("count_mismatch", _get(doc, f"{disease}.associatedTargets.count", "int") != F.size(items)),
        ("datatype_missing", F.coalesce("datatype", F.lit("")) == ""),
    ]
    values = {"raw": _get(row, "$.target.id", "string"), "symbol": _get(row, "$.target.approvedSymbol", "string"), "number": _get(row, "$.score", "double")}
    shape = rf"^OBJECT<score: {_NUMBER}, target: OBJECT<approvedSymbol: STRING, id: STRING>>$"
    plain, score = F.col("_plain"), _get(row, "$.score")
    numeric = plain | (_kind(score) == "number")
    blank = lambda path, text: (~plain & (_get(row, path).isNull() | (_kind(_get(row, path)) != "text"))) | (F.coalesce(text, F.lit("")) == "")
    row_checks = [
        ("unexpected_row_fields", ~plain & _bad_keys(row, ["target", "score", "datatypeScores"], ["target", "score"])),
        ("unexpected_target_fields", ~plain & _bad_keys(row, *[["id", "approvedSymbol"]] * 2, path="$.target")),
        ("score_not_numeric", ~plain & (score.isNull() | (_kind(score) != "number"))),
        ("below_threshold", (F.col("number") < F.col("applied_threshold")) & numeric),
        ("target_id_empty", blank("$.target.id", F.col("raw"))),
        ("symbol_empty", blank("$.target.approvedSymbol", F.col("symbol"))),
    ]
    judged = _judged(parsed, header, row_checks, shape, values, [
        F.col("raw").alias("raw_identifier"), F.col("symbol").alias("canonical_symbol"),
        F.concat_ws(":", "source_query_id", "raw", "datatype").alias("source_record_id"), F.col("number").alias("source_score")])
    violations = judged.select("artifact_id", F.explode("rules").alias("rule"))
    return _clean(judged, violations), violations


ACTIVITY_FIELDS = ["activity_id", "molecule_chembl_id", "target_chembl_id", "target_gene_symbol", "target_organism", "pchembl_value"]


def parse_activities(artifacts: DataFrame, max_records: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Compound activity artifacts -> (records of clean artifacts, violations).

    artifacts: artifact_id, content, compound_id, species, applied_threshold
    """
    doc, row, items = F.col("doc"), F.col("row"), F.col("_items")
    parsed = artifacts.withColumn("doc", F.try_parse_json("content")).withColumn("_items", _get(doc, "$.activities", "array<variant>"))
    header = [
        ("empty_artifact", F.length(F.trim("content")) == 0),
        ("invalid_json", doc.isNull()),
        ("unexpected_root_fields", doc.isNotNull() & _bad_keys(doc, ["activities"], ["activities"])),
        ("rows_not_array", doc.isNotNull() & items.isNull()),
        *_too_many(F.size(items), max_records),
    ]
    value = lambda name, kind="string": _get(row, f"$.{name}", kind)
    values = {n: value(n, "double" if n == "pchembl_value" else "string") for n in ACTIVITY_FIELDS}
    shape = f"^OBJECT<{', '.join(f'{n}: {_NUMBER}' if n == 'pchembl_value' else f'{n}: STRING' for n in sorted(ACTIVITY_FIELDS))}>$"
    plain, score = F.col("_plain"), value("pchembl_value", "variant")
    numeric = plain | (_kind(score) == "number")
    empty = lambda name: (~plain & (value(name, "variant").isNull() | (_kind(value(name, "variant")) != "text"))) | (F.coalesce(name, F.lit("")) == "")
    row_checks = [
        ("unexpected_row_fields", ~plain & _bad_keys(row, ACTIVITY_FIELDS, ACTIVITY_FIELDS)),
        ("compound_mismatch", ~F.coalesce("molecule_chembl_id", F.lit("")).eqNullSafe(F.col("compound_id"))),
        ("species_mismatch", ~F.coalesce("target_organism", F.lit("")).eqNullSafe(F.col("species"))),
        ("score_not_numeric", ~plain & (score.isNull() | (_kind(score) != "number"))),
        ("below_threshold", (F.col("pchembl_value") < F.col("applied_threshold")) & numeric),
        ("identifier_empty", empty("activity_id") | empty("target_chembl_id") | empty("target_gene_symbol")),
    ]
    judged = _judged(parsed, header, row_checks, shape, values, [
        F.col("target_chembl_id").alias("raw_identifier"), F.col("target_gene_symbol").alias("canonical_symbol"),
        F.col("activity_id").alias("source_record_id"), F.col("pchembl_value").alias("source_score")])
    counts = judged.where("row_no is not null").groupBy("artifact_id", "source_record_id").agg(F.count("*").alias("n"))
    repeated = counts.where("n > 1").select("artifact_id", F.lit("activity_id_not_unique").alias("rule"))
    violations = union_all([judged.select("artifact_id", F.explode("rules").alias("rule")), repeated])
    return _clean(judged, violations), violations


def trust_states(artifacts: DataFrame, manifest: DataFrame) -> DataFrame:
    """(artifact_id, sha256, state): unregistered hashes and metadata that differs from the
    registered entry. artifacts: artifact_id, content (binary), metadata; manifest: sha256, metadata"""
    hashed = artifacts.select("artifact_id", F.sha2("content", 256).alias("sha256"), "metadata")
    joined = hashed.join(manifest.select("sha256", F.col("metadata").alias("trusted")), "sha256", "left")
    state = (
        F.when(F.col("trusted").isNull(), F.lit("unregistered"))
        .when(F.col("trusted") != F.col("metadata"), F.lit("metadata_mismatch")).otherwise(F.lit("trusted"))
    )
    return joined.select("artifact_id", "sha256", state.alias("state"))


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Raw files with path, bytes and hash."""
    return spark.read.format("binaryFile").load(path).select(
        F.col("path").alias("artifact_id"), "content", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


# --- predictions, interactions, pathways ------------------------------------------------------------


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    fields = "compound string, target_symbol string, score string, source string, source_record_id string, retrieved_at string"
    if path.lower().endswith(".json"):
        return spark.read.schema(fields).option("multiLine", True).json(path)
    header = spark.read.option("header", True).csv(path)  # names by header; all strings
    for name in [f.split()[0] for f in fields.split(", ")]:
        if name not in header.columns:
            header = header.withColumn(name, F.lit(None).cast("string"))
    return header


def prediction_candidates(rows: DataFrame) -> DataFrame:
    """Rows with compound and symbol as predicted target candidates."""
    source = F.when(F.coalesce("source", F.lit("")) != "", F.col("source")).otherwise(F.lit("target-prediction-import"))
    kept = rows.where("compound is not null and compound <> '' and target_symbol is not null and target_symbol <> ''")
    return kept.select(
        "compound", F.col("target_symbol").alias("symbol"), F.lit("predicted").alias("evidence_type"),
        F.coalesce(F.col("score").try_cast("double"), F.lit(0.0)).alias("score"), source.alias("source"), "source_record_id", "retrieved_at",
        *[c for c in ("ord", "task_id") if c in rows.columns])


def prediction_sources(candidates: DataFrame) -> DataFrame:
    """First row per source (candidates carry ``ord``)."""
    return dedupe_first(candidates, ["source"]).select(F.col("source").alias("name"), "source_record_id", "retrieved_at")


def read_interactions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("sep", "\t").csv(path)


def interaction_edges(rows: DataFrame) -> DataFrame:
    """Preferred names, else ids; rows with a blank end drop; missing scores are 0."""
    full = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.col(c))
    end = lambda side: F.coalesce(full(f"preferredName_{side}"), full(f"stringId_{side}"))
    edges = rows.select(end("A").alias("source"), end("B").alias("target"), F.coalesce(F.col("score").try_cast("double"), F.lit(0.0)).alias("score"))
    return edges.where("source is not null and target is not null").withColumn(
        "source_record_id", F.concat(F.lit("STRING:"), "source", F.lit("-"), "target"))


def _after_colon(c: str) -> Column:
    return F.regexp_replace(c, "^[^:]*:", "")


def pathway_links(rows: DataFrame) -> DataFrame:
    """(left, right, ord) link lines -> (gene_id, pathway_id, ord)."""
    return rows.select(_after_colon("left").alias("gene_id"), _after_colon("right").alias("pathway_id"), "ord")


def distinct_pathway_ids(links: DataFrame) -> DataFrame:
    return links.groupBy("pathway_id").agg(F.min("ord").alias("ord"))


def pathways_from_links(links: DataFrame, names: DataFrame) -> DataFrame:
    """Pathways with their genes in link order; names end at `` - ``."""
    listed = names.select(_after_colon("pathway").alias("pathway_id"), F.trim(F.split_part("name", F.lit(" - "), F.lit(1))).alias("name"), "ord")
    last_name = listed.groupBy("pathway_id").agg(F.max_by("name", "ord").alias("name"))
    genes = links.groupBy("pathway_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("ord", "gene_id"))), lambda s: s["gene_id"]).alias("genes"))
    return genes.join(last_name, "pathway_id", "left").select(
        "pathway_id", F.coalesce("name", "pathway_id").alias("name"), "genes", F.concat(F.lit("path:"), "pathway_id").alias("source_record_id"))


def first_gene_id(text: Column) -> Column:
    """First ``hsa:`` id at the start of a line."""
    found = F.regexp_extract(text, "(?m)^(hsa:[^\\t\\r\\n]*)", 1)
    return F.when(found != "", found)


# --- landed lookup responses -----------------------------------------------------------------------


def compound_identities(responses: DataFrame) -> DataFrame:
    """(compound, payload) -> first CID."""
    cid = F.try_variant_get(F.try_parse_json("payload"), "$.IdentifierList.CID[0]", "string")
    return responses.select("compound", cid.alias("pubchem_cid"), F.concat(F.lit("CID:"), cid).alias("source_record_id")).where("pubchem_cid is not null")


def molecule_ids(responses: DataFrame) -> DataFrame:
    found = F.try_variant_get(F.try_parse_json("payload"), "$.molecules[0].molecule_chembl_id", "string")
    return responses.select("compound", found.alias("molecule_id")).where("molecule_id <> ''")


def activity_targets(responses: DataFrame) -> DataFrame:
    """Human activities of (compound, identity_record_id, payload) as known target candidates."""
    items = F.try_variant_get(F.try_parse_json("payload"), "$.activities", "array<variant>")
    rows = responses.select("compound", "identity_record_id", F.posexplode(items).alias("activity_no", "a"))
    value = lambda name: F.when(F.try_variant_get("a", f"$.{name}", "string") != "", F.try_variant_get("a", f"$.{name}", "string"))
    organism = value("target_organism")
    return rows.where(organism.isNull() | (organism == "Homo sapiens")).select(
        "compound", F.coalesce(value("target_pref_name"), value("target_chembl_id")).alias("symbol"),
        F.lit("known_activity").alias("evidence_type"), activity_score(value("pchembl_value")).alias("score"), F.lit("ChEMBL").alias("source"),
        F.coalesce(value("assay_chembl_id"), value("activity_id"), F.col("identity_record_id")).alias("source_record_id"), "activity_no",
    ).where("symbol is not null")


def normalized_targets(responses: DataFrame) -> DataFrame:
    """(query, payload) -> symbol, accession and protein name of the record whose gene symbol
    equals the query, else of the first record."""
    items = F.try_variant_get(F.try_parse_json("payload"), "$.results", "array<variant>")
    rows = responses.select("query", F.posexplode(items).alias("n", "r"))
    gene = F.try_variant_get("r", "$.genes[0].geneName.value", "string")
    fields = F.struct(
        gene.alias("gene"), F.try_variant_get("r", "$.primaryAccession", "string").alias("accession"),
        F.try_variant_get("r", "$.proteinDescription.recommendedName.fullName.value", "string").alias("protein_name"))
    exact = F.coalesce((F.upper(gene) == F.upper("query")).cast("int"), F.lit(0))
    best = rows.groupBy("query").agg(F.min_by(fields, F.struct(-exact, F.col("n"))).alias("b"))
    symbol = F.when(F.coalesce("b.gene", F.lit("")) != "", F.col("b.gene")).otherwise(F.col("query"))
    return best.select("query", symbol.alias("symbol"), "b.accession", "b.protein_name")


def split_requests(requests: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with payload, pending requests); requests: provider, query, params (struct)."""
    keyed = requests.withColumn("cache_key", request_key(F.col("provider"), F.col("query"), F.col("params")))
    hits = keyed.join(responses.select("cache_key", "payload"), "cache_key")
    return hits, keyed.join(responses.select("cache_key"), "cache_key", "left_anti")


# --- compound tables in pages -------------------------------------------------------------------------


@F.pandas_udf(T.StringType())
def _unescape(cells: pd.Series) -> pd.Series:
    import html

    return cells.map(lambda c: None if c is None else html.unescape(c).strip())


def page_rows(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """Table rows of pages: (key, row_no, is_header, cells)."""
    tr = F.regexp_extract_all(column, F.lit("(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    rows = pages.select(key, F.posexplode(tr).alias("row_no", "row"))
    cells = lambda tag: F.regexp_extract_all("row", F.lit(f"(?is)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1))
    clean = lambda cs: F.transform(cs, lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), "(?U)\\s+", " ")))
    heads = cells("th")
    return rows.select(key, "row_no", (F.size(heads) > 0).alias("is_header"), clean(F.when(F.size(heads) > 0, heads).otherwise(cells("td"))).alias("cells"))


def compounds_from_pages(pages: DataFrame, herb: Column, key: str = "page_id") -> DataFrame:
    """Compound rows of the pages' tables under the closest header above them.

    The name column is the first header naming a molecule or compound, or exactly ``name``;
    the other named columns become properties.
    """
    rows = page_rows(pages.withColumn("_herb", herb), key)
    herbs = pages.select(key, herb.alias("herb"))
    # headers are rare: each data row takes the last header position before it
    heads = rows.where("is_header").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("row_no", "cells"))).alias("heads"))
    data = rows.where(~F.col("is_header") & (F.size("cells") > 0)).join(heads, key, "left").join(herbs, key)
    above = F.filter(F.coalesce("heads", F.array().cast("array<struct<row_no:int,cells:array<string>>>")), lambda h: h["row_no"] < F.col("row_no"))
    none = F.array().cast("array<string>")
    data = data.withColumn("headers", F.coalesce(F.try_element_at(above, F.lit(-1))["cells"], none))
    names = F.transform("headers", lambda h: F.contains(F.lower(h), F.lit("molecule")) | F.contains(F.lower(h), F.lit("compound")) | (F.lower(h) == "name"))
    position = F.greatest(F.array_position(names, True), F.lit(1)).cast("int")
    data = data.withColumn("name_at", position)
    name = F.coalesce(F.try_element_at("cells", F.col("name_at")), F.element_at("cells", 1))
    pairs = F.filter(
        F.transform(F.arrays_zip("headers", "cells"), lambda z, i: F.struct(z["headers"].alias("h"), z["cells"].alias("c"), (i + 1).alias("i"))),
        lambda z: z["h"].isNotNull() & (z["h"] != "") & z["c"].isNotNull() & (z["i"] != F.col("name_at")))
    properties = F.map_from_entries(F.transform(pairs, lambda z: F.struct(z["h"], z["c"])))
    out = data.select(key, "row_no", "herb", _unescape(name).alias("name"), properties.alias("properties"))
    return out.where("name <> ''").withColumn("source_record_id", F.concat(F.lit("tcmsp:"), "herb", F.lit(":"), "name"))
