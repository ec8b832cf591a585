"""Target lineage: rows per source record, disease and compound intersection, readiness.

Lineage rows carry task_id, set_kind (disease / compound), lineage_row_id, canonical_symbol,
source_database, source_record_ids and the provenance columns of their import.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions.canonical import content_id
from evidra.operators.digests import streamed_sha256
from evidra.session import materialize, union_all

SAMPLE_DATABASE = "sample_network"

# Fields bound into a lineage row's id.
ROW_ID_FIELDS = [
    "set_kind", "source_database", "database_version", "source_query", "query_date", "retrieved_at",
    "species", "source_record_ids", "raw_identifier", "canonical_symbol", "source_score", "score_name",
    "applied_threshold", "threshold_operator", "identifier_mapping", "identifier_mapping_version",
]


def with_row_ids(rows: DataFrame) -> DataFrame:
    """Adds ``lineage_row_id``: set kind and the hash of the row's provenance and content."""
    values = []
    for name in ROW_ID_FIELDS:
        if name not in rows.columns:
            values.append(F.lit(None).cast("string").alias(name))
        elif name == "source_record_ids":
            values.append(F.sort_array(name).alias(name))
        else:
            values.append(F.col(name))
    body = F.struct(*values)
    return rows.withColumn("lineage_row_id", F.concat(F.col("set_kind"), content_id("", body)))


def rows_from_chains(chains: DataFrame) -> DataFrame:
    """Compound rows per (task, symbol, database, record id) with the best score.

    Without references the chain's target entity ids stand in, without those one row with no
    record. chains: task_id, target, score, evidence_refs, related_entity_ids, data_mode,
    target_evidence_type.
    """
    symbol = F.trim("target")
    entity_ids = F.filter("related_entity_ids", lambda i: i.startswith("target-"))
    refs = F.when(F.size("evidence_refs") > 0, F.col("evidence_refs")).otherwise(entity_ids)
    database = (
        F.when(F.col("data_mode") == "mock", F.lit(SAMPLE_DATABASE))
        .when(F.col("target_evidence_type") == "known_activity", F.lit("ChEMBL"))
        .otherwise(F.lit("network_live_provider"))
    )
    origin = F.when(F.col("data_mode") == "mock", F.lit("mock")).otherwise(F.col("target_evidence_type"))
    rows = chains.where(symbol != "").select(
        "task_id", symbol.alias("canonical_symbol"), database.alias("source_database"), origin.alias("origin"),
        F.explode_outer(refs).alias("record_id"), "score", "ord",
    )
    merged = rows.groupBy("task_id", "canonical_symbol", "source_database", F.coalesce("record_id", F.lit("")).alias("record_id")).agg(
        F.max("score").alias("source_score"), F.min_by("origin", "ord").alias("evidence_origin"))
    none = F.array().cast("array<string>")
    return merged.select(
        "task_id", F.lit("compound").alias("set_kind"), F.col("canonical_symbol").alias("raw_identifier"), "canonical_symbol",
        "source_database", "source_score", "evidence_origin", F.lit("identity_symbol").alias("identifier_mapping"),
        F.when(F.col("record_id") != "", F.array("record_id")).otherwise(none).alias("source_record_ids"),
    )


def rows_from_import(records: DataFrame, headers: DataFrame, set_kind: str, origin: str) -> DataFrame:
    """Frozen import records with their header's provenance, one lineage row each."""
    joined = records.join(headers, "task_id")
    return joined.select(
        "task_id", F.lit(set_kind).alias("set_kind"), "raw_identifier", "canonical_symbol", "source_database",
        "database_version", F.col("source_query_id").alias("source_query"), "query_date", "retrieved_at", "species",
        "source_score", "applied_threshold", "threshold_operator", "score_name", "identifier_mapping",
        "identifier_mapping_version", F.lit(origin).alias("evidence_origin"), F.array("source_record_id").alias("source_record_ids"),
    )


def symbol_rows(rows: DataFrame, out: str) -> DataFrame:
    return rows.where("lineage_row_id is not null").groupBy("task_id", "canonical_symbol").agg(
        F.sort_array(F.collect_list("lineage_row_id")).alias(out))


def intersections(disease: DataFrame, compound: DataFrame) -> DataFrame:
    """One row per symbol both sides share, with the sorted row ids of either side."""
    joined = symbol_rows(disease, "disease_lineage_row_ids").join(
        symbol_rows(compound, "compound_lineage_row_ids"), ["task_id", "canonical_symbol"])
    body = F.struct(
        F.lit("canonical_symbol_exact_match_v1").alias("derivation"), "canonical_symbol",
        "disease_lineage_row_ids", "compound_lineage_row_ids",
    )
    return joined.withColumn("lineage_row_id", content_id("intersection", body))


def intersection_ids(disease: DataFrame, compound: DataFrame) -> DataFrame:
    """task_id, canonical_symbol, lineage_row_id, n_disease, n_compound: the ids of ``intersections`` for symbols with any number of rows.

    The canonical text of a row (keys sorted, compact) is digested as a stream: head, compound ids, middle, disease ids, end.
    """
    keys = ["task_id", "canonical_symbol"]
    sides = [df.where("lineage_row_id is not null").select(*keys, F.lit(part).alias("part"), F.col("lineage_row_id").alias("id")) for part, df in ((1, compound), (3, disease))]
    rows = union_all(sides)
    sizes = materialize(rows.groupBy(*keys).agg(F.count_if(F.col("part") == 3).alias("n_disease"), F.count_if(F.col("part") == 1).alias("n_compound")).where(
        "n_disease > 0 and n_compound > 0"))
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), "^\\[|\\]$", "")
    frame = F.array(
        F.struct(F.lit(0).alias("part"), F.concat(F.lit('{"canonical_symbol":'), quoted(F.col("canonical_symbol")), F.lit(',"compound_lineage_row_ids":[')).alias("text")),
        F.struct(F.lit(2).alias("part"), F.lit('],"derivation":"canonical_symbol_exact_match_v1","disease_lineage_row_ids":[').alias("text")),
        F.struct(F.lit(4).alias("part"), F.lit("]}").alias("text")))
    fixed = sizes.select(*keys, F.explode(frame).alias("f")).select(*keys, "f.part", F.lit("").alias("id"), "f.text")
    ids = rows.join(sizes.select(*keys), keys, "left_semi").select(*keys, "part", "id", quoted(F.col("id")).alias("text"))
    digests = streamed_sha256(fixed.unionByName(ids), keys, ["part", "id"], "text", "part")
    return sizes.join(digests, keys).select(*keys, F.concat(F.lit("intersection-"), F.col("sha256")).alias("lineage_row_id"), "n_disease", "n_compound")


def shared_symbols(disease: DataFrame, compound: DataFrame) -> DataFrame:
    return disease.select("task_id", "canonical_symbol").intersect(compound.select("task_id", "canonical_symbol"))


def lineage_counts(tasks: DataFrame, disease: DataFrame, compound: DataFrame, shared: DataFrame) -> DataFrame:
    """Distinct symbols and rows per side, for every task."""
    def side(df, name):
        return df.groupBy("task_id").agg(
            F.count_distinct("canonical_symbol").alias(f"{name}_target_count"), F.count("*").alias(f"{name}_row_count"))

    out = tasks.select("task_id")
    for df, name in ((disease, "disease"), (compound, "compound"), (shared, "intersection")):
        out = out.join(side(df, name), "task_id", "left")
    return out.na.fill(0)


# Blocking reasons in report wording.
REASONS = {
    "mock": "当前任务使用 mock 数据，不能进入正式网络药理学研究。",
    "compound_unfrozen": "compound 来源数据库版本、阈值与标识符映射尚未冻结。",
    "edges": "compound-target 边尚未完成人工判定。",
    "no_loop": "导入靶点尚未构建可复算的成分-靶点-通路网络闭环。",
    "no_disease": "缺少独立疾病靶点集合，不能计算派生候选交集。",
    "client_import": "疾病靶点来自未验证的客户端导入，尚未通过服务端 connector 或原始快照校验。",
    "client_empty": "客户端导入声明疾病靶点查询在当前阈值下零命中，来源与查询执行未验证。",
    "disease_verified": "疾病来源已服务端核验；compound 来源保真、阈值与人工 adjudication 未完成，不能进入正式研究状态。",
    "both_verified": "疾病与 compound 来源已服务端核验；逐边人工 adjudication 未完成，不能进入正式研究状态。",
    "disease_empty": "疾病靶点集合为空，无法形成可供人工判定的疾病-成分网络。",
    "shared_empty": "疾病与成分靶点的派生交集为空，无法进入正式网络药理学研究。",
    "no_version": "至少一个成分靶点来源缺少数据库版本。",
    "compound_pending": "成分-靶点记录尚未完成人工判定。",
    "disease_pending": "疾病靶点记录尚未完成人工判定。",
    "shared_pending": "派生交集记录尚未完成人工判定。",
}


def readiness(tasks: DataFrame) -> DataFrame:
    """Blocking reasons per task, in order.

    tasks: task_id, has_protocol, has_lineage, data_mode, disease_status (null without import),
    has_compound_import, and n_disease, n_shared, compound_without_version, pending_compound,
    pending_disease, pending_shared.
    """
    r = {k: F.lit(v) for k, v in REASONS.items()}
    lin = F.col("has_lineage")
    has_disease = F.col("disease_status").isNotNull()
    client = F.col("disease_status") == "unverified_client_import"
    verified = F.col("disease_status") == "server_verified_raw_artifact"
    imported = F.col("has_compound_import")
    empty = F.col("n_disease") == 0
    reasons = F.array_compact(F.array(
        F.when(F.col("data_mode") == "mock", r["mock"]),
        F.when(~lin | ~imported, r["compound_unfrozen"]),
        r["edges"],
        F.when(lin & imported, r["no_loop"]),
        F.when(lin & ~has_disease, r["no_disease"]),
        F.when(lin & client, r["client_import"]),
        F.when(lin & client & empty, r["client_empty"]),
        F.when(lin & verified & ~imported, r["disease_verified"]),
        F.when(lin & verified & imported, r["both_verified"]),
        F.when(lin & has_disease & empty, r["disease_empty"]),
        F.when(lin & has_disease & imported & (F.col("n_shared") == 0), r["shared_empty"]),
        F.when(lin & (F.col("compound_without_version") > 0), r["no_version"]),
        F.when(lin & (F.col("pending_compound") > 0), r["compound_pending"]),
        F.when(lin & (F.col("pending_disease") > 0), r["disease_pending"]),
        F.when(lin & (F.col("pending_shared") > 0), r["shared_pending"]),
    ))
    none = F.array().cast("array<string>")
    return tasks.select(
        "task_id", F.col("has_protocol").alias("protocol_complete"),
        F.when(F.col("has_protocol"), reasons).otherwise(none).alias("blocking_reasons"))


def protocol_mismatches(pairs: DataFrame, fields: list[str]) -> Column:
    """Names of fields whose ``import_`` and ``protocol_`` columns differ, in order."""
    return F.array_compact(F.array(*[
        F.when(~F.col(f"import_{f}").eqNullSafe(F.col(f"protocol_{f}")), F.lit(f)) for f in fields
    ]))


def import_violations(records: DataFrame) -> DataFrame:
    """(import_id, rule, detail) of import records.

    records: import_id, raw_identifier, canonical_symbol, source_record_id, source_score,
    applied_threshold, query_date, retrieved_at, as_of (date of the check).
    """
    row_rules = F.array_compact(F.array(
        F.when(F.col("source_score").isNull() | F.isnan("source_score"), F.lit("score_not_numeric")),
        F.when(F.col("source_score") < 0, F.lit("score_below_zero")),
        F.when(~F.col("canonical_symbol").rlike("^[A-Za-z0-9][A-Za-z0-9._-]*$"), F.lit("symbol_malformed")),
        F.when(F.col("source_score") < F.col("applied_threshold"), F.lit("below_threshold")),
        F.when(F.to_date("query_date") > F.col("as_of"), F.lit("query_date_in_future")),
        F.when(F.to_date("retrieved_at") > F.col("as_of"), F.lit("retrieved_at_in_future")),
    ))
    detail = F.concat_ws(":", "source_record_id", "raw_identifier", "canonical_symbol")
    per_row = records.select("import_id", F.explode(row_rules).alias("rule"), detail.alias("detail"))
    repeated = records.groupBy("import_id", "source_record_id", "raw_identifier", "canonical_symbol").agg(F.count("*").alias("n")).where("n > 1").select(
        "import_id", F.lit("observation_not_unique").alias("rule"), detail.alias("detail"))
    ambiguous = records.groupBy("import_id", "source_record_id").agg(
        F.min("canonical_symbol").alias("a"), F.max("canonical_symbol").alias("b")).where("a <> b").select(
        "import_id", F.lit("record_id_ambiguous").alias("rule"), F.col("source_record_id").alias("detail"))
    return union_all([per_row, repeated, ambiguous])


# Greatest score and shape of identifiers per kind of import, and the fields an import shares with its protocol.
IMPORT_KINDS = {"disease": (1.0, "^.{1,100}$"), "compound": (20.0, "^CHEMBL[0-9]+$")}
IMPORT_SYMBOL = "^[A-Z][A-Z0-9.-]{0,39}$"
PROTOCOL_FIELDS = ["disease", "phenotype", "species", "query_date"]


def _kind_of(value: Column) -> Column:
    """BOOLEAN, STRING, BIGINT, ... of a JSON value; null without one."""
    return F.schema_of_variant(value)


def _is_number(value: Column) -> Column:
    return _kind_of(value).rlike("^(BIGINT|DOUBLE|DECIMAL)")


def landed_import_violations(imports: DataFrame) -> DataFrame:
    """(import_id, rule, detail) of imports as they landed, where types still show: booleans in place of numbers, times without a zone, query
    parameters that disagree with the import, and fields that disagree with its protocol.

    imports: import_id, kind (disease or compound), body (JSON text), protocol (JSON text or null), as_of (timestamp of the check).
    """
    top = F.col("kind").isin("disease")
    limit = F.when(top, F.lit(IMPORT_KINDS["disease"][0])).otherwise(F.lit(IMPORT_KINDS["compound"][0]))
    part = lambda path, kind: F.try_variant_get("doc", f"$.{path}", kind)
    agreed = lambda path: F.coalesce(F.try_variant_get("plan", f"$.{path}", "string"), F.lit("")) == F.coalesce(part(path, "string"), F.lit(""))
    docs = imports.select("import_id", "kind", "as_of", F.try_parse_json("body").alias("doc"), F.try_parse_json("protocol").alias("plan")).withColumn(
        "threshold", F.when(_is_number(part("applied_threshold", "variant")), part("applied_threshold", "double")))  # a boolean casts to a number
    written, minimum = part("retrieved_at", "string"), part("source_query_parameters.pchembl_value_min", "variant")
    zoned = F.coalesce(written.rlike("(Z|[+-][0-9]{2}:?[0-9]{2})$"), F.lit(False))
    rule = lambda cond, name, detail="": F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(name).alias("rule"), F.lit(detail).alias("detail") if isinstance(detail, str) else detail.alias("detail")))
    differing = F.array_join(F.array_compact(F.array(*[F.when(~agreed(f), F.lit(f)) for f in PROTOCOL_FIELDS])), ",")
    threshold_ok = _is_number(part("applied_threshold", "variant"))
    per_import = F.array_compact(F.array(
        rule(F.col("doc").isNull(), "body_unreadable"),
        rule(F.col("doc").isNotNull() & ~F.coalesce(threshold_ok, F.lit(False)), "threshold_not_numeric"),
        rule(threshold_ok & ~F.col("threshold").between(0, limit), "threshold_out_of_range"),
        rule(F.try_to_date(part("query_date", "string")) > F.to_date("as_of"), "query_date_in_future"),
        rule(F.col("doc").isNotNull() & ~zoned, "retrieved_at_without_zone"),
        rule(zoned & (written.try_cast("timestamp") > F.col("as_of")), "retrieved_at_in_future"),
        rule(top & F.col("doc").isNotNull() & ~F.coalesce(_kind_of(part("source_query_parameters", "variant")).rlike("^OBJECT<.+:"), F.lit(False)), "parameters_missing"),
        rule(~top & ~part("source_query_id", "string").eqNullSafe(part("compound_id", "string")), "query_id_mismatch"),
        rule(~top & ~part("source_query_parameters.assay_organism", "string").eqNullSafe(part("species", "string")), "organism_mismatch"),
        rule(~top & F.col("doc").isNotNull() & ~F.coalesce(_is_number(minimum), F.lit(False)), "minimum_not_numeric"),
        rule(~top & _is_number(minimum) & ~part("source_query_parameters.pchembl_value_min", "double").eqNullSafe(F.col("threshold")), "minimum_mismatch"),
        rule(top & F.col("doc").isNotNull() & F.col("plan").isNotNull() & (differing != ""), "protocol_mismatch", differing),
    ))
    found = docs.select("import_id", F.explode(per_import).alias("r")).select("import_id", "r.*")

    rows = docs.select("import_id", "kind", "threshold", F.explode(part("records", "array<variant>")).alias("record"))
    text = lambda path: F.trim(F.try_variant_get("record", f"$.{path}", "string"))
    rows = rows.select("import_id", "kind", "threshold", text("raw_identifier").alias("raw"), text("canonical_symbol").alias("symbol"), text("source_record_id").alias("record_id"),
                       F.try_variant_get("record", "$.source_score", "variant").alias("given"), F.try_variant_get("record", "$.source_score", "double").alias("score"))
    # equal observations meet once, with the number of their rows that break a rule on scores; all else is said of the observation, so the
    # records are taken apart a single time
    numeric = F.coalesce(_is_number(F.col("given")), F.lit(False))
    often = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("int")
    seen = rows.groupBy("import_id", "kind", "record_id", "raw", "symbol").agg(
        F.count("*").cast("int").alias("n"), often(~numeric).alias("untyped"), often(numeric & ~F.col("score").between(0, limit)).alias("outside"),
        often(numeric & (F.col("score") < F.col("threshold"))).alias("below"))
    named, whole = Window.partitionBy("import_id", "kind", "record_id"), Window.partitionBy("import_id", "record_id", "raw", "symbol")
    seen = seen.withColumn("name_place", F.row_number().over(named.orderBy("raw", "symbol"))).withColumn("names", F.sum("n").over(named)).withColumn(
        "least", F.min("symbol").over(named)).withColumn("most", F.max("symbol").over(named)).withColumn(
        "place", F.row_number().over(whole.orderBy("kind"))).withColumn("all", F.sum("n").over(whole))
    shape = F.when(top, F.col("raw").rlike(IMPORT_KINDS["disease"][1])).otherwise(F.col("raw").rlike(IMPORT_KINDS["compound"][1]))
    unlike = lambda col: F.when(~F.coalesce(col, F.lit(False)), F.col("n")).otherwise(0)
    detail = F.concat_ws(":", "record_id", "raw", "symbol")
    said = lambda name, times, of=detail: F.array_repeat(F.struct(F.lit(name).alias("rule"), of.alias("detail")), times)
    several = F.when(top, F.col("least") != F.col("most")).otherwise(F.col("names") > 1) & (F.col("name_place") == 1)
    once = lambda cond: F.when(cond, 1).otherwise(0)
    rules = F.concat(
        said("score_not_numeric", F.col("untyped")), said("score_out_of_range", F.col("outside")), said("below_threshold", F.col("below")),
        said("symbol_malformed", unlike(F.col("symbol").rlike(IMPORT_SYMBOL))), said("identifier_malformed", unlike(shape)),
        said("observation_not_unique", once((F.col("all") > 1) & (F.col("place") == 1))),
        said("record_id_ambiguous", once(top & several), F.col("record_id")),
        said("record_id_not_unique", once(~F.coalesce(top, F.lit(False)) & several), F.col("record_id")))
    by_row = seen.select("import_id", F.explode(rules).alias("r")).select("import_id", "r.*")
    return union_all([found, by_row])
