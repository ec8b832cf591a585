"""Expression artifacts: series matrix, platform annotation, sealed snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions.canonical import canonical_json, canonical_text
from evidra.operators.expression import canonical_group
from evidra.session import broadcast_if_small, materialize, union_all
from evidra.sources.positions import positioned, table_region


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of plain or gzip text files: (dataset = file path, line_no from 0, line). Plain files may be cut into splits."""
    return positioned(spark.read.text(path), "line_no", within_file=True, file="dataset").withColumnRenamed("value", "line").select(
        "dataset", "line_no", "line")


def _cells(line: Column) -> Column:
    return F.transform(F.split(line, "\t"), lambda c: F.regexp_replace(F.trim(c), "^\"+|\"+$", ""))


def sample_groups(lines: DataFrame) -> DataFrame:
    """(dataset, sample_idx, grp): condition rows decide, else the first source-name row."""
    meta = lines.where(F.col("line").rlike("^!Sample_(characteristics|source_name)_ch1\t"))
    cells = F.slice(_cells(F.col("line")), 2, 1_000_000_000)
    rows = meta.select("dataset", "line_no", F.col("line").startswith("!Sample_char").alias("is_char"), cells.alias("cells"))
    condition = F.col("is_char") & (F.size("cells") > 0) & F.forall("cells", lambda c: c.startswith("condition:"))
    usable = rows.withColumn("is_condition", condition).where("is_condition or not is_char")
    chosen = usable.groupBy("dataset").agg(F.min_by(F.struct("is_condition", "cells"), F.struct(~F.col("is_condition"), F.col("line_no"))).alias("c"))
    label = lambda c: F.when(F.col("is_condition"), F.regexp_replace(c, "^condition:", "")).otherwise(c)
    spread = chosen.select("dataset", F.col("c.is_condition").alias("is_condition"), F.posexplode("c.cells").alias("sample_idx", "cell"))
    return spread.select("dataset", "sample_idx", canonical_group(label(F.col("cell"))).alias("grp"))


# Lines that enclose the tables.
MATRIX_MARKS = ("!series_matrix_table_begin", "!series_matrix_table_end")
PLATFORM_MARKS = ("!platform_table_begin", "!platform_table_end")


def matrix_rows(lines: DataFrame) -> DataFrame:
    """(dataset, line_no, probe, cells) of the table between its markers, without the header; what lies outside is ignored."""
    rows = table_region(lines, *MATRIX_MARKS).select("dataset", "line_no", _cells(F.col("line")).alias("cells"))
    return rows.where(F.col("cells")[0] != "ID_REF").select("dataset", "line_no", F.col("cells")[0].alias("probe"), F.slice("cells", 2, 1_000_000_000).alias("cells"))


def last_of_probe(rows: DataFrame) -> DataFrame:
    """Of rows that repeat a probe the last one counts."""
    last = rows.groupBy("dataset", "probe").agg(F.max("line_no").alias("line_no"))
    return rows.join(last, ["dataset", "probe", "line_no"], "left_semi")


def expression_values(lines: DataFrame) -> DataFrame:
    """Long table (dataset, probe, sample_idx, value)."""
    rows = last_of_probe(matrix_rows(lines))
    return rows.select("dataset", "probe", F.posexplode("cells").alias("sample_idx", "cell")).select(
        "dataset", "probe", "sample_idx", F.col("cell").try_cast("double").alias("value"))


def matrix_violations(lines: DataFrame) -> DataFrame:
    """(dataset, rule, detail): non-numeric cells, ragged rows, empty table, missing or unknown
    groups, and a sample count that differs from the metadata."""
    rows = matrix_rows(lines)
    bad = rows.where(F.exists("cells", lambda c: c.try_cast("double").isNull())).select("dataset", F.lit("non_numeric_value").alias("rule"), F.col("probe").alias("detail"))
    widths = rows.groupBy("dataset").agg(F.min(F.size("cells")).alias("lo"), F.max(F.size("cells")).alias("hi"))
    ragged = widths.where("lo <> hi").select("dataset", F.lit("inconsistent_columns").alias("rule"), F.concat_ws("-", "lo", "hi").alias("detail"))
    datasets = lines.select("dataset").distinct()
    empty = datasets.join(widths.select("dataset"), "dataset", "left_anti").select("dataset", F.lit("no_expression_rows").alias("rule"), F.lit("").alias("detail"))
    groups = sample_groups(lines)
    counts = groups.groupBy("dataset").agg(F.count("*").alias("n"))
    no_groups = datasets.join(counts, "dataset", "left_anti").select("dataset", F.lit("no_condition_rows").alias("rule"), F.lit("").alias("detail"))
    unknown = groups.where(~F.col("grp").isin("atopic_lesional", "atopic_nonlesional", "normal")).select("dataset", F.lit("unmapped_condition").alias("rule"), F.col("grp").alias("detail")).distinct()
    width = counts.join(widths, "dataset").where("n <> hi").select("dataset", F.lit("sample_count_mismatch").alias("rule"), F.concat_ws("-", "n", "hi").alias("detail"))
    return union_all([bad, ragged, empty, no_groups, unknown, width])


def annotation_symbols(lines: DataFrame) -> DataFrame:
    """(dataset, probe, symbol) of the table between its markers: first entry of the ``Gene symbol`` column, blanks dropped; the last row
    of a probe counts."""
    table = table_region(lines, *PLATFORM_MARKS).select("dataset", "line_no", F.split("line", "\t").alias("cells"))
    # the first line of the table names the symbol column
    first = table.groupBy("dataset").agg(F.min("line_no").alias("line_no"))
    header = table.join(broadcast_if_small(materialize(first)), ["dataset", "line_no"]).select(
        "dataset", F.col("line_no").alias("header_no"), F.array_position("cells", "Gene symbol").cast("int").alias("at"))
    rows = table.join(broadcast_if_small(materialize(header)), "dataset").where("line_no > header_no and at > 0")
    raw = F.trim(F.try_element_at("cells", F.col("at")))
    found = rows.where(raw != "").select("dataset", "line_no", F.trim(F.col("cells")[0]).alias("probe"), F.trim(F.split_part(raw, F.lit("///"), F.lit(1))).alias("symbol"))
    return last_of_probe(found).select("dataset", "probe", "symbol")


# --- sealed snapshots ----------------------------------------------------------------------------------


def snapshot_candidates(manifests: DataFrame, artifacts: DataFrame, annotations: DataFrame | None = None) -> DataFrame:
    """Manifests bound to their uploaded bytes: hash, declared size check and snapshot id.

    manifests: accession, manifest (json text), size_bytes, declares_annotation, annotation_size
    artifacts / annotations: accession, content
    """
    rows = manifests.join(artifacts.select("accession", F.col("content").alias("raw")), "accession", "left")
    if annotations is not None:
        rows = rows.join(annotations.select("accession", F.col("content").alias("ann")), "accession", "left")
    else:
        rows = rows.withColumn("ann", F.lit(None).cast("binary"))
    raw_hash, ann_hash = F.sha2("raw", 256), F.sha2("ann", 256)
    problem = (
        F.when(F.col("raw").isNull(), F.lit("artifact_missing"))
        .when(F.octet_length("raw") != F.col("size_bytes"), F.lit("artifact_size_mismatch"))
        .when(F.col("declares_annotation") & F.col("ann").isNull(), F.lit("annotation_missing"))
        .when(F.col("declares_annotation") & (F.octet_length("ann") != F.col("annotation_size")), F.lit("annotation_size_mismatch"))
        .when(~F.col("declares_annotation") & F.col("ann").isNotNull(), F.lit("annotation_undeclared"))
    )
    # the manifest text is spliced in as JSON, not as a quoted string
    body = F.concat(
        F.lit('{"client_manifest":'), F.col("manifest"), F.lit(',"platform_annotation_sha256":'),
        F.coalesce(F.concat(F.lit('"'), ann_hash, F.lit('"')), F.lit("null")), F.lit(',"raw_artifact_sha256":"'), raw_hash, F.lit('"}'))
    snapshot = F.concat(F.lit("omics-snapshot-"), F.sha2(canonical_text(body), 256))
    return rows.select("accession", "manifest", raw_hash.alias("artifact_sha256"), ann_hash.alias("annotation_sha256"), problem.alias("problem"), snapshot.alias("snapshot_id"))


def seal_states(candidates: DataFrame, sealed: DataFrame) -> DataFrame:
    """created, existing (same content again), conflict (other content under a sealed key) or
    rejected. Only ``created`` rows are appended."""
    known = sealed.select("accession", F.col("snapshot_id").alias("sealed_id"))
    joined = candidates.join(known, "accession", "left")
    state = (
        F.when(F.col("problem").isNotNull(), F.lit("rejected"))
        .when(F.col("sealed_id").isNull(), F.lit("created"))
        .when(F.col("sealed_id") == F.col("snapshot_id"), F.lit("existing")).otherwise(F.lit("conflict"))
    )
    return joined.select(*candidates.columns, state.alias("state"))


def append_sealed(states: DataFrame, path: str) -> None:
    """Appends newly sealed snapshots; a repeated run finds them sealed and appends nothing."""
    states.where("state = 'created'").select("accession", "snapshot_id", "manifest", "artifact_sha256", "annotation_sha256").write.mode("append").parquet(path)


def store_issues(snapshots: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(accession, rule): stored bytes missing or changed, and ids that no longer derive."""
    stored = artifacts.select("accession", F.sha2("content", 256).alias("now"))
    joined = snapshots.join(stored, "accession", "left")
    rules = F.array_compact(F.array(
        F.when(F.col("now").isNull(), F.lit("artifact_missing")),
        F.when(F.col("now") != F.col("artifact_sha256"), F.lit("artifact_hash_mismatch")),
        F.when(~F.col("artifact_sha256").rlike("^[0-9a-f]{64}$"), F.lit("sealed_hash_malformed")),
        F.when(~F.col("snapshot_id").rlike("^omics-snapshot-[0-9a-f]{64}$"), F.lit("snapshot_id_malformed")),
        F.when(F.col("snapshot_id") != _derived_id(), F.lit("snapshot_id_mismatch")),
    ))
    return joined.select("accession", F.explode(rules).alias("rule"))


def _derived_id() -> Column:
    annotation = F.coalesce(F.concat(F.lit('"'), F.col("annotation_sha256"), F.lit('"')), F.lit("null"))
    body = F.concat(F.lit('{"client_manifest":'), "manifest", F.lit(',"platform_annotation_sha256":'), annotation, F.lit(',"raw_artifact_sha256":"'), "artifact_sha256", F.lit('"}'))
    return F.concat(F.lit("omics-snapshot-"), F.sha2(canonical_text(body), 256))


def payload_sha256(payload: Column) -> Column:
    """Hash an import snapshot is bound to."""
    return F.sha2(canonical_json(payload), 256)
