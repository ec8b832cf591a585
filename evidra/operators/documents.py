"""Documents as line tables: (doc_id, section, ord, line) rows, joined to text at the very end.

A document's lines come from many tables (header fields, lineage rows, chains); each becomes
rows of one line table, so a report of any number of tasks is one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions.text import redact, strip_space
from evidra.session import union_all

NOTHING = "无"
DISCLAIMER = "非诊断结论、需结合临床。"


def table_cell(value: Column) -> Column:
    """Table-safe text: empty becomes 无, white space collapses, control characters are escaped."""
    text = strip_space(F.regexp_replace(value.cast("string"), "(?U)\\s+", " "))
    # a backslash is escaped twice, like every report so far
    escaped = F.replace(text, F.lit("\\"), F.lit("\\" * 4))
    escaped = F.regexp_replace(escaped, "([`*\\[\\]()|])", "\\\\$1")
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("://", "&#58;//")):
        escaped = F.replace(escaped, F.lit(char), F.lit(entity))
    return F.when(value.isNull() | (value.cast("string") == ""), F.lit(NOTHING)).otherwise(escaped)


def table_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[table_cell(c) for c in cells]), F.lit(" |"))


def percent(score: Column) -> Column:
    return F.concat(F.round(score * 100).cast("int").cast("string"), F.lit("%"))


def listed(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.array_join(values, ", ")).otherwise(F.lit(NOTHING))


def field_lines(df: DataFrame, key: str, section: int, fields: list[tuple[str, Column]]) -> DataFrame:
    """One ``- label：value`` line per field."""
    entries = F.array(*[
        F.struct(F.lit(i).alias("ord"), F.concat(F.lit(f"- {label}："), table_cell(value)).alias("line")) for i, (label, value) in enumerate(fields)])
    return df.select(F.col(key).cast("string").alias("doc_id"), F.lit(section).alias("section"), F.explode(entries).alias("e")).select(
        "doc_id", "section", F.array(F.lit("1"), F.lpad(F.col("e.ord").cast("string"), 4, "0")).alias("ord"), "e.line")


def fixed_lines(df: DataFrame, key: str, section: int, place: int, lines: list[str]) -> DataFrame:
    """The same lines for every document (headings, table heads, notes)."""
    rows = F.posexplode(F.lit(lines)).alias("n", "line")
    return df.select(F.col(key).cast("string").alias("doc_id"), F.lit(section).alias("section"), rows).select(
        "doc_id", "section", F.array(F.lit(str(place)), F.lpad(F.col("n").cast("string"), 4, "0")).alias("ord"), "line")


def row_lines(df: DataFrame, key: str, section: int, order: list[Column], line: Column) -> DataFrame:
    """One line per row of a detail table, ordered by ``order`` (text keys)."""
    return df.select(
        F.col(key).cast("string").alias("doc_id"), F.lit(section).alias("section"),
        F.array(F.lit("5"), *[o.cast("string") for o in order]).alias("ord"), line.alias("line"))


def padded(number: Column) -> Column:
    return F.lpad(number.cast("string"), 12, "0")


def render(lines: DataFrame) -> DataFrame:
    """(doc_id, text): a document's lines in order. Only rendering gathers a document."""
    return lines.groupBy("doc_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section", "ord", "line"))), lambda s: s["line"]), "\n").alias("text"),
        F.count("*").alias("n_lines"))


def network_report_lines(
    tasks: DataFrame, lineage: DataFrame, intersections: DataFrame, summary: DataFrame, decisions: DataFrame,
    sources: DataFrame, steps: DataFrame, chains: DataFrame, levels: DataFrame, terms: DataFrame,
) -> DataFrame:
    """Report of every task: header, gate, lineage tables, decisions, sources, steps, chains,
    grading, enrichment and boundaries, as one line table.

    tasks: task_id, query, analysis_type, data_mode, gate_state, blockers, blocking_reasons,
    disease_target_count, compound_target_count, intersection_target_count
    """
    c = F.col
    parts = [
        fixed_lines(tasks, "task_id", 1, 0, ["# 网络药理学报告导出", ""]),
        field_lines(tasks, "task_id", 1, [
            ("task_id", c("task_id")), ("分析对象", c("query")), ("分析类型", c("analysis_type")), ("数据模式", c("data_mode"))]),
        fixed_lines(tasks, "task_id", 2, 0, ["", "## 研究协议与科研门禁", ""]),
        field_lines(tasks, "task_id", 2, [("formal_network_ready", F.lit("否")), ("候选装配状态", c("gate_state"))]),
    ]
    for column in ("blocking_reasons", "blockers"):
        spread = tasks.select("task_id", F.posexplode(column).alias("n", "item"))
        parts.append(row_lines(spread, "task_id", 2, [F.lit(column), padded(c("n"))], F.concat(F.lit("  - "), table_cell(c("item")))))
    parts += [
        fixed_lines(tasks, "task_id", 3, 0, ["", "## 靶点集合与逐行 Lineage", ""]),
        field_lines(tasks, "task_id", 3, [
            ("疾病靶点", c("disease_target_count")), ("成分靶点", c("compound_target_count")), ("派生候选交集", c("intersection_target_count"))]),
    ]
    head = "| Row ID | Canonical | Source | Score | Records |"
    for section, kind, title in ((4, "disease", "### 疾病靶点集合"), (5, "compound", "### 成分靶点集合")):
        rows = lineage.where(c("set_kind") == kind)
        parts += [
            fixed_lines(tasks, "task_id", section, 0, ["", title, "", head, "|---|---|---|---:|---|"]),
            row_lines(rows, "task_id", section, [c("canonical_symbol"), c("lineage_row_id")], table_row(
                c("lineage_row_id"), c("canonical_symbol"), c("source_database"), c("source_score"), listed(c("source_record_ids")))),
        ]
    parts += [
        fixed_lines(tasks, "task_id", 6, 0, ["", "### 派生候选交集", "", "| Row ID | Canonical | Disease refs | Compound refs |", "|---|---|---|---|"]),
        row_lines(intersections, "task_id", 6, [c("canonical_symbol")], table_row(
            c("lineage_row_id"), c("canonical_symbol"), F.array_join("disease_lineage_row_ids", ", "), F.array_join("compound_lineage_row_ids", ", "))),
        fixed_lines(tasks, "task_id", 7, 0, ["", "## 人工判定", "", "| Included（纳入） | Excluded（排除） | Needs review（待复核） | Pending（待判定） |", "|---:|---:|---:|---:|"]),
        row_lines(summary, "task_id", 7, [F.lit("0")], table_row(c("included"), c("excluded"), c("needs_review"), c("pending"))),
        row_lines(decisions, "task_id", 7, [F.lit("1"), c("lineage_row_id")], table_row(c("lineage_row_id"), c("decision"), c("reason"), c("decided_at"))),
    ]
    live = tasks.where("data_mode = 'live'")
    parts += [
        fixed_lines(live, "task_id", 8, 0, ["", "## 数据来源与参数版本", "", "| Source | Record ID | Cache key |", "|---|---|---|"]),
        row_lines(sources.join(live.select("task_id"), "task_id", "left_semi"), "task_id", 8, [padded(c("ord"))], table_row(c("name"), c("source_record_id"), c("cache_key"))),
        fixed_lines(live, "task_id", 9, 0, ["", "## 运行步骤", "", "| Step | Status | Duration ms | Requests | Cache hits |", "|---|---|---:|---:|---:|"]),
        row_lines(steps.join(live.select("task_id"), "task_id", "left_semi"), "task_id", 9, [c("step")], table_row(
            c("step"), c("status"), c("duration_ms"), c("external_request_count"), c("cache_hit_count"))),
        fixed_lines(tasks, "task_id", 10, 0, ["", "## 链路结果", "", "| 方剂 | 单味中药 | 成分 | 靶点 | 通路 | 疾病 | 置信度 |", "|---|---|---|---|---|---|---:|"]),
        row_lines(chains, "task_id", 10, [padded(c("chain_no"))], table_row(
            c("formula"), c("herb"), c("compound"), c("target"), c("pathway"), c("disease"), percent(c("score")))),
        fixed_lines(tasks, "task_id", 11, 0, ["", "## 证据分级", "", "| Level | 链路数 |", "|---|---:|"]),
        row_lines(levels, "task_id", 11, [padded(c("level_no"))], table_row(c("evidence_level"), c("n"))),
        fixed_lines(terms.select("task_id").distinct(), "task_id", 12, 0, ["", "## 富集分析结果", "", "| Term ID | 类别 | 重叠基因 | P-value | 校正后 P-value |", "|---|---|---:|---:|---:|"]),
        row_lines(terms, "task_id", 12, [padded(c("combined_rank"))], table_row(
            c("term_id"), c("collection"), F.concat_ws("/", c("overlap_count").cast("string"), c("gene_count").cast("string")),
            F.format_string("%.2e", c("p_value")), F.format_string("%.2e", c("adjusted_p_value")))),
        fixed_lines(tasks, "task_id", 13, 0, ["", "## 边界说明", "", "- 不构成诊断或治疗建议，实际判断需核对原始文献、参数版本与临床背景。", "", "---", "", DISCLAIMER]),
    ]
    return union_all(parts)


def answer_brief_lines(answers: DataFrame, cards: DataFrame, claims: DataFrame) -> DataFrame:
    """Brief of every answer: question, answer, claims with scores, citations, checklist.

    answers: query_id, question, answer, source, strategy, available_citation_count, status, reason
    """
    c = F.col
    score = lambda v: F.when(v.isNull(), F.lit("未计算")).otherwise(percent(v))
    claim_line = F.concat(
        F.lit("### Claim "), (c("claim_no") + 1).cast("string"), F.lit("\n\n"), c("text"), F.lit("\n\nevidence_refs："),
        F.when(F.size("evidence_refs") > 0, F.array_join("evidence_refs", "、")).otherwise(F.lit(NOTHING)),
        F.lit("\nsemantic_score："), score(c("semantic_score")), F.lit("\nentailment_score："), score(c("entailment_score")), F.lit("\n"))
    meta = F.concat_ws(
        " · ", F.concat(F.lit("来源："), c("source")), F.concat(F.lit("literature_id："), c("literature_id")),
        F.concat(F.lit("检索匹配度："), score(c("match_score"))), F.concat(F.lit("来源类型先验："), percent(c("confidence"))),
        F.when(F.length("chunk_id") > 0, F.concat(F.lit("chunk_id："), c("chunk_id"))))
    card_line = F.concat_ws(
        "\n", F.concat(F.lit("### 引用 "), c("position").cast("string"), F.lit(" — "), c("title")), meta, F.lit(""), F.concat(F.lit("> "), c("snippet")),
        F.when(F.length("quote") > 0, F.concat(F.lit("\n证据片段引文："), c("quote"))),
        F.when(F.length("reason") > 0, F.concat(F.lit("\n命中证据标签："), c("reason"))), F.lit(""))
    return union_all([
        fixed_lines(answers, "query_id", 1, 0, ["# 答案导出", "", "## 证据简报", ""]),
        field_lines(answers, "query_id", 1, [
            ("证据范围", c("source")), ("检索策略", c("strategy")), ("可用引用数", c("available_citation_count")), ("Grounding 状态", c("status")), ("拦截原因", c("reason"))]),
        fixed_lines(answers, "query_id", 2, 0, ["", "## 问题", ""]), row_lines(answers, "query_id", 2, [F.lit("0")], c("question")),
        fixed_lines(answers, "query_id", 3, 0, ["", "## 回答", ""]), row_lines(answers, "query_id", 3, [F.lit("0")], c("answer")),
        fixed_lines(answers, "query_id", 4, 0, ["", "## 结构化声明", ""]), row_lines(claims, "query_id", 4, [padded(c("claim_no"))], claim_line),
        fixed_lines(answers, "query_id", 5, 0, ["", "## 引用证据", ""]), row_lines(cards, "query_id", 5, [padded(c("position"))], card_line),
        fixed_lines(answers, "query_id", 6, 0, ["## Reviewer 核对清单", "", f"- [ ] 已核对免责声明：{DISCLAIMER}", "- [ ] 已逐条打开引用文献详情或原文 PDF", "", "---", "", DISCLAIMER]),
    ])


def selected_questions(questions: DataFrame, ids: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(passed questions, problems): the given ids, or all that passed; ids that are missing or
    did not pass are problems."""
    passed = questions.where("grounding_status = 'passed'")
    if not ids:
        return passed, questions.select("question_id").limit(0).withColumn("rule", F.lit(""))
    wanted = questions.sparkSession.createDataFrame([(i,) for i in ids], "question_id string")
    missing = wanted.join(questions, "question_id", "left_anti").withColumn("rule", F.lit("missing"))
    failed = wanted.join(questions.where("grounding_status <> 'passed'"), "question_id", "left_semi").withColumn("rule", F.lit("not_passed"))
    return passed.join(wanted, "question_id", "left_semi"), union_all([missing, failed])


def reviewer_packet_lines(questions: DataFrame, claims: DataFrame, cited: DataFrame) -> DataFrame:
    """Packet of every selected question: answer, claims with cited chunks and a warning for
    claims that do not cite exactly one chunk; secrets are redacted.

    claims: question_id, claim_no, text, evidence_refs; cited: question_id, claim_no, ref_no, chunk_id, text
    """
    c = F.col
    quoted = lambda v: F.concat(F.lit("> "), F.regexp_replace(redact(F.coalesce(v, F.lit("null"))), "\\r?\\n", "\n> "))
    keep = questions.select("question_id")
    mine = claims.join(keep, "question_id", "left_semi")
    n = F.size("evidence_refs")
    warning = F.concat(c("question_id"), F.lit(" claim has "), n.cast("string"), F.lit(" evidence refs (claim "), c("claim_no").cast("string"), F.lit("); expected exactly 1."))
    refs = F.when(n > 0, F.array_join("evidence_refs", ", ")).otherwise(F.lit("none"))
    claim_text = F.concat(
        F.lit("### Claim "), c("claim_no").cast("string"), F.lit("\n\n"), quoted(c("text")), F.lit("\n\n- Evidence refs: `"), redact(refs),
        F.lit("`\n- Reviewer verdict: `[ ] supported` / `[ ] unsupported` / `[ ] unclear`\n"))
    return union_all([
        row_lines(mine.where(n != 1), "question_id", 1, [padded(c("claim_no"))], F.concat(F.lit("- WARNING: "), redact(warning))),
        row_lines(questions, "question_id", 2, [F.lit("0")], F.concat(
            F.lit("## "), redact(c("question_id")), F.lit("\n\n- Question: "), redact(c("question")), F.lit("\n\n"), quoted(c("answer")))),
        row_lines(mine, "question_id", 3, [padded(c("claim_no")), F.lit("0")], claim_text),
        row_lines(cited.join(keep, "question_id", "left_semi"), "question_id", 3, [padded(c("claim_no")), F.lit("1"), padded(c("ref_no"))], F.concat(
            F.lit("- Chunk: `"), redact(c("chunk_id")), F.lit("`\n\n"), quoted(c("text")), F.lit("\n"))),
    ])


def write_documents(lines: DataFrame, path: str) -> None:
    """One row per document (doc_id, text) as parquet; a rerun replaces the folder as a whole."""
    render(lines).write.mode("overwrite").parquet(path)
