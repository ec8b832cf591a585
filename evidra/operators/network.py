"""Multi-hop entity network: chain assembly, target merging, grading, graph shape.

herbs: herb_id, name, pinyin      formulas: formula_id, name, pinyin, herb_ids, ord
compounds: compound_id, name, herb_ids      targets: target_id, symbol
pathways: pathway_id, name      edges: compound_id, target_id, pathway_id, disease, score, ord
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.operators.ordering import cumulative_count, with_blocks
from evidra.session import materialize, union_all

MAX_CHAINS_PER_QUERY = 5
UNKNOWN_HERB = "未识别中药"
UNKNOWN_PATHWAY = "未匹配 KEGG 通路"


def first_match(queries: DataFrame, entities: DataFrame, id_col: str) -> DataFrame:
    """Resolves query text to the first entity (by ord) whose name equals it, or whose pinyin
    equals it in lower case. Both keys are equality joins."""
    q = queries.select("query_id", F.trim("text").alias("key"), F.lower(F.trim("text")).alias("low"))
    by_name = q.join(entities.withColumnRenamed("name", "key"), "key").select("query_id", id_col, "ord")
    by_pinyin = q.join(
        entities.select(id_col, "ord", F.lower("pinyin").alias("low")), "low"
    ).select("query_id", id_col, "ord")
    return union_all([by_name, by_pinyin]).groupBy("query_id").agg(F.min_by(id_col, "ord").alias(id_col))


def herb_names(queries: DataFrame, formulas: DataFrame, herbs: DataFrame) -> DataFrame:
    """(query_id, position, herb): herbs of the formula in formula order, the herb itself, or
    the query text when nothing is known. queries: query_id, text, analysis_type."""
    formula_q = queries.where("analysis_type = 'formula'")
    herb_q = queries.where("analysis_type <> 'formula'")
    names = herbs.select("herb_id", F.col("name").alias("herb"))
    found = first_match(formula_q, formulas.select("formula_id", "name", "pinyin", "ord"), "formula_id")
    expanded = (
        found.join(formulas.select("formula_id", F.posexplode("herb_ids").alias("position", "herb_id")), "formula_id")
        .join(names, "herb_id").select("query_id", "position", "herb")
    )
    known_herb = first_match(herb_q, herbs, "herb_id").join(names, "herb_id").select(
        "query_id", F.lit(0).alias("position"), "herb")
    resolved = union_all([found.select("query_id"), known_herb.select("query_id")])
    unknown = queries.join(resolved, "query_id", "left_anti").select(
        "query_id", F.lit(0).alias("position"), F.col("text").alias("herb"))
    return union_all([expanded, known_herb, unknown])


def allowed_herbs(queries: DataFrame, formulas: DataFrame, herbs: DataFrame) -> DataFrame:
    """(query_id, herb_id, formula) a query may draw chains from."""
    found = first_match(queries.where("analysis_type = 'formula'"), formulas.select("formula_id", "name", "pinyin", "ord"), "formula_id")
    by_formula = found.join(
        formulas.select("formula_id", F.col("name").alias("formula"), F.explode(F.array_distinct("herb_ids")).alias("herb_id")), "formula_id"
    ).select("query_id", "herb_id", "formula")
    by_herb = first_match(queries.where("analysis_type <> 'formula'"), herbs, "herb_id").select(
        "query_id", "herb_id", F.lit(None).cast("string").alias("formula"))
    return union_all([by_formula, by_herb])


def all_chains(edges: DataFrame, compounds: DataFrame, targets: DataFrame, pathways: DataFrame, herbs: DataFrame) -> DataFrame:
    """Every edge with its named ends, one row per herb of the compound. Dimensions are plain
    joins: Spark broadcasts those its statistics show to be small."""
    named = (
        edges.join(compounds.select("compound_id", F.col("name").alias("compound"), "herb_ids"), "compound_id")
        .join(targets.select("target_id", F.col("symbol").alias("target")), "target_id")
        .join(pathways.select("pathway_id", F.col("name").alias("pathway")), "pathway_id")
    )
    rows = named.select("*", F.posexplode("herb_ids").alias("herb_no", "herb_id")).drop("herb_ids")
    herb_dim = herbs.where("name <> ''").select("herb_id", F.col("name").alias("herb"))
    return rows.join(herb_dim, "herb_id")


def assemble_chains(
    queries: DataFrame, edges: DataFrame, compounds: DataFrame, targets: DataFrame, pathways: DataFrame,
    herbs: DataFrame, formulas: DataFrame, limit: int = MAX_CHAINS_PER_QUERY,
) -> DataFrame:
    """Best ``limit`` chains per query by score; input order breaks ties."""
    order = [F.desc("score"), "ord", "herb_no"]
    best = F.row_number().over(Window.partitionBy("herb_id").orderBy(*order))
    # what a query keeps is among the best of its herbs
    chains = all_chains(edges, compounds, targets, pathways, herbs).withColumn("_best", best).where(F.col("_best") <= limit).drop("_best")
    candidates = chains.join(allowed_herbs(queries, formulas, herbs), "herb_id")
    w = Window.partitionBy("query_id").orderBy(*order)
    return (
        candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
        .withColumn("related_entity_ids", F.array(*[F.col(c).cast("string") for c in ("herb_id", "compound_id", "target_id", "pathway_id")]))
    )


# --- compounds and targets ------------------------------------------------------------------


def dedupe_first(df: DataFrame, keys: list[str | Column], order: str = "ord") -> DataFrame:
    """First row by ``order`` per key, without a sort per group: the whole row travels through
    a min-by aggregate, which combines before the shuffle."""
    named = [(k if isinstance(k, Column) else F.col(k)).alias(f"_k{i}") for i, k in enumerate(keys)]
    row = F.struct(*df.columns)
    return df.groupBy(*named).agg(F.min_by(row, F.col(order)).alias("r")).select("r.*")


def dedupe_compounds(compounds: DataFrame) -> DataFrame:
    """First per (herb, lower-cased name)."""
    return dedupe_first(compounds, ["herb", F.lower("name")])


def dedupe_sources(sources: DataFrame) -> DataFrame:
    null_safe = lambda c: F.struct(F.col(c).isNull(), F.coalesce(F.col(c), F.lit("")))
    return dedupe_first(sources, ["name", null_safe("source_record_id"), null_safe("cache_key")])


def dedupe_warnings(warnings: Column) -> Column:
    return F.array_distinct(F.filter(warnings, lambda w: w.isNotNull() & (w != "")))


def human_activities(activities: DataFrame) -> DataFrame:
    organism = F.col("target_organism")
    return activities.where(organism.isNull() | organism.isin("", "Homo sapiens"))


def activity_score(pchembl: Column) -> Column:
    """pChEMBL / 10 clamped to [0, 1]; 0.5 where it is no number."""
    value = pchembl.cast("string").try_cast("double")
    return F.greatest(F.lit(0.0), F.least(F.coalesce(value / 10, F.lit(0.5)), F.lit(1.0)))


def assembly_score(score: Column, score_name: Column) -> Column:
    scaled = F.when(score_name == "pchembl_value", score / 10).otherwise(score)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(scaled, F.lit(1.0))), F.lit(0.0))


def predictions_for(predictions: DataFrame, compounds: DataFrame) -> DataFrame:
    keys = compounds.select(F.lower("name").alias("_c")).distinct()
    return predictions.withColumn("_c", F.lower("compound")).join(keys, "_c", "left_semi").drop("_c")


def merge_targets(candidates: DataFrame) -> DataFrame:
    """One row per (lower compound, upper symbol) of candidates with an input ordinal.

    Evidence is ``mixed`` when types differ; the score is the maximum; sources and references
    are joined in input order; spelling and retrieval time come from the last row.
    """
    ordered = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("ord", F.col(c).alias("v")))), lambda s: s["v"])
    refs = F.filter(ordered("source_record_id"), lambda r: r.isNotNull() & (r != ""))
    merged = candidates.groupBy(F.lower("compound").alias("_c"), F.upper("symbol").alias("_s")).agg(
        F.max_by("compound", "ord").alias("compound"), F.max_by("symbol", "ord").alias("symbol"),
        F.when(F.min("evidence_type") != F.max("evidence_type"), F.lit("mixed")).otherwise(F.min("evidence_type")).alias("evidence_type"),
        F.max("score").alias("score"), F.array_join(ordered("source"), "+").alias("source"),
        F.array_join(refs, ";").alias("source_record_id"),
        F.max_by("retrieved_at", F.when(F.col("retrieved_at").isNotNull(), F.col("ord"))).alias("retrieved_at"),
        F.min("ord").alias("ord"),
    )
    return merged.drop("_c", "_s").withColumn("source_record_id", F.when(F.col("source_record_id") != "", F.col("source_record_id")))


def herb_of_compound(targets: DataFrame, compounds: DataFrame) -> DataFrame:
    """Adds the herb of the first compound with the target's compound name."""
    first = compounds.groupBy(F.col("name").alias("compound")).agg(F.min_by("herb", "ord").alias("herb"))
    return targets.join(first, "compound", "left").withColumn("herb", F.coalesce("herb", F.lit(UNKNOWN_HERB)))


def split_refs(value: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), ";"), lambda r: F.trim(r))  # F.trim itself would take the position as its signs
    return F.filter(parts, lambda r: r != "")


def pathway_by_gene(pathways: DataFrame) -> DataFrame:
    """(symbol, pathway): the first named pathway (by ord) that lists the gene."""
    genes = pathways.where("name <> ''").select("name", "ord", F.explode("genes").alias("symbol"))
    return genes.groupBy("symbol").agg(F.min_by("name", "ord").alias("pathway"))


def map_pathway_genes(pathways: DataFrame, gene_symbols: DataFrame) -> DataFrame:
    """Gene ids in pathway arrays replaced by symbols where known, order kept."""
    rows = pathways.select("pathway_id", "name", F.posexplode("genes").alias("gene_no", "gene_id"))
    mapped = rows.join(gene_symbols, "gene_id", "left").withColumn("gene", F.coalesce("symbol", "gene_id"))
    return mapped.groupBy("pathway_id", "name").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("gene_no", "gene"))), lambda s: s["gene"]).alias("genes"))


def live_chains(
    tasks: DataFrame, merged: DataFrame, compounds: DataFrame, pathways: DataFrame
) -> DataFrame:
    """Merged targets of every task as graded-to-be chains; one pathway label (first by id)
    stands for all chains of a task. tasks: task_id, query, analysis_type."""
    label = pathways.groupBy("task_id").agg(F.min_by("name", "pathway_id").alias("pathway"))
    first = compounds.groupBy("task_id", F.col("name").alias("compound")).agg(F.min_by("herb", "ord").alias("herb"))
    return (
        merged.join(tasks, "task_id").join(label, "task_id", "left").join(first, ["task_id", "compound"], "left")
        .select(
            "task_id", F.coalesce("herb", F.lit(UNKNOWN_HERB)).alias("herb"),
            F.when(F.col("analysis_type") == "formula", F.col("query")).alias("formula"), "compound",
            F.col("symbol").alias("target"), F.coalesce("pathway", F.lit(UNKNOWN_PATHWAY)).alias("pathway"),
            F.lit("Atopic dermatitis").alias("disease"), "score", split_refs(F.col("source_record_id")).alias("evidence_refs"),
            F.col("evidence_type").alias("target_evidence_type"), "ord",
        )
    )


def merge_task_targets(candidates: DataFrame) -> DataFrame:
    """merge_targets within each task."""
    keyed = candidates.withColumn("compound", F.concat_ws("\u0001", F.col("task_id").cast("string"), "compound"))
    merged = merge_targets(keyed)
    return merged.select(
        F.split_part("compound", F.lit("\u0001"), F.lit(1)).alias("task_id"),
        F.split_part("compound", F.lit("\u0001"), F.lit(2)).alias("compound"),
        *[c for c in merged.columns if c != "compound"],
    )


def step_metrics(requests: DataFrame) -> DataFrame:
    """Requests, cache hits and duration per (task, step); steps without items are degraded,
    skipped or failed by their kind."""
    empty = F.sum("items") == 0
    status = (
        F.when(~empty, F.lit("completed"))
        .when(F.first("kind") == "optional", F.lit("skipped"))
        .when(F.first("kind") == "final", F.lit("failed"))
        .otherwise(F.lit("degraded"))
    )
    return requests.groupBy("task_id", "step").agg(
        F.sum("request_count").alias("external_request_count"), F.sum("cache_hit").alias("cache_hit_count"),
        F.sum("duration_ms").alias("duration_ms"), status.alias("status"),
    )


# --- grading ---------------------------------------------------------------------------------


# Evidence levels in report order.
EVIDENCE_LEVELS = ["experimental", "omics_validated", "literature_supported", "predicted", "mock_inferred"]


def evidence_level(data_mode: Column, evidence_type: Column, has_refs: Column) -> Column:
    return (
        F.when(data_mode != "live", F.lit("mock_inferred"))
        .when(evidence_type == "known_activity", F.lit("experimental"))
        .when((evidence_type == "mixed") | has_refs, F.lit("literature_supported"))
        .otherwise(F.lit("predicted"))
    )


def level_counts(chains: DataFrame, tasks: DataFrame) -> DataFrame:
    """Chains per evidence level for every task, zeros included."""
    grid = tasks.select("task_id", F.posexplode(F.lit(EVIDENCE_LEVELS)).alias("level_no", "evidence_level"))
    counts = chains.groupBy("task_id", "evidence_level").agg(F.count("*").alias("n"))
    return grid.join(counts, ["task_id", "evidence_level"], "left").na.fill(0, ["n"])


def confirmation_overlay(chains: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Live chains of a confirmed (task_id, target) with a lower grade become omics_validated."""
    mark = confirmed.select("task_id", "target", F.lit(True).alias("_c")).distinct()
    lower = F.col("evidence_level").isin("predicted", "literature_supported")
    return chains.join(mark, ["task_id", "target"], "left").withColumn(
        "evidence_level",
        F.when(F.col("_c") & (F.col("data_mode") == "live") & lower, F.lit("omics_validated")).otherwise(F.col("evidence_level")),
    ).drop("_c")


# --- graph -----------------------------------------------------------------------------------

LAYERS = ["herb", "compound", "target", "pathway", "disease"]


def _with_herb_label(chains: DataFrame) -> DataFrame:
    """A formula stands in place of its herb on the first layer."""
    return chains.withColumn("herb", F.coalesce("formula", "herb")) if "formula" in chains.columns else chains


def graph_nodes(chains: DataFrame) -> DataFrame:
    """Distinct labels per layer, positions in first-seen order."""
    chains = _with_herb_label(chains)
    entries = F.array(*[F.struct(F.lit(i).alias("layer_no"), F.lit(n).alias("layer"), F.col(n).alias("label")) for i, n in enumerate(LAYERS)])
    rows = chains.select("task_id", "ord", F.explode(entries).alias("e")).select("task_id", "ord", "e.*").where("label is not null")
    seen = rows.groupBy("task_id", "layer_no", "layer", "label").agg(F.min("ord").alias("first_seen"))
    by = ["task_id", "layer_no"]
    counts = seen.groupBy(*by, "first_seen").agg(F.count("*").alias("_n"))
    kind = seen.schema["first_seen"].dataType
    leading = F.col("first_seen")[kind.names[0]] if isinstance(kind, T.StructType) else F.col("first_seen")
    upto = cumulative_count(with_blocks(counts.withColumn("_lead", leading), by, "_lead"), by, "first_seen", "_upto")
    before = upto.select(*by, "first_seen", (F.col("_upto") - F.col("_n")).alias("_before"))
    ties = Window.partitionBy(*by, "first_seen").orderBy("label")
    place = (F.col("_before") + F.row_number().over(ties) - 1).cast("int")
    return seen.join(before, [*by, "first_seen"]).withColumn("position", place).select(*seen.columns, "position")


def graph_edges(chains: DataFrame) -> DataFrame:
    """Four edges per chain, duplicates kept."""
    chains = _with_herb_label(chains)
    pairs = F.array(*[
        F.struct(F.lit(i).alias("layer_no"), F.col(a).alias("source"), F.col(b).alias("target"))
        for i, (a, b) in enumerate(zip(LAYERS, LAYERS[1:]))
    ])
    return chains.select("task_id", "ord", F.explode(pairs).alias("e")).select("task_id", "ord", "e.*")


def node_degree(edges: DataFrame) -> DataFrame:
    ends = union_all([
        edges.select("task_id", F.col("layer_no").alias("node_layer"), F.col("source").alias("node")),
        edges.select("task_id", (F.col("layer_no") + 1).alias("node_layer"), F.col("target").alias("node")),
    ])
    return ends.groupBy("task_id", "node_layer", "node").agg(F.count("*").alias("degree"))


def ego_edges(edges: DataFrame, focus: str) -> DataFrame:
    """Edges touching a focus node."""
    return edges.where((F.col("source") == focus) | (F.col("target") == focus))


def ego_nodes(edges: DataFrame, focus: str) -> DataFrame:
    """Nodes at the ends of the edges that touch a focus node."""
    touching = ego_edges(edges, focus)
    return touching.select(F.explode(F.array("source", "target")).alias("node")).distinct()


def edge_crossings(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Crossing pairs of edges per task and layer pair.

    Two edges cross when their ends are in opposite order. Edges are reduced to counts per
    (source position, target position); each cell is then compared with running totals of
    the cells before it, so no pair of edges is ever formed: for a cell (s, t) the edges it
    crosses from the left are those with a smaller source and a larger target.
    """
    pairs = edges.groupBy("task_id", "layer_no", "source", "target").agg(F.count("*").alias("n"))
    place = nodes.select("task_id", "layer_no", "label", "position")
    left = place.select("task_id", "layer_no", F.col("label").alias("source"), F.col("position").alias("s"))
    right = place.select("task_id", (F.col("layer_no") - 1).alias("layer_no"), F.col("label").alias("target"), F.col("position").alias("t"))
    cells = materialize(
        pairs.join(left, ["task_id", "layer_no", "source"]).join(right, ["task_id", "layer_no", "target"])
        .select("task_id", "layer_no", "s", "t", "n")
    )
    return inversions(cells, ["task_id", "layer_no"])


def inversions(cells: DataFrame, by: list[str], bits: int = 31) -> DataFrame:
    """Sum over pairs of cells with s1 < s2 and t1 > t2 of n1 * n2, by divide and conquer on t.

    At every bit level cells sharing the higher bits of t meet once: those with the bit set
    count the ones that come earlier in s. Each level is one running sum, so the work is
    cells x bits and never pairs x pairs.
    """
    levels = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("level"))
    top = cells.agg(F.max("t")).first()[0]
    levels = levels.where(F.col("level") <= (int(top).bit_length() if top else 0))
    split = levels.withColumn("prefix", F.expr("shiftright(t, level + 1)")).withColumn("bit", F.expr("shiftright(t, level) & 1"))
    keys = by + ["level", "prefix"]
    # cells of one s do not cross each other: totals up to smaller s only
    per_s = split.groupBy(*keys, "s").agg(F.sum(F.when(F.col("bit") == 1, F.col("n")).otherwise(0)).alias("high"),
                                         F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).alias("low"))
    counted = cumulative_count(with_blocks(per_s.withColumn("_n", F.col("high")), keys, "s"), keys, "s", "upto")
    weight = F.col("low") * (F.col("upto") - F.col("high"))
    return counted.groupBy(*by).agg(F.sum(weight).cast("bigint").alias("crossings"))


def entity_listing(herbs, formulas, compounds, targets, pathways) -> DataFrame:
    """One (kind, id, name) table of all five dimensions, targets under their symbol."""
    shape = lambda df, kind, key, name: df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.col(name).alias("name"))
    return union_all([
        shape(herbs, "herb", "herb_id", "name"), shape(formulas, "formula", "formula_id", "name"),
        shape(compounds, "compound", "compound_id", "name"), shape(targets, "target", "target_id", "symbol"),
        shape(pathways, "pathway", "pathway_id", "name"),
    ])
