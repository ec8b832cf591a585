"""Differential expression on long tables: probe collapse, Welch test, FDR, candidates.

values: dataset, probe, sample_idx, value     groups: dataset, sample_idx, grp
annotation: dataset, probe, symbol
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions.stats import student_t_two_sided
from evidra.operators.ordering import cumulative_count, running_min_from_right, with_blocks

# Condition labels and the group each stands for.
GROUP_ALIASES = {
    "al": "atopic_lesional", "atopic_lesional": "atopic_lesional", "lesional": "atopic_lesional",
    "anl": "atopic_nonlesional", "atopic_nonlesional": "atopic_nonlesional",
    "nonlesional": "atopic_nonlesional", "non-lesional": "atopic_nonlesional",
    "normal": "normal", "healthy": "normal", "control": "normal",
}
COMPARISON = "^([a-z_]+)\\s+vs\\s+([a-z_]+)$"


def canonical_group(label: Column) -> Column:
    cleaned = F.lower(F.trim(label))
    table = F.create_map(*[F.lit(x) for pair in GROUP_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, cleaned), cleaned)


def unknown_groups(groups: DataFrame) -> DataFrame:
    """Labels that are no known group."""
    known = sorted(set(GROUP_ALIASES.values()))
    return groups.select("dataset", "grp").distinct().where(~F.col("grp").isin(known))


def comparison_groups(comparison: Column) -> tuple[Column, Column]:
    text = F.trim(comparison)
    part = lambda i: F.when(text.rlike(COMPARISON), F.regexp_extract(text, COMPARISON, i))
    return part(1), part(2)


def group_count_mismatches(groups: DataFrame, declared: DataFrame) -> DataFrame:
    """Observed against declared (dataset, grp, n) sample counts; only differences remain."""
    observed = groups.groupBy("dataset", "grp").agg(F.count("*").alias("observed"))
    return (
        observed.join(declared.withColumnRenamed("n", "declared"), ["dataset", "grp"], "full_outer")
        .where(~F.col("observed").eqNullSafe(F.col("declared")))
    )


def collapse_probes(values: DataFrame, annotation: DataFrame) -> DataFrame:
    """(dataset, symbol, probe): per symbol the probe with the highest mean, then id."""
    means = values.groupBy("dataset", "probe").agg(F.avg("value").alias("mean"))
    mapped = means.join(annotation.where("symbol is not null and symbol <> ''"), ["dataset", "probe"])
    return mapped.groupBy("dataset", "symbol").agg(
        F.max_by("probe", F.struct("mean", "probe")).alias("probe")
    )


def group_moments(values: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Count, mean and sample variance per (dataset, key, group): one map-side combined pass."""
    return (
        values.join(groups, ["dataset", "sample_idx"]).groupBy("dataset", key, "grp")
        .agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var"))
    )


def welch(moments: DataFrame, case: str, control: str, keys: list[str]) -> DataFrame:
    """Welch statistic, degrees of freedom, two-sided p and difference of means per key.

    t, df and p are null where both variances vanish or a side has fewer than two samples.
    """
    pick = lambda name, grp: F.max(F.when(F.col("grp") == grp, F.col(name)))
    sides = moments.where(F.col("grp").isin(case, control)).groupBy(*keys).agg(
        *[pick(m, g).alias(f"{m}_{s}") for s, g in (("case", case), ("control", control)) for m in ("n", "mean", "var")]
    )
    a, b = F.col("var_case") / F.col("n_case"), F.col("var_control") / F.col("n_control")
    testable = (F.col("n_case") > 1) & (F.col("n_control") > 1) & (a + b > 0)
    stats = sides.where("n_case is not null and n_control is not null").select(
        *keys, "mean_case", "mean_control", "n_case", "n_control",
        (F.col("mean_case") - F.col("mean_control")).alias("log2fc"),
        F.when(testable, (F.col("mean_case") - F.col("mean_control")) / F.sqrt(a + b)).alias("t"),
        F.when(
            testable, (a + b) ** 2 / (a ** 2 / (F.col("n_case") - 1) + b ** 2 / (F.col("n_control") - 1))
        ).alias("df"),
    )
    return stats.withColumn("p_value", student_t_two_sided(F.col("t"), F.col("df")))


def benjamini_hochberg(tests: DataFrame, by: list[str], p: str = "p_value") -> DataFrame:
    """Adds ``adj_p_value`` over the finite p-values of each family ``by``; others get 1.

    Ranks and the running minimum need an order over a whole family, which may be large
    (all genes of all comparisons in one family). Equal p-values share the adjusted value of
    their last rank, so the family is reduced to distinct p-values and ordered block by block.
    """
    finite = F.col(p).isNotNull() & ~F.isnan(p)
    per_p = tests.where(finite).groupBy(*by, p).agg(F.count("*").alias("_n"))
    totals = per_p.groupBy(*by).agg(F.sum("_n").alias("_m"))
    # finer blocks near zero, where p-values crowd
    blocked = with_blocks(per_p, by, p, scale=F.pow(F.col(p), F.lit(0.25)))
    ranked = cumulative_count(blocked, by, p, "_rank").join(F.broadcast(totals) if not by else totals, by or None)
    ranked = ranked.withColumn("_q", F.col(p) * F.col("_m") / F.col("_rank"))
    lowest = running_min_from_right(ranked, by, p, "_q", "_min")
    adjusted = lowest.select(*by, p, F.least("_min", F.lit(1.0)).alias("adj_p_value"))
    joined = tests.join(adjusted, by + [p], "left")
    return joined.withColumn("adj_p_value", F.coalesce("adj_p_value", F.lit(1.0)))


def differential_expression(
    values: DataFrame, groups: DataFrame, annotation: DataFrame, case: str, control: str
) -> DataFrame:
    """Per dataset and symbol: means, log2 fold change, t, p and adjusted p after collapse."""
    chosen = collapse_probes(values, annotation)
    gene_values = values.join(chosen, ["dataset", "probe"])
    tests = welch(group_moments(gene_values, groups, "symbol"), case, control, ["dataset", "symbol"])
    return benjamini_hochberg(tests, ["dataset"])


def passing(tests: DataFrame, alpha: float, min_abs_fc: float) -> DataFrame:
    """adj p < alpha, |log2fc| > threshold (both strict) and a defined p."""
    return tests.where(
        (F.col("adj_p_value") < alpha) & (F.abs("log2fc") > min_abs_fc) & F.col("p_value").isNotNull()
    )


def lineage_candidates(passed: DataFrame, lineage: DataFrame) -> DataFrame:
    """Passing genes with the lineage rows (task_id, canonical_symbol, lineage_row_id) they back."""
    rows = lineage.groupBy("task_id", F.col("canonical_symbol").alias("symbol")).agg(
        F.sort_array(F.collect_list("lineage_row_id")).alias("lineage_row_ids")
    )
    return passed.join(rows, "symbol")


def projection_counts(values: DataFrame, tests: DataFrame, alpha: float, min_abs_fc: float) -> DataFrame:
    probes = values.groupBy("dataset").agg(F.count_distinct("probe").alias("analyzed_probe_count"))
    hit = (F.col("adj_p_value") < alpha) & (F.abs("log2fc") > min_abs_fc) & F.col("p_value").isNotNull()
    genes = tests.groupBy("dataset").agg(
        F.count("*").alias("analyzed_gene_count"), F.count_if(hit).alias("passing_gene_count")
    )
    return probes.join(genes, "dataset", "left")


def candidate_summary(candidates: DataFrame, shown: int = 6) -> DataFrame:
    """First ``shown`` symbols per task as text, with the total where there are more."""
    w = Window.partitionBy("task_id").orderBy("symbol")
    head = candidates.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= shown)
    names = head.groupBy("task_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", "symbol"))), lambda x: x["symbol"]), "、").alias("names")
    )
    total = candidates.groupBy("task_id").agg(F.count("*").alias("n"))
    count = F.concat(F.lit("候选基因 "), F.col("n").cast("string"), F.lit(" 个："))
    suffix = F.when(F.col("n") > shown, F.lit(" 等")).otherwise(F.lit(""))
    return names.join(total, "task_id").select("task_id", "n", F.concat(count, "names", suffix).alias("summary"))
