import gzip
import random
from fractions import Fraction
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from evidra.functions.stats import hypergeometric_tail, student_t_two_sided
from evidra.operators import enrichment, expression, latency, network, ordering
from evidra.sources import omics
from tests.conftest import rows


def test_hypergeometric_tail_known_values(spark):
    from fractions import Fraction
    from math import comb

    cases = [(3, 20000, 8, 4), (0, 50, 5, 5), (2, 50, 10, 20), (5, 50, 40, 30), (6, 50, 5, 5), (20, 50, 40, 30)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, k int, m int, n int, d int")
    got = {r.i: r.p for r in df.select("i", hypergeometric_tail("k", "m", "n", "d").alias("p")).collect()}
    assert abs(got[0] / 1.67993693488e-10 - 1) < 1e-9
    for i, (k, big, n, d) in enumerate(cases):
        want = sum(Fraction(comb(n, x) * comb(big - n, d - x), comb(big, d)) for x in range(max(k, 0), min(n, d) + 1))
        assert abs(got[i] - float(want)) <= 1e-9 * max(float(want), 1e-300) + 1e-300


def test_student_tail_known_values(spark):
    df = spark.createDataFrame([(1, 2.228138852, 10.0), (2, 0.0, 3.0), (3, -12.706204736, 1.0), (4, 1.959963985, 1e7), (5, float("nan"), 3.0)], "i int, t double, df double")
    got = {r.i: r.p for r in df.select("i", student_t_two_sided("t", "df").alias("p")).collect()}
    assert abs(got[1] - 0.05) < 1e-8 and got[2] == 1.0 and abs(got[3] - 0.05) < 1e-8 and abs(got[4] - 0.05) < 1e-6 and got[5] is None


def test_enrichment_rules(spark):
    genes = [["IL6", "TNF", "IL1B", "g1", "g2", "g3", "g4", "g5"], ["IL6", "x"], []]
    terms = spark.createDataFrame([("GO", f"t{i}", g, i) for i, g in enumerate(genes)], "collection string, term_id string, genes array<string>, ord int")
    inputs = spark.createDataFrame([(1, ["IL6", "TNF", "IL1B", "CXCL8"]), (2, ["IL6"])], "task_id int, symbols array<string>")
    got = enrichment.enrich(inputs, terms).collect()
    assert [(r.task_id, r.term_id, r.overlap_count, r.gene_count, r.genes) for r in got] == [(1, "t0", 3, 8, ["IL1B", "IL6", "TNF"])]
    assert abs(got[0].adjusted_p_value / (3 * got[0].p_value) - 1) < 1e-12  # all three terms of the collection count
    summary = enrichment.enrichment_summary(inputs, enrichment.combined(enrichment.enrich(inputs, terms), ["GO"]))
    assert rows(summary, "task_id", "n_terms") == [(1, 1)]


def test_enrichment_of_long_tables(spark):
    genes = spark.createDataFrame([("GO", "t0", g) for g in ("a", "b", "b", "c", "x")] + [("GO", "t1", "a")], "collection string, term_id string, symbol string")
    terms = spark.createDataFrame([("GO", "t0", 0), ("GO", "t1", 1), ("GO", "empty", 2)], "collection string, term_id string, ord int")
    inputs = spark.createDataFrame([(1, s) for s in ("a", "b", "c", "c")] + [(2, "a")], "task_id int, symbol string")
    got = enrichment.enrich(inputs, terms, genes=genes, max_p=1.1, min_overlap=1)
    assert rows(got, "task_id", "term_id", "overlap_count", "gene_count") == [(1, "t0", 3, 5), (1, "t1", 1, 1)]
    assert enrichment.enrich(inputs, terms, genes=genes, max_p=1e-30).count() == 0
    assert rows(enrichment.shared_symbols(got, inputs, terms, genes)) == [(1, "GO", "t0", "a"), (1, "GO", "t0", "b"), (1, "GO", "t0", "c"), (1, "GO", "t1", "a")]
    assert rows(enrichment.enrichment_summary(inputs, got), "task_id", "input_gene_count", "n_terms") == [(1, 4, 2)]


def brute_bh(p):
    p = np.array(p)
    order = np.argsort(p, kind="stable")
    ranked = p[order] * len(p) / np.arange(1, len(p) + 1)
    adjusted = np.clip(np.minimum.accumulate(ranked[::-1])[::-1], 0, 1)
    out = np.empty(len(p))
    out[order] = adjusted
    return out


def test_benjamini_hochberg_equals_brute_force(spark):
    rng = random.Random(5)
    p = [rng.choice([rng.random(), rng.random() ** 6, 0.5, 0.0, 1.0]) for _ in range(300)]
    table = [(i, "f", v) for i, v in enumerate(p)] + [(1000, "f", None), (1001, "f", float("nan"))]
    df = spark.createDataFrame(table, "i int, fam string, p_value double")
    got = {r.i: r.adj_p_value for r in expression.benjamini_hochberg(df, ["fam"]).collect()}
    assert np.allclose([got[i] for i in range(300)], brute_bh(p), atol=1e-12)
    assert got[1000] == got[1001] == 1.0


def test_series_matrix_golden(spark, tmp_path):
    matrix = (
        '!Sample_source_name_ch1\t"AL"\t"AL"\t"ANL"\t"Normal"\t"normal"\n'
        '!series_matrix_table_begin\n"ID_REF"\t"S1"\t"S2"\t"S3"\t"S4"\t"S5"\n'
        '"p1"\t9.1\t9.3\t5\t3.0\t3.0\n"p2"\t5.0\t5.2\t5\t4.9\t5.0\n"p3"\t4\t4\t4\t4\t4\n!series_matrix_table_end\n')
    annotation = "^Annotation\n!platform_table_begin\nID\tGene symbol\tx\np1\tIL6 /// IL6B\t1\np2\tSTAT3\t1\np3\tTNF\t1\np4\t\t1\n!platform_table_end\n"
    for name, text in (("m.txt.gz", matrix), ("a.txt.gz", annotation)):
        with gzip.open(tmp_path / name, "wt") as handle:
            handle.write(text)
    lines = omics.read_lines(spark, str(tmp_path / "m.txt.gz")).withColumn("dataset", F.lit("d"))
    notes = omics.read_lines(spark, str(tmp_path / "a.txt.gz")).withColumn("dataset", F.lit("d"))
    assert omics.matrix_violations(lines).count() == 0
    groups = omics.sample_groups(lines)
    assert [r.grp for r in groups.orderBy("sample_idx").collect()] == ["atopic_lesional", "atopic_lesional", "atopic_nonlesional", "normal", "normal"]
    symbols = omics.annotation_symbols(notes)
    assert rows(symbols, "probe", "symbol") == [("p1", "IL6"), ("p2", "STAT3"), ("p3", "TNF")]
    values = omics.expression_values(lines)
    tests = expression.differential_expression(values, groups, symbols, "atopic_lesional", "normal")
    passed = expression.passing(tests, 0.05, 1.0).collect()
    assert [(r.symbol, round(r.log2fc, 6)) for r in passed] == [("IL6", 6.2)]
    by_symbol = {r.symbol: r for r in tests.collect()}
    assert by_symbol["TNF"].p_value is None and by_symbol["TNF"].adj_p_value == 1.0
    counts = expression.projection_counts(values, tests, 0.05, 1.0).first()
    assert (counts.analyzed_probe_count, counts.analyzed_gene_count, counts.passing_gene_count) == (3, 3, 1)
    case, control = spark.range(1).select(*expression.comparison_groups(F.lit("atopic_lesional vs normal"))).first()
    assert (case, control) == ("atopic_lesional", "normal")


def test_matrix_violations_found(spark):
    text = ["!Sample_source_name_ch1\tAL\tstrange", "!series_matrix_table_begin", "ID_REF\ta\tb", "p1\t1\tx", "p2\t1", "!series_matrix_table_end"]
    lines = spark.createDataFrame([("d", i, t) for i, t in enumerate(text)], "dataset string, line_no bigint, line string")
    got = {r.rule for r in omics.matrix_violations(lines).collect()}
    assert got == {"non_numeric_value", "inconsistent_columns", "unmapped_condition"}
    empty = spark.createDataFrame([("d", 0, "!x")], "dataset string, line_no bigint, line string")
    assert {r.rule for r in omics.matrix_violations(empty).collect()} == {"no_expression_rows", "no_condition_rows"}


def test_percentiles_equal_brute_force(spark):
    rng = random.Random(2)
    data = [("a", float(rng.choice([1, 2, 2, 5, rng.random() * 100]))) for _ in range(301)] + [("b", 7.0)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {(r.g, r.q): (r.nearest, r.linear) for r in ordering.exact_percentiles(df, ["g"], "v", [0.0, 0.5, 0.95, 1.0]).collect()}
    values = sorted(v for g, v in data if g == "a")
    for q in (0.0, 0.5, 0.95, 1.0):
        near = values[min(max(int(np.ceil(len(values) * q)) - 1, 0), len(values) - 1)]
        assert got[("a", q)][0] == near
        assert abs(got[("a", q)][1] - np.quantile(values, q)) < 1e-9
        assert got[("b", q)] == (7.0, 7.0)


def test_latency_window_and_percentiles(spark):
    df = spark.createDataFrame([("e", i, float(i)) for i in range(1, 11)] + [("f", 1, 3.0)], "endpoint string, ts int, elapsed_ms double")
    got = {r.endpoint: r for r in latency.latency_stats(df, ["ts"], window=4).collect()}
    assert (got["e"]["count"], got["e"].avg_ms, got["e"].min_ms, got["e"].max_ms) == (10, 5.5, 1.0, 10.0)
    assert (got["e"].p50_ms, got["e"].p95_ms, got["f"].p99_ms) == (9.0, 10.0, 3.0)


def test_edge_crossings_equal_brute_force(spark):
    rng = random.Random(9)
    chains = [(1, i, *[f"{layer}{rng.randint(0, 5)}" for layer in "hctpd"]) for i in range(40)]
    df = spark.createDataFrame(chains, "task_id int, ord int, herb string, compound string, target string, pathway string, disease string")
    nodes, edges = network.graph_nodes(df), network.graph_edges(df)
    place = {(r.layer_no, r.label): r.position for r in nodes.collect()}
    pairs = {}
    for r in edges.collect():
        pairs.setdefault(r.layer_no, []).append((place[(r.layer_no, r.source)], place[(r.layer_no + 1, r.target)]))
    want = {k: sum((a[0] - b[0]) * (a[1] - b[1]) < 0 for i, a in enumerate(v) for b in v[i + 1:]) for k, v in pairs.items()}
    got = {r.layer_no: r.crossings for r in network.edge_crossings(edges, nodes).collect()}
    assert got == want


def test_hypergeometric_tail_is_exact_for_small_and_large_counts():
    cases = [(0, 10, 3, 4), (3, 10, 3, 4), (4, 10, 3, 4), (1, 5, 5, 5), (2, 4000, 1500, 2000), (900, 4000, 1500, 2000), (60, 20000, 200, 300), (1, 20000, 1, 1)]
    got = hypergeometric_tail.func(*(pd.Series(c) for c in zip(*cases, strict=True)))
    for (k, big, m, n), p in zip(cases, got, strict=True):
        exact = Fraction(sum(comb(m, i) * comb(big - m, n - i) for i in range(k, min(m, n) + 1)), comb(big, n))
        assert abs(p - float(exact)) <= 1e-9 * float(exact)


def test_shared_symbols_meet_through_the_inputs(spark):
    """All genes of every kept term are far more rows than an input's symbols have terms: the join with the kept terms comes last."""
    inputs = spark.createDataFrame([(t, f"s{t}{i}") for t in range(3) for i in range(4)] + [(0, "s00")], "task_id long, symbol string")
    terms = spark.createDataFrame([("GO", "a", 0), ("GO", "b", 1)], "collection string, term_id string, ord long")
    genes = spark.createDataFrame([("GO", "a", f"s{t}{i}") for t in range(3) for i in range(3)] + [("GO", "b", "s00"), ("GO", "b", "s00")], "collection string, term_id string, symbol string")
    kept = spark.createDataFrame([(0, "GO", "a"), (0, "GO", "b"), (2, "GO", "a")], "task_id long, collection string, term_id string")
    found = enrichment.shared_symbols(kept, inputs, terms, genes)
    assert rows(found) == [(0, "GO", "a", f"s0{i}") for i in range(3)] + [(0, "GO", "b", "s00")] + [(2, "GO", "a", f"s2{i}") for i in range(3)]
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    assert "task_id" in joins[0] and "symbol" not in joins[0] and "symbol" in joins[-1]
