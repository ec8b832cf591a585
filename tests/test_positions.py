import gzip
import json

import pytest
from pyspark.sql import functions as F

from evidra.sources import entities, literature, omics
from evidra.sources.positions import table_region


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def test_lines_are_numbered_over_splits(spark, tmp_path, small_splits):
    texts = {"a.txt": [f"line {i} of a" for i in range(100)], "b.txt": ["x"], "c.txt": [f"{i}" * (i % 40) for i in range(90)]}
    for name, lines in texts.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    with gzip.open(tmp_path / "d.txt.gz", "wt") as file:
        file.write("p\nq\n")
    df = omics.read_lines(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() > 4
    found = {}
    for r in df.collect():
        found.setdefault(r.dataset.rsplit("/", 1)[1], {})[r.line_no] = r.line
    assert {n: [v[i] for i in range(len(v))] for n, v in found.items()} == texts | {"d.txt.gz": ["p", "q"]}


@pytest.mark.parametrize("sizes", [(3, 1, 5), (1, 400, 2), (500, 1, 1)])
def test_items_and_entities_keep_their_input_order(spark, tmp_path, sizes):
    names, n = [], 0
    for i, size in enumerate(sizes):
        rows = [{"id": f"h{n + j}", "name": "x" * (j % 7)} for j in range(size)]
        n += size
        (tmp_path / f"part-{i}.json").write_text(json.dumps(rows))
        names += [r["id"] for r in rows]
    items = literature.read_items(spark, str(tmp_path)).orderBy("ord").select("ord", "id").collect()
    assert [(r.ord, r.id) for r in items] == list(enumerate(names))
    herbs = entities.read_entities(spark, str(tmp_path), "herb").orderBy("ord").select("ord", "herb_id").collect()
    assert [(r.ord, r.herb_id) for r in herbs] == list(enumerate(names))


def test_chunk_lookups_reach_the_scan(spark, tmp_path):
    rows = [{"chunk_id": f"c{i}", "literature_id": f"l{i % 5}", "text": "t"} for i in range(50)]
    (tmp_path / "chunks.json").write_text("\n".join(map(json.dumps, rows)))
    chunks = spark.read.schema(literature.CHUNK_SCHEMA).json(str(tmp_path))

    for found, n in ((literature.chunks_of(chunks, "l3"), 10), (literature.chunk_by_id(chunks, "c7"), 1)):
        assert found.count() == n
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [IsNotNull" in plan


def test_region_between_markers(spark):
    def region(lines):
        df = spark.createDataFrame([("d", i, x) for i, x in enumerate(lines)], "dataset string, line_no long, line string").repartition(3)
        return [r.line for r in table_region(df, "<", ">").orderBy("line_no").collect()]

    assert region(["a", "<", "b", " ", "<", "!c", ">", "d", "<", "e"]) == ["b", "!c"]
    assert region(["<", "a"]) == ["a"]
    assert region(["a", "b", ">"]) == [] and region([">", "<", "a"]) == []


def test_text_outside_the_markers_is_ignored(spark, tmp_path, small_splits):
    rows = [f"p{i}\t{i}\t{i + 1}" for i in range(60)]
    lines = ["!Sample_characteristics_ch1\tcondition:AL\tcondition:normal", "loose text", "p0\tx\ty", "!series_matrix_table_begin", "ID_REF\ta\tb", *rows,
             "p7\t70\t71", "!series_matrix_table_end", "p9\tlate\tlate"]
    (tmp_path / "m.txt").write_text("\n".join(lines))
    df = omics.read_lines(spark, str(tmp_path / "m.txt"))
    values = {(r.probe, r.sample_idx): r.value for r in omics.expression_values(df).collect()}
    assert len(values) == 120 and values["p7", 0] == 70.0 and values["p9", 1] == 10.0
    assert omics.matrix_violations(df).select("rule").collect() == []
    assert omics.matrix_violations(df.where(F.col("line") != "!series_matrix_table_begin")).select("rule").first().rule == "no_expression_rows"
