from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_registry_is_consistent():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100


def test_library_avoids_rdds_and_local_checkpoints():
    for path in (ROOT / "evidra").rglob("*.py"):
        text = path.read_text()
        assert "localCheckpoint" not in text and ".rdd" not in text and "crossJoin" not in text, path


def test_flagship_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "item_id", "score", "bonus", "year", "rank"]
    assert df.count() > 0
