import datetime
import json

from evidra.operators import lineage
from tests.conftest import rows


def test_records_are_taken_apart_once_and_judged_as_rows(spark):
    """One row per record and broken rule, repeats across bodies of one import and of another kind included, from one pass over the records."""
    def body(*records):
        names = ("raw_identifier", "canonical_symbol", "source_record_id", "source_score")
        return json.dumps({"applied_threshold": 0.5, "query_date": "2020-01-01", "retrieved_at": "2020-01-01T00:00:00Z", "species": "Homo sapiens", "compound_id": "C",
                           "source_query_id": "C", "source_query_parameters": {"assay_organism": "Homo sapiens", "pchembl_value_min": 0.5},
                           "records": [dict(zip(names, r, strict=True)) for r in records]})

    low, text, wide = ("E1", "IL6", "r1", 0.1), ("E1", "IL6", "r1", True), ("E2", "tnf", "r1", 3)
    table = [(1, "disease", body(low, low, text)), (1, "disease", body(wide)), (1, "compound", body(low)), (None, "disease", body((None, None, None, 0.9))),
             (2, "compound", body(("CHEMBL1", "IL6", None, 1), ("CHEMBL2", "IL6", None, 30)))]
    imports = spark.createDataFrame([(*r, None, datetime.datetime(2025, 1, 1)) for r in table], "import_id int, kind string, body string, protocol string, as_of timestamp")
    found = lineage.landed_import_violations(imports)
    first, second = "r1:E1:IL6", "r1:E2:tnf"
    assert rows(found) == sorted([
        (1, "below_threshold", first), (1, "below_threshold", first), (1, "below_threshold", first), (1, "score_not_numeric", first),
        (1, "score_out_of_range", second), (1, "symbol_malformed", second), (1, "identifier_malformed", first), (1, "observation_not_unique", first),
        (1, "record_id_ambiguous", "r1"), (None, "symbol_malformed", ""), (None, "identifier_malformed", ""),
        (2, "score_out_of_range", "CHEMBL2:IL6"), (2, "record_id_not_unique", None)], key=repr)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("$.records") == 1
