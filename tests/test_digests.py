import hashlib
import random
from collections import defaultdict

import pytest

from evidra.operators import digests, lineage
from tests.conftest import rows


@pytest.mark.parametrize("piece", [1, 30, 1 << 20])
def test_streamed_digest_equals_the_joined_text(spark, monkeypatch, piece):
    monkeypatch.setattr(digests, "PIECE_BYTES", piece)
    r = random.Random(4)
    data = [(r.choice(["hot"] * 6 + [f"k{i}" for i in range(40)]), r.randint(0, 3), r.randint(0, 10**6)) for _ in range(3000)]
    want = defaultdict(list)
    for k, part, n in sorted(data):
        want[k].append((part, f"t{n % 97}é"))
    table = spark.createDataFrame([(k, p, n, f"t{n % 97}é") for k, p, n in data], "k string, part int, n int, text string").repartition(5)
    found = {x.k: x.sha256 for x in digests.streamed_sha256(table, ["k"], ["part", "n"], "text", "part").collect()}

    def joined(values):
        return "".join(("," if i and values[i - 1][0] == p else "") + t for i, (p, t) in enumerate(values))

    assert found == {k: hashlib.sha256(joined(v).encode()).hexdigest() for k, v in want.items()}


def test_intersection_ids_equal_those_of_the_lists(spark):
    r = random.Random(2)
    side = lambda name, n: spark.createDataFrame(
        [(r.choice([1, 2]), r.choice(["IL6", 'q"uote', "Ünï", "only" + name]), f"{name}-{i}") for i in range(n)] + [(1, "IL6", None)],
        "task_id int, canonical_symbol string, lineage_row_id string").repartition(3)
    disease, compound = side("disease", 300), side("compound", 120)
    lists = lineage.intersections(disease, compound)
    assert rows(lineage.intersection_ids(disease, compound), "task_id", "canonical_symbol", "lineage_row_id") == rows(lists, "task_id", "canonical_symbol", "lineage_row_id")
    assert lineage.intersection_ids(disease.limit(0), compound).count() == 0
