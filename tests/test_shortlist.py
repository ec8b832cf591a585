import random

from pyspark.sql import functions as F

from evidra.operators import answers, retrieval, shortlist
from evidra.plans import evaluation_queries
from tests.conftest import rows

ITEMS = ("item_id int, title string, source_type string, record_origin string, year int, ord int, evidence_tags array<string>, "
         "related_entity_ids array<string>")


def _table(spark):
    """Items, chunks, questions and tokens with repeated items and questions, missing years, and chunks of no item."""
    draw = random.Random(7)
    words = ["gut", "skin", "itch", "rash", "zinc"]
    text = lambda n: " ".join(draw.choice(words) for _ in range(n))
    tags = lambda: [t for t in ("network_pharmacology", "targeted_therapy") if draw.random() < 0.4]
    items = [(i, text(2), draw.choice(["pubmed", "pubmed", "cn_literature"]), draw.choice(["seed_sample", "pubmed_live"]), draw.choice([2001, 2002, None]), i, tags(),
              [f"HERB:{i % 4}"] if i % 3 else []) for i in range(24)]
    items += [items[5], items[8][:4] + (1999,) + items[8][5:6] + (["targeted_therapy"],) + items[8][7:]]
    chunks = [(f"{i}-{c}", i, text(3), [f"herb:{c}"] if c else []) for i in range(26) for c in range(i % 4)]
    asked = [(q, "瘙痒与肠道" if q % 3 == 0 else "gut and skin") for q in range(7)] + [(1, "gut and skin"), (2, "瘙痒")]
    tokens = [(q, w) for q in range(7) for w in words if (q + len(w)) % 3 or w == "gut"]
    named = tokens + [(q, f"herb-{q}") for q in range(6)] + [(q, "network") for q in (0, 3, 4)]
    return (spark.createDataFrame(items, ITEMS), spark.createDataFrame(chunks, "chunk_id string, item_id int, text string, related_entity_ids array<string>"),
            spark.createDataFrame(asked, "query_id int, text string"), spark.createDataFrame(tokens, "query_id int, token string"),
            spark.createDataFrame(named, "query_id int, token string"))


def test_shortlist_chooses_as_all_candidates_do(spark):
    linked, chunks, questions, tokens, named = _table(spark)
    items = linked.drop("evidence_tags", "related_entity_ids")
    for parts in (chunks, chunks.drop("related_entity_ids"), None):
        every = retrieval.keyword_candidates(questions, items, tokens, parts).cache()
        few, totals = shortlist.citable_candidates(questions, items, tokens, parts, named, linked, 3, part_rows=4, set_queries=2)
        assert few.columns == every.columns and few.count() < every.count()
        topical = answers.topical_queries(every, named, tokens.select("token"))
        assert rows(answers.topical_queries(totals, named, tokens.select("token"))) == rows(topical) != []
        whole, some = (answers.domain_order(r, linked, named) for r in (every, few))
        for use in (True, False):
            marks = [answers.entity_matches(r, named, linked, parts) if use else None for r in (whole, some)]
            (want, available), (got, _) = (answers.select_citations(r, topical, m, top_k=3) for r, m in zip((whole, some), marks, strict=True))
            shown = [F.round("score", 6).alias("score"), "query_id", "item_id", "chunk_id", "position", "match_score", "bonus", "year"]
            assert rows(got, *shown) == rows(want, *shown)
            if use:
                assert rows(answers.available_counts(totals, topical)) == rows(available)


def test_questions_keep_few_of_their_candidates(spark, tmp_path):
    """Every question meets every turn here; four classes of three rows each are staged, not all pairs, and all pairs are counted."""
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", f"gut barrier {c} {t}" if c % 2 else "nothing") for c in range(60) for t in range(4)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    spark.createDataFrame([(q, "gut barrier") for q in range(5)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    ranked, *_ = evaluation_queries._entity_inputs(spark, str(tmp_path))
    assert 5 * 3 <= ranked.count() <= 5 * 12
    got = {r.query_id: r.available_citation_count for r in evaluation_queries.entity_citations(spark, str(tmp_path)).collect()}
    assert got == {0: 120, 1: 12, 2: 120, 3: 12, 4: 120}
