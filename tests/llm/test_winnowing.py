import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from evidra.llm import winnowing
from evidra.llm.registry import op12_winnowing

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, span=10):
    windows = {}
    for item, text in items:
        w = words_of(text)
        size = min(span, len(w))
        for s in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[s:s + size]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words_of(text), set(), set()
        for s in range(len(w)):
            for size in range(1, span + 1):
                known = windows.get(tuple(w[s:s + size])) if s + size <= len(w) else None
                if known is not None:
                    hit |= set(range(s, s + size))
                    found |= {str(i) for i in known if i is not None}
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def text_of(r, n, vocabulary):
    return "".join(r.choice(vocabulary) + r.choice([" ", ", ", ".\n", "-", "'"]) for _ in range(n))


def cases():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)] + ["Été", "Naïve", "漢字", "A1", "ÀB", "x\x80y"]
    items = [(i, text_of(r, r.choice([10, 11, 25, 40]), vocabulary)) for i in range(30)]
    items += [(30, "Short Item, five words long"), (31, "single"), (32, ""), (33, None), (None, text_of(r, 14, vocabulary)), (30, text_of(r, 12, vocabulary)),
              (34, items[3][1]), (35, "same same same same same same same same same same same same")]
    docs = [(i, text_of(r, r.randint(0, 80), vocabulary)) for i in range(120)]
    for i in range(120, 240):
        words = re.findall(r"\S+", items[r.choice([n for n, (_, t) in enumerate(items) if t])][1])
        start = r.randint(0, max(0, len(words) - 10))
        docs.append((i, text_of(r, r.randint(0, 30), vocabulary) + " " + " ".join(words[start:start + r.randint(8, 20)]).upper() + " " + text_of(r, 9, vocabulary)))
    docs += [(300, None), (301, ""), (302, " .,; "), (None, items[0][1]), (5, items[1][1]), (5, items[1][1]), (303, "same " * 30),
             (304, "short item five words " + "long " * 3), (305, text_of(r, 3000, vocabulary) + items[2][1] * 3), (306, "x" * 3000 + items[2][1] + "y" * 9),
             (307, "single-single SINGLE")]
    return docs, items


def frames(spark, docs, items):
    left = spark.createDataFrame([(*d, 1, "a", []) for d in docs], "doc_id long, text string, row int, key string, items array<int>").repartition(3)
    return left, spark.createDataFrame([(*i, 1, "b") for i in items], "item_id long, text string, window int, words string")


def test_query_against_brute_force(spark, tmp_path):
    docs, items = cases()
    left, right = frames(spark, docs, items)
    left.write.parquet(str(tmp_path / "documents.parquet"))
    right.write.parquet(str(tmp_path / "benchmark.parquet"))
    result = op12_winnowing(spark, str(tmp_path))
    assert result.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(tuple, result.collect()), key=repr) == brute(docs, items)


@pytest.mark.parametrize("span,k", [(4, 2), (6, 6), (3, 1)])
def test_other_spans(spark, span, k):
    docs, items = cases()
    left, right = frames(spark, docs, items)
    found = winnowing.digests(winnowing.shared_windows(left, right, span=span, k=k))
    assert sorted(map(tuple, found.collect()), key=repr) == brute(docs, items, span)


def test_small_batches_bitmaps_and_chunks_change_nothing(spark, monkeypatch):
    docs, items = cases()
    left, right = frames(spark, docs, items)
    want = brute(docs, items)
    for name, value in (("BATCH_BYTES", 300), ("CHUNK_WINDOWS", 3), ("MOST_BITS", 1 << 15)):
        monkeypatch.setattr(winnowing, name, value)
    assert sorted(map(tuple, winnowing.digests(winnowing.shared_windows(left, right)).collect()), key=repr) == want


def test_spans_are_maximal_stretches(spark):
    item = " ".join(f"t{i}" for i in range(14))
    docs = spark.createDataFrame([(1, f"a b {item} c t0 t1"), (2, " ".join(item.split()[:9]))], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, "t0 t1")], "item_id long, text string")
    rows = {r.doc_id: r for r in winnowing.shared_windows(docs, items).collect()}
    assert [tuple(s) for s in rows[1].spans] == [(2, 16), (17, 19)] and rows[1]["items"] == ["7", "8"]
    assert [tuple(s) for s in rows[2].spans] == [(0, 2)] and rows[2]["items"] == ["8"]


def test_every_shared_window_has_a_shared_fingerprint():
    r = random.Random(2)
    shared = " ".join(f"s{i}" for i in range(10))
    marks = []
    for _ in range(50):
        lead = text_of(r, r.randint(0, 20), ["a", "b", "s3"])
        batch = winnowing.Batch(pa.array([f"{lead} {shared} {text_of(r, 9, ['c', 's4'])}"]), 1)
        at = batch.windows(10)
        place = [i for i, t in zip(at, batch.texts(at, 10), strict=True) if t == shared.encode()]
        marks.append(int(batch.prints(np.array(place), 10, 10, 5)[0]))
    assert len(set(marks)) == 1


def test_empty_tables(spark):
    none_docs, none_items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert winnowing.shared_windows(none_docs, items).count() == 0
    assert tuple(winnowing.digests(winnowing.shared_windows(docs, none_items)).first())[:4] == (1, 2, 0, 0)
    with pytest.raises(ValueError):
        winnowing.shared_windows(docs, items, span=3, k=4)
