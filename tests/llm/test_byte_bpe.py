import hashlib

import public_tokenizers
import pytest
import tiktoken  # noqa: F401
from tokenizers import Tokenizer

from evidra.llm import byte_bpe
from tests.conftest import rows

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    (1, "Hello world's  end\n\n x"), (2, ""), (3, None), (None, "no id"), (5, "a" * 3000 + " b  c\n\td" * 400), (5, "a" * 3000 + " b  c\n\td" * 400),
    (7, " " * 700 + "x"), (8, "åß中文😀 don't " * 300), (9, "0123456789" * 200 + "!?" * 900), (10, "'ll've's" * 300),
]


@pytest.mark.parametrize(("chunk", "overlap"), [(100000, 10), (256, 32), (97, 11)])
def test_chunks_give_the_ids_of_the_whole_text(docs_of, chunk, overlap):
    coder = byte_bpe.encoding(PATH)
    got = byte_bpe.digests(byte_bpe.encode(docs_of(TEXTS), PATH, chunk=chunk, overlap=overlap), PATH)
    want = []
    for key, text in TEXTS:
        ids = coder.encode_ordinary(text or "")
        hexed = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want.append((key, len(ids), hexed, hashlib.sha256((text or "").encode()).hexdigest()))
    assert rows(got) == sorted(want, key=repr)


def test_empty_table(docs_of):
    assert byte_bpe.encode(docs_of([]), PATH).count() == 0


def test_very_long_runs_of_white_space(docs_of):
    got = rows(byte_bpe.digests(byte_bpe.encode(docs_of([(1, " " * 300_000 + "b")]), PATH, chunk=500_000), PATH), "decoded_sha256")
    assert got == [(hashlib.sha256(b" " * 300_000 + b"b").hexdigest(),)]


def test_json_vocabulary_equals_its_tokenizer():
    path = public_tokenizers.path("byte_bpe_50k.json")
    other, coder = Tokenizer.from_file(path), byte_bpe.encoding(path)
    other.encode_special_tokens = True
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and c % 7 == 0]
    texts = [t or "" for _, t in TEXTS] + ["x" + chr(c) + "1 " + chr(c) + " .z  " + chr(c) + "\n" + chr(c) for c in points]
    assert [e.ids for e in other.encode_batch(texts, add_special_tokens=False)] == [coder.encode_ordinary(t) for t in texts]
