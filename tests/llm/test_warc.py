import glob

import pytest
import zstandard

from evidra.llm import warc

PAGES = [
    (3, "http://a/ b", "<p>same</p>" * 50), (1, None, "<p>same</p>" * 50), (9, "u\r\nX: y", "<p>same</p>" * 50), (4, "u", ""), (2, "u", None),
    (None, "u", "<p>same</p>" * 50), (5, "u", "é\r\n\r\n" * 100), (5, "u", "é\r\n\r\n" * 100), (7, "u", "x" * 3_000_000), (8, None, "P*M\x18\0\0\0\0"),
]


def brute(pages, least=0):
    rows = []
    for page, _, html in pages:
        body = (html or "").encode()
        same = [p for p, _, h in pages if p is not None and (h or "").encode() == body]
        first = min(same) if page is not None and len(body) >= least else page
        revisit = first is not None and page is not None and first < page
        rows.append((page, len(body), warc.payload_digest(body), "revisit" if revisit else "response", first if revisit else None, True))
    return sorted(rows, key=repr)


@pytest.mark.parametrize("least", [0, 600])
def test_archive_round_trip(spark, tmp_path, least):
    folder = str(tmp_path / "out")
    source = spark.createDataFrame([(*p, "clash", 1) for p in PAGES], "page_id long, url string, html string, same string, first int")
    warc.write(source.repartition(2), folder, min_payload=least, sample_bytes=2000)
    got = warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(PAGES, least)


def test_files_are_plain_zstandard_streams(spark, tmp_path):
    folder = str(tmp_path / "out")
    many = spark.createDataFrame([(i, f"http://h/{i}", f"<html>page {i} <p>shared words of all pages</p></html>" * 20) for i in range(300)],
                                 "page_id long, url string, html string")
    warc.write(many.repartition(2), folder)
    records = 0
    for path in glob.glob(f"{folder}/part-*"):
        content = open(path, "rb").read()
        assert content[:4] == warc.DICTIONARY_MAGIC
        known = zstandard.ZstdCompressionDict(content[8:8 + int.from_bytes(content[4:8], "little")])
        with zstandard.ZstdDecompressor(dict_data=known).stream_reader(content, read_across_frames=True) as reader:
            text = reader.read()
        records += text.count(b"WARC/1.1\r\n")
        alone = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in warc.frames(memoryview(content)))
        assert len(content) < alone
    assert records == 300
    assert warc.read(spark, folder).select("url").distinct().count() == 300


def test_empty_table(spark, tmp_path):
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "out"))
    assert warc.read(spark, str(tmp_path / "out")).count() == 0


def test_damaged_records_are_refused():
    record = warc.record_bytes(1, None, b"abc", None)
    with pytest.raises(ValueError):
        warc.parse_record(record[:-6] + record[-4:])
