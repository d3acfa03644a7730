"""WARC archives: round trips, the normaliser and its index."""

import gzip
import hashlib
import io
import zlib

import pytest

from halocline.llm import warc
from halocline.storage import scratch_path

PAGE = "page_id long, url string, html string"


def test_round_trip(spark):
    long, other = "ä" * 600, "x" * 999
    rows = [(1, "http://a/", long), (7, "http://b/", long), (3, None, long), (4, "u", other), (5, "u", other), (6, "u v\n", None), (8, "u", ""), (None, "u", long)]
    got = {r.page_id: r for r in warc.archive_round_trip(spark.createDataFrame(rows, PAGE).repartition(3)).collect()}
    assert len(got) == len(rows)
    for page, _, html in rows:
        data = (html or "").encode()
        first = 7 if html == long and page != 7 else None
        assert got[page][1:] == (len(data), hashlib.sha1(data).hexdigest(), "revisit" if first else "response", first)


def test_repeated_page_ids_empty_tables_and_clashing_columns(spark):
    df = spark.createDataFrame([(2, "u", "y" * 1200, "d", 1), (2, "u", "y" * 1200, "d", 1), (1, "u", "y" * 1200, "d", 1)], PAGE + ", digest string, refers int")
    assert sorted((r.page_id, r.record_type) for r in warc.archive_round_trip(df).collect()) == [(1, "revisit"), (2, "response"), (2, "response")]
    assert warc.archive_round_trip(df.limit(0)).collect() == []


def test_files_are_what_they_should_be(spark):
    html = {i: "".join(hashlib.sha1(f"{i}/{k}".encode()).hexdigest() for k in range(200)) for i in range(40)}
    pages = spark.createDataFrame([(i, f"http://h/{i}", t) for i, t in html.items()], PAGE).coalesce(1)
    folder = scratch_path(spark, "warc-test")
    archives = warc.write_archives(pages, folder, file_bytes=40_000)
    assert archives.count() > 1
    normal = warc.normalise(archives)
    for old, new in zip(sorted(archives.collect()), sorted(normal.collect())):
        raw, rewritten = open(old.path, "rb").read(), open(new.path, "rb").read()
        whole = zlib.decompressobj(31)
        text = whole.decompress(raw)
        assert whole.eof and not whole.unused_data  # one member only
        assert gzip.decompress(rewritten) == text
        lines = [x.split(" ") for x in open(new["index"]).read().splitlines()]
        assert len(lines) == old.records == new.records
        for offset, length, kind, name in lines:
            record = zlib.decompress(rewritten[int(offset) : int(offset) + int(length)], 31)
            assert record.startswith(b"WARC/1.1\r\n") and name.encode() in record and kind == "response"
    read = warc.read_archives(normal).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in read} == html


@pytest.mark.parametrize("step", [1, 7, 1000])
def test_records_of_a_stream_in_pieces(step):
    rows = [{"payload": b"\r\n\r\nContent-Length: 3" * n, "payload_bytes": 22 * n, "revisit": False, "page_id": n, "url": "u", "digest": "00" * 20} for n in range(4)]
    records = [warc._record(r) for r in rows]
    data = b"".join(records)
    assert list(warc.split_records(data[i : i + step] for i in range(0, len(data), step))) == records
    with pytest.raises(ValueError, match="inside a record"):
        list(warc.split_records([data[:-1]]))
    with pytest.raises(ValueError, match="not a WARC"):
        list(warc.split_records([b"junk\r\n\r\n"]))


def test_inflating_several_members():
    data = gzip.compress(b"a" * 10**6) + gzip.compress(b"") + gzip.compress(b"b" * 10)
    assert b"".join(warc._inflated(io.BytesIO(data))) == b"a" * 10**6 + b"b" * 10
