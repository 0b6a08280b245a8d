import gzip
import json
import zlib
from pathlib import Path

import pytest

from assayer.llm import archives


def pages(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], "page_id bigint, url string, html string, payload int, digest string")


ROWS = [(1, "http://a.b/c d\r\nX: y", "<p>é</p>\r\n\r\nWARC/1.1\r\n"), (2, "http://a", "same"), (3, None, "same"), (9, "http://c", "same"), (4, "http://d", None), (5, "http://e", ""), (6, "http://f", "x" * 3_000_000),
        (None, "http://g", "only"), (7, "http://h", "lone"), (7, "http://h", "lone")]


def test_round_trip(spark):
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in archives.archive_round_trip(pages(spark, ROWS)).collect()]
    last = {}
    for key, _, html in ROWS:
        last[html or ""] = max(last.get(html or "", -1), -1 if key is None else key)
    want = [(k, len((h or "").encode()), archives.payload_digest((h or "").encode()), *(("response", None) if k is None or last[h or ""] == k else ("revisit", last[h or ""]))) for k, _, h in ROWS]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_files_and_offsets(spark, tmp_path):
    written = archives.write_archives(pages(spark, ROWS), f"file://{tmp_path}/raw")
    index = archives.normalise(written, f"file://{tmp_path}/members")
    whole = b""
    for path in sorted(tmp_path.glob("raw/*.gz")):
        machine = zlib.decompressobj(31)
        whole += machine.decompress(path.read_bytes())
        assert machine.eof and not machine.unused_data  # one member per file
    parts = b""
    for path in tmp_path.glob("members/*.gz"):
        lines = [json.loads(x) for x in Path(f"{path}.index").read_text().splitlines()]
        raw = path.read_bytes()
        assert sum(x["length"] for x in lines) == len(raw)
        for line in lines:
            member = gzip.decompress(raw[line["offset"]:line["offset"] + line["length"]])
            assert archives.parse(member)[0]["warc-record-id"] == line["record_id"]
            parts += member
    assert sorted(whole.split(b"WARC/1.1")) == sorted(parts.split(b"WARC/1.1")) and index.count() == len(ROWS)


def test_streams_of_many_members_and_cut_files(tmp_path):
    made = [archives.record(i, "http://a", b"p" * i, "D", None) for i in range(1, 40)]
    (tmp_path / "a.gz").write_bytes(b"".join(gzip.compress(b"".join(made[i:i + 5])) for i in range(0, 39, 5)))
    with archives._open(str(tmp_path / "a.gz"), "read") as stream:
        assert list(archives.records(archives.inflated(stream))) == made
    (tmp_path / "b.gz").write_bytes(gzip.compress(b"".join(made)[:-30]))
    with archives._open(str(tmp_path / "b.gz"), "read") as stream, pytest.raises(ValueError):
        list(archives.records(archives.inflated(stream)))


def test_empty_table(spark):
    assert archives.archive_round_trip(pages(spark, [])).collect() == []


def test_ids_named_none_and_null_ids(spark):
    rows = [("None", "u", "same"), (None, "u", "same"), ("!", "u", "other"), (None, "u", "other"), (None, None, None), (None, None, "alone"), ("a b/c", "u", "")]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    got = sorted(((r.page_id or "~", r.payload_bytes, r.record_type, r.refers_to) for r in archives.archive_round_trip(pages).collect()))
    assert got == sorted([("None", 4, "response", None), ("~", 4, "revisit", "None"), ("!", 5, "response", None), ("~", 5, "revisit", "!"), ("~", 0, "revisit", "a b/c"), ("~", 5, "response", None), ("a b/c", 0, "response", None)])
