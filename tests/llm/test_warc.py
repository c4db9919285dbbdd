"""Archives: every record read back, by stream and by index; nulls, copies, ties and repeats against brute force."""

import base64
import hashlib
import io
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from prosegauge.llm import warc as W

SCHEMA = "page_id long, url string, html string, payload string, sha1 string, n_bytes int"
BIG = "<p>" + "long text é " * 200_000


def pages():
    rows = [(i, f"http://a/{i}", f"<html><body><p>page number {i % 23} of {'many ' * (i % 23)}</p>") for i in range(160)]
    rows += [(200, "http://a/x y\r\nWARC-Type: none", "same"), (201, None, "same"), (None, "http://n", "same"), (None, None, None), (300, "u", None), (301, "u", ""), (302, "u", "")]
    rows += [(400, "z", "twice"), (400, "z", "twice"), (400, "a", "twice"), (399, "z", "twice")]
    rows += [(None, "u", "no id at all"), (None, "v", "no id at all"), (500, "http://long", BIG), (501, "http://crlf", "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n")]
    return [(*r, "clash", "clash", 1) for r in rows]


def expected(rows, least=0):
    groups, out = {}, []
    for page, url, html, *_ in rows:
        groups.setdefault((html or "").encode(), []).append((page, url))
    for payload, members in groups.items():
        ordered = sorted(members, key=lambda m: (m[0] is not None, m[0] or 0, m[1] is not None, m[1] or ""))
        sha1 = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        for k, (page, _) in enumerate(ordered):
            response = len(payload) < least or k == len(ordered) - 1
            out.append((page, len(payload), sha1, "response" if response else "revisit", None if response else ordered[-1][0]))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


@pytest.mark.parametrize(("parts", "least"), [(1, 0), (5, 0), (3, 5)])
def test_records_against_brute_force(spark, parts, least):
    rows = pages()
    assert rows_of(W.archived(spark.createDataFrame(rows, SCHEMA).repartition(parts), least)) == expected(rows, least)


def test_very_many_copies_of_one_row(spark, monkeypatch):
    monkeypatch.setattr(W, "COPIES_AT_ONCE", 7)
    rows = [(1, "u", "copy", "", "", 1)] * 50 + [(2, "u", "other", "", "", 1)] * 8
    assert rows_of(W.archived(spark.createDataFrame(rows, SCHEMA).repartition(3))) == expected(rows)


def test_files_index_and_names(spark, tmp_path):
    rows = pages()
    manifest, index = W.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(3), str(tmp_path / "w"), file_bytes=2000)
    assert manifest.count() > 3 and manifest.agg(F.sum("records")).first()[0] == len(rows)
    assert rows_of(W.read_archives(manifest)) == expected(rows)
    found = index.collect()
    ids = set()
    for r in found:
        raw = W.record_at(r["path"], r["start"], r["size"])
        assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
        fields = W._fields(raw.split(b"\r\n\r\n")[0].split(b"\r\n")[1:])
        ids.add(fields["warc-record-id"])
        assert fields["warc-type"] == r["type"]
    assert len(ids) == len(rows)


def test_layout_of_a_file(spark, tmp_path):
    manifest, _ = W.write_archives(spark.createDataFrame(pages(), SCHEMA).coalesce(1), str(tmp_path / "w"))
    path = manifest.orderBy(F.desc("records")).first()["path"].removeprefix("file://")
    raw = open(path, "rb").read()
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == 0x184D2A5D and raw[8 + size : 12 + size] == W.FRAME
    dictionary = W.read_dictionary(io.BytesIO(raw))
    assert zstandard.ZstdCompressionDict(dictionary).dict_id()  # a trained one
    # A record needs the dictionary: without it the frame does not decompress.
    with pytest.raises(zstandard.ZstdError):
        zstandard.ZstdDecompressor().decompressobj().decompress(raw[8 + size :])


def test_a_changed_payload_is_noticed():
    page = {"page_id": 1, "url": None, "payload": "abc", "n_bytes": 3, "sha1": hashlib.sha1(b"abd").digest(), "response": True, "shared": True, "refers_to": None}
    raw = W._dictionary_frame(b"") + zstandard.compress(W.record(page, "0"))
    with pytest.raises(ValueError, match="is not what its record says"):
        list(W.records(io.BytesIO(raw)))


def test_empty_and_tiny(spark):
    assert W.archived(spark.createDataFrame([], SCHEMA)).collect() == []
    one = [(7, "u", "x", "", "", 1)]
    assert rows_of(W.archived(spark.createDataFrame(one, SCHEMA))) == expected(one)
