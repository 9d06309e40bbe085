from __future__ import annotations

import base64
import hashlib
import random
import re
import struct

import pytest
import zstandard

from shoplens.llm import queries, warc


def brute(rows):
    first = {}
    for i, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", 1 << 62), i)
    out = []
    for i, h in rows:
        b = (h or "").encode()
        f = first.get(h or "")
        rev = f is not None and (i is None or f < i)
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(),
                    "revisit" if rev else "response", f if rev else None))
    return sorted(out, key=str)


def test_query_matches_brute_force(spark):
    got = queries.op1_warc(spark, "/root/testdata/sf0.001").collect()
    rows = [(r.page_id, r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_cases(spark):
    rows = [(1, "http://a/\r\nX: y?ä b", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (4, "u", ""),
            (None, "u", "lonely"), (5, "u", "x" * 3_000_000)]
    pages = spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, refers_to int")
    got = warc.roundtrip(pages).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) \
        == brute([(i, h) for i, _, h in rows])
    assert {r.url for r in got} == {"http://a/\r\nX: y?ä b", None, "u"}
    assert bytes(next(r.payload for r in got if r.page_id == 1)).decode() == "<p>é</p>"


def test_empty_table(spark):
    assert warc.roundtrip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_dictionary_leads_and_frames_are_single():
    records = [warc.build_record(i, f"http://h/{i}", b"<html>page body number %d</html>" % i * 20, None, "2024-01-01T00:00:00Z")
               for i in range(300)]
    archive = warc.build_archive(records)
    assert struct.unpack_from("<I", archive)[0] == warc.DICT_MAGIC
    assert list(warc.iter_frames(archive + warc.EMPTY_SKIP.encode())) == records
    # a compressed dictionary frame is accepted too
    size = struct.unpack_from("<I", archive, 4)[0]
    body = zstandard.compress(archive[8:8 + size])
    again = struct.pack("<II", warc.DICT_MAGIC, len(body)) + body + archive[8 + size:]
    assert list(warc.iter_frames(again)) == records
    with pytest.raises((warc.WarcError, zstandard.ZstdError)):
        list(warc.iter_frames(archive[:-5]))
    with pytest.raises((warc.WarcError, zstandard.ZstdError)):
        list(warc.iter_frames(archive[8 + size:]))            # without its dictionary


@pytest.mark.parametrize("change", [
    lambda r: r.replace(b"WARC/1.1", b"WARC/9.9"), lambda r: r[:-1], lambda r: r.replace(b"Content-Length: ", b"Content-Length: 1"),
    lambda r: r.replace(b"WARC-Type: response\r\n", b""), lambda r: r.replace(b"payload", b"pAyload"),
    lambda r: r.replace(b"WARC-Date:", b"WARC-Date")])
def test_bad_records_are_refused(change):
    record = warc.build_record(1, "u", b"payload", None, "2024-01-01T00:00:00Z")
    assert warc.parse_record(record)["payload"] == b"payload"
    with pytest.raises(warc.WarcError):
        warc.parse_record(change(record))


def test_header_names_in_any_case_and_foreign_ids():
    record = warc.build_record(7, "http://a/", b"hello", None, "2024-01-01T00:00:00Z")
    low = re.sub(rb"(?m)^(WARC-[A-Za-z-]+|Content-Length)(?=: )", lambda m: m[1].lower(), record, count=0)
    head, sep, rest = low.partition(b"\r\n\r\n")
    assert warc.parse_record(head + sep + record.partition(sep)[2]) == warc.parse_record(record)
    foreign = record.replace(b"<urn:x-page:7>", b"<urn:uuid:92283950-ef2f-4d72-b224-f54c6ec90bb0>")
    assert foreign != record
    with pytest.raises(warc.WarcError, match="no id of a page"):
        warc.parse_record(foreign)


def test_frames_longer_than_a_piece():
    rng = random.Random(5)
    records = [rng.randbytes(n) for n in (10, warc.PIECE - 1, warc.PIECE, 3 * warc.PIECE + 5, 0, 200_000, 1)]
    archive = warc.build_archive(records)
    assert list(warc.iter_frames(archive)) == records
    with pytest.raises(warc.WarcError):
        list(warc.iter_frames(archive[:-1]))
