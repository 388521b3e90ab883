import base64
import hashlib

import pytest

from codewarden.llm import warc


def _pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], "page_id long, url string, html string, sha string, first string, archive string")


ROWS = [
    (5, "http://a/", "<p>same</p>"), (3, "http://b/\r\nX: y", "<p>same</p>"), (4, None, None), (2, "http://c/", ""), (9, "u", "ö" * 300_000),
    (None, "http://d/", "<p>same</p>"), (3, "http://b/", "<p>same</p>"), (11, "http://e/", "only"),
]


def test_round_trip(spark):
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.problem) for r in warc.round_trip(_pages(spark, ROWS)).collect()), key=str)
    want = []
    for page_id, _, html in ROWS:
        data = (html or "").encode()
        first = min(i for i, _, h in ROWS if (h or "") == (html or "") and i is not None)
        again = page_id is None or page_id > first
        want.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first if again else None, None))
    assert got == sorted(want, key=str)


def test_small_payloads_are_all_responses(spark):
    kinds = {r.record_type for r in warc.round_trip(_pages(spark, ROWS), min_revisit_bytes=10**9).collect()}
    assert kinds == {"response"}


def test_files_keep_payloads(spark, tmp_path):
    warc.write_files(warc.archives(_pages(spark, ROWS)), str(tmp_path))
    got = warc.read(warc.read_files(spark, f"{tmp_path}/*.warc.gz"), keep_payload=True).collect()
    assert {(r.page_id, bytes(r.payload).decode()) for r in got if r.record_type == "response"} == {(3, "<p>same</p>"), (2, ""), (9, "ö" * 300_000), (11, "only")}


def test_empty_table(spark):
    assert warc.round_trip(_pages(spark, [])).count() == 0


def _archive():
    return warc.record(1, "u", b"abc" * 50_000, None, False, "d") + warc.record(2, "u", b"xyz", 1, True, "d")


@pytest.mark.parametrize("size", [1, 7, 1000, 10**6])
def test_reader_takes_any_blocks(size):
    data = _archive()
    found = list(warc.Reader((data[i : i + size] for i in range(0, len(data), size)), keep_payload=True))
    assert [(f["page_id"], f["payload_bytes"], f["record_type"], f["refers_to"]) for f in found] == [(1, 150_000, "response", None), (2, 3, "revisit", 1)]
    assert found[0]["payload"] == b"abc" * 50_000


def test_reader_reports_damage(spark):
    import zlib

    good = _archive()
    plain = zlib.decompress(warc.record(1, "u", b"abc", None, False, "d"), 31)
    pack = lambda b: (lambda c: c.compress(b) + c.flush())(zlib.compressobj(6, zlib.DEFLATED, 31))
    broken = {
        "cut": good[:-30], "digest": pack(plain.replace(b"abc\r\n", b"abd\r\n")), "short": pack(plain[:-6]), "long": pack(plain + b"more"),
        "no length": pack(plain.replace(b"\r\nContent-Length: ", b"\r\nX: ", 1)), "no version": pack(b"HELLO\r\n\r\n"), "noise": b"noise" * 10,
    }
    rows = [(i, 0, bytes(data)) for i, data in enumerate(broken.values())]
    got = warc.read(spark.createDataFrame(rows, "archive long, block int, data binary")).where("problem IS NOT NULL").collect()
    assert len(got) == len(broken)
