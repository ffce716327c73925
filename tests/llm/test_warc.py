import base64
import gzip
import hashlib
import uuid
from collections import defaultdict

import pytest

from kinscribe.llm import warc as W
from kinscribe.llm.common import checkpoint_folder
from kinscribe.llm.queries import op13_warc, table

SF = "/root/testdata/sf0.01"


def brute(rows):
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of (page_id, url, html)."""
    by = defaultdict(list)
    for page_id, _, html in rows:
        by[(html or "").encode()].append(page_id)
    for payload, ids in by.items():
        first = max((x for x in ids if x is not None), default=None)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        for x in ids:
            again = first is not None and x != first
            yield x, len(payload), digest, "revisit" if again else "response", first if again else None


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, id string, number int").repartition(3)


def round_trip(spark, rows, **k):
    got = [tuple(r) for r in W.archive_round_trip(pages_of(spark, rows), **k).collect()]
    assert all(r[5] is None for r in got)
    return sorted((r[:5] for r in got), key=repr)


@pytest.mark.parametrize("segment, chunk", [(32 << 10, 8 << 10), (120, 7), (200, 1000)])
def test_round_trip_equals_brute_force(spark, segment, chunk):
    torn = "before\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "http://a/", "same"), (9, None, "same"), (4, "u\r\nX: y", "same"), (2, "", None), (3, "http://b", ""), (5, "c", torn), (6, "c", torn + "!")]
    rows += [(7, "d", "ä€𝄞" * 300), (8, "e", "\r\n\r\n0\r\n\r\n" * 50), (None, "n", "alone"), (None, "n", "same"), (9, None, "same"), (10, "x", "y" * 5000), (10, "x", "y" * 5000), (11, "x", "y" * 5000)]
    assert round_trip(spark, rows, segment_bytes=segment, chunk_bytes=chunk) == sorted(brute(rows), key=repr)


def test_whole_table_and_empty_one(spark):
    rows = [tuple(r) for r in table(spark, SF, "pages").select("page_id", "url", "html").collect()]
    got = sorted((tuple(r) for r in op13_warc(spark, SF).collect()), key=repr)
    assert got == sorted(brute(rows), key=repr) and len(got) == len(rows)
    assert round_trip(spark, []) == []


def archive(spark, *records):
    """A folder with one archive file of the given bytes."""
    folder = f"{checkpoint_folder(spark)}/hand-{uuid.uuid4().hex}"
    spark.createDataFrame([(r[:-1],) for r in records], "r binary").coalesce(1).selectExpr("cast(r as string)").write.option("compression", "gzip").text(folder)
    return folder


def read(spark, *records):
    folder = archive(spark, *records)
    return [tuple(r) for r in W.read_pages(spark, folder, folder + "-scratch").collect()]


def segments(n=3, **k):
    return W.page_records(5, "u", "z" * 400, None, "00000000-0000-0000-0000-000000000001", 200, 64)


def test_broken_archives_name_their_problem(spark):
    parts = segments()
    assert len(parts) > 2
    whole = (5, 400, W.digest_of(b"z" * 400), "response", None, None)
    assert read(spark, *parts) == read(spark, *parts[::-1]) == [whole]
    lost = read(spark, parts[0], *parts[2:])
    assert [x[5] for x in lost] == ["a segment is missing or repeated"] and lost[0][:3] == (5, None, None)
    assert [x[5] for x in read(spark, *parts[:-1])] == ["no total length"]
    wrong = parts[-1].replace(b"Total-Length: ", b"Total-Length: 1")
    assert [x[5] for x in read(spark, *parts[:-1], wrong)] == ["segments do not add up to the total length"]
    other = W.page_records(6, "u", "right", None, "00000000-0000-0000-0000-000000000002", 999, 9)[0]
    assert read(spark, other.replace(b"right", b"wrong"))[0][5] == "the payload has another digest"
    assert read(spark, W.page_records(7, "u", "gone", 6, "00000000-0000-0000-0000-000000000003", 9, 9)[0], other)[1][5] == "the page referred to has another payload or none"


def test_chunked_framing():
    for payload in (b"", b"a", b"\r\n" * 9, bytes(range(256)) * 5):
        for size in (1, 3, 4096):
            assert W.unchunked(W.chunked(payload, size)) == payload
    assert W.unchunked(b"3;name=x\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for broken in (b"", b"3\r\nab", b"x\r\n", b"3\r\nabc\r\n0\r\n", b"3\r\nabcd\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            W.unchunked(broken)


def test_files_are_plain_archives(spark):
    folder = f"{checkpoint_folder(spark)}/plain-{uuid.uuid4().hex}"
    W.write_archives(pages_of(spark, [(1, "http://a/", "abc" * 100), (2, "http://b/", "abc" * 100)]), folder, 100, 50)
    raw = b"".join(gzip.decompress(r.content) for r in spark.read.format("binaryFile").load(folder).collect())
    kinds = defaultdict(int)
    while raw:
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.split(b"\r\n")
        assert lines[0] == b"WARC/1.1"
        fields = dict(x.split(b": ", 1) for x in lines[1:])
        n = int(fields[b"Content-Length"])
        assert rest[n : n + 4] == b"\r\n\r\n"
        kinds[fields[b"WARC-Type"]] += 1
        raw = rest[n + 4 :]
    assert kinds[b"response"] == kinds[b"revisit"] == 1 and kinds[b"continuation"] >= 3
