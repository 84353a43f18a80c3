import base64
import gzip
import hashlib
import io

import pytest

from hashwood.llm import op7_warc as W


def brute(rows):
    raw = [(p, (h or "").encode()) for p, _, h in rows]
    out = []
    for p, b in raw:
        newest = max((q for q, c in raw if c == b and q is not None), default=None)
        again = newest is not None and p != newest
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", newest if again else None))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rows = [(i, f"http://x/{i}", f"<p>é {i % 7}</p>" * (i % 5)) for i in range(60)]
    rows += [(100, None, None), (101, "u\r\nX: y", "<b>" + "é" * 200_000), (None, "n", "<p>é 1</p>"), (None, "n", "only here"), (7, "again", rows[7][2]), (59, "tie", rows[59][2]), (102, "", "x" * W.CHUNK), (103, "", "x" * (W.CHUNK + 1))]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, refers_to int").repartition(4)
    got = sorted((tuple(r)[:5] for r in W.archive(pages).collect()), key=str)
    assert got == brute(rows)
    assert W.archive(pages.limit(0)).count() == 0


def test_least_size(spark):
    pages = spark.createDataFrame([(1, "", "ab"), (2, "", "ab"), (3, "", "abcd"), (4, "", "abcd")], "page_id long, url string, html string")
    assert sorted((r.page_id, r.record_type) for r in W.archive(pages, min_bytes=3).collect()) == [(1, "response"), (2, "response"), (3, "revisit"), (4, "response")]


def test_file_round_trip():
    payload = b"<p>" + b"y" * 150_000
    rows = [*W.record_chunks("0", W.header_block(1, "http://a", W.base32(hashlib.sha1(payload).digest()), len(payload), None), payload, 1000), *W.record_chunks("1", W.header_block(0, "http://b", W.base32(hashlib.sha1(payload).digest()), len(payload), 1), b"", 1000)]
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb") as file:
        W.write_file(rows, file)
    back = list(W.read_file(gzip.GzipFile(fileobj=io.BytesIO(out.getvalue())), 1000))
    assert back == rows
    found = list(W.joined_records(back))
    assert [(r["page_id"], r["payload_bytes"], r["refers_to"]) for r in found] == [(1, len(payload), None), (0, len(payload), 1)]
    back[5]["data"] = b"z" * 1000
    with pytest.raises(ValueError, match="damaged"):
        list(W.joined_records(back))
    for gone, words in ((len(rows) - 2, "end is missing"), (3, "chunk 3 is missing")):
        with pytest.raises(ValueError, match=words):
            list(W.joined_records([r for i, r in enumerate(rows) if i != gone]))
