import gzip
import hashlib

from veilspark.llm import warc


def test_round_trip(spark):
    body = "<html>" + "é" * 60 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\n" + "</html>\r\n\r\n"
    rows = [(i, f"http://a.example/{i}?q=1#f", body if i % 3 == 0 else f"page {i}\n" * i) for i in range(40)]
    rows += [(50, None, None), (51, "http://b.example", ""), (52, "x\r\ny", "short"), (53, "http://c/", "short"), (7, "http://a.example/7?q=1#f", "page 7\n" * 7), (None, "http://n/", body), (60, "http://d/", "\n" * 500), (61, "http://e/", "z" * 300_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, type int")
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_round_trip(df).collect())
    first = {}
    for i, _, h in rows:
        if h and len(h.encode()) >= 100 and i is not None:
            first[h] = min(first.get(h, i), i)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        refers = first.get(h) if len(data) >= 100 and first[h] != i else None
        want.append((str(i), len(data), hashlib.sha256(data).hexdigest(), "revisit" if refers is not None else "response", refers))
    assert got == sorted(want, key=lambda r: r[:4])


def test_assembly_links_both_ways_and_through_a_record(spark):
    cols = "type string, record_id string, concurrent_to array<string>"
    df = spark.createDataFrame([("response", "r1", []), ("request", "q1", ["r1"]), ("metadata", "m1", ["q1"]), ("response", "r2", ["q2"]), ("request", "q2", []), ("revisit", "r3", []), ("request", "q9", ["gone"])], cols)
    got = {r.main.record_id: (r.request and r.request.record_id, r.metadata and r.metadata.record_id) for r in warc.assemble(df).collect()}
    assert got == {"r1": ("q1", "m1"), "r2": ("q2", None), "r3": (None, None)}


def test_reader_takes_other_archives(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n\xff\x00\n\r\n\r\nbinary"
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block)
    empty = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <b>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(empty))
    got = {r.record_id: r for r in warc.read(spark, str(tmp_path)).collect()}
    assert bytes(got["<a>"].payload) == b"\xff\x00\n\r\n\r\nbinary"
    assert got["<b>"].payload_bytes == 0


def test_empty(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
