import base64
import gzip
import hashlib

import pytest

from featurespark.llm.warc import chunked, member, op6_warc, parsed, read_archives, unchunked, write_archives


def brute(pages, least):
    data = [(i, (h or "").encode()) for i, h in pages]
    top = {}
    for i, p in data:
        if len(p) >= least and i is not None:
            top[p] = max(top.get(p, i), i)
    out = []
    for i, p in data:
        first = top.get(p) if sum(q == p for _, q in data) > 1 else None
        again = first is not None and i != first
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        out.append((i, len(p), digest, "revisit" if again else "response", first if again else None, None))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem").collect()), key=repr)


@pytest.mark.parametrize("least", [0, 3])
def test_round_trip(spark, tmp_path, rng, least):
    pages = [(i, rng.choice(["é", "<a>\r\n\r\nWARC/1.1\r\n", "x"]) * rng.choice([0, 1, 2, 50, 900])) for i in range(60)]
    pages += [(100, None), (101, ""), (101, ""), (None, "xx"), (102, "big" * 40000), (102, "big" * 40000), (103, "big" * 40000)]
    df = spark.createDataFrame(pages, "page_id long, html string").selectExpr("*", "'http://x/ y' as url", "1 as digest", "2 as first")
    for n, archive in ((300, 2000), (1 << 14, 8 << 20)):
        path = str(tmp_path / f"{n}")
        write_archives(df.repartition(3), path, least_bytes=least, segment_bytes=n, archive_bytes=archive)
        assert rows_of(read_archives(spark, path)) == brute(pages, least)
    files = list((tmp_path / "300").glob("part-*"))
    assert len(files) > 3
    heads = [h for f in files for h, _, _ in parsed(f.read_bytes())]
    assert {"response", "revisit", "continuation"} == {h["warc-type"] for h in heads}
    assert b"WARC/1.1" in gzip.decompress(files[0].read_bytes())


def test_broken_archives_are_reported(spark, tmp_path):
    def part(i, block, n=None, total=None):
        head = [("WARC-Type", "response" if i == 1 else "continuation"), ("WARC-Record-ID", f"<r:{n}:{i}>"), ("X-Page-ID", n)]
        head += [("WARC-Segment-Number", i), ("WARC-Segment-Origin-ID", f"<r:{n}:1>"), ("WARC-Segment-Total-Length", total)]
        return member(head, block, 1)

    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n0\r\n\r\n"
    data = part(3, http[20:], 1, len(http)) + part(1, http[:9], 1)
    data += part(1, http[:9], 2) + part(2, http[9:], 2, 7)
    data += part(2, http[9:], 3, len(http)) + part(1, http[:9], 3)
    data += member([("WARC-Type", "response"), ("WARC-Record-ID", "<x>"), ("X-Page-ID", 4)], http[:-9], 1)
    data += member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<y>")], b"about", 1)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.warc.gz").write_bytes(data)
    got = {r.page_id: r for r in read_archives(spark, str(tmp_path / "a")).collect()}
    assert got[1].problem.startswith("segments") and got[2].problem.startswith("total") and got[4].problem.startswith("framing")
    assert got[3].problem is None and got[3].payload_bytes == 3 and len(got) == 4


def test_broken_records_and_members_end_no_job(spark, tmp_path):
    def raw(n, head=(), length="x"):
        lines = ["WARC/1.1", "WARC-Type: response", f"WARC-Record-ID: <r:{n}>", f"X-Page-ID: {n}", *head]
        return "\r\n".join([*lines, f"Content-Length: {length}"] if length is not None else lines).encode()

    body = b"HTTP/1.1 200 OK\r\n\r\nabc"
    good = lambda n: raw(n, length=len(body)) + b"\r\n\r\n" + body + b"\r\n\r\n"
    end = b"\r\n\r\n"
    plain = good(1) + raw(2, length=None) + end + good(3) + raw(4) + end + good(5) + raw(6, ["WARC-Segment-Number: two"], 3) + end + b"abc" + end
    plain += raw(7, ["WARC-Segment-Number: 1"], 3).replace(b"WARC-Record-ID: <r:7>\r\n", b"") + end + b"abc" + end + raw(8, length=10**6) + end + b"short"
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.warc").write_bytes(plain)
    (tmp_path / "a" / "y.warc").write_bytes(good(11) + b"WARC/1.1\r\nWARC-Type: response\r\nX-Page-ID: 12")
    zipped = [gzip.compress(good(n)) for n in range(20, 25)]
    zipped[1] = zipped[1][:30] + b"\xff\xff\xff" + zipped[1][33:]
    (tmp_path / "a" / "z.warc.gz").write_bytes(b"".join(zipped)[:-20])
    (tmp_path / "a" / "w.warc.gz").write_bytes(gzip.compress(good(30)) + b"rubbish" + gzip.compress(good(31) + good(32)))
    (tmp_path / "a" / "empty.warc.gz").write_bytes(b"")
    rows = read_archives(spark, str(tmp_path / "a")).collect()
    fine = {r.page_id for r in rows if r.problem is None}
    assert fine == {1, 3, 5, 11, 20, 22, 23, 30, 31, 32} and all(r.payload_bytes == 3 for r in rows if r.problem is None)
    wrong = {r.page_id: r.problem for r in rows if r.problem is not None and r.page_id is not None}
    assert wrong[2] == wrong[4] == "no length" and wrong[6] == "no segment number" and wrong[7] == "no origin" and wrong[8] == "block cut short"
    assert wrong[12] == "header cut short"
    others = [r.problem for r in rows if r.page_id is None or r.page_id in (21, 24)]
    assert "bytes outside members" in others and "member cut short" in others and any(p.startswith("member: ") or p == "member cut short" for p in others)


def test_chunk_framing():
    for n in (0, 1, 4095, 4096, 4097, 10000):
        assert unchunked(chunked(b"a" * n)) == b"a" * n
    assert unchunked(b"2;x=y\r\nab\r\n0\r\nTrailer: 1\r\n\r\n") == b"ab"
    for bad in (b"5\r\nab\r\n0\r\n\r\n", b"zz\r\n", b"2\r\nab", b""):
        with pytest.raises(ValueError):
            unchunked(bad)


def test_query_and_empty(spark, sf, tmp_path):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()]
    assert rows_of(op6_warc(spark, sf)) == brute(pages, 0)
    none = spark.createDataFrame([], "page_id long, url string, html string")
    write_archives(none, str(tmp_path / "e"))
    assert read_archives(spark, str(tmp_path / "e")).count() == 0
