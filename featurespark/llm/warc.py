"""WARC archives: writing with segments, and reading with segment reassembly (operator 6).

Writing. Pages with equal payloads (SHA-1) of at least ``least_bytes`` have one response record, that of the largest
page_id; the others are revisit records that refer to it. A response block is an HTTP message in chunked transfer
framing. Blocks over ``segment_bytes`` are segmented: the first record carries WARC-Segment-Number 1, continuation
records name it in WARC-Segment-Origin-ID, the last states WARC-Segment-Total-Length. Records are gzip members of their
own, gathered into archive files of about ``archive_bytes``, written by Spark's text writer (one row is one file, with
a zero byte as line end, which gzip readers take for padding), so the output is committed as any Spark table, on any
file system Spark can write, and a lost task is written anew.

Reading. Files come in as binary rows; a task parses records by Content-Length, wherever they were cut. Whole records
are decoded where they are read. Only segmented ones are shuffled: grouped by origin, ordered by number, checked for
gaps and for the total length, joined and decoded. Revisits get their payload's size from the record they refer to.

A group of equal payloads may hold any share of all pages: only (page_id, digest) meets in the group's aggregate, which
combines before the shuffle, and joins on it can be split where one key is large. Only repeated payloads (and the few that
a Bloom filter takes for such) are shuffled.

Defined results: null html is an empty payload; pages of one page_id are separate records, equal ones included, and a
revisit refers to the largest page_id; equal rows of that page_id are all responses; a null page_id is read back as null; an empty table gives no archives and no
rows. Bad framing, gaps, lengths or segment numbers, records and gzip members cut short, and bytes outside members are
listed in ``problem`` instead of being dropped or ending the job: what is known of the record stands in the row's other
columns, and reading goes on with the next record or member.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurespark.ship import ship

from .bloom import perhaps
from .common import drop_written, map_rows, names, shared_dir, written

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def chunked(payload: bytes, size: int = 4096) -> bytes:
    """Chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(x), x) for x in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(framed: bytes) -> bytes:
    """The payload of chunked transfer framing; chunk extensions and trailers are allowed. ValueError if it is broken."""
    at, parts = 0, []
    while True:
        end = framed.index(b"\r\n", at)
        size = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            break
        if len(framed) < at + size + 2 or framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk cut short")
        parts.append(framed[at : at + size])
        at += size + 2
    if framed[at:] != b"\r\n" and not framed.endswith(b"\r\n\r\n"):
        raise ValueError("no end of chunks")
    return b"".join(parts)


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP message."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(headers: list[tuple[str, object]], block: bytes, level: int) -> bytes:
    """A record as one gzip member."""
    lines = [f"{k}: {v}" for k, v in headers if v is not None] + [f"Content-Length: {len(block)}"]
    head = ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode()
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(head) + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def records(page: tuple, name: str, segment_bytes: int, level: int) -> Iterator[bytes]:
    """The gzip members of a page (page_id, url, html, hex digest, page referred to); name is unique to its row.

    WARC-Concurrent-To holds the name of the page, which WARC-Refers-To of its revisits uses.
    """
    page_id, url, html, digest, refers_to = page
    head = [("WARC-Date", "2024-01-01T00:00:00Z"), ("X-Page-ID", page_id), ("WARC-Concurrent-To", f"<urn:page:{page_id}>")]
    head += [("WARC-Target-URI", "".join((url or "").split()) or None)]
    head += [("WARC-Payload-Digest", f"sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")]
    if refers_to is not None:
        own = [("WARC-Type", "revisit"), ("WARC-Record-ID", f"<urn:record:{name}>")]
        own += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        yield member([*own, *head, ("WARC-Refers-To", f"<urn:page:{refers_to}>")], b"", level)
        return
    block = HTTP + chunked(html or b"")
    cuts = range(0, len(block), segment_bytes)
    for i, at in enumerate(cuts, 1):
        own = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:record:{name}>")]
        if i > 1:
            own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:record:{name}:{i}>")]
            own += [("WARC-Segment-Origin-ID", f"<urn:record:{name}>")]
        if len(cuts) > 1:
            own += [("WARC-Segment-Number", i)]
            own += [("WARC-Segment-Total-Length", len(block))] * (i == len(cuts))
        own += [("Content-Type", "application/http; msgtype=response")]
        yield member(own + head, block[at : at + segment_bytes], level)


def write_archives(
    pages: DataFrame,
    path: str,
    least_bytes: int = 0,
    segment_bytes: int = 16 << 10,
    archive_bytes: int = 8 << 20,
    level: int = 1,
) -> None:
    """Writes pages (page_id, url, html) as archive files below path."""
    ship(pages.sparkSession)
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"))
    pages = pages.withColumn("digest", F.sha1("html"))
    largest = pages.filter(F.octet_length("html") >= least_bytes).groupBy("digest")
    largest = written(largest.agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    repeated = perhaps(largest.select("digest"))(F.col("digest"))  # payloads that occur once stay where they are
    pages = pages.filter(repeated).join(largest, "digest", "left").unionByName(pages.filter(~repeated).withColumn("first", F.lit(None).cast("long")))
    other = (F.octet_length("html") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    pages = pages.withColumn("refers_to", F.when(other, F.col("first")))
    pages = pages.withColumn("html", F.when(F.col("refers_to").isNull(), F.col("html")))

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def file() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"value": pa.array([b"".join(held)], pa.binary())})

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for page in zip(*[c.to_pylist() for c in batch.slice(at, 64).columns], strict=True):
                    n += 1
                    for x in records(page, f"{part}.{n}", segment_bytes, level):
                        held.append(x)
                        size += len(x)
                        if size >= archive_bytes:
                            yield file()
                            held, size = [], 0
        if held:
            yield file()

    out = pages.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(files, "value binary")
    out.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)
    drop_written(largest)


def members(content: bytes) -> Iterator[tuple[bytes, str | None]]:
    """Parts of an archive file that are whole by themselves: its gzip members, or all of a plain one; and what is wrong.

    After a broken member reading goes on where the next one seems to begin.
    """
    if content[:2] != b"\x1f\x8b":
        yield content, None
        return
    view, at = memoryview(content), 0
    while at < len(content):
        begun = content.find(MAGIC, at)
        between = content[at : begun if begun >= 0 else len(content)]
        if between.strip(b"\0"):
            yield b"", "bytes outside members"
        if begun < 0:
            return
        unpack, out, problem, at = zlib.decompressobj(31), [], None, begun
        try:
            while not unpack.eof and at < len(content):
                out.append(unpack.decompress(view[at : at + (1 << 16)]))
                at = min(at + (1 << 16), len(content))
            at -= len(unpack.unused_data)
            if not unpack.eof:
                problem = "member cut short"
        except zlib.error as e:
            problem = f"member: {e}"
        if problem:
            at = content.find(MAGIC, begun + 1)
            at = at if at >= 0 else len(content)
        yield b"".join(out), problem


MAGIC = b"\x1f\x8b\x08"


def parsed(content: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """Headers (lower-case names), block, and what is wrong, of each record of an archive file, plain or in gzip members.

    A record of broken length has an empty block; bytes in which no record begins are one without headers.
    """
    for data, broken in members(content):
        f, some = io.BytesIO(data), False
        while line := f.readline():
            if not line.startswith(b"WARC/"):
                continue  # the empty lines after a record
            head, some, problem = {}, True, broken
            while (line := f.readline()).strip():
                name, _, value = line.decode("utf-8", "replace").partition(":")
                head[name.strip().lower()] = value.strip()
            length = head.get("content-length", "")
            block = b""
            if not line:
                problem = problem or "header cut short"
            elif not (length.isascii() and length.isdigit()):
                problem = problem or "no length"
            else:
                block = f.read(int(length))
                if len(block) < int(length):
                    problem = problem or "block cut short"
            yield head, block, problem
        if broken and not some:
            yield {}, b"", broken


def _number(text: str | None) -> int | None:
    digits = (text or "").rpartition(":")[2].strip("<> ")
    return int(digits) if digits.lstrip("-").isdigit() else None


def _decoded(block: bytes, digest: str | None) -> tuple[int | None, str | None, str | None]:
    """Length and digest of the payload, and what is wrong with it."""
    try:
        payload = payload_of(block)
    except ValueError as e:
        return None, None, f"framing: {e}"
    own = sha1_base32(payload)
    return len(payload), own, None if digest in (None, own) else "digest differs"


PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, problem string"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per page of the archives below path: the columns of PAGE."""
    ship(spark)
    content = spark.read.format("binaryFile").load(path).select("content")
    kept = f"{PAGE}, origin string, segment int, total long, block binary, broken boolean"
    kind = pa.schema(
        [(n, {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}[t]) for n, t in
         (x.split() for x in kept.split(", "))]
    )

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                for head, block, broken in parsed(batch.column(0)[i].as_py()):
                    kind_of, segment = head.get("warc-type"), head.get("warc-segment-number")
                    if kind_of not in ("response", "revisit", "continuation") and not broken:
                        continue
                    page, digest = _number(head.get("x-page-id")), head.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    origin = head.get("warc-segment-origin-id") or head.get("warc-record-id")
                    if segment is not None and not broken:
                        broken = "no segment number" if not (segment.isascii() and segment.isdigit()) else "no origin" if not origin else None
                    if broken:  # a part of a segmented record is missed where its other parts are put together
                        row = (page, None, digest, kind_of, None, broken, None, None, None, None, True)
                    elif kind_of == "revisit":
                        row = (page, None, digest, kind_of, _number(head.get("warc-refers-to")), None, None, None, None, None, False)
                    elif segment is None:
                        n, own, problem = _decoded(block, digest)
                        row = (page, n, own, "response", None, problem, None, None, None, None, False)
                    else:
                        total = _number(head.get("warc-segment-total-length"))
                        row = (page, None, digest, "response", None, None, origin, int(segment), total, block, False)
                        size += len(block)
                    rows.append(row)
                    if len(rows) >= 4096 or size >= 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

    def assemble(columns: list[list]) -> dict:
        out = []
        for (parts,) in zip(*columns, strict=True):
            first, total = parts[0], parts[-1]["total"]
            block = b"".join(p["block"] for p in parts)
            n, own, problem = _decoded(block, first["payload_digest"])
            if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)):
                problem = "segments missing or repeated"
            elif total != len(block):
                problem = "total length differs"
            out.append((first["page_id"], n, own, "response", None, problem))
        return dict(zip(names(PAGE), zip(*out, strict=True), strict=True))

    rows = written(content.mapInArrow(parse, kept))
    part = F.struct("segment", "total", "page_id", "payload_digest", "block")
    grouped = rows.filter("segment is not null").groupBy("origin").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    joined = map_rows(grouped.select("parts"), assemble, PAGE, rows=16)
    wrong = rows.filter("broken").select(names(PAGE))
    whole = rows.filter("not broken and segment is null and record_type = 'response'").select(names(PAGE)).unionByName(joined)
    again = rows.filter("not broken and record_type = 'revisit'").select("page_id", "payload_digest", "record_type", "refers_to")
    source = whole.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    again = again.join(source, ["refers_to", "payload_digest"], "left")
    again = again.withColumn("problem", F.when(F.col("payload_bytes").isNull(), "no response with this digest"))
    return whole.unionByName(again).unionByName(wrong)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back."""
    path = shared_dir(spark)
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


QUERIES = {"op6_warc": op6_warc}
ORACLES: dict[str, str] = {}
