"""WARC archives: writing with revisits, segments and chunked framing; reading with reassembly.

Archives are written by Spark's text writer (records end in CRLF CRLF, files are compressed as a whole and
hold at most ``records`` records of at most ``segment`` bytes each), so any file system that Spark knows
will do. A block longer than ``segment`` bytes becomes a response record and continuation records with
WARC-Segment-Origin-ID, WARC-Segment-Number and, on the last, WARC-Segment-Total-Length. Cuts, of chunks and
of segments, fall between characters. Readers frame records by Content-Length alone. Segments are dealt by origin and by
the copy of it that they are of (rows that repeat have one origin, but each write has its own WARC-Segment-Copy), sorted by number, and
joined as they stream by: no task holds more than one page's block. A segment that is missing, or a total
length that is wrong, is an error.

Of records with equal payloads of at least ``least`` bytes, that of the smallest page is the response, the
others revisit it; smaller payloads are always responses. Equality is that of SHA-256.

Cases: null html is an empty payload; null urls have no WARC-Target-URI; rows that repeat a page with the
same payload are as many records, none a revisit of the other; an empty table writes no record.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import fresh, written

SEGMENT = 1 << 16
CHUNK = 1 << 13
RECORDS = 4000
LEAST = 100
MOST_FIRSTS = 500_000
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def cut(data: bytes, size: int) -> list[bytes]:
    """data in parts of at most size bytes (at least 4), none ending within a character."""
    out, at = [], 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80 and end > at + size - 4:
            end -= 1
        out.append(data[at:end])
        at = end
    return out


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    return b"".join([*(b"%x\r\n%b\r\n" % (len(c), c) for c in cut(payload, size)), b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of chunked framing; extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0].strip(), 16)
        at = line + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def payload(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head) else body


def record_id(page: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{page} {digest}'.encode()).hexdigest())}>"


def records(page: int | None, url: str | None, html: bytes, digest: str, first: int | None, date: str = "2024-01-01T00:00:00Z", segment: int = SEGMENT, chunk: int = CHUNK, copy: str = "") -> list[bytes]:
    """The records of a page. first: the page that it revisits; copy: tells the segments of rows that repeat apart."""
    own = record_id(page, digest)
    shared = [f"WARC-Date: {date}"] + ([f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url)}"] if url else []) + ([f"WARC-Page-ID: {page}"] if page is not None else [])
    if first is not None:
        head = ["WARC-Type: revisit", f"WARC-Record-ID: {own}", *shared, f"WARC-Refers-To: {record_id(first, digest)}", f"WARC-Profile: {_PROFILE}", f"WARC-Payload-Digest: sha256:{digest}"]
        return [_record(head, _HTTP)]
    parts = cut(block := _HTTP + chunked(html, chunk), segment)
    out = []
    for i, part in enumerate(parts):
        if not i:
            head = ["WARC-Type: response", f"WARC-Record-ID: {own}", *shared, f"WARC-Payload-Digest: sha256:{digest}"]
        else:
            head = ["WARC-Type: continuation", f"WARC-Record-ID: {record_id(page, f'{digest} {i}')}", *shared, f"WARC-Segment-Origin-ID: {own}"]
        if len(parts) > 1:
            head.append(f"WARC-Segment-Number: {i + 1}")
            if copy:
                head.append(f"WARC-Segment-Copy: {copy}")
            if i + 1 == len(parts):
                head.append(f"WARC-Segment-Total-Length: {len(block)}")
        out.append(_record(head, part))
    return out


def _record(head: list[str], block: bytes) -> bytes:
    return "\r\n".join(["WARC/1.1", *head, "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(stream) -> list[tuple[dict[str, str], bytes]]:
    """Yields (fields in lower case, block) of each record of a binary stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        head = {}
        while line := stream.readline().rstrip(b"\r\n"):
            k, _, v = line.partition(b":")
            head[k.decode().lower()] = v.strip().decode()
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record is cut short")
        yield head, block


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST, segment: int = SEGMENT, chunk: int = CHUNK, per_file: int = RECORDS, most_firsts: int = MOST_FIRSTS) -> None:
    """Archives of all pages, as gzip files below path.

    Pages that others revisit are broadcast while they number at most ``most_firsts`` (counted), else joined.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    firsts = rows.where(F.length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    firsts = written(firsts, "firsts")
    rows = rows.join(F.broadcast(firsts) if firsts.count() <= most_firsts else firsts, "digest", "left")
    rows = rows.withColumn("first", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            out = []
            for page, url, html, digest, first in zip(*(batch.column(i) for i in range(5)), strict=True):
                out += [r[:-2] for r in records(page.as_py(), url.as_py(), html.as_py(), digest.as_py(), first.as_py(), segment=segment, chunk=chunk, copy=f"{part}-{n}")]
                n += 1
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    made = rows.select("page_id", "url", "html", "digest", "first").mapInArrow(run, "value binary")
    made.select(F.col("value").cast("string")).write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


RECORD = "record string, copy string, kind string, page_id long, refers string, digest string, segment int, total long, payload_bytes long, block binary"
_RECORD = pa.schema([("record", pa.string()), ("copy", pa.string()), ("kind", pa.string()), ("page_id", pa.int64()), ("refers", pa.string()), ("digest", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("payload_bytes", pa.int64()), ("block", pa.binary())])


def read(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """A row for each response and revisit below path: page_id, payload_bytes, payload_digest, record_type, refers_to (and payload on demand).

    Payload, bytes and digest are those of the full payload, also of revisits; digests are made anew and held
    against the records' own.
    """

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RECORD, strict=True)], schema=_RECORD)

    def run(batches):
        n = 0
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                raw = content.as_buffer()
                packed = raw[:2].to_pybytes() == b"\x1f\x8b"
                stream = io.BufferedReader(gzip.GzipFile(fileobj=pa.BufferReader(raw)), 1 << 18) if packed else io.BufferedReader(pa.BufferReader(raw))
                for head, block in parsed(stream):
                    kind, number = head["warc-type"], head.get("warc-segment-number")
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    page = head.get("warc-page-id")
                    digest = head.get("warc-payload-digest", "").removeprefix("sha256:")
                    name = head.get("warc-segment-origin-id") or head["warc-record-id"]
                    n += 1  # whole records go to any task
                    row = [name, head.get("warc-segment-copy", "") if number else str(n), kind, int(page) if page else None, head.get("warc-refers-to"), digest, int(number) if number else None, int(head["warc-segment-total-length"]) if "warc-segment-total-length" in head else None, None, block]
                    if kind == "revisit":
                        row[9] = None
                    elif not number:
                        said = payload(block)
                        row[5:10] = [checked(said, digest), None, None, len(said), said if keep_payload else None]
                    rows.append(row)
                    held += len(row[9] or b"")
                    if len(rows) >= 2000 or held > 1 << 23:
                        yield table(rows)
                        rows, held = [], 0
                if rows:
                    yield table(rows)

    def joined(name, segments):
        """A page's record from its segments; those that come several times (of rows that repeat, without a copy's name) make as many."""
        segments.sort(key=lambda s: s[0])
        times = sum(s[0] == 1 for s in segments)
        own = segments[::times] if times else segments
        block = b"".join(s[4] for s in own)
        if len(segments) != times * len(own) or [s[0] for s in own] != list(range(1, len(own) + 1)) or own[-1][1] != len(block):
            raise ValueError(f"segments of {name} are missing or have another total length")
        said = payload(block)
        return [[name, "", "response", own[0][2], None, checked(said, own[0][3]), None, None, len(said), said if keep_payload else None]] * times

    def reassembled(batches):
        key, segments, rows, held = None, [], [], 0
        for batch in batches:
            blocks = (x.as_py() for x in batch.column(9))  # one at a time
            for row in zip(*(c.to_pylist() for c in batch.columns[:9]), blocks, strict=True):
                if segments and row[:2] != key:
                    rows += joined(key[0], segments)
                    segments = []
                if row[6] is None:
                    rows.append(row)
                else:
                    key = row[:2]
                    segments.append((row[6], row[7], row[3], row[5], row[9]))
                held += len(row[9] or b"") if keep_payload else 0
                if len(rows) >= 2000 or held > 1 << 23:
                    yield table(rows)
                    rows, held = [], 0
        if segments:
            rows += joined(key[0], segments)
        if rows:
            yield table(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = files.mapInArrow(run, RECORD).repartition(parts, "record", "copy").sortWithinPartitions("record", "copy", "segment")
    rows = written(dealt.mapInArrow(reassembled, RECORD), "records")
    whole = rows.where("kind = 'response'")
    known = whole.groupBy("record").agg(F.first("page_id").alias("refers_to"), F.first("payload_bytes").alias("bytes"), F.first("digest").alias("known"), *([F.first("block").alias("payload")] if keep_payload else []))
    known = written(known, "known")  # so that Spark can split the revisits of a page that a large share of all rows repeats
    also = ["payload"] if keep_payload else []
    again = rows.where("kind = 'revisit'").join(known.withColumnRenamed("record", "refers"), "refers", "left")
    bad = F.when(F.col("known").eqNullSafe(F.col("digest")), F.col("bytes")).otherwise(F.raise_error(F.lit("a revisit's response is missing or differs")).cast("long"))
    again = again.select("page_id", bad.alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to", *also)
    whole = whole.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), *([F.col("block").alias("payload")] if keep_payload else []))
    return whole.unionByName(again)


def checked(said: bytes, digest: str) -> str:
    found = hashlib.sha256(said).hexdigest()
    if digest and digest != found:
        raise ValueError("a payload differs from its digest")
    return found


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of 2 KB and chunks of 512 bytes, so that most pages are put together from continuation records and several chunks."""
    path = fresh(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path, segment=2048, chunk=512)
    return read(spark, path)


OP2_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (d)
"""
