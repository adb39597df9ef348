"""WARC archives with segmented records, and their reassembly.

*Writing.*  Every page is a record: a response whose block is an HTTP message in chunked
transfer framing, or a revisit of the response with an equal payload.  Blocks longer than
``SEGMENT`` are split into a first record and continuation records, as WARC segmentation has
it.  Records are written by Spark's text sink (a record ends with a line feed, which the sink
adds), gzipped, at most ``FILE_RECORDS`` a file, so every file has a proven size bound.

*Reading.*  Files are read as they are, records are cut by their Content-Length, and the
segments of one record are brought together by their origin identifier, ordered by segment
number and checked: numbers without a gap, and the sum of lengths equal to the
total that the last segment states.  Then the HTTP head is cut off and the chunked framing decoded.
Archives of other writers are read as well: header names in any case, values with or without a blank,
folded lines, SHA-1 digests in base 32 or hexadecimal, of the body as sent or as decoded.  ``Page-Id`` and
``Refers-To-Page`` are headers of this writer; other archives have ``record``, ``uri`` and ``refers_record``.

Defined results: null html is an empty payload, null url a ``urn:page`` target; a null
page_id cannot be referred to, but can revisit; repeated rows with the largest page_id of
their group are all responses; an incomplete record has null payload and ``complete`` false;
an empty table gives an empty archive and result; other columns are ignored.  Records that are
neither response, revisit nor continuation are skipped, as are those without a type, an id or a length in digits; a
record that the end of its file cuts off is incomplete, and of a damaged gzip file the readable front is read.
A response without a SHA-1 digest is complete if its framing is; its digest is that of its payload, a revisit's is null.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellcast.llm import graph, store

QUERY = "op6_warc_segments"

LEAST_REVISIT = 1000   # bytes of a payload that can be revisited
SEGMENT = 4096         # bytes of a record's block at most
CHUNK = 1500           # bytes of a chunk of the transfer framing
FILE_RECORDS = 4096
DATE = "2025-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(payload[i:i + size]), payload[i:i + size]) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            return None
        n, at = int(size, 16), end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n:at + n + 2] != b"\r\n":
            return None
        out.append(body[at:at + n])
        at += n + 2


def _clean(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in value)


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC record without its last line feed."""
    lines = "".join(f"{k}: {_clean(v)}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r"


def records(page_id: int | None, url: str | None, payload: bytes, refers: int | None) -> Iterator[bytes]:
    """The records of one page; the first is the origin, the others continue it."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    origin = f"<urn:uuid:{uuid.uuid4()}>"
    base = [("WARC-Date", DATE), ("WARC-Target-URI", url or f"urn:page:{page_id}")] + [("Page-Id", str(page_id))] * (page_id is not None)
    if refers is not None:
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", origin), *base, ("WARC-Payload-Digest", digest), ("WARC-Profile", PROFILE),
                       ("Refers-To-Page", str(refers))], b"")
        return
    block = HEAD + chunked(payload)
    parts = [block[i:i + SEGMENT] for i in range(0, len(block), SEGMENT)]
    for n, part in enumerate(parts, 1):
        fields = [("WARC-Type", "response" if n == 1 else "continuation"), ("WARC-Record-ID", origin if n == 1 else f"<urn:uuid:{uuid.uuid4()}>"), *base]
        if n == 1:
            fields += [("WARC-Payload-Digest", digest), ("Content-Type", "application/http;msgtype=response")]
        if len(parts) > 1:
            fields += [("WARC-Segment-Number", str(n))] + [("WARC-Segment-Origin-ID", origin)] * (n > 1)
            fields += [("WARC-Segment-Total-Length", str(len(block)))] * (n == len(parts))
        yield _record(fields, part)


def _write(batches):
    for b in batches:
        rows: list[bytes] = []
        size = 0
        cols = (b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers"))
        for page_id, url, html, refers in zip(*cols, strict=True):
            for r in records(page_id, url, html.encode(errors="surrogatepass"), refers):
                rows.append(r)
                size += len(r)
            if size > 1 << 23:
                yield pa.record_batch([pa.array(rows, pa.binary())], names=["record"])
                rows, size = [], 0
        yield pa.record_batch([pa.array(rows, pa.binary())], names=["record"])


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, refers: the largest page_id of the equal payload (null for responses)."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    small = F.octet_length("html") < LEAST_REVISIT
    big = p.where(~small).withColumn("key", F.sha2("html", 256))
    last = big.groupBy("key").agg(F.max("page_id").alias("last"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    return big.join(last, "key").select("page_id", "url", "html", refers.alias("refers")).unionByName(
        p.where(small).withColumn("refers", F.lit(None).cast("long")))


def write_archive(pages: DataFrame, path: str) -> None:
    with_revisits(pages).mapInArrow(_write, "record binary").select(F.col("record").cast("string").alias("value")).write.option(
        "compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


READ = ("origin string, type string, segment int, total long, page_id long, digest string, refers long, uri string, refers_record string, "
        "cut boolean, block binary")
READ_SCHEMA = pa.schema([("origin", pa.string()), ("type", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("page_id", pa.int64()),
                         ("digest", pa.string()), ("refers", pa.int64()), ("uri", pa.string()), ("refers_record", pa.string()),
                         ("cut", pa.bool_()), ("block", pa.binary())])
READ_TYPES = ("response", "revisit", "continuation")


def headers(lines: list[str]) -> dict[str, str]:
    """Header values by lower-case name; the first of a name counts, a line that begins with white space continues the one before."""
    out: dict[str, str] = {}
    name = None
    for line in lines:
        if line[:1] in (" ", "\t"):
            if name is not None:
                out[name] += " " + line.strip()
            continue
        key, colon, value = line.partition(":")
        name = key.strip().lower() if colon and key.strip().lower() not in out else None
        if name is not None:
            out[name] = value.strip()
    return out


def _digits(text: str | None, most: int) -> int | None:
    return int(text) if text is not None and re.fullmatch(r"[0-9]{1,%d}" % most, text) else None


def parse(data: bytes) -> Iterator[tuple]:
    """The records of one file, cut by their Content-Length."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        fields = headers(data[at:end].decode(errors="replace").split("\r\n")[1:])
        n = _digits(fields.get("content-length"), 18)
        at = end + 4
        if n is None:
            continue
        block = data[at:at + n]
        at += n
        kind, record = fields.get("warc-type", "").lower(), fields.get("warc-record-id")
        if kind not in READ_TYPES or record is None:
            continue
        page, refers = (int(v) if (v := fields.get(k)) and re.fullmatch(r"-?[0-9]{1,18}", v) else None for k in ("page-id", "refers-to-page"))
        yield (fields.get("warc-segment-origin-id", record), kind, _digits(fields.get("warc-segment-number"), 9), _digits(fields.get("warc-segment-total-length"), 18),
               page, fields.get("warc-payload-digest"), refers, fields.get("warc-target-uri"), fields.get("warc-refers-to"), len(block) < n, block)


def inflate(content: bytes) -> bytes:
    """The content of a gzip file, or as much of it as can be read."""
    out = []
    with gzip.GzipFile(fileobj=io.BytesIO(content)) as f:
        try:
            while piece := f.read(1 << 20):
                out.append(piece)
        except (OSError, EOFError, zlib.error):
            pass
    return b"".join(out)


def _read(batches):
    for b in batches:
        for content in b.column("content").to_pylist():
            rows, size = [], 0
            for r in parse(inflate(content)):
                rows.append(r)
                size += len(r[-1])
                if size > 1 << 23:
                    yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), READ_SCHEMA, strict=True)], schema=READ_SCHEMA)
                    rows, size = [], 0
            if rows:
                yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), READ_SCHEMA, strict=True)], schema=READ_SCHEMA)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_read, READ)


DONE = ("page_id long, type string, digest string, refers long, record string, uri string, refers_record string, segments int, "
        "complete boolean, payload binary")
DONE_SCHEMA = pa.schema([("page_id", pa.int64()), ("type", pa.string()), ("digest", pa.string()), ("refers", pa.int64()), ("record", pa.string()),
                         ("uri", pa.string()), ("refers_record", pa.string()), ("segments", pa.int32()),
                         ("complete", pa.bool_()), ("payload", pa.binary())])


def sha1_hex(stated: str | None) -> str | None:
    """A stated SHA-1 digest in lower-case hexadecimal; None for other algorithms and forms."""
    algorithm, _, value = (stated or "").partition(":")
    if algorithm.strip().lower() != "sha1":
        return None
    value = value.strip()
    if re.fullmatch(r"[0-9A-Fa-f]{40}", value):
        return value.lower()
    return base64.b32decode(value.upper()).hex() if re.fullmatch(r"[A-Za-z2-7]{32}", value) else None


def payload_of(block: bytes, stated: str | None) -> tuple[bytes | None, str | None]:
    """(payload, its digest) of a response's block; None where neither the decoded nor the sent body is what the digest states."""
    if not block.startswith(b"HTTP/"):
        bodies = [block]
    else:
        head, _, body = block.partition(b"\r\n\r\n")
        sent_chunked = re.search(rb"(?im)^transfer-encoding:[ \t]*chunked[ \t]*\r?$", head)
        bodies = [b for b in ((dechunked(body), body) if sent_chunked else (body,)) if b is not None]
        if sent_chunked and stated is None and len(bodies) == 1:
            return None, None           # broken framing, and nothing else to go by
    for b in bodies:
        digest = hashlib.sha1(b).hexdigest()
        if stated is None or digest == stated:
            return bodies[0], hashlib.sha1(bodies[0]).hexdigest()
    return None, stated


def assemble(parts: list[dict]) -> tuple | None:
    """One record from its segments in order; None where the origin itself is missing."""
    first = parts[0]
    if first["type"] == "continuation":
        return None
    block = b"".join(p["block"] for p in parts)
    whole = [p["segment"] or 1 for p in parts] == list(range(1, len(parts) + 1)) and not any(p["cut"] for p in parts)
    if len(parts) > 1 or parts[-1]["total"] is not None:
        whole = whole and parts[-1]["total"] == len(block)
    payload, digest = None, sha1_hex(first["digest"])
    if first["type"] == "response":
        payload, digest = payload_of(block, digest) if whole else (None, digest)
        whole = payload is not None
    return (first["page_id"], first["type"], digest, first["refers"], first["origin"], first["uri"], first["refers_record"], len(parts), whole, payload)


def _assemble(batches):
    """Records from their consecutive segments."""
    return _records(assemble(t.to_pylist()) for t in graph.groups(batches, ["origin"]))


def _decode(batches):
    """Records that are whole as they are."""
    return _records(assemble([r]) for b in batches for r in b.to_pylist())


def _records(done):
    rows, size = [], 0
    for r in done:
        if r is None:
            continue
        rows.append(r)
        size += len(r[-1] or b"") + 100
        if size > 1 << 23:
            yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), DONE_SCHEMA, strict=True)], schema=DONE_SCHEMA)
            rows, size = [], 0
    if rows:
        yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), DONE_SCHEMA, strict=True)], schema=DONE_SCHEMA)


def reassemble(read: DataFrame) -> DataFrame:
    """One row per record: page_id, type, digest, refers, segments, complete, payload.

    Only the segments of split records are shuffled; a record without a segment number is whole.
    """
    parts = read.where("segment is not null").repartition("origin").sortWithinPartitions("origin", "segment").mapInArrow(_assemble, DONE)
    return read.where("segment is null").mapInArrow(_decode, DONE).unionByName(parts)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.new_path(spark, "warc")
    write_archive(store.table(spark, sf_dir, "pages"), path)
    back = store.save(reassemble(read_records(spark, path)).select("page_id", "type", "digest", "refers", "complete",
                                                                  F.octet_length("payload").cast("long").alias("bytes")), "warc-read")
    responses = back.where("type = 'response'")
    own = responses.groupBy(F.col("page_id").alias("refers"), "digest").agg(F.max("bytes").alias("of_response"))
    revisits = back.where("type = 'revisit'").drop("bytes").join(own, ["refers", "digest"], "left").withColumnRenamed("of_response", "bytes")
    return responses.unionByName(revisits).select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
                                                  F.col("type").alias("record_type"), F.col("refers").alias("refers_to"))


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
k AS (SELECT *, CASE WHEN n >= {LEAST_REVISIT} THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS last FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN last <> page_id THEN last END AS refers_to FROM k
"""
