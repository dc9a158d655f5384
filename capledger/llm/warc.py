"""WARC archives: chunked HTTP responses in segments, written and read back.

Writing: one response record per row, its HTTP body framed in chunks. A record larger
than ``segment_bytes`` goes on in continuation records, which name their origin and a
segment number; the last one tells the total length. Of equal payloads one row is the
response and the others are revisit records without a body.

Reading: files are cut at the version line that begins every record, so a large archive
is read by many tasks. No block may contain that line: the writer ends a chunk inside
each such place. Records in one piece are decoded where they are read; only segments
are shuffled, by their origin.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capledger.sources.scratch import stored

VERSION = b"WARC/1.1"
SEGMENT_BYTES = 16 * 1024
CHUNK_BYTES = 4 * 1024
LEAST_REVISIT = 1000  # bytes of a payload from which equal ones are revisits
DATE = "2020-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_RECORD = "record_id string, record_type string, row_id long, target_uri string, refers_to long, digest string, origin string, segment int, total long, block binary, fault string"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing in which the version line of a record never occurs."""
    out, at = [], 0
    while at < len(payload):
        end = min(at + size, len(payload))
        bad = payload.find(VERSION, at, min(end + len(VERSION), len(payload)))
        if bad >= 0:
            end = min(end, bad + 5)
        out.append(b"%x\r\n%b\r\n" % (end - at, payload[at:end]))
        at = end
    out.append(b"0\r\n\r\n")
    return b"".join(out)


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("a chunk has no size")
        size = int(body[at:line].split(b";")[0].strip(), 16)
        if size == 0:
            return b"".join(out)
        data = body[line + 2 : line + 2 + size]
        if len(data) < size or body[line + 2 + size : line + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut off")
        out.append(data)
        at = line + 4 + size


def payload_of(block: bytes) -> bytes:
    """The body of an HTTP response, without its transfer framing."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = [line.lower() for line in head.split(b"\r\n")[1:]]
    if any(f.startswith(b"transfer-encoding:") and b"chunked" in f for f in fields):
        return dechunked(body)
    return body


def _header(kind: str, record_id: str, length: int, **fields: object) -> bytes:
    lines = [VERSION.decode(), f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    lines += [f"{name.replace('_', '-')}: {value}" for name, value in fields.items() if value is not None]
    return "\r\n".join([*lines, f"Content-Length: {length}", "", ""]).encode()


def records(row: int, number: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, segment_bytes: int) -> bytes:
    """All records of one row, each followed by two line ends."""
    record_id = f"urn:x-row:{row}"
    uri = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A").replace("WARC/1.1", "WARC/1%2E1")
    common = {"WARC_Target_URI": uri, "X_Row_ID": number}
    if refers_to is not None:
        head = HTTP.replace(b"Transfer-Encoding: chunked\r\n", b"")
        return _header("revisit", record_id, len(head), **common, WARC_Refers_To=f"<urn:x-page:{refers_to}>", WARC_Profile=PROFILE, WARC_Payload_Digest=f"sha1:{digest}", Content_Type="application/http; msgtype=response") + head + b"\r\n\r\n"
    block = HTTP + chunked(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    first = {"WARC_Segment_Number": 1} if len(parts) > 1 else {}
    out = [_header("response", record_id, len(parts[0]), **common, WARC_Payload_Digest=f"sha1:{digest}", **first, Content_Type="application/http; msgtype=response"), parts[0], b"\r\n\r\n"]
    for i, part in enumerate(parts[1:], 2):
        total = {"WARC_Segment_Total_Length": len(block)} if i == len(parts) else {}
        out += [_header("continuation", f"{record_id}:{i}", len(part), WARC_Segment_Origin_ID=f"<{record_id}>", WARC_Segment_Number=i, **total), part, b"\r\n\r\n"]
    return b"".join(out)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", segment_bytes: int = SEGMENT_BYTES, compression: str = "none") -> None:
    """Writes every row as records of WARC files below ``path``, one file per task.

    A NULL payload is an empty one. Of rows with equal payloads of at least
    ``LEAST_REVISIT`` bytes, that with the largest id is the response; rows that repeat
    that id are responses too. A NULL id is never referred to, so where all ids of a
    payload are NULL all are responses.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit(""))
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("number"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"),
        F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("size"),
    )
    repeated = rows.where(F.col("size") >= LEAST_REVISIT).groupBy("digest", "size").agg(F.max("number").alias("last"), F.count(F.lit(1)).alias("n"))
    repeated = stored(repeated.where("n > 1 AND last IS NOT NULL").drop("n"), "repeated-payloads")
    refers = F.when(~F.col("number").eqNullSafe(F.col("last")), F.col("last"))
    out = rows.join(repeated, ["digest", "size"], "left").select(F.monotonically_increasing_id().alias("row"), "number", "url", "payload", "digest", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256).to_pylist()
                # The text sink adds the last line end.
                made = [records(r["row"], r["number"], r["url"], r["payload"].encode(), r["digest"], r["refers_to"], segment_bytes)[:-1] for r in part]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])

    out.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\n").option("compression", compression).text(path)


def _fields(head: bytes) -> dict[str, str]:
    lines = (line.split(":", 1) for line in head.decode("utf-8", "replace").split("\r\n") if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in lines}


def parse_record(raw: bytes) -> dict:
    """What follows the version line: named fields and block, and what is wrong with it."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    f = _fields(head)
    number = lambda name: int(f[name]) if f.get(name, "").lstrip("-").isdigit() else None
    length, refers = number("content-length"), f.get("warc-refers-to", "").strip("<>").rpartition(":")[2]
    fault = "no length" if length is None else "cut off" if len(rest) < length else None
    return {
        "record_id": f.get("warc-record-id", "").strip("<>") or None, "record_type": f.get("warc-type"), "row_id": number("x-row-id"),
        "target_uri": f.get("warc-target-uri"), "refers_to": int(refers) if refers.lstrip("-").isdigit() else None, "digest": f.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        "origin": f.get("warc-segment-origin-id", "").strip("<>") or None, "segment": number("warc-segment-number"), "total": number("warc-segment-total-length"),
        "block": rest[: length or 0], "fault": fault,
    }


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("row_id", pa.int64()), ("target_uri", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary()), ("fault", pa.string())])
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            yield pa.RecordBatch.from_pylist([parse_record(raw) for raw in batch.column(0).slice(start, 256).to_pylist()], schema=schema)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins segments, checks their numbers and total length, and takes off the framing."""
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("row_id", pa.int64()), ("target_uri", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("payload", pa.binary()), ("fault", pa.string())])
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            out = []
            for r in batch.slice(start, 256).to_pylist():
                pieces = sorted(r.pop("pieces"), key=lambda p: p["segment"] or 0)
                block, payload, fault = b"".join(p["block"] for p in pieces), None, r["fault"]
                if not fault and (len(pieces) > 1 or pieces[0]["segment"]):
                    if [p["segment"] for p in pieces] != list(range(1, len(pieces) + 1)):
                        fault = "segments are missing or repeated"
                    elif pieces[-1]["total"] != len(block):
                        fault = "the total length differs"
                if not fault and r["record_type"] == "response":
                    try:
                        payload = payload_of(block)
                    except ValueError as e:
                        fault = str(e)
                out.append({**r, "payload": payload, "fault": fault})
            yield pa.RecordBatch.from_pylist(out, schema=schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, record_type, row_id, target_uri, refers_to, digest, payload, fault): one row
    per logical record. Revisits have no payload; ``fault`` names what is wrong with a record,
    whose payload is then NULL. An archive without records gives no rows."""
    raw = spark.read.option("lineSep", VERSION.decode() + "\r\n").text(path).where(F.length("value") > 0)
    head = F.substring_index("value", "\r\n\r\n", 1)
    split = F.lower(head).contains("warc-segment-number:")
    value = F.col("value").cast("binary")
    piece = F.struct("segment", "total", "block")
    named = ["record_id", "record_type", "row_id", "target_uri", "refers_to", "digest"]
    whole = raw.where(~split).select(value).mapInArrow(_parsed, _RECORD).select(*named, F.array(piece).alias("pieces"), "fault")
    segments = raw.where(split).select(value).mapInArrow(_parsed, _RECORD).withColumn("key", F.coalesce("origin", "record_id"))
    first = F.col("record_type") != "continuation"
    joined = segments.groupBy("key").agg(
        *[F.max(F.when(first, F.col(c))).alias(c) for c in named], F.collect_list(piece).alias("pieces"),
        F.coalesce(F.max("fault"), F.when(F.max(first.cast("int")) == 0, F.lit("the origin is missing"))).alias("fault"),
    ).drop("key")
    kinds = ", ".join(f"{c} {'long' if c in ('row_id', 'refers_to') else 'string'}" for c in named)
    return whole.unionByName(joined).mapInArrow(_decoded, f"{kinds}, payload binary, fault string")


def resolved(read: DataFrame) -> DataFrame:
    """(row_id, payload_bytes, payload_digest, record_type, refers_to, fault): revisits have
    the size of the response that they refer to, and a fault where there is none of their digest."""
    slim = read.select("row_id", "record_type", "refers_to", "digest", F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("found"), "fault")
    slim = stored(slim, "records")
    referred = slim.where("record_type = 'response' AND row_id IS NOT NULL").groupBy(F.col("row_id").alias("refers_to"), F.col("found").alias("digest")).agg(F.max("size").alias("referred_size"))
    revisits = slim.where("record_type = 'revisit'").join(referred, ["refers_to", "digest"], "left").select(
        "row_id", F.col("referred_size").alias("payload_bytes"), F.when(F.col("referred_size").isNotNull(), F.col("digest")).alias("payload_digest"), "record_type", "refers_to",
        F.coalesce("fault", F.when(F.col("referred_size").isNull(), F.lit("no response of this digest"))).alias("fault"))
    responses = slim.where("record_type <> 'revisit' OR record_type IS NULL").select(
        "row_id", F.col("size").alias("payload_bytes"), F.col("found").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"),
        F.coalesce("fault", F.when(F.col("found") != F.col("digest"), F.lit("the digest differs"))).alias("fault"))
    return responses.unionByName(revisits)
