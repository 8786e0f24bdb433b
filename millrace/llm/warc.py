"""WARC archives: written natively, read back, and assembled into captures.

A page becomes three WARC/1.1 records that stand together: the request and the
metadata name the response (or revisit) as WARC-Concurrent-To. Spark's text
writer commits the archives, so they lie on any store that Spark writes, with one
copy when tasks are tried again. Payloads are UTF-8; lengths are bytes.

Of pages with equal payloads of at least ``least`` bytes, those with the smallest
page_id are responses and the others revisits without a body; smaller payloads
are always responses. Rows that repeat a page_id are captures of their own, all
of one kind. Null payloads are empty; null urls leave the target out; a null
page_id is read back as null and never is the one referred to while another id
has the payload.

Reading inflates an archive piece by piece and parses records by Content-Length, so
of an archive no more than its compressed bytes and a record is held, and archives
have ``RECORDS_A_FILE`` records at most. An empty table gives empty archives and no
captures; columns of clashing names are left out. Assembly joins the three kinds by the
response's record id; records without their response give a capture with a null
response. Only the columns named are read from the table of pages.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import scratch_path, settle, share_code

LEAST = 100
_PIECE = 1 << 20  # bytes inflated at a time
_BATCH = 1 << 24  # bytes of blocks whose records go on together
RECORDS_A_FILE = 100_000
DATE = "2024-01-01T00:00:00Z"
_KINDS = "file string, type string, record_id string, concurrent_to string, target_uri string, payload_bytes long, payload_digest string, digest_stated string, fields map<string,string>"


def _uuid(kind: str) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), "page_key", "digest", F.col("__n").cast("string")))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">"))


def _record(kind: Column | str, record_id: Column, content_type: str, block: Column, more: list[Column]) -> Column:
    """One record; the writer's line feed ends it."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    target = F.when(F.col("uri").isNotNull(), line("WARC-Target-URI", F.col("uri"))).otherwise("")
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", kind), line("WARC-Record-ID", record_id), line("WARC-Date", F.lit(DATE)), target, *more,
        line("Content-Type", F.lit(content_type)), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block, F.lit("\r\n\r"),
    )


def write_warc(pages: DataFrame, path: str, least: int = LEAST, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", compression: str = "gzip") -> None:
    """Write the archives of ``pages`` to the folder ``path``."""
    rows = pages.select(F.col(id_col).alias("page"), F.regexp_replace(F.col(url_col).cast("string"), r"[\r\n]", "%0A").alias("uri"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    # Digests of single pages are left out, so this table is small where copies are few; a common digest is a skewed join key, no group.
    first = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = settle(first.select(F.col("digest").alias("d"), "first"), "warc-copies")
    rows = rows.join(first, F.col("digest") == F.col("d"), "left").withColumn("__n", F.monotonically_increasing_id())
    rows = rows.withColumn("page_key", F.coalesce(F.col("page").cast("string"), F.lit("")))
    rows = rows.withColumn("revisit", F.col("first").isNotNull() & (F.col("page").isNull() | (F.col("page") > F.col("first"))))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    answer, http = _uuid("response"), F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    with_ = line("WARC-Concurrent-To", answer)
    digest = line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest"))
    profile = line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    fields = F.concat(
        F.when(F.col("page").isNotNull(), line("pageId", F.col("page").cast("string"))).otherwise(""),
        line("payloadBytes", F.col("size").cast("string")),
        F.when(F.col("revisit"), line("refersToPage", F.col("first").cast("string"))).otherwise(""),
    )
    records = F.array(
        _record("request", _uuid("request"), "application/http; msgtype=request", F.concat(F.lit("GET "), F.coalesce("uri", F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n")), [with_]),
        F.when(F.col("revisit"), _record("revisit", answer, "application/http; msgtype=response", http, [digest, profile])).otherwise(
            _record("response", answer, "application/http; msgtype=response", F.concat(http, "payload"), [digest])
        ),
        _record("metadata", _uuid("metadata"), "application/warc-fields", fields, [with_]),
    )
    rows.select(F.explode(records).alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", RECORDS_A_FILE).option("compression", compression).text(path)


def _inflated(data: bytes):
    """Pieces of an archive of bounded size; gzip of one or many members, or none."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[at : at + _PIECE] for at in range(0, len(data), _PIECE))
        return
    view = memoryview(data)
    while len(view):
        member = zlib.decompressobj(31)
        at = 0
        while not member.eof and at < len(view):
            piece = member.decompress(view[at : at + _PIECE])
            at += _PIECE
            if piece:
                yield piece
        if not member.eof:
            raise ValueError("the archive ends within a member")
        view = view[min(at, len(view)) - len(member.unused_data) :]


def parse_records(pieces):
    """(offset, headers, block) of each record of an archive that comes in pieces, or whole; no more than a record and a piece is held."""
    held, base, at = bytearray(), 0, 0
    pieces = iter([pieces] if isinstance(pieces, (bytes, bytearray)) else pieces)

    def more() -> bool:
        piece = next(pieces, None)
        if piece is not None:
            held.extend(piece)
        return piece is not None

    while True:
        seen = at
        while (end := held.find(b"\r\n\r\n", seen)) < 0:
            seen = max(at, len(held) - 3)
            if not more():
                if len(held) > at:
                    raise ValueError(f"no record at byte {base + at}")
                return
        first, *lines = bytes(held[at:end]).split(b"\r\n")
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {base + at}")
        headers = {k.lower(): v for k, _, v in (x.decode().partition(": ") for x in lines)}
        start, size = end + 4, int(headers["content-length"])
        while len(held) < start + size + 4 and more():
            pass
        yield base + at, headers, bytes(held[start : start + size])
        at = start + size + 4
        if at > _PIECE:
            base += at
            del held[:at]
            at = 0


def read_records(spark, path: str, payloads: bool = False) -> DataFrame:
    """One row a record of the archives below ``path``; with ``payloads`` also the payload."""

    def run(batches):
        types = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string())] + [pa.string()] * payloads
        names = ["file", "type", "record_id", "concurrent_to", "target_uri", "payload_bytes", "payload_digest", "digest_stated", "fields"] + ["payload"] * payloads

        def given(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            for k in range(batch.num_rows):
                rows, size = [], 0
                for _, headers, block in parse_records(_inflated(batch.column(1)[k].as_py())):
                    kind, body, fields = headers["warc-type"], None, []
                    if kind in ("response", "revisit"):
                        body = block[block.index(b"\r\n\r\n") + 4 :]
                    elif kind == "metadata":
                        fields = [tuple(x.split(": ", 1)) for x in block.decode().split("\r\n") if ": " in x]
                    digest = headers.get("warc-payload-digest", "").removeprefix("sha256:") or None
                    own = kind == "response"
                    rows.append(
                        (batch.column(0)[k].as_py(), kind, headers["warc-record-id"], headers.get("warc-concurrent-to"), headers.get("warc-target-uri"))
                        + (len(body) if own else None, hashlib.sha256(body).hexdigest() if own else None, digest, fields)
                        + ((body.decode("utf-8", "replace") if own else None,) if payloads else ())
                    )
                    size += len(block)
                    if len(rows) >= 4096 or size >= _BATCH:
                        yield given(rows)
                        rows, size = [], 0
                if rows:
                    yield given(rows)

    share_code(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, _KINDS + ", payload string" * payloads)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: (capture_id, request, response, metadata), joined by concurrent-to identifiers."""
    own = [c for c in records.columns]
    part = lambda kinds, key, name: records.where(F.col("type").isin(*kinds)).select(F.col(key).alias("capture_id"), F.struct(*own).alias(name))
    response = part(["response", "revisit"], "record_id", "response")
    request = part(["request"], "concurrent_to", "request")
    metadata = part(["metadata"], "concurrent_to", "metadata")
    return response.join(request, "capture_id", "full").join(metadata, "capture_id", "full").select("capture_id", "request", "response", "metadata")


def captures(pages: DataFrame, path: str | None = None, least: int = LEAST, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", payloads: bool = False) -> DataFrame:
    """Write ``pages`` as archives, read them back, and assemble the captures."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_warc(pages, path, least, id_col, url_col, payload_col)
    return assemble(settle(read_records(spark, path, payloads), "warc-records"))


def capture_digests(nested: DataFrame, kind: str = "bigint") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, digest_holds) of each capture."""
    field = lambda name: F.try_element_at(F.col("metadata.fields"), F.lit(name))
    return nested.select(
        field("pageId").cast(kind).alias("page_id"),
        F.coalesce("response.payload_bytes", field("payloadBytes").cast("long")).alias("payload_bytes"),
        F.coalesce("response.payload_digest", "response.digest_stated").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        field("refersToPage").cast(kind).alias("refers_to"),
        (F.coalesce(F.col("response.payload_digest") == F.col("response.digest_stated"), F.lit(True))).alias("digest_holds"),
    )
