"""WARC archives with revisit resolution.

Records are headers and a payload. Headers alone are shuffled by payload digest; of equal payloads of at least
``MIN_BYTES`` the one with the smallest id is the response, and the others become revisits that refer to it. Archives are
written anew with fresh headers, revisits without their payload; reading joins revisits to their responses again.

An archive file is a run of gzip members, one per record. Members are written in runs of about ``RUN_BYTES``, each
followed by an empty member (the record separator of Spark's text sink, which writes the bytes as they are); gzip readers
skip empty members. A file has ``FILE_RUNS`` runs at most, so its bytes are bounded but for a record longer than that.
Spark alone writes and reads the files, so any store that it reaches serves.

Defined results: a null payload is empty; records equal in id and payload are copies of one capture and share its type
and record id; a null id refers to a response but is one only if all equal payloads have null ids; repeated rows give a
record each; control characters in a URI are percent-encoded, a null URI has no header; an empty table writes no records;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_BYTES = 100
#: Compressed bytes in a run of members, and runs in a file.
RUN_BYTES, FILE_RUNS = 1 << 20, 64
#: The fixed profile name of revisits with equal payloads.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A gzip member without content.
EMPTY_MEMBER = b"\x1f\x8b\x08\0\0\0\0\0\0\x03\x03\0" + bytes(8)
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def record_id(page_id: int | None, digest: str) -> str:
    return f"urn:uuid:{uuid.UUID(hashlib.md5(f'{page_id} {digest}'.encode()).hexdigest())}"


def record(page_id: int | None, url: str | None, date: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A whole record, uncompressed."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{record_id(page_id, digest)}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(refers_to, digest)}>"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def members(content: bytes, step: int = 1 << 14) -> Iterator[bytes]:
    """Content of each gzip member with content."""
    at = 0
    while at < len(content):
        d = zlib.decompressobj(31)
        parts = []
        while not d.eof:
            if at >= len(content):
                raise ValueError("a member is cut off")
            parts.append(d.decompress(content[at : at + step]))
            at += min(step, len(content) - at) - len(d.unused_data)
        if data := b"".join(parts):
            yield data


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, payload) of a record; the payload of a revisit is empty."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no record")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return headers, rest[: int(headers["content-length"])].partition(b"\r\n\r\n")[2]


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, n_bytes) of a table of pages."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    return src.withColumns({"digest": F.sha2("payload", 256), "n_bytes": F.octet_length("payload").cast("long")})


def resolve(records: DataFrame, min_bytes: int = MIN_BYTES, broadcast_rows: int = 200_000) -> DataFrame:
    """(page_id, digest, refers_to) of the captures that become revisits. Payloads are not read."""
    heads = records.where(F.col("n_bytes") >= min_bytes).select("page_id", "digest")
    groups = heads.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
    groups = common.written(groups.where("n > 1").select("digest", "refers_to"), "warc-groups")
    # a shuffled join of two plain exchanges, so that adaptive execution can split a hot digest's rows
    again = heads.join(F.broadcast(groups) if common.size_bounded(groups, broadcast_rows) else groups, "digest")
    again = again.where("page_id > refers_to or (page_id is null and refers_to is not null)")
    return again.select("page_id", "digest", "refers_to").distinct()


def write_archives(records: DataFrame, revisits: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", broadcast_rows: int = 200_000, run_bytes: int = RUN_BYTES) -> None:
    """Writes a record for each row of ``records`` (see ``captures``) to archives under ``path``."""
    revisits = common.written(revisits, "warc-revisits").select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to", F.lit(True).alias("revisit"))
    if common.size_bounded(revisits, broadcast_rows):
        revisits = F.broadcast(revisits)
    on = F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for b in common.slices(batches):
            for i, url, payload, digest, to, revisit in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(member(record(i, url, date, payload, digest, to, bool(revisit))))
                size += len(held[-1])
                if size >= run_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["members"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["members"])

    joined = records.join(revisits, on, "left").select("page_id", "url", "payload", "digest", "refers_to", "revisit")
    out = joined.mapInArrow(run, "members binary").select(F.col("members").cast("string").alias("value"))
    sink = out.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin1"))
    with common.batch_rows(records.sparkSession):
        sink.option("maxRecordsPerFile", FILE_RUNS).text(path)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """(page_id, url, record_id, record_type, refers_to_id, digest, n_bytes, payload): one row per record. digest and
    n_bytes are those of the payload read, for revisits null."""
    schema = "page_id long, url string, record_id string, record_type string, refers_to_id string, digest string, n_bytes long, payload binary"

    def rows_of(content: bytes) -> Iterator[tuple]:
        for data in members(content):
            h, payload = parsed(data)
            whole = h["warc-type"] != "revisit"
            digest = hashlib.sha256(payload).hexdigest()
            if whole and h["warc-payload-digest"] != f"sha256:{digest}":
                raise ValueError(f"payload of {h['warc-record-id']} differs from its digest")
            page = int(h["page-id"]) if "page-id" in h else None
            yield (
                page, h.get("warc-target-uri"), h["warc-record-id"].strip("<>"), h["warc-type"], h.get("warc-refers-to", "").strip("<>") or None,
                digest if whole else None, len(payload) if whole else None, payload if whole and with_payload else None,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = [x.split()[0] for x in schema.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            for content in b.column(0).to_pylist():
                rows: list[tuple] = []
                for row in rows_of(content):
                    rows.append(row)
                    if len(rows) == 500:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, schema)


def with_originals(records: DataFrame, broadcast_rows: int = 200_000) -> DataFrame:
    """(page_id, url, n_bytes, digest, record_type, refers_to) of the records read, revisits with what their responses
    hold. Headers alone are joined; pass a table that was written, as it is read twice."""
    heads = records.select("page_id", "url", "record_id", "record_type", "refers_to_id", "digest", "n_bytes")
    whole = heads.where("record_type <> 'revisit'")
    wanted = heads.where("record_type = 'revisit'")
    targets = wanted.select(F.col("refers_to_id").alias("record_id")).distinct()
    small = common.size_bounded(targets, broadcast_rows)
    found = whole.join(F.broadcast(targets) if small else targets, "record_id", "left_semi")
    found = found.groupBy("record_id").agg(F.first("page_id").alias("refers_to"), F.first("digest").alias("digest"), F.first("n_bytes").alias("n_bytes"))
    found = common.written(found.withColumnRenamed("record_id", "refers_to_id"), "warc-originals")
    again = wanted.drop("digest", "n_bytes").join(F.broadcast(found) if small else found, "refers_to_id", "left")
    cols = ["page_id", "url", "n_bytes", "digest", "record_type", "refers_to"]
    return whole.withColumn("refers_to", F.lit(None).cast("long")).select(*cols).unionByName(again.select(*cols))


def op2(spark, sf_dir: str) -> DataFrame:
    records = captures(common.table(spark, sf_dir, "pages"))
    path = common.scratch_path(spark, "warc")
    write_archives(records, resolve(records), path)
    read = common.written(read_archives(spark, path, with_payload=False), "warc-read")
    out = with_originals(read)
    return out.select("page_id", F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")


ORACLE_OP2 = """
with p as (
  select page_id, octet_length(encode(coalesce(html, '')))::bigint as n, sha256(coalesce(html, '')) as d from pages),
g as (select d, min(page_id) as first from p where n >= 100 group by d)
select page_id, n as payload_bytes, p.d as payload_digest,
       case when page_id > first then 'revisit' else 'response' end as record_type,
       case when page_id > first then first end as refers_to
from p left join g on p.d = g.d and n >= 100
"""
