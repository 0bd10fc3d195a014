"""WARC archives: a writer with revisit records, and a splittable reader.

A record is a gzip member of its own. The reader deals byte ranges of the files to tasks; a task looks for the gzip
magic in its range, takes a place for a member only if it decodes and begins with a WARC header, and owns the members
that start in its range, reading beyond the range's end for the last one. After a member that was read whole the
search goes on behind it, so bytes inside a member are looked at only where a range begins within one.

Files are opened through pyarrow's filesystems by the scheme of their path, so a shared folder may be local or remote.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import cut, join_dealt, new_path

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a range; payloads shorter than LEAST_REVISIT are always written in full.
RANGE_BYTES, LEAST_REVISIT = 4 << 20, 100
_ID = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: A fixed date makes archives of the same pages equal byte for byte.
DATE = datetime(2024, 1, 1, tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """The filesystem of a path with or without a scheme, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), path.removeprefix("file:").replace("///", "/", 1)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_ID, str(page_id))}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str | None = None) -> bytes:
    """A gzip member with one record. A revisit has the digest and length of its payload but not the payload."""
    digest = digest or hashlib.sha256(payload).hexdigest()
    kind = "response" if refers_to is None else "revisit"
    body = payload if kind == "response" else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    head.append("WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + body + b"\r\n\r\n") + packer.flush()


def write_archives(pages: DataFrame, path: str) -> None:
    """Writes (page_id, url, html) as archives to path, one file a task, under the task's number.

    Of equal payloads of at least LEAST_REVISIT bytes that with the smallest page_id is the response. A task writes to
    a name of its own and renames at the end, so a task that is run again leaves one file with the same records."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    told = cut(rows.filter(F.octet_length("html") >= LEAST_REVISIT).select("page_id", "digest"), "digests")
    keys = told.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))
    shared = keys.filter((F.col("copies") > 1) & F.col("first_id").isNotNull()).select("digest", "first_id")
    # digests meet without payloads, and the many copies of a page in several tasks; what a record refers to follows from its id and digest alone
    again = join_dealt(told, shared, ["digest"], [F.col("page_id")]).filter(F.col("page_id").isNull() | (F.col("page_id") != F.col("first_id")))
    refers = again.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), F.col("first_id").alias("refers_to")).distinct()
    d = rows.join(refers.hint("merge"), (F.col("digest") == F.col("_digest")) & F.col("page_id").eqNullSafe(F.col("_id")), "left")

    def write(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = open_fs(path)
        store.create_dir(root, recursive=True)
        name, count, size, out = f"{root}/part-{task.partitionId():05d}.warc.gz", 0, 0, None
        tried = f"{root}/.{task.partitionId():05d}-{task.taskAttemptId()}"
        for t in tables:
            for page, url, html, refers, digest in zip(*(t.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "digest")), strict=True):
                if out is None:
                    out = store.open_output_stream(tried, compression=None)
                raw = record(page, url, html.encode("utf-8", "surrogatepass"), refers, digest)
                out.write(raw)
                count, size = count + 1, size + len(raw)
        if out is not None:
            out.close()
            store.move(tried, name)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], ["file", "records", "bytes"])

    files = d.select("page_id", "url", "html", "refers_to", "digest").mapInArrow(write, "file string, records long, bytes long")
    files.write.parquet(f"{path}/manifest")


def members(read, start: int, end: int, size: int, more: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(place, decoded bytes) of the WARC members that start in [start, end). read(at, n) gives bytes of the file."""
    at, buffer, base = start, b"", start

    def fill(upto: int) -> None:
        nonlocal buffer
        if base + len(buffer) < min(upto, size):
            buffer += read(base + len(buffer), min(size, max(upto, base + len(buffer) + more)) - base - len(buffer))

    while at < end:
        buffer, base = buffer[at - base :], at
        fill(min(size, end + len(MAGIC)))
        k = buffer.find(MAGIC)
        if k < 0 or base + k >= end:
            return
        at = base + k
        unpack, out, used = zlib.decompressobj(31), [], k
        good = False
        try:
            while not unpack.eof:
                fill(base + used + 1)
                part = buffer[used : used + more]
                if not part:
                    break
                out.append(unpack.decompress(part))
                used += len(part)
                if not good and sum(map(len, out)) >= 5:
                    good = b"".join(out).startswith(b"WARC/")
                    if not good:
                        break
        except zlib.error:
            good = False
        if good and unpack.eof:
            yield at, b"".join(out)
            at = base + used - len(unpack.unused_data)
        else:
            at += 1


def parse(raw: bytes) -> dict:
    """The fields of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:] if ": " in line)
    body = rest[: int(fields["Content-Length"])]
    return {"kind": fields["WARC-Type"], "page": fields.get("X-Page-Id"), "url": fields.get("WARC-Target-URI"), "digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"), "size": int(fields["X-Payload-Length"]), "refers": fields.get("X-Refers-To-Page-Id"), "body": body}


def read_archives(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """url and the columns of the contract, from all archives of the manifest at path. Responses are checked against their
    digests, and each archive's records are counted: a member that can't be read is an error, not a gap."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_fs(path)
        for t in tables:
            for file, size, start in zip(*(t.column(c).to_pylist() for c in ("file", "bytes", "start")), strict=True):
                with store.open_input_file(file) as f:

                    def read(at: int, n: int, f=f) -> bytes:
                        f.seek(at)
                        return f.read(n)

                    rows = []
                    for _, raw in members(read, start, min(size, start + range_bytes), size):
                        r = parse(raw)
                        if r["kind"] == "response" and (len(r["body"]) != r["size"] or hashlib.sha256(r["body"]).hexdigest() != r["digest"]):
                            raise ValueError(f"a record of page {r['page']} in {file} is damaged")
                        rows.append((file, None if r["page"] is None else int(r["page"]), r["url"], r["size"], r["digest"], r["kind"], None if r["refers"] is None else int(r["refers"])))
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["file", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    files = spark.read.schema("file string, records long, bytes long").parquet(f"{path}/manifest")
    step = F.lit(range_bytes).cast("long")
    ranges = files.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), step)).alias("start"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = ranges.repartition(parts, "file", "start").mapInArrow(run, "file string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")
    found = cut(found, "records")
    counts = found.groupBy("file").agg(F.count("*").alias("found"))
    bad = files.join(counts, "file", "left").filter(F.coalesce("found", F.lit(0)) != F.col("records")).select("file", "records", "found").take(1)
    if bad:
        raise ValueError(f"{bad[0].file} holds {bad[0].records} records, of which {bad[0].found or 0} could be read")
    return found.drop("file")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back.

    A null html is an empty payload, a null url an empty target. Equal payloads refer to the smallest page_id; a row that
    repeats that page_id too is a response as well. Pages without an id are never referred to. No pages: no rows."""
    path = new_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
