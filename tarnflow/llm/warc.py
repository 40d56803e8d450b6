"""WARC archives: a distributed writer and a splittable reader.

The writer makes one file a task, each record a gzip member of its own, later copies of a payload as ``revisit``
records. The reader cuts files into byte ranges; a task looks for gzip's magic in its range, accepts a candidate only
if the member inflates to a WARC header, and owns the records that start inside, reading on past its end for the last.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, scratch_path, table

SPLIT_BYTES, CHUNK = 8 << 20, 1 << 18
_MAGIC = b"\x1f\x8b\x08"
_DATE = "2024-01-01T00:00:00Z"
RECORD = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def _open_store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _clean(value: str | None) -> str:
    return (value or "").replace("\r", " ").replace("\n", " ")


def _record(page_id, url, html, refers_to, level: int) -> bytes:
    payload = (html or "").encode("utf-8", "surrogatepass")
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def write_archives(pages: DataFrame, folder: str, least_revisit: int = 0, level: int = 4) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) and returns the manifest (path, bytes, records) of committed files.

    Of rows with equal payloads of ``least_revisit`` bytes or more, that with the largest page_id is the response and
    the others are revisits of it; a row repeated whole is a response again. A null html is an empty payload, a null
    page_id or url an empty header (a null page_id never is referred to); no rows give no files; other columns are
    ignored. A file is named for one attempt of a task, and only files of the attempt that counts are in the manifest.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    copies = (
        rows.where(F.octet_length("html") >= least_revisit)
        .groupBy("digest")
        .agg(F.max("page_id").alias("last"), F.min("page_id").alias("least"), F.count("*").alias("n"))
        .where("n > 1 and (last > least or n > 1)")
        .select("digest", "last")
    )
    copies = materialise(spark, copies, "warc-copies")
    marked = rows.join(copies.hint("shuffle_hash"), "digest", "left").select(
        "page_id", "url", "html", F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("last")), F.col("last")).alias("refers_to")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n, path = None, 0, f"{folder}/part-{uuid.uuid4().hex}.warc.gz"
        size = 0
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if out is None:
                    store, where = _open_store(path)
                    store.create_dir(where.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(where, compression=None)
                record = _record(*row, level)
                out.write(record)
                size, n = size + len(record), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [n]}, schema=pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    return materialise(spark, marked.mapInArrow(write, "path string, bytes long, records long"), "warc-manifest")


def _parse(raw: bytes) -> dict | None:
    """A record's fields, or nothing if the bytes are no whole WARC record."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"WARC/1."):
        return None
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        fields[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not length.isdigit() or len(rest) < int(length):
        return None
    block = rest[: int(length)]
    http, sep, payload = block.partition(b"\r\n\r\n")
    page = lambda k: int(x) if (x := fields.get(k, "").removeprefix("<urn:page:").rstrip(">")).lstrip("-").isdigit() else None
    declared = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    kind = fields.get("warc-type", "")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response":
        digest, declared = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
    return {
        "page_id": page("warc-record-id"), "url": fields.get("warc-target-uri"), "record_type": kind, "payload_digest": digest,
        "payload_bytes": declared, "refers_to": page("warc-refers-to"), "payload": payload if kind == "response" else None,
    }


def records_in(f, size: int, start: int, end: int, chunk: int = CHUNK) -> Iterator[dict]:
    """The records of an open archive whose members start in [start, end)."""
    at, buffered, origin = start, b"", start

    def more() -> bool:
        nonlocal buffered
        f.seek(origin + len(buffered))
        got = f.read(min(chunk, size - origin - len(buffered)))
        buffered += got
        return bool(got)

    def member(pos: int):
        """The member at ``pos`` inflated, and where it ends; nothing if it is none or starts no WARC record."""
        z, out, checked, p = zlib.decompressobj(31), [], False, pos - origin
        while not z.eof:
            if p >= len(buffered) and not more():
                return None
            try:
                out.append(z.decompress(buffered[p:]))
            except zlib.error:
                return None
            p = len(buffered)
            if not checked and sum(map(len, out)) >= 7:
                if not b"".join(out).startswith(b"WARC/1."):
                    return None
                checked = True
        return b"".join(out), origin + p - len(z.unused_data)

    while at < end:
        while (hit := buffered.find(_MAGIC, at - origin)) < 0 and origin + len(buffered) < min(size, end + 2):
            keep = max(at - origin, len(buffered) - 2)
            buffered, origin = buffered[keep:], origin + keep
            at = max(at, origin)
            if not more():
                break
        if hit < 0 or origin + hit >= end:
            return
        at = origin + hit
        got = member(at)
        parsed = _parse(got[0]) if got else None
        if parsed is None:
            at += 1
            continue
        yield parsed
        at = got[1]
        cut = min(at - origin, len(buffered))
        buffered, origin = buffered[cut:], origin + cut


def read_archives(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records (``RECORD``) of the archives named by ``files`` (path, bytes); each range of a file is a task's unit."""
    spark = files.sparkSession
    ranges = files.where("bytes > 0").select(
        "path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start")
    )
    ranges = ranges.repartition(max(1, spark.sparkContext.defaultParallelism * 4), "path", "start")
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[x.split()[1]]) for n, x in zip(names, RECORD.split(", "), strict=True)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                store, where = _open_store(r["path"])
                with store.open_input_file(where) as f:
                    held, weight = [], 0
                    for x in records_in(f, r["bytes"], r["start"], min(r["bytes"], r["start"] + split_bytes)):
                        held.append(x)
                        weight += x["payload_bytes"] + 200
                        if weight > 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, weight = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)

    return ranges.mapInArrow(read, RECORD)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
