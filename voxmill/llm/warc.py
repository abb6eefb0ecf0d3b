"""WARC archives with an index: write records and where they stand, then read chosen byte ranges.

Each task writes gzip members, one a record, to files of its own; the index row of a record holds
file, offset, length, URL and digest. A retried task writes other files, and only files that the
index names count. Reading sorts the chosen records by file and offset and joins neighbouring
ranges into one read.
"""

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm.shared import folder, stored

INDEX = "page_id long, url string, file string, offset long, length long, digest string, record_type string, refers_to long"
READ = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"
_INDEX = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()),
                    ("length", pa.int64()), ("digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                   ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def record_types(pages: DataFrame, page_id="page_id", url="url", html="html", min_bytes: int = 1000) -> DataFrame:
    """``page_id, url, html, digest, refers_to``; refers_to is set for rows that only revisit.

    Among equal payloads of at least ``min_bytes`` the largest page_id is the response. Rows that
    repeat the response's id and payload are responses too; without any id all are. A hot payload
    is counted before the shuffle, and its pages join one row a payload, so Spark may split them.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    first = (rows.filter(F.octet_length("html") >= min_bytes).groupBy("digest")
             .agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    other = F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))
    return rows.join(first, "digest", "left").withColumn("refers_to", F.when(other, F.col("keep"))).drop("keep")


def _record_id(page_id, digest: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}').urn}>"


def _clean(value) -> str:
    """Header values stay on one line."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in value or "")


def _record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    http = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload), b"", b""]
    block = b"\r\n".join(http) + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {date}",
            f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(pages: DataFrame, root: str | None = None, page_id="page_id", url="url", html="html",
                   min_bytes: int = 1000, file_bytes: int = 1 << 30, level: int = 1, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write every row as a record below ``root``, a URI all executors share; return the stored index.

    Null html is an empty payload, null urls and ids leave their headers out, repeated rows give
    repeated records, an empty table an empty index. Control characters in a url are percent-encoded.
    """
    spark = pages.sparkSession
    root = root or folder(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(root)
        store.create_dir(path, recursive=True)
        out, at, name = None, 0, ""
        try:
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    data = _member(_record(r["page_id"], r["url"], r["html"].encode(), r["digest"], r["refers_to"], date), level)
                    if out is None or at + len(data) > file_bytes and at:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{path}/{name}", compression=None)
                    out.write(data)
                    rows.append({"page_id": r["page_id"], "url": r["url"], "file": name, "offset": at, "length": len(data),
                                 "digest": r["digest"], "record_type": "response" if r["refers_to"] is None else "revisit",
                                 "refers_to": r["refers_to"]})
                    at += len(data)
                yield pa.RecordBatch.from_pylist(rows, schema=_INDEX)
        finally:
            if out is not None:
                out.close()

    rows = record_types(pages, page_id, url, html, min_bytes).select("page_id", "url", "html", "digest", "refers_to")
    index = stored(rows.mapInArrow(write, INDEX), "warc-index")
    return index.withColumn("file", F.concat(F.lit(root + "/"), "file"))


def _parse(data: bytes, ids: dict) -> dict:
    head, _, rest = zlib.decompress(data, 31).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    if int(fields["Content-Length"]) + 4 != len(rest):
        raise ValueError(f"a record of {ids['file']} at {ids['offset']} has another length than its header says")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    row = {"page_id": int(fields["X-Page-ID"]) if "X-Page-ID" in fields else None, "url": fields.get("WARC-Target-URI"),
           "record_type": fields["WARC-Type"], "refers_to": None, "payload": None,
           "payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": digest}
    if row["record_type"] == "revisit":
        row["refers_to"] = int(fields["X-Refers-To-Page-ID"])
        return row
    payload = rest.partition(b"\r\n\r\n")[2][:-4]
    if len(payload) != row["payload_bytes"] or hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"the payload in {ids['file']} at {ids['offset']} does not match its digest")
    return row | {"payload": payload}


def read_records(index: DataFrame, gap: int = 64 << 10, most: int = 4 << 20) -> DataFrame:
    """The records of the chosen index rows, lengths and digests verified.

    Ranges of a file at most ``gap`` bytes apart become one read of at most ``most`` bytes (a longer
    record is one read). Revisits have a null payload, but the length and digest of the whole one.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handle, opened, store = None, None, None
        run: list[dict] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal handle, opened, store
            if opened != run[0]["file"]:
                if handle is not None:
                    handle.close()
                opened = run[0]["file"]
                store, path = fs.FileSystem.from_uri(opened)
                handle = store.open_input_file(path)
            first = run[0]["offset"]
            data = handle.read_at(run[-1]["offset"] + run[-1]["length"] - first, first)
            yield pa.RecordBatch.from_pylist([_parse(data[r["offset"] - first:r["offset"] - first + r["length"]], r) for r in run], schema=_READ)

        for batch in batches:
            for r in batch.to_pylist():
                if run and (r["file"] != run[0]["file"] or r["offset"] - run[-1]["offset"] - run[-1]["length"] > gap
                            or r["offset"] + r["length"] - run[0]["offset"] > most):
                    yield from flush()
                    run = []
                run.append(r)
        if run:
            yield from flush()
        if handle is not None:
            handle.close()

    ranges = index.select("file", "offset", "length")
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(read, READ)
