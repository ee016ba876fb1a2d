"""WARC archives: written with an index first, read back by byte ranges.

Pages become WARC/1.1 records, each a gzip member of its own, in archive files of
a bounded size. Tasks write files under names of their own and return an index row
for each record: file, offset, length, URL and digest. The index, written once as Parquet, is
the only list of what belongs to the archive: the files of a lost or repeated
task are never in it. A reader selects records in the index, deals them out by
file and offset, and reads neighbouring records of a file in one byte range.

Equal payloads are stored once: the smallest page_id has the response, the others
are revisits of it. The folder must be one that executors reach by `pyarrow.fs`
(file, hdfs, s3, gs, abfs) and by Spark.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .session import checkpoint_folder
from .textkit import column


@dataclass(frozen=True)
class Archive:
    """least: bytes of a payload that others may refer to; file_bytes: after which a file ends; gap: bytes
    between two records that are read along; run_bytes: of a read of several records; task_bytes: read by a
    task; date: of the records; level: of compression."""

    least: int = 100
    file_bytes: int = 256 << 20
    gap: int = 64 << 10
    run_bytes: int = 8 << 20
    task_bytes: int = 32 << 20
    date: str = "2000-01-01T00:00:00Z"
    level: int = 6


HTTP = "application/http; msgtype=response"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or local path, and the path in it."""
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return (fs.LocalFileSystem(), folder) if folder.startswith("/") else fs.FileSystem.from_uri(folder)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id}:{digest}'.encode()).digest()[:16])}>"


def _header(fields: list[tuple[str, str | None]]) -> bytes:
    """WARC header lines; control characters and blanks within a value are percent-encoded where it is a URI."""
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields if v is not None), "\r\n"]).encode("utf-8", "surrogateescape")


def uri(url: str | None) -> str | None:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) if url is not None else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None, revisit: bool, date: str) -> bytes:
    """A record, not compressed: a response with its payload, or a revisit with the HTTP header only."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = block if revisit else block + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date), ("WARC-Target-URI", uri(url)), ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Page-ID", None if page_id is None else str(page_id)),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("WARC-Refers-To-Target-URI", uri(refers_url)), ("X-Refers-To-Page-ID", str(refers_to))]
    return _header([*fields, ("Content-Type", HTTP), ("Content-Length", str(len(block)))]) + block + b"\r\n\r\n"


def _gzip(raw: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string, refers_to long"


def _write(batches: Iterator[pa.RecordBatch], folder: str, a: Archive) -> Iterator[pa.RecordBatch]:
    files, root = store(folder)
    names = [f.split(" ")[0] for f in INDEX.split(", ")]
    kinds = {"offset": pa.int64(), "length": pa.int64(), "page_id": pa.int64(), "refers_to": pa.int64()}
    out, name, at = None, "", 0
    try:
        for batch in batches:
            rows = []
            cols = [column(batch, c) for c in ("page_id", "url", "payload", "digest", "refers_to", "refers_url", "revisit")]
            for page_id, url, payload, digest, refers_to, refers_url, revisit in zip(*[c.to_pylist() for c in cols]):
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                    info = _header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", a.date), ("WARC-Filename", name), ("Content-Length", "0")]) + b"\r\n\r\n"
                    at += out.write(_gzip(info, a.level))
                raw = _gzip(record(page_id, url, payload, digest, refers_to, refers_url, revisit, a.date), a.level)
                out.write(raw)
                rows.append((name, at, len(raw), page_id, url, digest, "revisit" if revisit else "response", refers_to if revisit else None))
                at += len(raw)
                if at >= a.file_bytes:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*rows) if rows else [()] * len(names))], names)
    finally:
        if out is not None:
            out.close()


def written(pages: DataFrame, folder: str, a: Archive = Archive()) -> DataFrame:
    """Writes `pages` (page_id, url, html) as archives to a new folder, and returns their index as written."""
    spark = pages.sparkSession
    html = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= a.least
    first = rows.where(large).select("digest", "page_id", "url").groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("refers_to"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))["url"].alias("refers_url"))
    # written, so that its size is known when the join is planned
    first.where("n > 1 and refers_to is not null").drop("n").write.parquet(f"{folder}/repeated")
    repeated = spark.read.parquet(f"{folder}/repeated").withColumnRenamed("digest", "of")
    revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    judged = rows.join(repeated, (F.col("digest") == F.col("of")) & large, "left").withColumn("revisit", revisit)
    files, root = store(f"{folder}/archives")
    files.create_dir(root, recursive=True)
    where = f"{folder}/archives"
    judged.select("page_id", "url", "payload", "digest", "refers_to", "refers_url", "revisit").mapInArrow(lambda it: _write(it, where, a), INDEX).write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


Place = tuple[str, int, int]


def runs(places: Iterable[Place], gap: int, most: int) -> Iterator[list[Place]]:
    """Places (file, offset, length) in order, those together that one read can fetch."""
    run: list[Place] = []
    for place in places:
        file, offset, length = place
        if run and (file != run[-1][0] or offset - run[-1][1] - run[-1][2] > gap or offset + length - run[0][1] > most):
            yield run
            run = []
        run.append(place)
    if run:
        yield run


@dataclass(frozen=True)
class Parsed:
    """A record as read: `payload` of a response; of a revisit its size only."""

    kind: str
    page_id: int | None
    url: str | None
    payload: bytes
    size: int
    digest: str
    refers_to: int | None


def parsed(raw: bytes) -> Parsed:
    """One record of its bytes in the archive; a payload that doesn't have its digest is an error."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogateescape").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record at this offset")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?im)^Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is damaged")
    number = lambda name: int(fields[name]) if name in fields else None
    return Parsed(fields["WARC-Type"], number("X-Page-ID"), fields.get("WARC-Target-URI"), payload, size, digest, number("X-Refers-To-Page-ID"))


RECORDS = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def _read(batches: Iterator[pa.RecordBatch], folder: str, payload: bool, a: Archive) -> Iterator[pa.RecordBatch]:
    files, root = store(folder)
    places = (p for b in batches for p in zip(column(b, "file").to_pylist(), column(b, "offset").to_pylist(), column(b, "length").to_pylist()))
    name, source = None, None
    try:
        for run in runs(places, a.gap, a.run_bytes):
            if run[0][0] != name:
                if source is not None:
                    source.close()
                name, source = run[0][0], files.open_input_file(f"{root}/{run[0][0]}")
            start = run[0][1]
            data = source.read_at(run[-1][1] + run[-1][2] - start, start)
            got = [parsed(data[offset - start : offset - start + length]) for _, offset, length in run]
            arrays = [
                pa.array([r.page_id for r in got], pa.int64()), pa.array([r.url for r in got], pa.string()), pa.array([r.kind for r in got], pa.string()), pa.array([r.payload if payload and r.kind == "response" else None for r in got], pa.binary()),
                pa.array([r.size for r in got], pa.int64()), pa.array([r.digest for r in got], pa.string()), pa.array([r.refers_to for r in got], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, [f.split(" ")[0] for f in RECORDS.split(", ")])
    finally:
        if source is not None:
            source.close()


def records(selected: DataFrame, folder: str, payload: bool = True, a: Archive = Archive()) -> DataFrame:
    """The records of the index rows `selected` (file, offset, length): RECORDS. Payloads of revisits are null."""
    spark = selected.sparkSession
    size = selected.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-size // a.task_bytes), min(spark.sparkContext.defaultParallelism, size >> 20))
    dealt = selected.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    where = f"{folder}/archives"
    return dealt.mapInArrow(lambda it: _read(it, where, payload, a), RECORDS)


def selected_pages(index: DataFrame, folder: str, condition: Column, a: Archive = Archive()) -> DataFrame:
    """RECORDS of the index rows that meet `condition`; a revisit has the payload of its response, which is read once for all."""
    wanted = index.where(condition)
    revisits = wanted.where("record_type = 'revisit'").select("digest", F.col("refers_to").alias("page_id")).distinct()
    others = index.where("record_type = 'response'").join(revisits, ["digest", "page_id"], "left_semi")
    every = records(wanted.unionByName(others).select("file", "offset", "length").distinct(), folder, True, a)
    own = wanted.select("page_id", "digest", "record_type", "refers_to").alias("own")
    source = every.where("record_type = 'response'").select("page_id", "payload_digest", "payload", "payload_bytes").dropDuplicates(["page_id", "payload_digest"]).alias("source")
    at = F.when(F.col("own.record_type") == "revisit", F.col("own.refers_to")).otherwise(F.col("own.page_id"))
    found = own.join(source, at.eqNullSafe(F.col("source.page_id")) & (F.col("own.digest") == F.col("source.payload_digest")))
    return found.select("own.page_id", "own.record_type", "source.payload", "source.payload_bytes", "source.payload_digest", "own.refers_to")


def archived(pages: DataFrame, a: Archive = Archive(), folder: str | None = None) -> DataFrame:
    """Writes `pages` (page_id, url, html) as archives, reads them all back: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    A null html is an empty payload; a null url leaves its header field out; control characters and blanks of a url are
    percent-encoded in the header (the index has it as it is). Of equal payloads of
    at least `least` bytes the smallest page_id is the response; rows that repeat this
    id with this payload (ties) are responses too. A null page_id refers to the
    smallest id that there is, or, among null ids alone, is a response. Long
    payloads are written and read whole; an empty table gives no rows; columns other than those named are not read.
    """
    folder = folder or f"{checkpoint_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return records(written(pages, folder, a), folder, False, a).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def index_of(spark: SparkSession, folder: str) -> DataFrame:
    """The index of an archive that was written earlier."""
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


SQL = """
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, n >= 100 AND page_id > min(page_id) OVER (PARTITION BY digest) AS again, min(page_id) OVER (PARTITION BY digest) AS first FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
FROM f
"""
