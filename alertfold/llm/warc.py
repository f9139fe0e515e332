"""A sharded WARC archive writer whose bytes depend on the records alone, and a reader.

Records are range-sorted; each sorted partition is written by one task, record by record as gzip members, and a new file
begins when the compressed size passes a limit. Headers, record ids and digests are made from the record's own columns.
A task writes below a temporary name of its own attempt; when all tasks are done the driver moves the files of the
successful attempts to their final names and writes a manifest with sizes, record counts and checksums. Files of lost or
repeated attempts are never moved.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from alertfold.llm.common import blocks_for

# A row with a payload is a record to be written; one without is a note that the records of its key revisit another.
RECORD = "page_id long, url string, sha1 string, payload binary, payload_bytes long, refers_to long, refers_to_url string"
KEY = ("page_id", "url", "sha1")
READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
DATE = "2000-01-01T00:00:00Z"  # records carry no time of their own; a fixed one keeps the archive reproducible
MANIFEST = "_MANIFEST.json"


def _digest(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _record_id(page_id: int | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{digest}|{url}')}>"


def _one_line(value: str) -> str:
    """A header value: a line break or another control character would end it, so these are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def record_bytes(row: dict) -> bytes:
    """One WARC/1.1 record. A revisit keeps the response's headers and no payload."""
    digest, payload = _digest(row["sha1"]), row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http if row["record_type"] == "revisit" else http + payload
    headers = [
        ("WARC-Type", row["record_type"]), ("WARC-Record-ID", _record_id(row["page_id"], row["url"], digest)),
        ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{_digest(hashlib.sha1(block).hexdigest())}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if row["url"] is not None:
        headers.append(("WARC-Target-URI", _one_line(row["url"])))
    if row["page_id"] is not None:
        headers.append(("X-Page-ID", str(row["page_id"])))
    if row["record_type"] == "revisit":
        headers += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", _record_id(row["refers_to"], row["refers_to_url"], digest)),
            ("X-Refers-To-Page-ID", str(row["refers_to"])),
        ]
        if row["refers_to_url"] is not None:
            headers.append(("WARC-Refers-To-Target-URI", _one_line(row["refers_to_url"])))
    headers.append(("Content-Length", str(len(block))))
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class _Files(WriterCommitMessage):
    files: list[dict]


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, roll_bytes: int):
        self.folder, self.roll_bytes = folder, roll_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, folder = fs.FileSystem.from_uri(self.folder)
        context = TaskContext.get()
        own = f"{folder}/_temporary/{context.partitionId()}-{context.taskAttemptId()}-{uuid.uuid4().hex}"
        files, out, note = [], None, None
        for batch in iterator:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                key = [row[c] for c in KEY]
                if row["payload"] is None:
                    note = key, row
                    continue
                row["record_type"] = "response"
                if note is not None and note[0] == key:
                    row |= {"record_type": "revisit", "refers_to": note[1]["refers_to"], "refers_to_url": note[1]["refers_to_url"]}
                if out is None:
                    name = f"part-{context.partitionId():06}-{len(files):05}.warc.gz"
                    system.create_dir(own, recursive=True)
                    out, size, records, sha = system.open_output_stream(f"{own}/{name}", compression=None), 0, 0, hashlib.sha256()
                data = gzip.compress(record_bytes(row), 6, mtime=0)
                out.write(data)
                sha.update(data)
                size, records = size + len(data), records + 1
                if size >= self.roll_bytes:
                    out.close()
                    files.append({"from": f"{own}/{name}", "name": name, "bytes": size, "records": records, "sha256": sha.hexdigest()})
                    out = None
        if out is not None:
            out.close()
            files.append({"from": f"{own}/{name}", "name": name, "bytes": size, "records": records, "sha256": sha.hexdigest()})
        return _Files(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, folder = fs.FileSystem.from_uri(self.folder)
        files = sorted((f for m in messages if m is not None for f in m.files), key=lambda f: f["name"])
        system.create_dir(folder, recursive=True)
        for file in files:
            system.move(file.pop("from"), f"{folder}/{file['name']}")
        with system.open_output_stream(f"{folder}/{MANIFEST}.tmp") as out:
            out.write(json.dumps({"files": files}, indent=1).encode())
        system.move(f"{folder}/{MANIFEST}.tmp", f"{folder}/{MANIFEST}")
        self._clean(system, folder)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clean(*fs.FileSystem.from_uri(self.folder))

    @staticmethod
    def _clean(system: fs.FileSystem, folder: str) -> None:
        if system.get_file_info(f"{folder}/_temporary").type != fs.FileType.NotFound:
            system.delete_dir(f"{folder}/_temporary")


class WarcArchive(DataSource):
    """``df.write.format("warc").option("path", uri).option("rollBytes", n)``; rows as in ``RECORD``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        system, folder = fs.FileSystem.from_uri(self.options["path"])
        if system.get_file_info(f"{folder}/{MANIFEST}").type != fs.FileType.NotFound:
            raise FileExistsError(f"{folder} already holds an archive")
        return _Writer(self.options["path"], int(self.options.get("rollbytes", 64 << 20)))


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Rows of ``RECORD``: one with the payload per row of ``pages`` (page_id, url, html), and one note per key of revisits.

    Of pages with equal payloads of at least ``min_bytes`` bytes the one with the largest page_id is the response and the
    others revisit it; smaller ones are all responses. A null html is an empty payload. Rows that tie on the largest id are
    responses; a row without id is the response only where none of its copies has one. Other columns are ignored. Payloads
    don't travel to the comparison of digests; the notes, which are short, travel to the payloads' place in the archive.
    """
    rows = pages.select(
        "page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumns(
        {"payload_bytes": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload")})
    keys = rows.where(F.col("payload_bytes") >= min_bytes).select(*KEY)
    newest = (keys.groupBy("sha1").agg(F.max(F.struct("page_id", "url")).alias("newest"), F.count("*").alias("n"))
              .where("n > 1 AND newest.page_id IS NOT NULL")
              .select("sha1", F.col("newest.page_id").alias("refers_to"), F.col("newest.url").alias("refers_to_url")))
    notes = keys.join(newest, "sha1").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()
    nothing = lambda kind: F.lit(None).cast(kind)
    return rows.select(*KEY, "payload", "payload_bytes", nothing("long").alias("refers_to"), nothing("string").alias("refers_to_url")).unionByName(
        notes.select(*KEY, nothing("binary").alias("payload"), nothing("long").alias("payload_bytes"), "refers_to", "refers_to_url"))


def write(pages: DataFrame, folder: str, min_bytes: int = 0, roll_bytes: int = 64 << 20) -> str:
    """Writes the archive of ``pages`` below ``folder`` (a path or URI that all executors reach) and returns its URI. A folder
    that holds a committed archive is refused, so that no record is overwritten."""
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    pages.sparkSession.dataSource.register(WarcArchive)
    (records(pages, min_bytes).repartitionByRange(blocks_for(pages, "html"), *KEY)
     .sortWithinPartitions(*KEY, F.col("payload").isNotNull())
     .write.format("warc").option("path", uri).option("rollBytes", roll_bytes).mode("append").save())
    return uri


def _parsed(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record."""
    while line := stream.readline():
        if line.strip() == b"":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode().partition(":")
            headers[key.strip().lower()] = value.strip()
        yield headers, stream.read(int(headers["content-length"]))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row of ``READ`` per record of the files that the manifest names; other files, such as those of a write that died
    before its manifest, are not read, and a folder without manifest is an error. The payload of a response is checked
    against its digest."""
    system, place = fs.FileSystem.from_uri(folder)
    with system.open_input_stream(f"{place}/{MANIFEST}") as manifest:
        paths = [f"{folder}/{file['name']}" for file in json.loads(manifest.read())["files"]]
    if not paths:
        return spark.createDataFrame([], READ)
    files = spark.read.format("binaryFile").load(paths).select("content")
    fields = [f.strip().split()[0] for f in READ.split(",")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def row_of(headers: dict[str, str], block: bytes) -> tuple:
        number = lambda key: int(headers[key]) if key in headers else None
        http, _, payload = block.partition(b"\r\n\r\n")
        digest = headers["warc-payload-digest"].partition(":")[2]
        if headers["warc-type"] == "response":
            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"{headers['warc-record-id']}: the payload doesn't match its digest")
            size = len(payload)
        else:
            payload = None
            size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
        return (number("x-page-id"), headers.get("warc-target-uri"), headers["warc-type"], size, digest,
                number("x-refers-to-page-id"), payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())), 1 << 20)
                for headers, block in _parsed(stream):
                    rows.append(row_of(headers, block))
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], fields)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], fields)

    return files.mapInArrow(run, READ)
