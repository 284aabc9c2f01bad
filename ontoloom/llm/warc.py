"""WARC archives: a Spark data source that writes and sequentially reads one gzip member per record.

Writing, each task makes one archive under a name of its own; ``commit`` lists the archives of the
tasks that won in a manifest of that write, so lost executors and repeated tasks leave nothing that a reader
sees, and a second write to a folder adds to the first. Reading, each archive is one partition, read in pieces through ``zlib.decompressobj``: a member ends
where zlib says so, its record's block is as long as Content-Length says, and block and payload are
held against their digests. Memory is bounded by one record.
"""

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ontoloom.shared import new_place, written

MANIFEST = "_archives-"
#: smaller payloads are always written whole
REVISIT_FROM = 1000
#: bytes read from an archive at once
PIECE = 1 << 20
#: records in a batch handed to Spark; also cut by bytes
BATCH, BATCH_BYTES = 1000, 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def _sha(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(url: str) -> str:
    return quote(url, safe="!#$&'()*+,/:;=?@[]-._~")


def member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int = 6, refers_url: str | None = None) -> bytes:
    """One record as one gzip member, under an id that no other has. A revisit has the HTTP head alone for its block, and
    names the response by its page and address."""
    head = HTTP % len(payload)
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {uuid.uuid4().urn.join('<>')}", "WARC-Date: 1970-01-01T00:00:00Z"]
    for name, value in (("WARC-Page-ID", page_id), ("WARC-Target-URI", None if url is None else _uri(url)), ("WARC-Refers-To-Page-ID", refers_to)):
        if value is not None:
            lines.append(f"{name}: {value}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", *([f"WARC-Refers-To-Target-URI: {_uri(refers_url)}"] if refers_url is not None else [])]
    lines += [f"WARC-Payload-Digest: {_sha(payload)}", f"WARC-Payload-Length: {len(payload)}", f"WARC-Block-Digest: {_sha(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def members(stream) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one after the other; raises EOFError where the last is cut short."""
    engine, parts, open_ = zlib.decompressobj(31), [], False
    while piece := stream.read(PIECE):
        while piece:
            open_ = True
            parts.append(engine.decompress(piece))
            if not engine.eof:
                break
            yield b"".join(parts)
            piece, engine, parts, open_ = engine.unused_data, zlib.decompressobj(31), [], False
    if open_:
        raise EOFError("the archive ends within a record")


def parse(record: bytes) -> dict:
    """Head fields and payload of one record; raises ValueError where framing or a digest is wrong."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines)
    n = int(fields["Content-Length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError("Content-Length does not frame the record")
    if fields["WARC-Block-Digest"] != _sha(block):
        raise ValueError("the block's digest differs")
    whole = fields["WARC-Type"] == "response"
    payload = block.partition(b"\r\n\r\n")[2] if whole else None
    if whole and (fields["WARC-Payload-Digest"] != _sha(payload) or int(fields["WARC-Payload-Length"]) != len(payload)):
        raise ValueError("the payload's digest differs")
    fields["payload"] = payload
    return fields


def _number(said: str | None) -> int | None:
    return None if said is None else int(said)


def _manifests(path: str) -> tuple:
    """The file system, the folder in it, and the manifests there."""
    where, folder = fs.FileSystem.from_uri(path)
    return where, folder, sorted(x.path for x in where.get_file_info(fs.FileSelector(folder)) if x.base_name.startswith(MANIFEST))


def _listed(where, manifest: str) -> list[str]:
    with where.open_input_stream(manifest, compression=None) as stream:
        return json.loads(stream.read())


class _Message(WriterCommitMessage):
    def __init__(self, name: str, records: int):
        self.name, self.records = name, records


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, level: int, overwrite: bool = False):
        self.path, self.level, self.overwrite = path, level, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Message:
        where, folder = fs.FileSystem.from_uri(self.path)
        where.create_dir(folder, recursive=True)
        name, n = f"part-{uuid.uuid4().hex}.warc.gz", 0
        with where.open_output_stream(f"{folder}/{name}", compression=None) as out:
            for batch in iterator:
                for page_id, url, html, refers_to, refers_url in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to", "refers_url")), strict=True):
                    text = html.as_py()
                    out.write(member(page_id.as_py(), url.as_py(), (text or "").encode(), refers_to.as_py(), self.level, refers_url.as_py()))
                    n += 1
        return _Message(name, n)

    def commit(self, messages: list) -> None:
        where, folder = fs.FileSystem.from_uri(self.path)
        where.create_dir(folder, recursive=True)
        before = _manifests(self.path)[2] if self.overwrite else []
        with where.open_output_stream(f"{folder}/{MANIFEST}{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps([m.name for m in messages if m is not None and m.records]).encode())
        for m in messages:
            if m is not None and not m.records:
                where.delete_file(f"{folder}/{m.name}")
        for manifest in before:
            gone = _listed(where, manifest)
            where.delete_file(manifest)
            for name in gone:
                where.delete_file(f"{folder}/{name}")

    def abort(self, messages: list) -> None:
        where, folder = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None:
                where.delete_file(f"{folder}/{m.name}")


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        where, folder, manifests = _manifests(self.path)
        if not manifests:
            raise FileNotFoundError(f"no manifest in {self.path}")
        return [InputPartition(name) for manifest in manifests for name in _listed(where, manifest)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        names, rows, held = [x.split()[0] for x in SCHEMA.split(", ")], [], 0
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names)
        if partition.value is not None:
            where, folder = fs.FileSystem.from_uri(self.path)
            with where.open_input_stream(f"{folder}/{partition.value}", compression=None) as stream:
                for record in members(stream):
                    x = parse(record)
                    digest = base64.b32decode(x["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    rows.append((_number(x.get("WARC-Page-ID")), x.get("WARC-Target-URI"), x["WARC-Type"], _number(x.get("WARC-Refers-To-Page-ID")), int(x["WARC-Payload-Length"]), digest, x["payload"]))
                    held += len(record)
                    if len(rows) >= BATCH or held >= BATCH_BYTES:
                        yield pack()
                        rows, held = [], 0
        yield pack()


class WarcSource(DataSource):
    """``format("warc")``: options ``path`` (a folder as URI or absolute path) and ``level`` (of gzip)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], int(self.options.get("level", "6")), overwrite)


def archive(pages: DataFrame, path: str, level: int = 6, overwrite: bool = False) -> None:
    """Writes a record for each row: of equal payloads of REVISIT_FROM bytes or more the row with the largest page_id
    is the response and the others revisit it. Rows that share that page_id are all responses; a null page_id is
    smaller than any, and where only null ids share a payload all are responses. Null html is the empty payload, a null
    url is left out. No rows leave a folder without records. Rows are added to what the folder has, or take its
    place with ``overwrite``; what earlier writes put there is not looked at for revisits.
    """
    pages.sparkSession.dataSource.register(WarcSource)
    html = F.coalesce("html", F.lit(""))
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.octet_length(html).alias("_n"), F.sha1(F.encode(html, "utf-8")).alias("_digest"))
    # Of a hot payload each map task sends one row to the count.
    shared = named.where(F.col("_n") >= REVISIT_FROM).groupBy("_digest", "_n").agg(F.max(F.struct("page_id", "url")).alias("_r"), F.count(F.lit(1)).alias("_copies")).where("_copies > 1")
    # Written first, so that Spark knows its size: a small table is broadcast and no payload is shuffled; a large one meets
    # the payloads in a join whose hot partitions adaptive execution splits.
    copies = written(shared.select(F.col("_digest").alias("_of"), F.col("_n").alias("_of_n"), F.col("_r.page_id").alias("_largest"), F.col("_r.url").alias("_url")), "copies")
    told = named.join(copies, (F.col("_digest") == F.col("_of")) & (F.col("_n") == F.col("_of_n")), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_largest")), F.col("_largest"))
    told.select("page_id", "url", "html", refers.alias("refers_to"), F.col("_url").alias("refers_url")).write.format("warc").mode("overwrite" if overwrite else "append").option("level", level).save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive folder, digests verified; a revisit has a null payload."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").load(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_place(spark, "warc")
    archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html) as n, sha1(html) as digest from p),
m as (select *, max(page_id) over (partition by digest, n) as largest from d)
select page_id, n::bigint as payload_bytes, digest as payload_digest, case when n >= 1000 and page_id is distinct from largest and largest is not null then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and page_id is distinct from largest then largest end as refers_to from m
"""
