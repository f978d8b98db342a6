"""WARC archives: monolithic gzip files, and their normaliser.

``write_archives`` makes archives whose records share one gzip stream. ``normalise`` inflates each stream once,
rewrites every record as a gzip member of its own and adds a sidecar index of offsets. ``read_records`` opens
members through the index. Archives are rows of a table in the shared folder (name, bytes, index), so any
store that Spark writes will do; ``export`` puts them into files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domainforge.plans.scratch import materialize

#: Payloads of fewer bytes are never deduplicated.
MIN_REVISIT = 1000
#: An archive is closed at so many bytes of records.
ARCHIVE_BYTES = 8 << 20
INDEX = "array<struct<offset:long,length:long,id:string>>"


#: What is inflated at once.
CHUNK_BYTES = 1 << 20
#: The date of all records: pages come without one.
DATE = "2000-01-01T00:00:00Z"


def urn(name: str) -> str:
    """A record id that follows from the page's id (or, without one, from the record's place)."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def record(page_id, url, kind: str, digest: bytes, size: int, payload: bytes, refers_to, place: str = "") -> bytes:
    head = [
        "WARC/1.0",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {urn(f'place:{place}' if page_id is None else f'page:{page_id}')}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '').replace(chr(10), '')}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        f"X-Payload-Length: {size}",
        *([] if page_id is None else [f"X-Page-Id: {page_id}"]),
        *([f"WARC-Refers-To: {urn(f'page:{refers_to}')}", f"X-Refers-To-Page-Id: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"] if kind == "revisit" else []),
        "Content-Type: text/html",
        f"Content-Length: {len(payload)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict[str, str], int, int]:
    """(fields, start of the payload, end of the record) of the record at ``at``."""
    cut = data.index(b"\r\n\r\n", at)
    lines = data[at:cut].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record at {at}")
    fields = {name.strip(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
    body = cut + 4
    return fields, body, body + int(fields["Content-Length"]) + 4


def inflated(data) -> Iterator[bytes]:
    """A gzip file's content in chunks, all of its members. Whatever follows that is no member is an error, and so
    is a member that ends too early; zero bytes at the end are padding."""
    left = memoryview(data)
    while len(left):
        if not any(left[:512]) and not any(left):
            return
        member, fed = zlib.decompressobj(31), 0
        while not member.eof:
            if fed >= len(left) and not member.unconsumed_tail:
                raise ValueError("a gzip member ends too early")
            source = member.unconsumed_tail or left[fed : fed + CHUNK_BYTES]
            if not member.unconsumed_tail:
                fed += len(source)
            part = member.decompress(source, CHUNK_BYTES)
            if part:
                yield part
        left = left[fed - len(member.unused_data) :]


def records(data) -> Iterator[bytes]:
    """The records of a gzip file one by one, however they are dealt over its members; only the record at hand
    and a chunk are held."""
    held = bytearray()
    need = 0  # length of the record at hand, when its head is complete
    for part in inflated(data):
        held += part
        while True:
            if not need and b"\r\n\r\n" in held:
                need = parse(held, 0)[2]
            if not need or len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held.strip():
        raise ValueError("a record ends too early")


def dedupe(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, refers_to: of equal payloads the largest page_id is the response. A page
    without an id refers to none and is never referred to, so it stays a response; repeated rows of the largest
    id are responses each.

    Only digests that occur twice meet the pages again, by a join whose hot keys Spark can split."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("digest", F.sha1("payload"))
    long = p.where(F.octet_length("payload") >= MIN_REVISIT)
    many = long.groupBy("digest").agg(F.max("page_id").alias("latest"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = p.join(many, "digest", "left")
    return joined.withColumn("refers_to", F.when(F.col("page_id") < F.col("latest"), F.col("latest"))).drop("latest")


def _write(batches):
    task, number, size, packer, out = TaskContext.get().partitionId(), 0, 0, None, []
    schema = pa.schema([("archive", pa.string()), ("data", pa.binary())])

    def close():
        nonlocal number, size, packer, out
        out.append(packer.flush())
        row = pa.RecordBatch.from_arrays([pa.array([f"part-{task:06d}-{number:05d}.warc.gz"]), pa.array([b"".join(out)], pa.binary())], schema=schema)
        number, size, packer, out = number + 1, 0, None, []
        return row

    for batch in batches:
        for k in range(batch.num_rows):
            page, url, payload, digest, refers = (batch.column(c)[k].as_py() for c in range(5))
            kind = "response" if refers is None else "revisit"
            data = record(page, url, kind, bytes.fromhex(digest), len(payload), payload if refers is None else b"", refers, f"{task}-{number}-{size}")
            packer = packer or zlib.compressobj(1, zlib.DEFLATED, 31)
            out.append(packer.compress(data))
            size += len(data)
            if size >= ARCHIVE_BYTES:
                yield close()
    if packer:
        yield close()


def write_archives(pages: DataFrame) -> DataFrame:
    """(archive, data): monolithic gzip archives of all pages, a record each. Null html is an empty payload,
    a null url or id an empty field; repeated rows give a record each."""
    return dedupe(pages).select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(_write, "archive string, data binary")


def _normalise(batches):
    schema = pa.schema([("archive", pa.string()), ("data", pa.binary()), ("index", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("id", pa.string())])))])
    for batch in batches:
        for k in range(batch.num_rows):
            offset, members, index = 0, [], []
            for whole in records(batch.column(1)[k].as_buffer()):
                member = gzip.compress(whole, 4, mtime=0)
                members.append(member)
                index.append({"offset": offset, "length": len(member), "id": parse(whole, 0)[0]["WARC-Record-ID"]})
                offset += len(member)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([b"".join(members)], pa.binary()), pa.array([index], schema.field(2).type)], schema=schema)


def normalise(archives: DataFrame) -> DataFrame:
    """(archive, data, index): every record a gzip member of its own, found through the index. The input may have
    its records in one member, in a member each, or in any other layout; damage is an error."""
    return archives.mapInArrow(_normalise, f"archive string, data binary, index {INDEX}")


def _page(value: str | None):
    return None if value is None else int(value)


def _read(batches):
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    for batch in batches:
        rows = []
        for k in range(batch.num_rows):
            data = batch.column(1)[k].as_buffer()
            for entry in batch.column(2)[k].as_py():
                whole = zlib.decompress(data.slice(entry["offset"], entry["length"]), 31)
                fields, body, end = parse(whole, 0)
                digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                kind, size = fields["WARC-Type"], int(fields["X-Payload-Length"])
                if kind == "response" and (hashlib.sha1(whole[body : end - 4]).hexdigest() != digest or end - 4 - body != size):
                    raise ValueError(f"damaged record {entry['id']}")
                rows.append((_page(fields.get("X-Page-Id")), size, digest, kind, _page(fields.get("X-Refers-To-Page-Id"))))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def read_records(archives: DataFrame) -> DataFrame:
    """One row per record, read member by member; a payload that differs from its digest is an error."""
    return archives.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archives_in(spark: SparkSession, path: str) -> DataFrame:
    """(archive, data): the .warc.gz files under ``path``, a row each."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc.gz").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), F.col("content").alias("data"))


def export(archives: DataFrame, folder: str) -> None:
    """Write normalised archives as .warc.gz files with .idx files beside them. Tasks write into ``folder``, which
    all executors have to share; a file appears whole or not at all, so a task can be run again."""

    def put(path: str, data: bytes) -> None:
        partial = f"{path}.{uuid.uuid4().hex}"
        with open(partial, "wb") as f:
            f.write(data)
        os.replace(partial, path)

    def write(rows) -> None:
        for row in rows:
            path = os.path.join(folder, row["archive"])
            put(f"{path}.idx", "".join(f"{e['offset']}\t{e['length']}\t{e['id']}\n" for e in row["index"]).encode())
            put(path, bytes(row["data"]))

    archives.foreachPartition(write)


def op4_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through monolithic and normalised archives and back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read_records(materialize(normalise(materialize(write_archives(pages), "monolithic")), "normalised"))


#: The contract's rows, from the pages themselves.
ORACLE = f"""SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < latest THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id < latest THEN latest END AS refers_to
    FROM (SELECT *, CASE WHEN payload_bytes >= {MIN_REVISIT} THEN max(page_id) OVER (PARTITION BY payload_digest) END AS latest
    FROM (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages) a) b"""
