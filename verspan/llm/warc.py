"""WARC archives: writer, normaliser of monolithic gzip, reader by offsets.

``write_archives`` writes one archive for each task as a single gzip stream, as many
crawlers leave them. ``normalise`` inflates such a stream once, rewrites each record
as a gzip member of its own, and writes a sidecar index (offset, length, type, record
id) beside the archive. ``read_records`` seeks to the index's offsets and inflates
single members.

Equal payloads of at least ``min_bytes`` are stored once: the record with the largest
id is a response, the others revisit it. The groups are found on digests and ids
alone; html is not shuffled by its digest.

Files lie in the folder that all executors share and are named anew by each attempt of
a task; only those are read on that a finished attempt has told, so a lost executor or
a second attempt leaves nothing wrong.

Defined cases: null html is an empty payload; rows that share the largest id of a
group are all responses; a null id stays null and is a response unless a row with an
id has the same payload; a null url has no target header; other columns are ignored;
an empty table writes nothing and gives no rows. A stream that ends early raises.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verspan.llm.common import new_path, remove, stored, table

MIN_BYTES = 1000
DATE = "1970-01-01T00:00:00Z"
STEP = 1 << 20
INDEX = "path string, offset long, length long, record_type string, record_id string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def _fs(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or without payload a revisit of another."""
    revisit = refers_to is not None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(record: bytes) -> tuple[dict[str, str], int]:
    """(headers by lower-case name, where the block begins)."""
    at = record.index(b"\r\n\r\n")
    lines = record[:at].decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}, at + 4


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n, z = None, 0, zlib.compressobj(6, zlib.DEFLATED, 31)
        path = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                if out is None:
                    fs, at = _fs(path)
                    fs.create_dir(at.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(at, compression=None)
                out.write(z.compress(warc_record(*r)))
                n += 1
        if out is not None:
            out.write(z.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "records"])
    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write the archives; (path, records) of each."""
    payload = F.encode(F.coalesce(pages[html_col], F.lit("")), "UTF-8")
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    large = rows.where(F.octet_length("payload") >= min_bytes).select("page_id", "digest", F.xxhash64("payload").alias("h"))
    groups = large.groupBy("digest", "h").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    revisits = large.join(groups, ["digest", "h"]).where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()
    rows = rows.join(revisits, ["page_id", "digest"], "left")
    return stored(rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(_write(folder), "path string, records long"), "archives")


def inflated(stream) -> Iterator[bytes]:
    """A gzip stream of one member or many, inflated once; at most ``STEP`` bytes at a time, whatever they were packed into."""
    z, open_ = zlib.decompressobj(31), False
    while raw := stream.read(STEP):
        while raw:
            open_ = True
            out = z.decompress(raw, STEP)
            raw = z.unconsumed_tail
            if z.eof:
                raw, z, open_ = z.unused_data, zlib.decompressobj(31), False
            if out:
                yield out
    while open_ and (out := z.decompress(z.unconsumed_tail, STEP)):  # what was packed but not asked for yet
        yield out
    if open_ and not z.eof:
        raise ValueError("the archive ends within a record")


def records_of(stream) -> Iterator[bytes]:
    """Records of an archive; what is held is one record and a step."""
    held, need = bytearray(), None
    for chunk in inflated(stream):
        held += chunk
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 8 + int(headers(bytes(held[: end + 4]))[0]["content-length"])
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError("the archive ends within a record")


def _normalise(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                fs, at = _fs(path)
                to = f"{folder}/{path.rpartition('/')[2][:11]}-{uuid.uuid4().hex}.warc.gz"
                out_fs, out_at = _fs(to)
                out_fs.create_dir(out_at.rpartition("/")[0], recursive=True)
                rows, offset = [], 0
                with fs.open_input_stream(at, compression=None) as stream, out_fs.open_output_stream(out_at, compression=None) as out, out_fs.open_output_stream(f"{out_at}.idx", compression=None) as idx:
                    for record in records_of(stream):
                        z = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = z.compress(record) + z.flush()
                        out.write(member)
                        h, _ = headers(record)
                        rows.append((to, offset, len(member), h["warc-type"], h["warc-record-id"]))
                        idx.write(f"{offset}\t{len(member)}\t{h['warc-type']}\t{h['warc-record-id']}\n".encode())
                        offset += len(member)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["path", "offset", "length", "record_type", "record_id"])
    return run


def normalise(archives: DataFrame, folder: str, files: int) -> DataFrame:
    """Rewrite each archive record by record; the index, also written beside each archive."""
    return stored(archives.select("path").repartition(max(1, files)).mapInArrow(_normalise(folder), INDEX), "warc-index")


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, file = None, None
        for b in batches:
            out: list[tuple] = []
            for path, offset, length in zip(b.column("path").to_pylist(), b.column("offset").to_pylist(), b.column("length").to_pylist()):
                if path != now:
                    if file is not None:
                        file.close()
                    fs, at = _fs(path)
                    now, file = path, fs.open_input_file(at)
                file.seek(offset)
                record = zlib.decompress(file.read(length), 31)
                h, at = headers(record)
                block = record[at : at + int(h["content-length"])]
                payload = block[block.index(b"\r\n\r\n") + 4 :]
                digest, size = h["warc-payload-digest"].removeprefix("sha1:"), int(h["x-payload-length"])
                if h["warc-type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError(f"payload of {h['warc-record-id']} doesn't match its digest")
                page, refers = h.get("x-page-id"), h.get("x-refers-to-page")
                out.append((page and int(page), size, digest, h["warc-type"], refers and int(refers), h.get("warc-target-uri"), payload if with_payload and h["warc-type"] == "response" else None))
            if out:
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])
        if file is not None:
            file.close()
    return run


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records at the index's offsets; a revisit's payload is null, its length and digest are the full payload's."""
    return index.select("path", "offset", "length").mapInArrow(_read(with_payload), RECORDS)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    archives = write_archives(table(spark, sf_dir, "pages"), f"{folder}/raw")
    index = normalise(archives, f"{folder}/members", archives.count())
    remove(spark, f"{folder}/raw")
    return read_records(index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
g AS (SELECT payload, max(page_id) AS top, count(*) AS n FROM p WHERE octet_length(encode(payload)) >= 1000 GROUP BY payload)
SELECT p.page_id, octet_length(encode(p.payload))::BIGINT AS payload_bytes, sha1(p.payload) AS payload_digest,
       CASE WHEN g.n > 1 AND p.page_id <> g.top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.n > 1 AND p.page_id <> g.top THEN g.top END AS refers_to
FROM p LEFT JOIN g ON p.payload = g.payload
"""
