"""WARC archives (operator 9).

Pages are written as WARC 1.1 records, one archive a task, as one monolithic gzip stream. A response's block is an
HTTP answer whose body is the payload; a revisit names the response's record, and has an HTTP head for a block.
Payload digests are written in base 32, as archives have them; the page's id and a revisit's payload length stand in
extension fields. The normaliser inflates
such a stream once, record by record, rewrites every record as a gzip member of its own, and writes a sidecar
index of offsets beside the archive, so any record can be read by one seek. Reading back goes by the index.

Files lie in the shared folder, on any file system that Arrow opens. A task writes under names of its own attempt,
and only names that a finished task has reported are read, so a lost executor leaves no half archive behind.

Defined cases: a null html counts as empty; a null url is written as none; a null page_id is carried as none, and
the largest page_id of a group ignores nulls; rows that repeat the largest page_id of a group are all responses;
where all page_ids of a group are null, all are responses; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import batches_of, cut_lineage, scratch

#: Bytes of a payload from which an equal one is a revisit.
LEAST_REVISIT = 1000
#: Bytes of a group of equal payloads in memory, about, and of all groups up to which they are broadcast.
GROUP_BYTES, BROADCAST_BYTES = 128, 32 << 20
#: Bytes read or inflated at once, and the level of compression.
CHUNK, LEVEL = 1 << 20, 6


def _place(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class Files:
    """Files of one folder, by name."""

    def __init__(self, folder: str):
        self.fs, self.path = _place(folder)

    def write(self, name: str):
        self.fs.create_dir(self.path, recursive=True)
        return self.fs.open_output_stream(f"{self.path}/{name}", compression=None)

    def read(self, name: str):
        return self.fs.open_input_file(f"{self.path}/{name}")

    def delete(self, name: str) -> None:
        self.fs.delete_file(f"{self.path}/{name}")


def record_id(page_id: int | None, digest: str) -> str:
    """A record's id: the same for a page and payload wherever it is written, so that revisits can name it."""
    return f"<urn:uuid:{uuid.uuid4() if page_id is None else uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, digest: str) -> bytes:
    """One WARC record of a payload with a hexadecimal SHA-1."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if kind == "response" else head
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe='!#$%&()*+,/:;=?@[]~-._' + chr(39))}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {record_id(refers_to, digest)}")
        lines.append(f"X-Refers-To-Page-ID: {refers_to}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])]


def payload_of(block: bytes) -> bytes:
    """The body of an HTTP answer."""
    return block.partition(b"\r\n\r\n")[2]


def _inflated(source) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, a chunk at a time."""
    z = zlib.decompressobj(31)
    while data := source.read(CHUNK):
        while data:
            if out := z.decompress(data, CHUNK):
                yield out
            if z.eof:
                data, z = z.unused_data, zlib.decompressobj(31)
            else:
                data = z.unconsumed_tail
    while not z.eof and (out := z.decompress(z.unconsumed_tail, CHUNK)):
        yield out


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an inflated stream, each with its closing blank lines; no more than one record is held."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        while (end := held.find(b"\r\n\r\n")) >= 0:
            head = bytes(held[: end + 2]).lower()
            at = head.index(b"content-length:") + 15
            size = end + 4 + int(head[at : head.index(b"\r\n", at)]) + 4
            if len(held) < size:
                break
            yield bytes(held[:size])
            del held[:size]
    if held:
        raise ValueError(f"{len(held)} bytes after the last whole record")


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def normalise(files: Files, monolith: str, archive: str, index: str) -> int:
    """Rewrites a whole-file gzip stream with a member for each record, and writes the offset index; gives the records."""
    at = n = 0
    with files.read(monolith) as source, files.write(archive) as out, files.write(index) as side:
        for data in split_records(_inflated(source)):
            member = _member(data)
            out.write(member)
            headers, _ = parse(data)
            side.write((json.dumps({"offset": at, "length": len(member), "id": headers["WARC-Record-ID"]}) + "\n").encode())
            at, n = at + len(member), n + 1
    return n


def read_archive(files: Files, archive: str, index: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record that the index names, each inflated by itself."""
    with files.read(index) as side, files.read(archive) as source:
        for line in io.TextIOWrapper(side, "utf-8"):
            entry = json.loads(line)
            source.seek(entry["offset"])
            yield parse(zlib.decompress(source.read(entry["length"]), 31))


def write_archives(df: DataFrame, folder: str) -> DataFrame:
    """Writes rows (page_id, url, payload, kind, refers_to, digest) to archives; the manifest: archive, index, records."""
    schema = pa.schema([("archive", pa.string()), ("index", pa.string()), ("records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, task = Files(folder), TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        z, out = zlib.compressobj(1, zlib.DEFLATED, 31), None
        for batch in batches:
            for page_id, url, payload, kind, refers_to, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = out or files.write(f"{name}.mono.gz")
                out.write(z.compress(record(page_id, url, payload, kind, refers_to, digest)))
        if out:
            out.write(z.flush())
            out.close()
            n = normalise(files, f"{name}.mono.gz", f"{name}.warc.gz", f"{name}.idx")
            files.delete(f"{name}.mono.gz")
            yield pa.record_batch([pa.array([f"{name}.warc.gz"]), pa.array([f"{name}.idx"]), pa.array([n])], schema=schema)

    picked = df.select("page_id", "url", "payload", "kind", "refers_to", "digest")
    return cut_lineage(picked.mapInArrow(run, "archive string, index string, records long"))


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload of every record; a response's digest is computed anew."""
    schema = pa.schema(
        [
            ("page_id", pa.int64()),
            ("url", pa.string()),
            ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()),
            ("record_type", pa.string()),
            ("refers_to", pa.int64()),
            ("payload", pa.binary()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(folder)

        def rows():
            for batch in batches:
                for archive, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for h, block in read_archive(files, archive, index):
                        revisit = h["WARC-Type"] == "revisit"
                        digest, body = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex(), payload_of(block)
                        if not revisit and hashlib.sha1(body).hexdigest() != digest:
                            raise ValueError(f"{archive}: the block of {h['WARC-Record-ID']} does not have its digest")
                        page, refers = h.get("X-Page-ID"), h.get("X-Refers-To-Page-ID")
                        size = int(h["X-Payload-Length"]) if revisit else len(body)
                        yield page and int(page), h.get("WARC-Target-URI"), size, digest, h["WARC-Type"], refers and int(refers), body

        yield from batches_of(rows(), schema)

    names = manifest.select("archive", "index")
    tasks = max(1, min(names.count(), 100_000))  # an archive a task
    ddl = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return names.repartition(tasks).mapInArrow(run, ddl)


def archive_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None) -> DataFrame:
    """Writes a record for each row of df and gives what the archives then hold, as read_archives."""
    folder = folder or scratch(df.sparkSession, "warc")
    payload = F.coalesce(df[html_col].cast("string"), F.lit("")).cast("binary")
    pages = df.select(df[id_col].cast("long").alias("page_id"), df[url_col].cast("string").alias("url"), payload.alias("payload"))
    pages = pages.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    # narrow, and combined before the shuffle: only groups with something to revisit come back
    groups = pages.filter(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(F.max("page_id").alias("newest"), F.count("*").alias("n"))
    groups = cut_lineage(groups.filter("n > 1 and newest is not null").select("digest", "newest"))
    small = groups.count() * GROUP_BYTES <= BROADCAST_BYTES  # then the payloads stay where they are
    known = pages.join(F.broadcast(groups) if small else groups, "digest", "left")
    revisit = F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest"))
    typed = known.select(
        "page_id",
        "url",
        "payload",
        F.when(revisit, "revisit").otherwise("response").alias("kind"),
        F.when(revisit, F.col("newest")).alias("refers_to"),
        "digest",
    )
    return read_archives(write_archives(typed, folder), folder)
