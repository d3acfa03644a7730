"""WARC archives of pages: writing, normalising and reading them back.

Archives are first written the way many crawls leave them, as one gzip stream per file, which can only be
read from its start.  The normaliser inflates each such stream once, in bounded pieces, rewrites every
record as a gzip member of its own and writes a sidecar index of offsets.  Reading goes by the index: a
task opens a file, jumps to its own members and inflates only those.

Files go to the shared folder through ``pyarrow.fs``.  A task writes under a name of its own attempt and moves the
file into place when it is whole, so tasks of lost executors can run again.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halocline.llm.frames import pick, utf8_size
from halocline.storage import materialise, scratch_path

REVISIT_BYTES = 1000
FILE_BYTES = 32 << 20
PIECE = 1 << 18
MEMBERS_PER_READ = 512
# Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
GZIP = 31  # window bits of a gzip stream in zlib
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, payload binary"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


class _File:
    """A file that appears under its name only when it is whole."""

    def __init__(self, uri: str):
        self.fs, self.path = _open(uri)
        self.fs.create_dir(posixpath.dirname(self.path), recursive=True)
        self.draft = f"{self.path}.{uuid.uuid4().hex}"
        self.out, self.size = self.fs.open_output_stream(self.draft), 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.draft, self.path)


def _sha1(digest: str) -> str:
    """A hexadecimal SHA-1 in the spelling of WARC headers."""
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def _record(row: dict) -> bytes:
    """The WARC record of one page; a revisit carries the HTTP header alone."""
    payload = row["payload"] or b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"]
    block = http if row["revisit"] else http + payload
    url = re.sub(r"[\s\x00-\x1f]", lambda m: f"%{ord(m[0]):02X}", row["url"] or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if row['revisit'] else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if row['page_id'] is None else row['page_id']}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: {_sha1(row['digest'])}",
    ]
    if row["revisit"]:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{row['refers']}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _parse(record: bytes) -> dict:
    """A record's headers by lower-case name, and its block under ``block``."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields | {"block": rest[: int(fields["content-length"])]}


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated stream that comes in pieces."""
    held = bytearray()
    need = 0
    for piece in pieces:
        held += piece
        while len(held) >= need:
            end = held.find(b"\r\n\r\n")
            if end < 0:
                break
            length = re.search(rb"(?i)\r\nContent-Length:\s*(\d+)", held[:end])
            if not held.startswith(b"WARC/") or not length:
                raise ValueError("not a WARC record")
            need = end + 8 + int(length[1])
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held:
        raise ValueError("the stream ends inside a record")


def _inflated(stream) -> Iterator[bytes]:
    """Bytes of all members of a gzip file, a bounded piece at a time."""
    inflate = zlib.decompressobj(GZIP)
    while raw := stream.read(PIECE):
        while raw:
            yield inflate.decompress(raw, PIECE * 4)
            while inflate.unconsumed_tail:
                yield inflate.decompress(inflate.unconsumed_tail, PIECE * 4)
            raw = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(GZIP)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield from batch.slice(at, 256).to_pylist()


def _pages_with_revisits(pages: DataFrame) -> DataFrame:
    """Pages with payload digest and whether they revisit an equal one; groups are reduced before they are joined."""
    rows = pick(pages, "page_id", "url", "html").select(
        "page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"), utf8_size(F.col("html")).alias("payload_bytes")
    )
    rows = rows.withColumn("digest", F.sha1("payload"))
    long = rows.where(F.col("payload_bytes") >= REVISIT_BYTES)
    firsts = long.groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("refers"))
    rows = rows.join(firsts, ["digest", "payload_bytes"], "left")
    revisit = F.col("refers").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("refers")))
    return rows.withColumn("revisit", revisit)


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write monolithic archives of all pages under ``folder``; returns (path, records), stored.

    A null html is an empty payload, a null url an empty target.  Of equal payloads of at least 1000 bytes the one with
    the largest page_id is a response (all rows with that page_id, if it is repeated), the others revisit
    it; a null page_id counts as smallest.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, out, paths, counts = TaskContext.get().partitionId(), 0, None, [], []
        for row in _rows(batches):
            if out is None:
                path = f"{folder}/part-{part:06d}-{len(paths):04d}.warc.gz"
                out, deflate, n = _File(path), zlib.compressobj(6, zlib.DEFLATED, GZIP), 0
                paths.append(path)
            out.write(deflate.compress(_record(row)))
            n += 1
            if out.size >= file_bytes:
                out.write(deflate.flush())
                out.close()
                out = None
                counts.append(n)
        if out is not None:
            out.write(deflate.flush())
            out.close()
            counts.append(n)
        yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "records": pa.array(counts, pa.int64())})

    return materialise(_pages_with_revisits(pages).mapInArrow(write, "path string, records long"), "warc-manifest")


def normalise(archives: DataFrame) -> DataFrame:
    """Rewrite each archive in ``path`` record by record, beside it, with a sidecar index.

    Returns (path, index, records), stored: the new archive, its index, a text line ``offset length type id`` per
    record, and how many there are.  A file is one task, as its stream can only be read in order.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            fs, path = _open(row["path"])
            new = row["path"].removesuffix(".warc.gz") + ".members.warc.gz"
            out, index, n = _File(new), _File(new + ".idx"), 0
            with fs.open_input_stream(path, compression=None) as stream:
                for record in split_records(_inflated(stream)):
                    deflate = zlib.compressobj(6, zlib.DEFLATED, GZIP)
                    member = deflate.compress(record) + deflate.flush()
                    fields = _parse(record)
                    index.write(f"{out.size} {len(member)} {fields['warc-type']} {fields['warc-record-id']}\n".encode())
                    out.write(member)
                    n += 1
            out.close()
            index.close()
            if n != row["records"]:
                raise ValueError(f"{row['path']} holds {n} records, {row['records']} were written")
            yield pa.RecordBatch.from_pydict({"path": [new], "index": [new + ".idx"], "records": pa.array([n], pa.int64())})

    spread = archives.repartition(max(1, archives.count()), "path")
    return materialise(spread.mapInArrow(rewrite, "path string, index string, records long"), "warc-normalised")


def read_archives(normalised: DataFrame) -> DataFrame:
    """Every record of normalised archives, by their indexes: a row of ``READ`` each.

    ``payload`` is what the record itself holds, empty in revisits; the size and digest are of the full payload,
    checked against the bytes where the record has them.
    """

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            fs, path = _open(row["index"])
            with fs.open_input_stream(path) as stream:
                lines = stream.read().decode().splitlines()
            for at in range(0, len(lines), MEMBERS_PER_READ):
                own = [x.split(" ", 2) for x in lines[at : at + MEMBERS_PER_READ]]
                start = int(own[0][0])
                end = int(own[-1][0]) + int(own[-1][1])
                yield pa.RecordBatch.from_pydict({"path": [row["path"]], "start": pa.array([start]), "end": pa.array([end]), "lengths": pa.array([[int(x[1]) for x in own]])})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            fs, path = _open(row["path"])
            out = []
            with fs.open_input_file(path) as file:
                file.seek(row["start"])
                for length in row["lengths"]:
                    out.append(_page(_parse(zlib.decompress(file.read(length), GZIP))))
            yield pa.RecordBatch.from_pylist(out, _READ_SCHEMA)

    wide = normalised.repartition(max(1, normalised.count()), "path")
    return wide.mapInArrow(spans, "path string, start long, end long, lengths array<long>").mapInArrow(read, READ)


_READ_SCHEMA = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("payload", pa.binary())])


def _page(fields: dict) -> dict:
    number = lambda name: int(m[1]) if (m := re.search(r"<urn:page:(-?\d+)>", fields.get(name, ""))) else None
    http, _, payload = fields["block"].partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    if fields["warc-type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['warc-record-id']} isn't what its header says")
    return {"page_id": number("warc-record-id"), "payload_bytes": size, "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": number("warc-refers-to"), "target_uri": fields["warc-target-uri"], "payload": payload}


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, normalise the archives and read them back: one row per page."""
    folder = scratch_path(pages.sparkSession, "warc")
    read = read_archives(normalise(write_archives(pages, folder)))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


WARC_SQL = f"""
WITH rows AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT payload_digest, max(page_id) AS first FROM rows WHERE payload_bytes >= {REVISIT_BYTES} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id < first THEN first END AS refers_to
FROM rows LEFT JOIN firsts USING (payload_digest)
"""
