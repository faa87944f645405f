"""WARC archives through a table of chunks.

Where a page is read its payload is cut into rows (record, chunk number, bytes) of at most CHUNK bytes, each with the SHA-1
and the size up to it; these rows are a table, and no later step holds a record. Last chunks alone, without their bytes,
decide: of records with equal payloads of `least` bytes or more, that with the largest page_id is a response and the others
are revisits of it. A writer task takes decisions and chunks in order and streams them into gzip members, one a record; a
reader task streams the members back into the same rows.

Each task writes files of its own under names that no other attempt uses; only those of the attempt that succeeded are in
the manifest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, new_path, pieces, written
from .token_output import filesystem

CHUNK = 1 << 20
#: Compressed bytes of a file at which the next is begun.
FILE = 1 << 30
#: Tasks among which the records of one payload are dealt.
SALTS = 32
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def chunks(pages: DataFrame) -> DataFrame:
    """rec, page_id, url, chunk_no, last, digest, payload_bytes and data: a row for each chunk; digest (hexadecimal SHA-1) and payload_bytes are those up to it.

    Null html is an empty payload, of one empty chunk.
    """
    names = ["rec", "page_id", "url", "chunk_no", "last", "digest", "payload_bytes", "data"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.int64(), pa.binary()]

    def rows(batch):
        for rec, page_id, url, html in zip(*(batch.column(c) for c in ("rec", "page_id", "url", "html")), strict=True):
            body = memoryview(html.as_buffer() or b"") if html.is_valid else memoryview(b"")
            sha, count = hashlib.sha1(), max(1, -(-len(body) // CHUNK))
            for k in range(count):
                data = body[k * CHUNK : (k + 1) * CHUNK]
                sha.update(data)
                yield rec.as_py(), page_id.as_py(), url.as_py() if k == count - 1 else None, k, k == count - 1, sha.hexdigest(), min(len(body), (k + 1) * CHUNK), bytes(data)

    def run(batches):
        for batch in pieces(batches, column="html"):
            held, size = [], 0
            for r in rows(batch):
                held.append(r)
                size += len(r[-1]) + 200
                if size >= 4 * CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    read = pages.select(F.monotonically_increasing_id().alias("rec"), F.col("page_id").cast("long"), "url", "html")
    return arrow(read, run, "rec long, page_id long, url string, chunk_no int, last boolean, digest string, payload_bytes long, data binary")


def decided(table: DataFrame, least: int = 0) -> DataFrame:
    """rec, page_id, url, digest, payload_bytes and keeper, the response's page_id where the record is a revisit."""
    heads = table.filter("last").select("rec", "page_id", "url", "digest", "payload_bytes")
    # Combined before the shuffle: a payload that a third of all pages share is one row for each task.
    shared = heads.filter(F.col("payload_bytes") >= least).groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("keeper"), F.count("*").alias("k")).filter("k > 1").drop("k")
    # The records of one payload are dealt to SALTS tasks.
    shared = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = heads.withColumn("salt", F.pmod(F.hash("rec"), F.lit(SALTS))).join(shared, ["digest", "payload_bytes", "salt"], "left")
    return joined.select("rec", "page_id", "url", "digest", "payload_bytes", F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("keeper"))


def _head(page_id, url, sha1, payload_bytes, keeper, date) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n"
    fields = ["WARC/1.1", f"WARC-Type: {'response' if keeper is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        fields.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    fields.append(f"WARC-Payload-Digest: sha1:{_base32(sha1)}")
    if keeper is not None:
        fields += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{keeper}>"]
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (payload_bytes if keeper is None else 0)}"]
    return ("\r\n".join(fields) + "\r\n\r\n" + http).encode()


def write(pages: DataFrame, folder: str, least: int = 0, date: str = DATE) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) under `folder`; returns the manifest: path, n_records, n_bytes.

    Null html is an empty payload. Rows that repeat a page_id and payload are all responses or all revisits. Other columns
    aren't read; an empty table gives no file.
    """

    def run(batches):
        fs, place = filesystem(folder)
        fs.create_dir(place, recursive=True)
        out = gz = sha = path = head = None
        done, records, size = [], 0, 0

        def put(data: bytes) -> int:
            if data:
                out.write(data)
            return len(data)

        for batch in batches:
            for _, k, page_id, url, digest, n, keeper, last, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if out is None:
                    path, records, size = f"{place}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(path)
                if k < 0:  # the decision stands before the record's chunks
                    head, gz, sha = (page_id, digest, keeper), zlib.compressobj(1, zlib.DEFLATED, 31), hashlib.sha1()
                    size += put(gz.compress(_head(page_id, url, digest, n, keeper, date)))
                elif head[2] is None:
                    sha.update(data)
                    size += put(gz.compress(data))
                if last:
                    if head[2] is None and sha.hexdigest() != head[1]:
                        raise ValueError(f"record {head[0]}: its chunks don't give its digest")
                    size += put(gz.compress(b"\r\n\r\n")) + put(gz.flush())
                    records += 1
                    if size >= FILE:
                        out.close()
                        done.append((path, records, size))
                        out = None
        if out is not None:
            out.close()
            done.append((path, records, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*done, strict=True)], ["path", "n_records", "n_bytes"])

    spark = pages.sparkSession
    table = written(chunks(pages), "warc-chunks")
    heads = decided(table, least).select("rec", F.lit(-1).alias("chunk_no"), "page_id", "url", "digest", "payload_bytes", "keeper", F.lit(False).alias("last"), F.lit(None).cast("binary").alias("data"))
    rows = table.select("rec", "chunk_no", *[F.lit(None).cast(t).alias(c) for c, t in (("page_id", "long"), ("url", "string"), ("digest", "string"), ("payload_bytes", "long"), ("keeper", "long"))], "last", "data")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = heads.unionByName(rows).repartition(parts, "rec").sortWithinPartitions("rec", "chunk_no")
    return written(arrow(ordered, run, "path string, n_records long, n_bytes long"), "warc-manifest")


class _Stream:
    """The decompressed bytes of a file of gzip members, a piece at a time."""

    def __init__(self, f):
        self.f, self.gz, self.raw, self.held = f, zlib.decompressobj(31), b"", b""

    def more(self) -> bool:
        while True:
            if self.gz.eof:
                self.raw, self.gz = self.gz.unused_data, zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.f.read(CHUNK)
                if not self.raw:
                    return False
            got = self.gz.decompress(self.raw, CHUNK)
            self.raw = self.gz.unconsumed_tail
            if got:
                self.held += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        while (i := self.held.find(mark)) < 0:
            if not self.more():
                return None
        found, self.held = self.held[:i], self.held[i + len(mark) :]
        return found

    def take(self, n: int) -> Iterator[bytes]:
        """n bytes, in pieces of CHUNK and a shorter last one."""
        while n:
            while len(self.held) < min(n, CHUNK):
                if not self.more():
                    raise ValueError("a record ends early")
            piece = self.held[: min(n, CHUNK)]
            self.held = self.held[len(piece) :]
            n -= len(piece)
            yield piece


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}


def _page(uri: str | None) -> int | None:
    found = (uri or "").strip("<>").rpartition(":")[2]
    return int(found) if found.lstrip("-").isdigit() else None


def _records(f) -> Iterator[tuple]:
    """(page_id, type, refers_to, payload bytes so far, digest so far, chunk number, data, last) of every chunk; a revisit has the response's."""
    s = _Stream(f)
    while (head := s.until(b"\r\n\r\n")) is not None:
        h = _fields(head)
        http = s.until(b"\r\n\r\n")
        whole = int(_fields(http).get("content-length", 0))
        kind, page, refers = h["warc-type"], _page(h["warc-record-id"]), _page(h.get("warc-refers-to"))
        digest = h["warc-payload-digest"].partition(":")[2]
        rest = int(h["content-length"]) - len(http) - 4
        sha, n, k = hashlib.sha1(), 0, 0
        if not rest:
            yield page, kind, refers, whole, digest if kind == "revisit" else _base32(sha.hexdigest()), 0, b"", True
        for data in s.take(rest):
            sha.update(data)
            n += len(data)
            done = n == rest
            yield page, kind, refers, n, _base32(sha.hexdigest()), k, data, done
            k += 1
        if kind == "response" and _base32(sha.hexdigest()) != digest:
            raise ValueError(f"record {page}: its payload doesn't give its digest")
        if b"".join(s.take(4)) != b"\r\n\r\n":
            raise ValueError(f"record {page} isn't closed")


def read(manifest: DataFrame, data: bool = True) -> DataFrame:
    """The archives' chunk rows: page_id, record_type, refers_to, payload_bytes and payload_digest up to this chunk, chunk_no, data and last. Without `data`, the last rows alone and no payload leaves its task."""
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "chunk_no", "data", "last"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.bool_()]

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, name = filesystem(path)
                with fs.open_input_stream(name) as f:
                    rows, size = [], 0
                    for r in _records(f):
                        if data or r[-1]:
                            rows.append(r if data else (*r[:-2], b"", True))
                            size += len(r[-2]) if data else 200
                        if size >= 4 * CHUNK:
                            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    schema = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, chunk_no int, data binary, last boolean"
    return arrow(manifest.select("path").repartition(parts, "path"), run, schema)


def report(pages: DataFrame, least: int = 0) -> DataFrame:
    """Every record as it stands in the archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    manifest = write(pages, new_path(pages.sparkSession, "warc"), least)
    return read(manifest, data=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
