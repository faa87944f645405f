"""Token ids as Parquet list columns, in files that can be read by token range or by metadata alone.

Documents are dealt into ranges of doc_id, sorted, encoded, and written by each task into files of its own: ids in a
dictionary-encoded list column, doc_id and positions delta-encoded, row groups of ROW_GROUP tokens, and a page index. A
manifest with one row a file holds its documents and tokens; its running sum gives every document the count of ids before it.
Files appear in the manifest only through the task attempt that succeeded, under names that no other attempt uses, so a
lost executor leaves at most files that nobody reads.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import arrow, as_bytes, new_path, pieces, written

#: Tokens of a row group and of a file, at which the next is begun (a document is never split).
ROW_GROUP, FILE = 4_000_000, 64_000_000
END = 2

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.field("element", pa.int32())))])


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system for a path of Spark's shared folder, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)
    return pafs.LocalFileSystem(), path


class _Writer:
    def __init__(self, folder: str, part: int, row_group: int, file: int):
        self.row_group, self.file = row_group, file
        self.fs, self.folder = filesystem(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.part, self.seq, self.rows, self.held, self.done = part, 0, 0, 0, []
        self.out = None
        self.buffer: list[pa.Table] = []

    def add(self, batch: pa.Table, tokens: int) -> None:
        if self.out is None:
            self.path = f"{self.folder}/part-{self.part:06d}-{self.seq:04d}-{uuid.uuid4().hex}.parquet"
            self.sink = self.fs.open_output_stream(self.path)
            self.out = pq.ParquetWriter(
                self.sink, _SCHEMA, compression="zstd", use_dictionary=["ids.list.element"], write_page_index=True, data_page_size=1 << 18,
                column_encoding={"doc_id": "DELTA_BINARY_PACKED", "offset": "DELTA_BINARY_PACKED", "n_tokens": "DELTA_BINARY_PACKED"}, dictionary_pagesize_limit=1 << 20,
            )
            self.rows = self.tokens = 0
            self.first = batch.column("doc_id")[0].as_py()
        self.buffer.append(batch)
        self.held += tokens
        self.tokens += tokens
        self.rows += batch.num_rows
        self.last = batch.column("doc_id")[-1].as_py()
        if self.held >= self.row_group:
            self.flush()
        if self.tokens >= self.file:
            self.close()

    def flush(self) -> None:
        if self.buffer:
            self.out.write_table(pa.concat_tables(self.buffer), row_group_size=1 << 30)
        self.buffer, self.held = [], 0

    def close(self) -> None:
        if self.out is not None:
            self.flush()
            self.out.close()
            self.sink.close()
            self.done.append((self.part, self.seq, self.path, self.rows, self.tokens, self.first, self.last))
            self.out = None
            self.seq += 1


def write(docs: DataFrame, model: str, folder: str, end_id: int = END, row_group: int = ROW_GROUP, file: int = FILE) -> DataFrame:
    """Writes docs' ids under `folder` and returns the manifest: part, seq, path, n_docs, n_tokens, first and last doc_id, and start of each file.

    Null and empty texts hold the end id alone. Rows with equal or null doc_id each keep a place, next to each other; null is
    before all others. Other columns aren't read; an empty table gives no file.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        enc, out = encoder(shared.value), _Writer(folder, TaskContext.get().partitionId(), row_group, file)
        for batch in pieces(batches, min(4 << 20, row_group)):
            ids = [np.append(x, np.int32(end_id)) for x in enc.encode([b.decode("utf-8", "replace") for b in as_bytes(batch.column("text"))])]
            n = np.array([len(x) for x in ids])
            offset = np.cumsum(n) - n + (out.tokens if out.out is not None else 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(np.concatenate(ids)))
            out.add(pa.Table.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(offset), pa.array(n), lists], schema=_SCHEMA), int(n.sum()))
        out.close()
        if out.done:
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out.done, strict=True), types, strict=True)], ["part", "seq", "path", "n_docs", "n_tokens", "first_doc", "last_doc"])

    ranged = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    manifest = written(arrow(ranged, run, "part long, seq long, path string, n_docs long, n_tokens long, first_doc long, last_doc long"), "tokens-manifest")
    before = F.sum("n_tokens").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))  # one row a file
    return manifest.withColumn("start", F.coalesce(before, F.lit(0)).cast("long"))


def read(manifest: DataFrame, columns: tuple[str, ...] = ("doc_id", "offset", "n_tokens", "ids"), tokens: tuple[int, int] | None = None, doc_ids: tuple[int, int] | None = None) -> DataFrame:
    """The files' rows with start, the count of ids before each; only `columns` are read from disk.

    `tokens` (from, to) gives the documents that hold any of those ids of the whole sequence, `doc_ids` (first, last) those
    of a range. Files outside are skipped by the manifest, row groups by their statistics.
    """
    fields = {"doc_id": "doc_id long", "offset": "offset long", "n_tokens": "n_tokens long", "ids": "ids array<int>"}
    if tokens is not None:
        manifest = manifest.filter((F.col("start") < tokens[1]) & (F.col("start") + F.col("n_tokens") > tokens[0]))
    if doc_ids is not None:
        manifest = manifest.filter((F.col("last_doc") >= doc_ids[0]) & (F.coalesce("first_doc", "last_doc") <= doc_ids[1]))
    extra = [c for c, on in (("offset", tokens), ("n_tokens", tokens), ("doc_id", doc_ids)) if on is not None]
    wanted = tuple(dict.fromkeys([*columns, *extra]))

    def run(batches):
        for start, batch in _groups(batches, wanted, tokens, doc_ids):
            at = pa.array(batch.column("offset").to_numpy() + start) if "offset" in wanted else pa.nulls(batch.num_rows, pa.int64())
            out = pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], at], [*columns, "start"])
            keep = np.ones(batch.num_rows, bool)
            if tokens is not None:
                keep &= (at.to_numpy() < tokens[1]) & (at.to_numpy() + batch.column("n_tokens").to_numpy() > tokens[0])
            if doc_ids is not None:
                ids = batch.column("doc_id").to_pandas()
                keep &= ids.between(*doc_ids).to_numpy()
            if keep.any():
                yield out.filter(pa.array(keep))

    return arrow(_dealt(manifest), run, ", ".join([*[fields[c] for c in columns], "start long"]))


def _dealt(manifest: DataFrame) -> DataFrame:
    return manifest.select("path", "start").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")


def groups_in(file: pq.ParquetFile, tokens: tuple[int, int] | None, doc_ids: tuple[int, int] | None) -> list[int]:
    """The row groups that may hold documents with any of the file's ids [from, to) or of a range of doc_id, by their statistics."""
    meta, place = file.metadata, {name: k for k, name in enumerate(("doc_id", "offset", "n_tokens"))}
    stats = lambda g, c: meta.row_group(g).column(place[c]).statistics
    found = []
    for g in range(meta.num_row_groups):
        if tokens is not None:
            end = stats(g + 1, "offset").min if g + 1 < meta.num_row_groups else tokens[1]
            if stats(g, "offset").min >= tokens[1] or (g + 1 < meta.num_row_groups and end <= tokens[0]):
                continue
        if doc_ids is not None and (not (s := stats(g, "doc_id")).has_min_max or s.max < doc_ids[0] or s.min > doc_ids[1]):
            continue
        found.append(g)
    return found


def _groups(batches, columns, tokens=None, doc_ids=None) -> Iterator[tuple[int, pa.RecordBatch]]:
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
            fs, name = filesystem(path)
            with fs.open_input_file(name) as f:
                file = pq.ParquetFile(f)
                inside = groups_in(file, tokens and (tokens[0] - start, tokens[1] - start), doc_ids)
                for found in file.iter_batches(2_000, row_groups=inside, columns=list(columns)) if inside else ():
                    yield start, found


def report(docs: DataFrame, model: str) -> DataFrame:
    """Every document from the files: start, n_tokens and the checksum of its ids."""

    def run(batches):
        for start, batch in _groups(batches, ("doc_id", "offset", "n_tokens", "ids")):
            lists = batch.column("ids")
            flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(batch.column("offset").to_numpy() + start), batch.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    manifest = write(docs, model, new_path(docs.sparkSession, "tokens"))
    return arrow(_dealt(manifest), run, "doc_id long, start long, n_tokens long, ids_crc32 long")
