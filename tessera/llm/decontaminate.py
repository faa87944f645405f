"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts become their words joined by one space, with a space at either end, so that a pattern " w1 ... w10 " can only match
whole words. A table of block shifts says how far a search position can move on; where it says zero, the suffix hash
selects a bucket of patterns and a direct comparison confirms the occurrence. Many segments of text are searched in step,
so that each table look-up is one numpy operation. The patterns are a stated query set: they are taken in blocks of
bounded size, each broadcast on its own, and every block runs against all documents.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, as_bytes, pieces, set_aside, written

WINDOW = 10
#: Bytes of benchmark text searched for in one pass over the documents; more text makes more passes. A longer item is a block of its own.
BLOCK_BYTES = 4 << 20
#: Passes after which what was found is written, so that no job holds more broadcast blocks than these.
PASSES = 4
#: Bytes of a block, and entries of the shift table.
BLOCK, TABLE_BITS = 6, 20
#: Bytes of text that one of the searches in step walks over.
SEGMENT = 4096

_TO = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_TO).split()


def windows(words_: list[bytes], size: int = WINDOW) -> set[bytes]:
    """Each window as it stands in a joined text."""
    if not words_:
        return set()
    return {b" " + b" ".join(words_[i : i + size]) + b" " for i in range(max(1, len(words_) - size + 1))}


class WuManber:
    """Finds each occurrence of `patterns` (all of `least` bytes or more) in a joined text."""

    def __init__(self, patterns: list[bytes]):
        self.m = min(map(len, patterns))
        self.block = min(BLOCK, self.m)
        self.bits = TABLE_BITS if self.m >= 4 else 12
        self.longest = max(map(len, patterns))
        self.buckets: dict[bytes, list[int]] = {}
        self.patterns = patterns
        heads = np.frombuffer(b"".join(p[: self.m] for p in patterns), np.uint8).reshape(len(patterns), self.m)
        far = self.m - self.block + 1
        self.shift = np.full(1 << self.bits, far, np.int32)
        for j in range(far):  # later blocks have smaller shifts and so come last
            self.shift[self._hash(heads[:, j : j + self.block].T)] = far - 1 - j
        for k, p in enumerate(patterns):
            self.buckets.setdefault(p[: self.m], []).append(k)

    def _hash(self, columns: np.ndarray) -> np.ndarray:
        h = np.zeros(columns.shape[1:], np.uint32)
        for c in columns:
            h = (h * np.uint32(0x01000193)) ^ c
        return (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)

    def find(self, text: np.ndarray, raw: bytes) -> Iterator[tuple[int, int]]:
        """(start, pattern) of every occurrence in `raw`, whose bytes `text` holds."""
        n = len(raw)
        if n < self.m:
            return
        codes = self._hash(np.stack([text[i : n - self.block + 1 + i] for i in range(self.block)]))
        shift = self.shift[codes]
        back = self.m - self.block  # the block of a head that starts at p lies at p + back
        last = n - self.m
        at = np.arange(0, last + 1, SEGMENT)
        stop = np.minimum(at + SEGMENT, last + 1)
        found = []
        while len(at):
            s = shift[at + back]
            if (hit := s == 0).any():
                found.append(at[hit])
            at = at + np.maximum(s, 1)
            if not (live := at < stop).all():
                at, stop = at[live], stop[live]
        if not found:
            return
        m = self.m
        for p in np.sort(np.concatenate(found)).tolist():
            for k in self.buckets.get(raw[p : p + m], ()):
                if raw.startswith(self.patterns[k], p):
                    yield p, k


class Searcher:
    """A Wu-Manber table for each class of head length, so that short items don't shorten every shift."""

    def __init__(self, items: list[tuple[int, bytes]]):
        owners: dict[bytes, set[int]] = {}
        for item_id, text in items:
            for w in windows(words(text)):
                owners.setdefault(w, set()).add(item_id)
        self.owners = owners
        classes: dict[int, list[bytes]] = {}
        for w in sorted(owners):
            classes.setdefault(0 if len(w) < 8 else 1 if len(w) < 24 else 2 if len(w) < 48 else 3, []).append(w)
        self.tables = [WuManber(v) for _, v in sorted(classes.items())]

    def search(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, set[int]]]:
        """For each text the number of its words, which of them are hit, and the items with occurring windows."""
        normal = [b" " + b" ".join(words(t)) + b" " for t in texts]
        raw = b"".join(normal)
        text = np.frombuffer(raw, np.uint8)
        ends = np.cumsum([len(x) for x in normal])
        spaces = np.flatnonzero(text == 32)
        of = np.searchsorted(ends, spaces, "right")
        counts = np.bincount(of, minlength=len(texts))
        first = np.concatenate(([0], np.cumsum(counts)[:-1]))  # index of a text's first space
        marks: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[int]] = {}
        for table in self.tables:
            for p, k in table.find(text, raw):
                w = table.patterns[k]
                d = int(np.searchsorted(ends, p, "right"))
                if p + len(w) > ends[d]:
                    continue
                i = int(np.searchsorted(spaces, p))
                marks.setdefault(d, []).append((i - int(first[d]), w.count(b" ") - 1))
                items.setdefault(d, set()).update(self.owners[w])
        for d in range(len(texts)):
            n = max(0, int(counts[d]) - 1) if len(normal[d]) > 2 else 0
            hit = np.zeros(n + 1, np.int32)
            for i, k in marks.get(d, ()):
                hit[i] += 1
                hit[i + k] -= 1
            yield n, np.cumsum(hit)[:n] > 0, items.get(d, set())


def _blocks(benchmark: DataFrame, nbytes: int) -> Iterator[list[tuple[int, bytes]]]:
    """The query set in blocks of about `nbytes`, streamed to the driver one partition at a time; one empty block of an empty set."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").filter("text IS NOT NULL AND item_id IS NOT NULL").distinct().orderBy("item_id", "text").toLocalIterator():
        text = row.text.encode()
        if block and size + len(text) > nbytes:
            yield block
            block, size = [], 0
        block.append((row.item_id, text))
        size += len(text)
    yield block


_searchers: dict[str, Searcher] = {}


def _searcher(name: str, block: list[tuple[int, bytes]]) -> Searcher:
    """This worker's tables of a block."""
    if name not in _searchers:
        if len(_searchers) >= PASSES:
            _searchers.clear()
        _searchers[name] = Searcher(block)
    return _searchers[name]


def find_items(docs: DataFrame, benchmark: DataFrame, nbytes: int = BLOCK_BYTES) -> DataFrame:
    """docs' columns with _n_words, _hits (bitmap of hit words) and _items.

    Null and empty texts have no words and no hits; an item without words matches nothing; repeated rows of either table
    get the same answer as one. Columns other than text are passed through, whatever their names.
    """
    spark = docs.sparkSession
    out = docs
    for k, block in enumerate(_blocks(benchmark, nbytes)):
        if k and k % PASSES == 0:
            out = written(out, "decontaminate")
        name = uuid.uuid4().hex
        shared = spark.sparkContext.broadcast(block)
        schema = out.schema if k else out.select("*", F.lit(0).cast("long").alias("_n_words"), F.lit(b"").alias("_hits"), F.array(F.lit(0).cast("long")).alias("_items")).schema

        def run(batches, shared=shared, k=k, name=name):
            searcher = _searcher(name, shared.value)
            for batch in pieces(batches):
                n, hits, items = [], [], []
                for j, (count, hit, found) in enumerate(searcher.search(as_bytes(batch.column("text")))):
                    if k:
                        old = np.unpackbits(np.frombuffer(batch.column("_hits")[j].as_py(), np.uint8))[:count].astype(bool)
                        hit = hit | old
                        found = found | set(batch.column("_items")[j].as_py())
                    n.append(count)
                    hits.append(np.packbits(hit).tobytes())
                    items.append(sorted(found))
                new = [pa.array(n, pa.int64()), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.int64()))]
                old = [c for c, at in zip(batch.columns, batch.schema.names, strict=True) if at not in ("_n_words", "_hits", "_items")]
                names = [c for c in batch.schema.names if c not in ("_n_words", "_hits", "_items")]
                yield pa.RecordBatch.from_arrays([*old, *new], [*names, "_n_words", "_hits", "_items"])

        out = arrow(out, run, schema)
    return out


def report(docs: DataFrame, benchmark: DataFrame, nbytes: int = BLOCK_BYTES) -> DataFrame:
    """Every document's count of words, hit words and items, and whether it is contaminated."""

    def run(batches):
        for batch in batches:
            hits = [int(np.unpackbits(np.frombuffer(h, np.uint8)).sum()) for h in batch.column("_hits").to_pylist()]
            items = [sorted(map(str, x)) for x in batch.column("_items").to_pylist()]
            digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_n_words"), pa.array(hits, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(digest), pc.greater(pa.array(hits, pa.int64()), 0)],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    found = find_items(docs.select("doc_id", "text"), benchmark, nbytes).drop("text")
    return arrow(found, run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a benchmark window, with their own columns."""
    own = set_aside(docs, "doc_id", "text")
    return find_items(own, benchmark).filter(F.size("_items") == 0).select(*own.columns).toDF(*docs.columns)


#: DuckDB over `documents` and `benchmark`. Windows are joined on their words.
SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bx AS (SELECT item_id, least(len(ws), 10) AS k, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i, ws FROM bw WHERE len(ws) > 0),
pat AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS win FROM bx),
ps AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM dw),
nx AS (SELECT doc_id, i, x, lead(x, 1) OVER o AS a1, lead(x, 2) OVER o AS a2, lead(x, 3) OVER o AS a3, lead(x, 4) OVER o AS a4, lead(x, 5) OVER o AS a5,
              lead(x, 6) OVER o AS a6, lead(x, 7) OVER o AS a7, lead(x, 8) OVER o AS a8, lead(x, 9) OVER o AS a9
       FROM ps WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
ks AS (SELECT DISTINCT k FROM pat),
occ AS (SELECT doc_id, i, k, CASE k WHEN 1 THEN x WHEN 2 THEN x || ' ' || a1 WHEN 3 THEN x || ' ' || a1 || ' ' || a2 WHEN 4 THEN x || ' ' || a1 || ' ' || a2 || ' ' || a3
              WHEN 5 THEN x || ' ' || a1 || ' ' || a2 || ' ' || a3 || ' ' || a4 WHEN 6 THEN x || ' ' || a1 || ' ' || a2 || ' ' || a3 || ' ' || a4 || ' ' || a5
              WHEN 7 THEN x || ' ' || a1 || ' ' || a2 || ' ' || a3 || ' ' || a4 || ' ' || a5 || ' ' || a6
              WHEN 8 THEN x || ' ' || a1 || ' ' || a2 || ' ' || a3 || ' ' || a4 || ' ' || a5 || ' ' || a6 || ' ' || a7
              WHEN 9 THEN x || ' ' || a1 || ' ' || a2 || ' ' || a3 || ' ' || a4 || ' ' || a5 || ' ' || a6 || ' ' || a7 || ' ' || a8
              ELSE x || ' ' || a1 || ' ' || a2 || ' ' || a3 || ' ' || a4 || ' ' || a5 || ' ' || a6 || ' ' || a7 || ' ' || a8 || ' ' || a9 END AS win
       FROM nx CROSS JOIN ks),
m AS (SELECT doc_id, i, occ.k, item_id FROM occ JOIN pat ON occ.k = pat.k AND occ.win = pat.win),
hit AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS w FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM m) GROUP BY doc_id)
SELECT dw.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
