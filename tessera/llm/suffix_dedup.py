"""Suffix-array dedup: byte strings of LENGTH that also start earlier are removed, by a run-length index.

1. A window is a string of LENGTH bytes. Its anchor is the least hash among its GRAM-byte grams, the leftmost if tied: a
   function of the window's content, so equal windows have equal anchors. The windows of one anchor occurrence are a run of
   starts; their bytes are a segment (about 140 bytes, one for each 43 bytes of text).
2. Segments meet by anchor. Of equal segments the earliest stays and the others are repeats throughout; they are combined
   within each piece of input before the shuffle. Where an anchor has several distinct segments, the earliest of each goes on.
3. A window that two segments of an anchor share holds LENGTH - GRAM bytes beside the anchor: k times UNIT of them before it
   and the rest but two parts of a UNIT after it, for some k. Segments that have such bytes in common with no other one share
   no window and go no further. The others form texts of bounded size, each with whole anchors. For each a run-compressed Burrows-Wheeler transform is
   built, with the suffix sampled at both sides of every run boundary and the length of their match. The index yields, for
   a stream of all positions, matching statistics: the match with the lexicographic predecessor, which falls by one with
   each position until the next sample. Positions with LENGTH or more link to that predecessor; of a chain all but the
   earliest window are repeats.
4. An anchor with more than TEXT bytes of distinct segments doesn't fit into a text. Its windows are grouped by content
   instead, with a minimum combined before the shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, as_bytes, pieces, written

LENGTH, GRAM = 100, 16
#: Bytes of a text that is indexed, and of the largest single anchor in one.
TEXT, ANCHOR = 1 << 20, 8 << 20
#: Window starts looked at together.
SPAN = 1 << 18

_GRAMS = LENGTH - GRAM + 1
#: Bytes in which what equal windows share beside their anchors is counted, and how many times that is there on both sides in all, at least.
UNIT = 12
_UNITS = -(-(LENGTH - GRAM - 2 * (UNIT - 1)) // UNIT)
_ENTRY = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
_R = np.uint64(0xD6E8FEB86659FD93)
_R_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_LOW = np.uint64((1 << 20) - 1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_POWER, _INVERSE = _powers(_R, 1 << 20), _powers(_R_INVERSE, 1 << 20)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _segments(text: np.ndarray, valid: np.ndarray):
    """Of the window starts marked valid: each segment's first start, number of windows, anchor hash and content hash."""
    x = _ENTRY[text]
    h, step = x, 1
    for odd in _ODD:
        h = h[:-step] * odd + h[step:]
        step *= 2
    key = (_mix(h) & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    low, width = key, 1
    while 2 * width <= _GRAMS:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (_GRAMS - width)], low[_GRAMS - width :])
    starts = np.flatnonzero(valid[: len(low)])
    if not len(starts):
        e = np.zeros(0, np.uint64)
        return starts, starts, e, e
    anchor = low[starts]
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1))))
    n = np.diff(np.concatenate((first, [len(starts)])))
    s = starts[first]
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * _POWER[: len(x)])))
    content = _mix((prefix[s + n + LENGTH - 1] - prefix[s]) * _INVERSE[s] + n.astype(np.uint64))
    return s, n, anchor[first] >> np.uint64(20), content


def _spans(texts: list[bytes]):
    """Pieces of the joined texts: bytes, valid window starts, and the text and offset of each position."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts])
    begin = np.cumsum(size) - size
    of = np.repeat(np.arange(len(texts)), size)
    left = np.repeat(begin + size, size) - np.arange(len(raw))
    valid = left >= LENGTH
    for a in range(0, len(raw), SPAN):
        b = min(len(raw), a + SPAN + LENGTH - 1)
        ok = valid[a:b].copy()
        ok[SPAN:] = False
        if b - a >= LENGTH:
            yield raw[a:b], ok, of[a:b], np.arange(a, b) - begin[of[a:b]]


def _records(docs: DataFrame) -> DataFrame:
    """kind 0: a segment (anchor, content, doc_id, start, n). kind 1: windows known to be repeats within a piece."""

    def run(batches):
        for batch in pieces(batches, 1 << 20):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            for text, ok, of, offset in _spans(as_bytes(batch.column("text"))):
                s, n, anchor, content = _segments(text, ok)
                if not len(s):
                    continue
                doc, start = ids[of[s]], offset[s]
                order = np.lexsort((start, doc, content, anchor))
                new = np.concatenate(([True], (anchor[order][1:] != anchor[order][:-1]) | (content[order][1:] != content[order][:-1])))
                head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
                again = (doc[order] != doc[head]) | (start[order] != start[head])
                repeat = np.zeros(len(s), bool)
                repeat[order[~new & again]] = True
                keep = np.zeros(len(s), bool)
                keep[order[new]] = True
                # Repeats that follow each other in a document are one row.
                r = np.flatnonzero(repeat)
                joint = np.concatenate(([False], (doc[r][1:] == doc[r][:-1]) & (start[r][1:] == start[r][:-1] + n[r][:-1]))) if len(r) else np.zeros(0, bool)
                at = np.flatnonzero(~joint)
                total = np.add.reduceat(n[r], at) if len(at) else np.zeros(0, np.int64)
                k = np.flatnonzero(keep)
                columns = (
                    (np.concatenate((np.zeros(len(k), np.int32), np.ones(len(at), np.int32)))), np.concatenate((anchor[k], r[at].astype(np.uint64))).view(np.int64),
                    np.concatenate((content[k], np.zeros(len(at), np.uint64))).view(np.int64), np.concatenate((doc[k], doc[r[at]])),
                    np.concatenate((start[k], start[r[at]])).astype(np.int64), np.concatenate((n[k], total)).astype(np.int32),
                )
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "anchor", "content", "doc_id", "start", "n"])

    return arrow(docs.filter("doc_id IS NOT NULL").select("doc_id", "text"), run, "kind int, anchor long, content long, doc_id long, start long, n int")


def _decided(records: DataFrame, parts: int) -> DataFrame:
    """kind 1: repeats; kind 0: the earliest of each distinct segment of an anchor that has several."""
    dealt = records.repartition(parts, "anchor").sortWithinPartitions("kind", "anchor", "content", "doc_id", "start")
    names = ["kind", "anchor", "doc_id", "start", "n"]

    def run(batches):
        last_a = last_c = None  # anchor and content of the row before
        head = (None, None)  # doc_id and start of that content's earliest
        held, n_distinct = None, 0  # that anchor's only segment so far, not yet passed on

        for batch in batches:
            kind, anchor, content, doc, start, n = (c.to_numpy() for c in batch.columns)
            out = []
            done = kind == 1
            if done.any():
                out.append((kind[done], anchor[done], doc[done], start[done], n[done]))
                keep = ~done
                kind, anchor, content, doc, start, n = (c[keep] for c in (kind, anchor, content, doc, start, n))
            if len(kind):
                new_a = np.concatenate(([anchor[0] != last_a], anchor[1:] != anchor[:-1]))
                new_c = new_a | np.concatenate(([content[0] != last_c], content[1:] != content[:-1]))
                at = np.maximum.accumulate(np.where(new_c, np.arange(len(kind)), -1))
                h_doc = np.where(at < 0, -1 if head[0] is None else head[0], doc[np.maximum(at, 0)])
                h_start = np.where(at < 0, -1 if head[1] is None else head[1], start[np.maximum(at, 0)])
                gone = ~new_c & ((doc != h_doc) | (start != h_start))
                out.append((np.ones(gone.sum(), np.int32), anchor[gone], doc[gone], start[gone], n[gone]))
                group = np.cumsum(new_a)  # 0: the anchor of the row before
                distinct = np.bincount(group[new_c], minlength=int(group[-1]) + 1)
                distinct[0] += n_distinct
                ask = new_c & (distinct[group] > 1)
                if held is not None and distinct[0] > 1:
                    out.append(tuple(np.array([v]) for v in (0, *held)))
                    held = None
                out.append((np.zeros(ask.sum(), np.int32), anchor[ask], doc[ask], start[ask], n[ask]))
                if group[-1] > 0:
                    held = None
                    if distinct[group[-1]] == 1:
                        i = int(np.flatnonzero(new_a)[-1])
                        held = (anchor[i], doc[i], start[i], n[i])
                last_a, last_c, head, n_distinct = anchor[-1], content[-1], (int(h_doc[-1]), int(h_start[-1])), int(distinct[group[-1]])
            cols = [np.concatenate(c) for c in zip(*out, strict=True)]
            if len(cols[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(cols, (np.int32, np.int64, np.int64, np.int64, np.int32), strict=True)], names)

    return arrow(dealt, run, "kind int, anchor long, doc_id long, start long, n int")


class RunIndex:
    """A run-compressed Burrows-Wheeler transform of a text with samples at run boundaries.

    Kept are the boundaries' text positions in order, the lexicographic predecessor of each and the length of their match:
    three numbers for each run, whatever the length of the text.
    """

    def __init__(self, text: np.ndarray):
        n = self.n = len(text)
        padded = np.concatenate((text, np.zeros(8, np.uint8))).astype(np.uint64)
        key = np.zeros(n, np.uint64)
        for j in range(8):
            key = (key << np.uint64(8)) | padded[j : n + j]
        levels, depth = [], 8
        while True:
            order = np.argsort(key)  # equal keys get one rank, and at last none are equal
            rank, sorted_ = np.empty(n, np.int64), key[order]
            rank[order] = np.cumsum(np.concatenate(([0], sorted_[1:] != sorted_[:-1])))
            levels.append((depth, rank.astype(np.int32)))
            if rank[order[-1]] == n - 1:
                break
            behind = np.zeros(n, np.int64)
            behind[: max(0, n - depth)] = rank[depth:] + 1
            key = (rank * np.int64(n + 1) + behind).astype(np.uint64)
            depth *= 2
        before = text[order - 1].astype(np.int16)
        before[order == 0] = -1
        edge = np.concatenate(([True], before[1:] != before[:-1]))  # starts of runs
        at = np.flatnonzero(edge)
        position, previous = order[at], np.where(at > 0, order[np.maximum(at - 1, 0)], -1)
        match = self._match(text, position, previous, levels)
        by = np.argsort(position)
        self.position, self.previous, self.match = position[by], previous[by], match[by]

    @staticmethod
    def _match(text, a, b, levels) -> np.ndarray:
        n = len(text)
        out = np.zeros(len(a), np.int64)
        live = b >= 0
        for depth, rank in reversed(levels):
            for _ in range(2 if depth == levels[-1][0] else 1):
                i, j = a + out, b + out
                same = live & (i + depth <= n) & (j + depth <= n)
                same[same] = rank[i[same]] == rank[j[same]]
                out[same] += depth
        for _ in range(8):
            i, j = a + out, b + out
            same = live & (i < n) & (j < n)
            same[same] = text[i[same]] == text[j[same]]
            live = same
            out[same] += 1
        return out

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For each position of the text, in order: its match's length with the predecessor, and where that starts."""
        mark = np.zeros(self.n, np.int64)
        mark[self.position] = np.arange(len(self.position))
        at = np.maximum.accumulate(mark)
        on = np.arange(self.n) - self.position[at]
        return self.match[at] - on, self.previous[at] + on


def repeats(segments: list[bytes]) -> list[np.ndarray]:
    """For each of the segments, in order of occurrence: which of its windows are windows of an earlier one."""
    text = np.frombuffer(b"\xff".join(segments) + b"\xff", np.uint8)
    size = np.array([len(s) for s in segments])
    begin = np.cumsum(size + 1) - size - 1
    of = np.repeat(np.arange(len(size)), size + 1)
    window = (np.repeat(begin + size, size + 1) - np.arange(len(text))) >= LENGTH
    length, where = RunIndex(text).statistics()
    long = window & (length >= LENGTH)
    head = np.where(long, where, np.arange(len(text)))
    while ((further := head[head]) != head).any():
        head = further
    first = np.full(len(text), len(text), np.int64)
    w = np.flatnonzero(window)
    np.minimum.at(first, head[w], w)
    again = np.zeros(len(text), bool)
    again[w] = first[head[w]] != w
    return [again[b : b + s - LENGTH + 1] for b, s in zip(begin, size, strict=True)]


def meeting(segments: list[bytes], anchors: np.ndarray) -> np.ndarray:
    """Which of the segments, each with its anchor's hash, have what stands beside the anchor, _UNITS times UNIT bytes split between both sides in some way, in common with another one of that anchor."""
    raw = np.frombuffer(b"".join(segments), np.uint8)
    size = np.array([len(x) for x in segments])
    begin = np.cumsum(size) - size
    h, step = _ENTRY[raw], 1
    for odd in _ODD:
        h = h[:-step] * odd + h[step:]
        step *= 2
    hits = np.flatnonzero(_mix(h) >> np.uint64(20) == np.repeat(anchors.view(np.uint64), size)[: len(h)])
    of, first = np.unique(np.searchsorted(begin, hits, "right") - 1, return_index=True)  # the anchor is the first gram of its hash in a segment
    at = np.zeros(len(size), np.int64)
    at[of] = hits[first]
    out, own = np.zeros(len(size), bool), _mix(anchors.view(np.uint64))
    for k in range(_UNITS + 1):
        before, after = UNIT * k, UNIT * (_UNITS - k)
        which = np.flatnonzero((at - before >= begin) & (at + GRAM + after <= begin + size))
        beside = at[which, None] + np.concatenate((np.arange(-before, 0), np.arange(GRAM, GRAM + after)))
        _, same, many = np.unique(_mix((_ENTRY[raw[beside]] * _POWER[: before + after]).sum(1) ^ own[which]), return_inverse=True, return_counts=True)
        out[which] |= many[same] > 1
    return out


def _texts(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """anchor, doc_id, start and the bytes of each asked segment."""
    per_doc = asked.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "start", "n")).alias("at"))  # at most a document's own segments

    def run(batches):
        for batch in pieces(batches):
            anchor, doc, start, data = [], [], [], []
            for i, text, at in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), batch.column("at"), strict=True):
                for x, s, n in zip(*(at.values.field(k).to_pylist() for k in range(3)), strict=True):
                    anchor.append(x)
                    doc.append(i)
                    start.append(s)
                    data.append(text[s : s + n + LENGTH - 1])
            yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(data, pa.binary())], ["anchor", "doc_id", "start", "data"])

    return arrow(docs.select("doc_id", "text").join(per_doc, "doc_id"), run, "anchor long, doc_id long, start long, data binary")


def _indexed(segments: DataFrame, parts: int, most: int = ANCHOR) -> DataFrame:
    """kind 1: repeats (doc_id, start, n). kind 2: single windows of too large anchors, with two hashes of their content."""
    dealt = segments.repartition(parts, "anchor").sortWithinPartitions("anchor", "doc_id", "start")
    names = ["kind", "doc_id", "start", "n", "w1", "w2"]

    def runs(rows):
        doc, start, n = [], [], []
        rows = [rows[k] for k in np.flatnonzero(meeting([r[2] for r in rows], np.array([r[3] for r in rows], np.int64))).tolist()]
        for (i, s, *_), again in zip(rows, repeats([r[2] for r in rows]) if rows else (), strict=True):
            edge = np.flatnonzero(np.diff(np.concatenate(([0], again.view(np.int8), [0]))))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                doc.append(i)
                start.append(s + a)
                n.append(b - a)
        k = len(doc)
        return pa.RecordBatch.from_arrays([pa.array([1] * k, pa.int32()), pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int32()), pa.array([0] * k, pa.int64()), pa.array([0] * k, pa.int64())], names)

    def windows(rows):
        doc, start, a, b = [], [], [], []
        for i, s, data, _ in rows:
            for o in range(len(data) - LENGTH + 1):
                d = hashlib.blake2b(data[o : o + LENGTH], digest_size=16).digest()
                doc.append(i)
                start.append(s + o)
                a.append(int.from_bytes(d[:8], "little", signed=True))
                b.append(int.from_bytes(d[8:], "little", signed=True))
        k = len(doc)
        return pa.RecordBatch.from_arrays([pa.array([2] * k, pa.int32()), pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array([1] * k, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names)

    def run(batches):
        text, size = [], 0  # whole anchors
        own, own_size, anchor, large = [], 0, None, False  # the anchor being read
        for batch in batches:
            for x, i, s, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if x != anchor:
                    if large:
                        if own:
                            yield windows(own)
                    else:
                        text += own
                        size += own_size
                        if size >= TEXT:
                            yield runs(text)
                            text, size = [], 0
                    own, own_size, anchor, large = [], 0, x, False
                own.append((i, s, data, x))
                own_size += len(data)
                if own_size > (1 << 16 if large else most):
                    large = True
                    for k in range(0, len(own), 1000):
                        yield windows(own[k : k + 1000])
                    own, own_size = [], 0
        if large and own:
            yield windows(own)
        elif not large:
            text += own
        if text:
            yield runs(text)

    return arrow(dealt, run, "kind int, doc_id long, start long, n int, w1 long, w2 long")


def _by_content(windows: DataFrame) -> DataFrame:
    first = windows.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("k")).filter("k > 1").drop("k")
    return windows.join(first, ["w1", "w2"]).filter("doc_id > first.doc_id OR (doc_id = first.doc_id AND start > first.start)").select("doc_id", "start", "n")


def repeated_windows(docs: DataFrame, most: int = ANCHOR) -> DataFrame:
    """doc_id, start and n: n windows from start on that also start earlier (smaller doc_id, or same document and start)."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    decided = written(_decided(_records(docs), parts), "segments-decided")
    found = written(_indexed(_texts(docs, decided.filter("kind = 0")), parts, most), "segments-indexed")
    out = decided.filter("kind = 1").select("doc_id", "start", "n").unionByName(found.filter("kind = 1").select("doc_id", "start", "n"))
    large = found.filter("kind = 2").select("doc_id", "start", "n", "w1", "w2")
    return out if large.isEmpty() else out.unionByName(_by_content(large))


def dedup(docs: DataFrame, most: int = ANCHOR) -> DataFrame:
    """doc_id, kept (the remaining bytes), n_bytes, n_removed and n_spans of every row.

    A null text is empty; texts under LENGTH bytes lose nothing by themselves. Rows that share a doc_id are taken as one
    document and lose the same bytes. A null doc_id is compared with nothing. The remaining bytes may split a character.
    """
    ranges = repeated_windows(docs, most).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("gone"))  # a document's own ranges

    def run(batches):
        for batch in pieces(batches):
            kept, n_bytes, n_removed, n_spans = [], [], [], []
            for text, gone in zip(as_bytes(batch.column("text")), batch.column("gone"), strict=True):
                cover = np.zeros(len(text) + 1, np.int32)
                if gone.is_valid:
                    start, n = (gone.values.field(k).to_numpy() for k in range(2))
                    np.add.at(cover, start, 1)
                    np.add.at(cover, np.minimum(start + n + LENGTH - 1, len(text)), -1)
                out = np.cumsum(cover[:-1]) > 0 if len(text) else np.zeros(0, bool)
                kept.append(np.frombuffer(text, np.uint8)[~out].tobytes())
                n_bytes.append(len(text))
                n_removed.append(int(out.sum()))
                n_spans.append(int((np.diff(np.concatenate(([0], out.view(np.int8)))) == 1).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary()), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64())], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    joined = docs.select("doc_id", "text").join(ranges, "doc_id", "left")
    return arrow(joined, run, joined.select("doc_id").schema.add("kept", "binary").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long"))


def report(docs: DataFrame, most: int = ANCHOR) -> DataFrame:
    return dedup(docs, most).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
