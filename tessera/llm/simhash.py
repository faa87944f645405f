"""SimHash near-duplicates found through pivot distance tables.

The Hamming distance to a fixed reference fingerprint (a pivot) moves by at most one for each differing bit, so two
fingerprints within 2 bits have pivot distances within 2 in every coordinate; a pair with a larger difference anywhere is
discarded without a comparison. The coordinates are split by blocks of bits: a distance is the sum of its distances inside
the 6 blocks, and 2 differing bits leave at least 4 blocks alone. The distances of those blocks to the pivots are then
equal on both sides, and their tuple is the key on which pairs meet: 15 choices of 4 blocks, each a key of some 40 bits.
Inside a bucket the pairs are discarded by maximum coordinate difference and survivors are verified by their bits.

Only distinct fingerprints take part, so exact copies cost nothing. A bucket with more than LARGE distinct fingerprints is
not compared in pairs: fingerprints within 2 bits share one that is within 1 bit of either, so those 65 neighbours are
grouped instead, in a shuffle that is linear in the bucket. Links become components by joins of stars on Spark.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, as_bytes, dropped, pieces, written

SEED, SHINGLE, BITS, NEAR = 42, 3, 64, 2
BLOCKS = 6
PIVOTS = 16
#: Distinct fingerprints of a bucket up to which its pairs go through the pivot table.
LARGE = 2_000
#: A group of components this many rounds deep would hold 2^ROUNDS fingerprints in a row.
ROUNDS = 40

_WIDTHS = [BITS // BLOCKS + (i < BITS % BLOCKS) for i in range(BLOCKS)]
_STARTS = np.cumsum([0, *_WIDTHS])
_MASKS = np.array([((1 << w) - 1) << int(s) for w, s in zip(_WIDTHS, _STARTS[:-1], strict=True)], np.uint64)
_KEPT = list(itertools.combinations(range(BLOCKS), BLOCKS - NEAR))
#: Reference fingerprints: random, from a fixed seed.
_PIVOTS = np.random.default_rng(SEED).integers(0, 1 << 63, PIVOTS, np.uint64) * np.uint64(2) + np.random.default_rng(SEED + 1).integers(0, 2, PIVOTS, np.uint64)


def _fingerprints(texts: list[bytes]) -> np.ndarray:
    hashes: list[int] = []
    counts = []
    digest = xxhash.xxh64_intdigest
    for text in texts:
        words = text.lower().split()
        if len(words) > SHINGLE:
            joined = b" ".join(words)
            starts = list(itertools.accumulate((len(w) + 1 for w in words), initial=0))
            new = [digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[SHINGLE:], strict=False)]
        else:
            new = [digest(b" ".join(words), SEED)] if words else []
        hashes += new
        counts.append(len(new))
    out = np.zeros(len(texts), np.uint64)
    if not hashes:
        return out
    bits = np.array(hashes, np.uint64)
    n = np.array(counts)
    full = n > 0
    at = np.concatenate(([0], np.cumsum(n)[:-1]))[full]
    for b in range(BITS):
        ones = np.add.reduceat((bits >> np.uint64(b)).astype(np.uint8) & 1, at, dtype=np.int64)
        out[full] |= (2 * ones > n[full]).astype(np.uint64) << np.uint64(b)
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long. Null and empty texts have fingerprint zero."""

    def run(batches):
        for batch in pieces(batches):
            fp = _fingerprints(as_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return arrow(docs.select("doc_id", "text"), run, "doc_id long, fp long")


def pivot_table(fp: np.ndarray) -> np.ndarray:
    """Distances of each fingerprint to each pivot, by block: fingerprints x blocks x pivots."""
    return np.bitwise_count((fp[:, None, None] ^ _PIVOTS) & _MASKS[None, :, None])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _keys(fp: np.ndarray) -> np.ndarray:
    """fingerprints x choices of blocks: the hash of a choice's block distances to all pivots."""
    parts = pivot_table(fp)
    power = np.random.default_rng(7).integers(1, 1 << 63, PIVOTS, np.uint64) | np.uint64(1)
    with np.errstate(over="ignore"):
        block = _mix((parts.astype(np.uint64) * power).sum(2, dtype=np.uint64))
        out = np.empty((len(fp), len(_KEPT)), np.uint64)
        for c, chosen in enumerate(_KEPT):
            h = np.full(len(fp), c + 1, np.uint64)
            for b in chosen:
                h = _mix(h + block[:, b])
            out[:, c] = h
    return out


def _edges_of(fp: np.ndarray) -> list[tuple[int, int]]:
    """Links inside one bucket, as a forest: each fingerprint with the smallest of its component."""
    table = pivot_table(fp).sum(1).astype(np.int16)
    order = np.argsort(table[:, 0], kind="stable")
    fp, table = fp[order], table[order]
    reach = np.searchsorted(table[:, 0], table[:, 0] + NEAR, "right")
    parent = np.arange(len(fp))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(fp)):
        j = np.arange(i + 1, reach[i])
        if len(j):
            j = j[(np.abs(table[j] - table[i]) <= NEAR).all(1)]
            for k in j[np.bitwise_count(fp[j] ^ fp[i]) <= NEAR]:
                a, b = root(i), root(k)
                if a != b:
                    parent[max(a, b)] = min(a, b)
    signed = fp.view(np.int64)
    return [(int(signed[root(i)]), int(signed[i])) for i in range(len(fp)) if root(i) != i]


def _links(distinct: DataFrame, large: int = LARGE) -> DataFrame:
    """kind 0: pairs (a, b) of fingerprints that link, enough to join all of a bucket. kind 1: those (a) of larger buckets."""

    def keyed(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 20_000):
                fp = batch.column("fp").to_numpy()[start : start + 20_000].view(np.uint64)
                keys = _keys(fp)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(fp, len(_KEPT)).view(np.int64))], ["key", "fp"])

    keys = arrow(distinct, keyed, "key long, fp long")
    # One exchange by key; a bucket is a run of rows in key order, and a large one is passed on without being held.
    parts = distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")
    sorted_keys = keys.repartition(int(parts), "key").sortWithinPartitions("key", "fp")

    def linked(batches):
        held_key, held, n = None, [], 0

        def flush():
            if 1 < n <= large:
                return [(0, a, b) for a, b in _edges_of(np.concatenate(held).view(np.uint64))]
            return []

        def out(rows):
            k, a, b = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["kind", "a", "b"])

        for batch in batches:
            key, fp = batch.column("key").to_numpy(), batch.column("fp").to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)])) if len(key) else []
            rows = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if key[a] != held_key:
                    rows += flush()
                    held_key, held, n = key[a], [], 0
                elif b - a == 1 and not n:
                    continue
                before = n
                n += int(b - a)
                if n <= large:
                    held.append(fp[a:b].copy())
                else:  # from the first row past the limit on, the bucket's fingerprints go to the linear way
                    rows += [(1, int(x), 0) for x in (np.concatenate([*held, fp[a:b]]) if before <= large else fp[a:b])]
                    held = []
            if rows:
                yield out(rows)
        if rows := flush():
            yield out(rows)

    # Checkpointed, as the links feed every round below.
    return written(arrow(sorted_keys, linked, "kind int, a long, b long"), "simhash-links")


def _balls(large: DataFrame) -> DataFrame:
    """Links among fingerprints of large buckets: all that are within 1 bit of the same value are within 2 of each other."""

    def run(batches):
        flips = np.concatenate(([0], np.uint64(1) << np.arange(BITS, dtype=np.uint64))).astype(np.uint64)
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for start in range(0, len(fp), 10_000):
                x = fp[start : start + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array((x[:, None] ^ flips).ravel().view(np.int64)), pa.array(np.repeat(x, BITS + 1).view(np.int64))], ["z", "fp"])

    # A value has at most 65 fingerprints around it, so its group is small whatever the input.
    return arrow(large, run, "z long, fp long").groupBy("z").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")).select("a", F.explode("all").alias("b")).filter("a != b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node reachable.

    Alternating stars: each node's larger neighbours, then its smaller ones, are linked to the smallest neighbour, until
    nothing changes. The smallest comes from a join with a pre-aggregated minimum, so no neighbourhood is ever gathered.
    """
    spark = edges.sparkSession
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")

    def star(e: DataFrame, large: bool) -> DataFrame:
        """large: of u's neighbours those above u, else u and those below, go to the least of u and its neighbours."""
        both = e.select(F.col("a").alias("v"), F.col("b").alias("u")) if not large else e.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(e.select(F.col("b").alias("v"), F.col("a").alias("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        joined = both.join(least, "u")
        moved = joined.filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")) if large else joined.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
        return moved.filter("a < b").distinct()

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = state(edges)
    for _ in range(ROUNDS):
        if not now[0]:
            break
        last, edges = edges, written(star(star(edges, True), False), "edges")
        dropped(last)
        before, now = now, state(edges)
        if before == now:
            break
    else:
        raise RuntimeError(f"components: not done after {ROUNDS} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable) of each row of docs.

    Repeated rows stay repeated; an empty table gives no rows. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    fps = written(fingerprints(docs), "fingerprints")
    distinct = fps.select("fp").distinct()
    found = _links(distinct)
    links = found.filter("kind = 0").select("a", "b")
    large = found.filter("kind = 1").select(F.col("a").alias("fp")).distinct()
    if not large.isEmpty():
        links = links.unionByName(_balls(large).select("a", "b"))
    roots = components(links)
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    with_root = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # Both sums below are combined before they are shuffled; a component of a third of all rows is one row for each task.
    with_root = written(with_root, "roots")
    least = with_root.groupBy("root").agg(F.min("first").alias("component_id"))
    of = with_root.join(least, "root").select("fp", "component_id")
    return fps.join(of, "fp").select("doc_id", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    return linked(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The document with the smallest doc_id of each component, with docs' own columns."""
    kept = linked(docs).filter("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi")
