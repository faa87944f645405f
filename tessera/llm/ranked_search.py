"""Ranked lexical search over an index of documents in the order of recursive graph bisection.

Every task takes documents in chunks, orders a chunk by recursive graph bisection (halves exchange documents while that lowers the
summed logarithms of gaps between a term's documents) and cuts the order into shards of alike documents. A shard keeps its postings and,
for each term, the greatest frequency and the least length of its documents, from which no document of it can score more than a bound.
A search takes items in blocks. The shards of the greatest bounds are searched first and give each item a score that its tenth
document has at least; then every task visits its shards by falling bounds and stops at the first below that score or the task's
own tenth, so that no document that ranks is left out. Equal scores go by doc_id, to which positions in shards lead back.

Defined results: null texts and texts without a term are in no shard and not counted; an item without a known term has no row; a
repeated document ranks as often as it stands there, a repeated item is answered as often; a null doc_id goes before the others of its
score; empty tables give an empty result; other columns are not read. A text of any length is read in slices.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow, pieces, written

TOP = 10
#: Documents and bytes of text that are bisected together, and documents and postings of a shard.
CHUNK, CHUNK_BYTES, SHARD, SHARD_POSTINGS = 2_048, 8 << 20, 64, 1 << 18
#: Exchanges of documents between two halves, at most.
EXCHANGES = 6
#: Items of a block, shards searched first for an item, shards whose bounds are ordered together.
BLOCK, BLOCK_BYTES, FIRST, GROUP = 512, 4 << 20, 2, 32
#: Shards that are read and handed to Python together: a batch of Spark's own size would hold all of a partition, which grows with the input.
ROWS = 32
_SLICE = 1 << 20
_INDEX = "shard bigint, doc_ids array<bigint>, lengths array<bigint>, terms array<binary>, starts array<int>, most array<bigint>, shortest array<bigint>, docs array<smallint>, tfs array<int>"

# A term is a run of ASCII letters, digits and what is not ASCII; A-Z count as a-z.
_FOLD = bytes(c if c >= 128 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))


def counted(text: bytes) -> Counter:
    """The terms of a text and how often each occurs."""
    folded = text.translate(_FOLD)
    if len(folded) <= _SLICE:
        return Counter(folded.split())
    found: Counter = Counter()
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + _SLICE)
        end = len(folded) if end < 0 else end
        found.update(folded[at:end].split())
        at = end
    return found


def bisected(doc: np.ndarray, term: np.ndarray, n_docs: int, leaf: int = SHARD, exchanges: int = EXCHANGES) -> np.ndarray:
    """The documents 0 .. n_docs - 1 in the order of recursive graph bisection; (doc, term) are the distinct pairs.

    All parts of a level are halved at once. A term of a part with a documents among the n on one side adds a * log2(n / (a + 1))
    for that side, about what the gaps between its documents take; documents change sides in pairs while their two gains add to more
    than nothing.
    """
    order = np.arange(n_docs)
    common = np.bincount(term, minlength=1)[term] > 1  # a term of one document costs as much wherever that goes
    doc, term = doc[common], term[common]
    part = np.zeros(n_docs, np.int64)
    width = int(term.max()) + 1 if len(term) else 1
    size = n_docs
    while size > leaf:
        n_parts = int(part.max()) + 1
        sizes = np.bincount(part, minlength=n_parts)
        rank = np.arange(n_docs) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        side = np.empty(n_docs, np.int8)
        side[order] = rank >= np.repeat((sizes + 1) // 2, sizes)
        left, right = (sizes + 1) // 2, sizes // 2
        kinds, key = np.unique(part[doc] * width + term, return_inverse=True)
        of_part = kinds // width
        all_ = np.bincount(key, minlength=len(kinds))
        n1, n2 = np.maximum(left[of_part], 1), np.maximum(right[of_part], 1)
        cost = lambda a, n: a * np.log2(n / (a + 1.0))
        for _ in range(exchanges if len(kinds) else 0):
            b = np.bincount(key, weights=side[doc], minlength=len(kinds))
            a = all_ - b
            now = cost(a, n1) + cost(b, n2)
            to_right = now - cost(np.maximum(a - 1, 0), n1) - cost(b + 1, n2)
            to_left = now - cost(a + 1, n1) - cost(np.maximum(b - 1, 0), n2)
            gain = np.bincount(doc, weights=np.where(side[doc] == 0, to_right[key], to_left[key]), minlength=n_docs)
            ranked = np.lexsort((-gain, part, side))
            one, two = ranked[: n_docs - int(side.sum())], ranked[n_docs - int(side.sum()) :]
            at = np.arange(len(two)) - np.repeat(np.cumsum(right) - right, right)  # rank within the right half of its part
            one = one[(np.cumsum(left) - left)[part[two]] + at]
            swap = gain[one] + gain[two] > 1e-9
            if not swap.any():
                break
            side[one[swap]], side[two[swap]] = 1, 0
        before = np.empty(n_docs, np.int64)
        before[order] = np.arange(n_docs)
        part = 2 * part + side
        order = np.lexsort((before, part))
        _, part = np.unique(part, return_inverse=True)
        size = int(np.bincount(part).max())
    return order


def _schema() -> pa.Schema:
    kind = {"binary": pa.binary(), "int": pa.int32(), "smallint": pa.int16(), "bigint": pa.int64()}
    of = lambda t: pa.list_(kind[t[6:-1]]) if t.startswith("array") else kind[t]
    return pa.schema([(name, of(t)) for name, t in (x.split() for x in _INDEX.split(", "))])


class _Chunk:
    """Documents that are bisected together; of each its terms, as numbers of the chunk, and their frequencies."""

    def __init__(self):
        self.ids: list = []
        self.names: dict[bytes, int] = {}
        self.terms: list[np.ndarray] = []
        self.tfs: list[np.ndarray] = []
        self.nbytes = 0

    def add(self, doc_id, found: Counter, nbytes: int) -> None:
        names = self.names
        self.ids.append(doc_id)
        self.terms.append(np.fromiter((names.setdefault(t, len(names)) for t in found), np.int32, len(found)))
        self.tfs.append(np.fromiter(found.values(), np.int32, len(found)))
        self.nbytes += nbytes

    def full(self) -> bool:
        return len(self.ids) >= CHUNK or self.nbytes >= CHUNK_BYTES


def _shards(chunk: _Chunk, serial: Iterator[int]) -> Iterator[pa.RecordBatch]:
    """The shards of a chunk."""
    ids, sizes = chunk.ids, np.array([len(t) for t in chunk.terms])
    term, tf = np.concatenate(chunk.terms), np.concatenate(chunk.tfs)
    doc = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
    length = np.bincount(doc, weights=tf, minlength=len(ids)).astype(np.int64)
    order = bisected(doc, term, len(ids))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    heavy = np.cumsum(sizes[order]) // SHARD_POSTINGS
    breaks = np.flatnonzero((np.diff(heavy, prepend=0) > 0) | (np.arange(len(order)) % SHARD == 0))
    shard = np.searchsorted(breaks, place, side="right")[doc] - 1
    by = np.lexsort((place[doc], term, shard))
    doc, term, tf, shard = doc[by], term[by], tf[by], shard[by]
    names = np.array(list(chunk.names), object)
    ends = np.searchsorted(shard, np.arange(len(breaks)), side="right")
    schema = _schema()
    for i, low in enumerate(breaks):
        high = breaks[i + 1] if i + 1 < len(breaks) else len(order)
        rows = slice(ends[i - 1] if i else 0, ends[i])
        t, d, n = term[rows], place[doc[rows]] - low, tf[rows]
        starts = np.flatnonzero(np.diff(t, prepend=-1))
        members = order[low:high]
        values = {
            "shard": next(serial), "doc_ids": [ids[k] for k in members], "lengths": length[members], "terms": names[t[starts]], "starts": np.r_[starts, len(t)].astype(np.int32),
            "most": np.maximum.reduceat(n, starts), "shortest": np.minimum.reduceat(length[doc[rows]], starts), "docs": d.astype(np.int16), "tfs": n,
        }
        yield pa.RecordBatch.from_arrays([pa.array([values[f.name]], f.type) for f in schema], schema=schema)


def _indexed(batches):
    chunk = _Chunk()
    partition = TaskContext.get().partitionId() if TaskContext.get() else 0
    serial = iter(range(partition << 33, (partition + 1) << 33))
    for batch in pieces(batches):
        texts = batch.column("text").cast(pa.binary())
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts):
            terms = counted(text.as_py() or b"")
            if terms:
                chunk.add(doc_id, terms, len(text.as_py()))
                if chunk.full():
                    yield from _shards(chunk, serial)
                    chunk = _Chunk()
    if chunk.ids:
        yield from _shards(chunk, serial)


def index(docs: DataFrame) -> DataFrame:
    """A row per shard, written."""
    return written(arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), _indexed, _INDEX), "shards")


class _Block:
    """Items of a block: the rows of `term`, `times` from starts[i] on are item i's."""

    def __init__(self, ids: list, kind: str, counts: list[Counter]):
        self.ids, self.kind = ids, kind
        names: dict[bytes, int] = {}
        sizes = np.array([len(c) for c in counts])
        self.starts = np.cumsum(sizes) - sizes
        self.term = np.array([names.setdefault(t, len(names)) for c in counts for t in c], np.int64)
        self.times = np.array([n for c in counts for n in c.values()], np.int64)
        self.names = list(names)
        self.weight = np.zeros(0, np.int64)
        self.n = self.total = 0

    def weigh(self, n: int, total: int, df: dict[bytes, int]) -> None:
        self.n, self.total = n, total
        of = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(t, 0) + 1))) for t in self.names], np.int64)
        self.weight = of[self.term] * self.times

    def of_length(self, length: np.ndarray) -> np.ndarray:
        return 25 + (75 * length * self.n) // self.total

    def rows(self, terms: pa.Array) -> np.ndarray:
        """Where in a shard's terms each of the block's terms stands; -1: nowhere."""
        at = pc.fill_null(pc.index_in(terms, value_set=pa.array(self.names, terms.type)), -1).to_numpy(zero_copy_only=False)
        found = np.full(len(self.names), -1, np.int64)
        here = np.flatnonzero(at >= 0)
        found[at[here]] = here
        return found

    def bounds(self, rows: np.ndarray, most: np.ndarray, shortest: np.ndarray) -> np.ndarray:
        """What no document of the shard scores more than, by item."""
        value = np.zeros(len(rows), np.int64)
        here = rows >= 0
        tf = most[rows[here]]
        value[here] = (1_000_000_000 * tf) // (1000 * tf + 8 * self.of_length(shortest[rows[here]]))
        return np.add.reduceat(value[self.term] * self.weight, self.starts)


def _values(batch: pa.RecordBatch, name: str, i: int):
    return batch.column(name)[i].values.to_numpy(zero_copy_only=False)


def _frequencies(names: list[bytes]):
    def run(batches):
        wanted = pa.array(names, pa.binary())
        df = np.zeros(len(names), np.int64)
        for batch in batches:
            for i in range(len(batch)):
                at = pc.index_in(batch.column("terms")[i].values, value_set=wanted)
                here = pc.is_valid(at).to_numpy(zero_copy_only=False)
                np.add.at(df, at.drop_null().to_numpy(), np.diff(_values(batch, "starts", i))[here])
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"no": some.astype(np.int32), "df": df[some]})

    return run


def _greatest(block: _Block):
    """The `FIRST` shards of the task with the greatest bounds of each item."""

    def run(batches):
        best: list[list[tuple[int, int]]] = [[] for _ in block.ids]
        for batch in batches:
            for i, shard in enumerate(batch.column("shard").to_pylist()):
                bounds = block.bounds(block.rows(batch.column("terms")[i].values), _values(batch, "most", i), _values(batch, "shortest", i))
                for k in np.flatnonzero(bounds):
                    mine = best[k]
                    if len(mine) < FIRST or bounds[k] > mine[-1][0]:
                        mine.append((int(bounds[k]), shard))
                        mine.sort(reverse=True)
                        del mine[FIRST:]
        found = [(k, shard, bound) for k, mine in enumerate(best) for bound, shard in mine]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64())], names=["no", "shard", "bound"])

    return run


def _ahead(hit: tuple) -> tuple:
    score, doc_id = hit
    return -score, doc_id is not None, doc_id or 0


def _visited(block: _Block, least: dict[int, int], top: int):
    """The task's best documents of each item: shards by falling bounds until one is below what the top has."""

    def run(batches):
        best: list[list[tuple]] = [[] for _ in block.ids]
        reached = np.array([max(1, least.get(k, 0)) for k in range(len(block.ids))], np.int64)
        ends = np.r_[block.starts[1:], len(block.term)]

        def search(group: list[tuple]) -> None:
            bounds = np.stack([g[0] for g in group])
            tables: dict[int, tuple] = {}
            for k in np.flatnonzero((bounds >= reached).any(axis=0)):
                for g in np.argsort(-bounds[:, k], kind="stable"):
                    if bounds[g, k] < reached[k]:
                        break
                    _, rows, batch, i = group[g]
                    if g not in tables:
                        starts, docs, tf = (_values(batch, name, i) for name in ("starts", "docs", "tfs"))
                        ids, m = batch.column("doc_ids")[i].values, block.of_length(_values(batch, "lengths", i))
                        here = np.flatnonzero(rows >= 0)
                        n = np.diff(starts)[rows[here]]
                        posting = np.repeat(starts[rows[here]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        value = np.zeros((len(here) + 1, len(m)), np.int64)  # the last row is that of terms the shard does not have
                        tf = tf[posting].astype(np.int64)
                        value[np.repeat(np.arange(len(here)), n), docs[posting]] = (1_000_000_000 * tf) // (1000 * tf + 8 * m[docs[posting]])
                        row = np.full(len(rows), len(here))
                        row[here] = np.arange(len(here))
                        tables[g] = value, row, ids
                    value, row, ids = tables[g]
                    span = slice(block.starts[k], ends[k])
                    score = block.weight[span] @ value[row[block.term[span]]]
                    for j in np.flatnonzero(score >= reached[k]):
                        best[k].append((int(score[j]), ids[j].as_py()))
                    if len(best[k]) > top:
                        best[k] = sorted(best[k], key=_ahead)[:top]
                    if len(best[k]) == top:
                        reached[k] = max(reached[k], min(s for s, _ in best[k]))

        group: list[tuple] = []
        for batch in batches:
            for i in range(len(batch)):
                rows = block.rows(batch.column("terms")[i].values)
                bounds = block.bounds(rows, _values(batch, "most", i), _values(batch, "shortest", i))
                if (bounds >= reached).any():
                    group.append((bounds, rows, batch, i))
                if len(group) == GROUP:
                    search(group)
                    group = []
        if group:
            search(group)
        found = [(k, *hit) for k, mine in enumerate(best) for hit in mine]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["no", "doc_id", "score"])

    return run


@contextmanager
def _few_rows(spark: SparkSession) -> Iterator[None]:
    """Within it plans that run read and hand over at most ROWS rows at a time."""
    before = {name: spark.conf.get(name) for name in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")}
    try:
        for name in before:
            spark.conf.set(name, str(ROWS))
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


_BOUNDS = ("shard", "terms", "most", "shortest")


def _searched(shards: DataFrame, block: _Block, n: int, total: int, top: int) -> DataFrame:
    spark = shards.sparkSession
    df = arrow(shards.select("terms", "starts"), _frequencies(block.names), "no int, df bigint").groupBy("no").agg(F.sum("df").alias("df")).collect()  # the block's terms
    block.weigh(n, total, {block.names[r.no]: r.df for r in df})
    by_bound = Window.partitionBy("no").orderBy(F.desc("bound"), "shard")
    first = arrow(shards.select(*_BOUNDS), _greatest(block), "no int, shard bigint, bound bigint").withColumn("k", F.row_number().over(by_bound)).filter(F.col("k") <= FIRST)
    first = sorted({r.shard for r in first.select("shard").collect()})  # FIRST for each item of the block
    ranked = Window.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    hits = "no int, doc_id bigint, score bigint"
    seen = arrow(shards.filter(F.col("shard").isin(first)), _visited(block, {}, top), hits).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") == top)
    least = {r.no: r.score for r in seen.select("no", "score").collect()}  # one for each item of the block
    found = arrow(shards, _visited(block, least, top), hits).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)
    of = spark.createDataFrame(list(enumerate(block.ids)), f"no int, item_id {block.kind}")
    return written(found.join(F.broadcast(of), "no").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked")


def search(shards: DataFrame, items: DataFrame, *, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score) of the `top` best documents of every item, from an index."""
    spark, kind = shards.sparkSession, dict(items.dtypes)["item_id"]
    of = shards.agg(F.sum(F.size("lengths")).alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("total")).first()
    parts: list[DataFrame] = []
    ids: list = []
    counts: list[Counter] = []
    nbytes = 0

    def done() -> None:
        if ids and of.n:
            with _few_rows(spark):
                parts.append(_searched(shards, _Block(ids, kind, counts), of.n, of.total, top))

    for r in items.select("item_id", "text").toLocalIterator():
        text = (r.text or "").encode()
        terms = counted(text)
        if not terms:
            continue
        if ids and (len(ids) >= BLOCK or nbytes + len(text) > BLOCK_BYTES):
            done()
            ids, counts, nbytes = [], [], 0
        ids.append(r.item_id)
        counts.append(terms)
        nbytes += len(text)
    done()
    found = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    for part in parts:
        found = found.unionByName(part)
    return found


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The ten highest-scoring documents of every item."""
    return search(index(docs), items)


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _terms(table: str, key: str) -> str:
    return f"SELECT {key}, k, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS t FROM (SELECT *, row_number() OVER () AS k FROM {table})"


#: DuckDB's rows for the query.
SQL = f"""
WITH d AS MATERIALIZED (SELECT k, t, any_value(doc_id) AS doc_id, count(*) AS tf FROM ({_terms("documents", "doc_id")}) GROUP BY k, t),
len AS MATERIALIZED (SELECT k, sum(tf)::BIGINT AS n FROM d GROUP BY k),
whole AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM len),
q AS MATERIALIZED (SELECT k AS item, t, any_value(item_id) AS item_id, count(*) AS times FROM ({_terms("benchmark", "item_id")}) GROUP BY k, t),
w AS (SELECT t, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM d WHERE t IN (SELECT t FROM q) GROUP BY t), whole),
m AS (SELECT k, 25 + ((75 * n * big_n) // big_l) AS m FROM len, whole),
scored AS (
  SELECT item, item_id, k, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN w USING (t) JOIN d USING (t) JOIN m USING (k) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scored WHERE score > 0) WHERE rank <= {TOP}
"""
