"""Centroid clustering: Lloyd rounds over two trees.

Every task turns its vectors, `CHUNK` at a time, into cover trees, which are written once. A round builds a cover tree over the
centroids and walks both trees from their roots: a pair of nodes is left out when the nearest its points can be is farther than
another centroid certainly is, a node whose one centroid is left goes to it whole, with the sum its subtree holds, and pairs of
leaves are compared exactly. A round sends k sums a task; the driver holds k centroids.

Defined results: vectors that are null, of another length, or with a null or non-finite component are left out; of fewer vectors
than k each is a centroid; a repeated row is a vector of its own (equal hashes of ids: by vector); a null id is hashed as an empty
text; an empty table gives an empty result; other columns are not read. A scaled component of 2**27 or more raises an error, since
squares of such no longer fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, written

DIM, K, ROUNDS, SCALE, SEED = 64, 16, 3, 64, "1"
CHUNK = 1_024
_WIDE = 1 << 27
_INDEX = "ids array<bigint>, place array<int>, weight array<bigint>, points array<bigint>, center array<int>, radius array<double>, low array<int>, high array<int>, first array<int>, n_children array<int>"


class Tree(NamedTuple):
    """Points in tree order; of each node the center's place, the farthest of its points, the places low <= p < high, and its children."""

    points: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    n_children: np.ndarray


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = a - b
    return np.einsum("ij,ij->i", gap, gap)


def cover_tree(points: np.ndarray) -> tuple[Tree, np.ndarray]:
    """A cover tree over distinct points, and which point stands at each place of its order.

    A node of radius r has children that cover 2**i < r: its own center, then points that no child before them covers, so that
    centers of children are more than 2**i apart. A leaf is one point.
    """
    # Nodes in breadth-first order, so that children follow one another; `members` begin with the center.
    members = [np.arange(len(points))]
    away = [np.sqrt(_squares(points, points[:1]).astype(float))]
    radius, low, high, first, n_children = [], [0], [len(points)], [], []
    node = 0
    while node < len(members):
        own, d = members[node], away[node]
        radius.append(float(d.max()))
        first.append(len(members))
        n_children.append(0)
        if len(own) > 1:
            cover = 2.0 ** (np.ceil(np.log2(radius[-1])) - 1)
            at = low[node]
            inside = d <= cover
            rest = own
            while True:
                members.append(rest[inside])
                away.append(d[inside])
                low.append(at)
                at += int(inside.sum())
                high.append(at)
                n_children[-1] += 1
                rest = rest[~inside]
                if not len(rest):
                    break
                d = np.sqrt(_squares(points[rest], points[rest[:1]]).astype(float))
                inside = d <= cover
        node += 1
    order = np.empty(len(points), np.int64)
    for m, at, kids in zip(members, low, n_children):
        if not kids:
            order[at] = m[0]
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    as_int = lambda x: np.array(x, np.int32)
    return Tree(points[order], as_int([place[m[0]] for m in members]), np.array(radius), as_int(low), as_int(high), as_int(first), as_int(n_children)), order


def _children(tree: Tree, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children of each node, and the position in `nodes` that each belongs to."""
    n = tree.n_children[nodes]
    of = np.repeat(np.arange(len(nodes)), n)
    return tree.first[nodes][of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n), of


def nearest(tree: Tree, centroids: Tree, number: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(low, high, number) of runs of places and the nearest centroid of all their points; `number` names the centroid at each place.

    A pair of nodes stays while the least distance between their points is not above the bound of its vector node: the distance
    of its center to the nearest center among its centroid nodes, itself a centroid, and its radius.
    """
    q, c = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(q):
        squares = _squares(tree.points[tree.center[q]], centroids.points[centroids.center[c]])
        d = np.sqrt(squares.astype(float))
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        bound = np.minimum.reduceat(d, starts) + tree.radius[q[starts]]
        bound = np.repeat(bound, np.diff(np.r_[starts, len(q)]))
        keep = d - tree.radius[q] - centroids.radius[c] <= bound * (1 + 1e-9)
        q, c, squares = q[keep], c[keep], squares[keep]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        sizes = np.diff(np.r_[starts, len(q)])
        leaf_q, inner_c = tree.n_children[q] == 0, centroids.n_children[c] > 0
        wide = inner_c & (leaf_q | (centroids.radius[c] >= tree.radius[q]))
        wide |= np.repeat(sizes == 1, sizes) & inner_c
        any_wide = np.repeat(np.logical_or.reduceat(wide, starts), sizes)
        single = np.repeat(sizes == 1, sizes) & ~inner_c
        if single.any():
            yield tree.low[q[single]], tree.high[q[single]], number[centroids.center[c[single]]]
        last = leaf_q & ~any_wide & ~single
        if last.any():
            q_, n_ = q[last], number[centroids.center[c[last]]]
            order = np.lexsort((n_, squares[last], q_))
            won = order[np.r_[True, q_[order][1:] != q_[order][:-1]]]
            yield tree.low[q_[won]], tree.high[q_[won]], n_[won]
        # Pairs whose centroid node opens, pairs that wait for them, and vector nodes that open.
        opened, of = _children(centroids, c[wide])
        wait = any_wide & ~wide
        split = ~any_wide & ~single & ~last
        kids, by = _children(tree, q[split])
        q, c = np.r_[q[wide][of], q[wait], kids], np.r_[opened, c[wait], c[split][by]]
        order = np.argsort(q, kind="stable")
        q, c = q[order], c[order]


def _grow(ids: list, points: np.ndarray) -> dict:
    """A row of the index: equal vectors are one point with a weight."""
    distinct, of = np.unique(points, axis=0, return_inverse=True)
    of = of.reshape(-1)
    tree, order = cover_tree(distinct)
    at = np.empty(len(order), np.int64)
    at[order] = np.arange(len(order))
    return {"ids": ids, "place": at[of], "weight": np.bincount(at[of], minlength=len(order)), **tree._asdict(), "points": tree.points.reshape(-1)}


def _planted(dim: int, chunk: int):
    def run(batches):
        ids, points, n = [], [], 0

        def row():
            schema = _index_schema()
            found = _grow([i for part in ids for i in part], np.concatenate(points))
            return pa.RecordBatch.from_arrays([pa.array([found[f.name]], f.type) for f in schema], schema=schema)

        for batch in batches:
            for start in range(0, len(batch), chunk):
                part = batch.slice(start, chunk)
                found = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                if len(found) and max(int(found.max()), -int(found.min())) >= _WIDE:
                    raise ValueError("a scaled component is 2**27 or more: its squares do not fit a long")
                if n and n + len(part) > chunk:
                    yield row()
                    ids, points, n = [], [], 0
                ids.append(part.column(0).to_pylist())
                points.append(found)
                n += len(part)
        if n:
            yield row()

    return run


def _index_schema() -> pa.Schema:
    kind = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}
    return pa.schema([(name, pa.list_(kind[rest[len("array<") : -1]])) for name, rest in (x.split() for x in _INDEX.split(", "))])


def _trees(batches, dim: int) -> Iterator[tuple[pa.RecordBatch, int, Tree]]:
    for batch in batches:
        for i in range(len(batch)):
            of = lambda name: batch.column(name)[i].values.to_numpy(zero_copy_only=False)  # noqa: E731, B023
            yield batch, i, Tree(of("points").reshape(-1, dim), of("center"), of("radius"), of("low"), of("high"), of("first"), of("n_children"))


def _of_centroids(centroids: list[list[int]]) -> tuple[Tree, np.ndarray]:
    """The tree over distinct centroids; of equal ones the smallest number, which wins every tie, stays."""
    distinct, number = np.unique(np.array(centroids, np.int64), axis=0, return_index=True)
    tree, order = cover_tree(distinct)
    return tree, number[order]


def _summed(centroids: list[list[int]], dim: int):
    def run(batches):
        k = len(centroids)
        ctree, number = _of_centroids(centroids)
        total, count = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch, i, tree in _trees(batches, dim):
            weight = batch.column("weight")[i].values.to_numpy(zero_copy_only=False)
            sums = np.concatenate([np.zeros((1, dim), np.int64), np.cumsum(tree.points * weight[:, None], axis=0)])
            counts = np.r_[0, np.cumsum(weight)]
            for low, high, n in nearest(tree, ctree, number):
                np.add.at(total, n, sums[high] - sums[low])
                np.add.at(count, n, counts[high] - counts[low])
        some = np.flatnonzero(count)
        if len(some):
            cluster = np.repeat(some, dim + 1).astype(np.int32)
            pos = np.tile(np.arange(dim + 1), len(some)).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"cluster": cluster, "pos": pos, "amount": np.concatenate([total[some], count[some, None]], axis=1).reshape(-1)})

    return run


def _assigned(centroids: list[list[int]], dim: int):
    def run(batches):
        ctree, number = _of_centroids(centroids)
        at = np.array(centroids, np.int64)
        for batch, i, tree in _trees(batches, dim):
            cluster = np.empty(len(tree.points), np.int32)
            for low, high, n in nearest(tree, ctree, number):
                sizes = high - low
                cluster[np.repeat(low, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.repeat(n, sizes)
            distance = _squares(tree.points, at[cluster])
            place = batch.column("place")[i].values.to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(cluster[place]), pa.array(distance[place])], names=["vec_id", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, *, id_column: str = "vec_id", vector: str = "embedding", dim: int = DIM, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, seed: str = SEED, chunk: int = CHUNK) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every kept vector after `rounds` Lloyd rounds, and the final centroids."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    scaled = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("bigint"))
    kept = vectors.filter(x.isNotNull() & (F.size(x) == dim)).filter(finite).select(F.col(id_column).cast("bigint").alias("vec_id"), scaled.alias("point"))
    name = F.concat(F.lit(seed + ":"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    index = written(arrow(kept, _planted(dim, chunk), _INDEX), "trees")
    centroids = [list(r.point) for r in kept.orderBy(F.sha2(name, 256), "point").limit(k).collect()]  # k rows
    if not centroids:
        return vectors.sparkSession.createDataFrame([], "vec_id bigint, cluster int, distance bigint"), []
    for _ in range(rounds):
        parts = arrow(index.select("weight", "points", "center", "radius", "low", "high", "first", "n_children"), _summed(centroids, dim), "cluster int, pos int, amount bigint")
        sums: dict[int, dict[int, int]] = {}
        for r in parts.groupBy("cluster", "pos").agg(F.sum("amount").alias("amount")).collect():  # at most k * (dim + 1) rows
            sums.setdefault(r.cluster, {})[r.pos] = r.amount
        centroids = [[sums[i][j] // sums[i][dim] for j in range(dim)] if i in sums else c for i, c in enumerate(centroids)]
    return written(arrow(index, _assigned(centroids, dim), "vec_id bigint, cluster int, distance bigint"), "clusters"), centroids


def report(vectors: DataFrame, **options) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    found, centroids = cluster(vectors, **options)
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    of = found.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = sums.agg(F.sum("cluster_inertia").alias("inertia"))
    about = sums.join(of, "cluster").crossJoin(total)  # one row each for k clusters
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round(k: int) -> str:
    return f"""
near{k} AS MATERIALIZED (
  SELECT vec_id, v, arg_min(c, d * {K} + c) AS cluster, min(d) AS distance
  FROM (SELECT p.vec_id, p.copy, p.v, z.c, list_sum(list_transform(list_zip(p.v, z.z), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS d FROM points p CROSS JOIN at{k} z)
  GROUP BY vec_id, copy, v),"""


def _moved(k: int) -> str:
    return f"""
moved{k} AS (
  SELECT cluster, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM near{k}) GROUP BY ALL),
at{k + 1} AS MATERIALIZED (
  SELECT c, coalesce(any_value(m), any_value(z)) AS z FROM at{k} LEFT JOIN (
    SELECT cluster AS c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS m FROM moved{k} GROUP BY cluster) USING (c) GROUP BY c),"""


#: DuckDB's rows for the query's parameters.
SQL = f"""
WITH points AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS copy, list_transform(embedding::DOUBLE[], lambda x: floor({SCALE} * x)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
at0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS z FROM (SELECT v, sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')) AS h FROM points ORDER BY h, v LIMIT {K})),
{"".join(_round(i) + _moved(i) for i in range(ROUNDS))}
{_round(ROUNDS)}
sums AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM near{ROUNDS} GROUP BY cluster)
SELECT vec_id, n.cluster::INTEGER AS cluster, distance, cluster_inertia, (SELECT sum(cluster_inertia)::BIGINT FROM sums) AS inertia,
  sha256(array_to_string(z, ',')) AS centroid_sha256
FROM near{ROUNDS} n JOIN sums USING (cluster) JOIN at{ROUNDS} a ON a.c = n.cluster
"""
