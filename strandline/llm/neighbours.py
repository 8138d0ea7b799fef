"""Approximate nearest neighbours by stable projections and a kd-tree.

Vectors are scaled to length one, so that the largest cosine is the smallest
Euclidean distance, and projected by PROJECTIONS Gaussian (2-stable) directions
fixed by a seed. One kd-tree over the projections covers the whole table: its upper
levels are cells, cut at medians of a sample of at most SAMPLE vectors (those with
the least hash of their id); every vector is filed in its cell, cells over BLOCK
vectors in several blocks; within a block the tree goes on down to leaves.

A query visits cells in order of their projected distance, a few in the first round
and eight times as many in each later one, with the best it has found anywhere; in a
cell it visits leaves in that order, and of a leaf it verifies, on the original
values, the vectors whose own projection is near enough. What is near enough is the
chi-square stopping test: a vector nearer than the k-th best so far, d, would have
its projected distance squared over d squared distributed as chi-square, so past the
quantile at CONFIDENCE each nearer vector left unseen has a chance below
1 - CONFIDENCE. A query whose next cell fails the test is done.

Equal vectors are one row of the index, which keeps their k + 1 least ids; that is
all of them that a result can hold. Equal queries are searched once.

Defined results: vectors that are null, of zero length, or hold null or
non-finite components take no part, neither do rows without an id; vectors of
different dimensions are never compared. Ties go to the smaller id. Rows that
share an id are all candidates, but none for a query of that id; such a query is
asked once for each of its vectors, and the best of both answers count. Norms are
taken after scaling by a power of two, so large and small values don't overflow.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import _shared, _text as T

PROJECTIONS, CONFIDENCE, LEAF = 16, 0.95, 16
BLOCK, QUERIES, SAMPLE = 8192, 4096, 16384
FIRST, GROWTH = 2, 8
FOUND = "code long, near long, score double"


def chi_square_quantile(p: float, m: int) -> float:
    """For even m."""

    def below(x: float) -> float:
        term = total = math.exp(-x / 2)
        for k in range(1, m // 2):
            term *= x / 2 / k
            total += term
        return 1 - total

    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def directions(dim: int, m: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, m))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that the largest component lies between 1/2 and 1; cosines stay the same bit by bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def projected(x: np.ndarray, m: int) -> np.ndarray:
    """Projections of the unit vectors of scaled rows."""
    return (x / np.sqrt((x * x).sum(1))[:, None]) @ directions(x.shape[1], m)


def leaves(points: np.ndarray, size: int) -> list[np.ndarray]:
    """Leaves of a kd-tree: halves at the median of the widest dimension."""
    todo, done = [np.arange(len(points))], []
    while todo:
        i = todo.pop()
        if len(i) <= size:
            done.append(i)
            continue
        x = points[i]
        axis = int(np.argmax(x.max(0) - x.min(0)))
        half = len(i) // 2
        o = np.argpartition(x[:, axis], half)
        todo += [i[o[:half]], i[o[half:]]]
    return done


class Cells:
    """The upper levels of the tree for one dimension: a complete binary tree of cuts, numbered as a heap."""

    def __init__(self, levels: int, axis: np.ndarray, cut: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.levels, self.axis, self.cut, self.low, self.high = levels, axis, cut, low, high

    @staticmethod
    def grown(sample: np.ndarray, levels: int) -> tuple:
        """Cuts at medians of a sample, as arguments of Cells; arrays alone, so that they can be sent where the package isn't loaded yet."""
        inner = (1 << levels) - 1
        at, cuts = np.zeros(inner, np.int64), np.zeros(inner)
        low, high = np.full((2 * inner + 1, sample.shape[1]), -np.inf), np.full((2 * inner + 1, sample.shape[1]), np.inf)
        held = [np.arange(len(sample))] + [np.zeros(0, np.int64)] * (2 * inner)
        for node in range(inner):
            left, right = 2 * node + 1, 2 * node + 2
            x = sample[held[node]]
            axis = int(np.argmax(x.max(0) - x.min(0))) if len(x) else 0
            cut = float(np.median(x[:, axis])) if len(x) else 0.0
            at[node], cuts[node] = axis, cut
            above = x[:, axis] > cut
            held[left], held[right] = held[node][~above], held[node][above]
            low[left], high[left], low[right], high[right] = low[node], high[node], low[node], high[node]
            high[left, axis] = low[right, axis] = cut
        return levels, at, cuts, low[inner:], high[inner:]

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        node = np.zeros(len(points), np.int64)
        for _ in range(self.levels):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] > self.cut[node])
        return node - len(self.cut)

    def far(self, points: np.ndarray) -> np.ndarray:
        """Squared distances of points from all cells."""
        out = np.zeros((len(points), len(self.low)))
        for d in range(points.shape[1]):
            gap = np.maximum(np.maximum(self.low[:, d] - points[:, d, None], points[:, d, None] - self.high[:, d]), 0)
            out += gap * gap
        return out


def search(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, m: int, confidence: float, leaf: int, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest found in one block: per query, row numbers (-1: none), scores, and how many vectors were verified.

    q and x: scaled rows. bound: the k-th best score found elsewhere so far, for each
    query. A row of the query's own id counts as any other.
    """
    q_norm, norm = np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1))
    p, pq = projected(x, m), projected(q, m)
    parts = leaves(p, leaf)
    low, high = np.array([p[i].min(0) for i in parts]), np.array([p[i].max(0) for i in parts])
    width = max(map(len, parts))
    member = np.array([np.pad(i, (0, width - len(i)), constant_values=-1) for i in parts])
    limit = chi_square_quantile(confidence, m)
    best, who = np.full((len(q), k), -np.inf), np.full((len(q), k), -1)
    past = np.full(len(q), -np.inf) if bound is None else bound
    seen = np.zeros(len(q), np.int64)
    for first in range(0, len(q), 1024):
        active = np.arange(first, min(first + 1024, len(q)))
        far = np.zeros((len(active), len(parts)))
        for d in range(m):
            gap = np.maximum(np.maximum(low[:, d] - pq[active, d, None], pq[active, d, None] - high[:, d]), 0)
            far += gap * gap
        order = np.argsort(far, axis=1, kind="stable")
        for t in range(len(parts)):
            at = order[active - first, t]
            near = limit * np.maximum(2 - 2 * np.maximum(best[active, -1], past[active]), 0)
            go = ~(far[active - first, at] > near)
            active, at, near = active[go], at[go], near[go]
            if not len(active):
                break
            rows = member[at]
            apart = ((pq[active, None, :] - p[rows]) ** 2).sum(2)
            i, j = np.nonzero((rows >= 0) & ~(apart > near[:, None]))
            if not len(i):
                continue
            score = np.full(rows.shape, -np.inf)
            score[i, j] = np.einsum("nd,nd->n", q[active[i]], x[rows[i, j]]) / (q_norm[active[i]] * norm[rows[i, j]])
            seen[active] += np.bincount(i, minlength=len(active))
            hit = np.unique(i)
            a = active[hit]
            all_s, all_r = np.concatenate([best[a], score[hit]], 1), np.concatenate([who[a], rows[hit]], 1)
            o = np.lexsort((ids[all_r], -all_s), axis=1)[:, :k]
            best[a], who[a] = np.take_along_axis(all_s, o, 1), np.take_along_axis(all_r, o, 1)
    who[best == -np.inf] = -1
    return who, best, seen


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one dimension as scaled rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return scaled(np.asarray(column.flatten(), np.float64).reshape(len(column), -1))


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = np.asarray(batch.column("dim"))
    for dim in np.unique(dims).tolist():
        yield dim, batch.filter(pa.array(dims == dim))


def project_batches(batches: Iterator[pa.RecordBatch], m: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for dim, part in _by_dim(batch):
            p = projected(_matrix(part.column("vector")), m)
            yield pa.RecordBatch.from_arrays([part.column("dim"), pa.array([r.tobytes() for r in p], pa.binary())], names=["dim", "p"])


def file_batches(batches: Iterator[pa.RecordBatch], trees: dict[int, tuple], m: int) -> Iterator[pa.RecordBatch]:
    """Each vector's cell."""
    for batch in batches:
        for dim, part in _by_dim(batch):
            cell = Cells(*trees[dim]).of(projected(_matrix(part.column("vector")), m)) if dim in trees else np.zeros(len(part), np.int64)
            yield pa.RecordBatch.from_arrays([part.column("dim"), pa.array(cell.astype(np.int32)), part.column("code"), part.column("vector")], names=["dim", "cell", "code", "vector"])


def visit_batches(batches: Iterator[pa.RecordBatch], trees: dict[int, tuple], m: int, confidence: float, start: int, stop: int) -> Iterator[pa.RecordBatch]:
    """The cells each query visits in one round: those from start to stop in order of distance that pass the test."""
    limit = chi_square_quantile(confidence, m)
    for batch in batches:
        for dim, part in _by_dim(batch):
            for a in range(0, len(part), 1024):
                some = part.slice(a, 1024)
                if dim in trees:
                    far = Cells(*trees[dim]).far(projected(_matrix(some.column("vector")), m))
                    order = np.argsort(far, axis=1, kind="stable")[:, start:stop]
                    near = limit * np.maximum(2 - 2 * np.asarray(some.column("worst")), 0)
                    i, j = np.nonzero(~(np.take_along_axis(far, order, 1) > near[:, None]))
                    cell = order[i, j]
                else:
                    i = np.arange(len(some) if start == 0 else 0)
                    cell = np.zeros(len(i), np.int64)
                take = some.take(pa.array(i))
                yield pa.RecordBatch.from_arrays([take.column("dim"), pa.array(cell.astype(np.int32)), take.column("code"), take.column("worst"), take.column("vector")], names=["dim", "cell", "code", "worst", "vector"])


def search_block(key, left: pa.Table, right: pa.Table, k: int, m: int, confidence: float, leaf: int) -> pa.Table:
    """The k best of one block (left) for each query that visits it (right)."""
    if not left.num_rows or not right.num_rows:
        return pa.table({"code": pa.array([], pa.int64()), "near": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    q_ids, ids = np.asarray(right.column("code")), np.asarray(left.column("code"))
    who, best, _ = search(q_ids, _matrix(right.column("vector")), ids, _matrix(left.column("vector")), k, m, confidence, leaf, np.asarray(right.column("worst")))
    r, c = np.nonzero(who >= 0)
    return pa.table({"code": pa.array(q_ids[r]), "near": pa.array(ids[who[r, c]]), "score": pa.array(best[r, c])})


def _good(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("vector"))
    good = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0)
    return v.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & good)


def grow(index: DataFrame, m: int, block: int, sample: int) -> dict[int, tuple]:
    """A tree for each dimension of more than block vectors; cells hold about block vectors, but 16 of the sample at least.

    What reaches the driver: the number of vectors of each dimension, and sample projections.
    """
    many = {r["dim"]: r["count"] for r in index.groupBy("dim").count().filter(F.col("count") > block).collect()}
    if not many:
        return {}
    drawn = index.filter(F.col("dim").isin(list(many))).orderBy(F.xxhash64("code"), "code").limit(sample).select("dim", "vector")
    got = drawn.mapInArrow(T.shipped(__name__, "project_batches", m), "dim int, p binary").toArrow()
    dims, points = np.asarray(got.column("dim")), got.column("p").to_pylist()
    trees = {}
    for dim, n in many.items():
        x = np.array([np.frombuffer(points[i]) for i in np.flatnonzero(dims == dim)]).reshape(-1, m)
        levels = int(min(math.log2(n / block) + 1, math.log2(max(1, len(x) / 16))))
        if levels > 0:
            trees[dim] = Cells.grown(x, levels)
    return trees


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, projections: int = PROJECTIONS, confidence: float = CONFIDENCE, leaf: int = LEAF, block: int = BLOCK, queries: int = QUERIES, sample: int = SAMPLE) -> DataFrame:
    """The k nearest of each query row by cosine: query_id, rank from 1, vec_id, score.

    is_query: a condition over a column vec_id. projections: an even number.
    block, queries: how many vectors and how many queries one task holds at a time.
    sample: at most so many vectors are sampled for the cuts between cells.
    """
    if projections % 2:
        raise ValueError("projections must be even")
    v = _good(vectors, id_col, vector_col)
    kind = dict(v.dtypes)["vector"]
    same, whole = Window.partitionBy("vector").orderBy("vec_id"), Window.partitionBy("vector")
    ranked = v.withColumn("copy", F.dense_rank().over(same)).filter(F.col("copy") <= k + 1)
    ranked = ranked.select("vector", F.sort_array(F.collect_set("vec_id").over(whole)).alias("ids"), F.row_number().over(same).alias("copy")).filter("copy = 1")
    index = _shared.written(ranked.select(F.size("vector").alias("dim"), F.col("ids")[0].alias("code"), "ids", "vector"), "vectors")
    print_of = [F.xxhash64("vector").alias("one"), F.xxhash64(F.lit("two"), "vector").alias("two")]
    asked = v.filter(is_query).select("vec_id", "vector", *print_of).join(index.select("code", *print_of), ["one", "two"])
    asked = _shared.written(asked.select(F.col("vec_id").alias("query_id"), "code", "vector"), "asked")
    q = _shared.written(asked.groupBy("code").agg(F.first("vector").alias("vector")).select(F.size("vector").alias("dim"), "code", "vector"), "queries")
    asked = asked.select("query_id", "code").distinct()
    trees = grow(index, projections, block, sample)
    ship = lambda f, *args: T.shipped(__name__, f, *args)
    filed = index.mapInArrow(ship("file_batches", trees, projections), f"dim int, cell int, code long, vector {kind}")
    blocks = _shared.written(filed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "blocks")
    placed = filed.join(F.broadcast(blocks), ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("code"), F.col("blocks")).cast("int"))
    last = max((len(t[-1]) for t in trees.values()), default=1)
    best, start, width = None, 0, FIRST
    while start < last:
        state = q.withColumn("worst", F.lit(float("-inf")))
        if best is not None:
            worst = best.groupBy("code").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") > k).select("code", "least")
            state = q.join(worst, "code", "left").select("dim", "code", "vector", F.coalesce("least", F.lit(float("-inf"))).alias("worst"))
        visits = _shared.written(state.mapInArrow(ship("visit_batches", trees, projections, confidence, start, start + width), f"dim int, cell int, code long, worst double, vector {kind}"), "visits")
        counted = visits.groupBy("dim", "cell").agg(F.ceil(F.count("*") / queries).cast("int").alias("parts"))
        if visits.isEmpty():
            break
        keys = ["dim", "cell", "block", "part"]
        asking = visits.join(F.broadcast(counted), ["dim", "cell"]).join(F.broadcast(blocks), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("code"), F.col("parts")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        visited = placed.join(F.broadcast(counted), ["dim", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        found = visited.select(*keys, "code", "vector").groupBy(*keys).cogroup(asking.select(*keys, "code", "worst", "vector").groupBy(*keys)).applyInArrow(_keyed2(ship("search_block", k + 1, projections, confidence, leaf)), FOUND)
        if best is not None:
            found = found.unionByName(best)
        place = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("score"), "near"))
        best = _shared.written(found.withColumn("place", place).filter(F.col("place") <= k + 1).drop("place"), "best")
        start, width = start + width, width * GROWTH
    if best is None:
        best = vectors.sparkSession.createDataFrame([], FOUND)
    pairs = best.join(index.select(F.col("code").alias("near"), "ids"), "near").select("code", "score", F.explode("ids").alias("vec_id"))
    pairs = asked.join(pairs, "code").filter("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _keyed2(f):
    def run(key, left, right):
        return f(key, left, right)

    return run
