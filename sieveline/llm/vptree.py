"""Nearest neighbours with vantage-point trees, one for each shard.

Vectors are brought to unit length, where the distance |a - b| is a metric and grows as the cosine falls.  A node
has a vantage point; the nearer half of its vectors lies inside, the other outside, and each half knows its range
of distances.  By the triangle inequality a half whose range is farther from the query's distance than the k-th
nearest found so far cannot hold a better one.  The pruning is relaxed by a factor: a half is visited if its bound
is at most that distance divided by the factor.  Factor one is exact; larger ones visit less.

A tree answers a batch of queries at once: at each node the queries are split by the half they visit first,
and leaves are matrix products.

Shards: a bounded sample of the vectors (`pivots`) are the pivots, each vector belongs to the cell of its nearest, and
cells are cut into shards of about `SHARD` vectors by a hash of the ids.  A query first searches its own cell;
then it goes only to cells whose range of distances from their pivot can, by the triangle inequality and the same
factor, hold something nearer.  Every shard lies sorted before its queries in one partition, so its tree is built once
in a round and queries stream through it; neither side is broadcast, only pivots (at most PIVOT_BYTES) are.  Of
equal vectors only the k + 1 with the smallest ids are candidates, for others can't be among the nearest k.

Defined cases: vectors that are null, empty, zero or hold null or non-finite numbers take no part; numbers of any finite
size are scaled by powers of two first; vectors of different lengths never meet; a query's own row (equal id) is no
candidate; equal distances go to smaller ids: where a shard holds more equally near points than the search keeps, it
takes all of them; rows that repeat an id are points each, and queries each where their vectors differ; fewer
candidates than k give fewer rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import Scratch, bounded

SHARD, LEAF = 8192, 96
#: Bytes of the pivots' vectors, at most.
PIVOT_BYTES = 16 << 20
#: Points kept beyond k, so that rounding in matrix products cannot push out one that is as near.
SPARE = 4
ROUNDING = 1e-7
#: Cosines nearer than this are held to be equal until they are worked out on the original vectors.
TIE = 1e-9


class Tree:
    """A vantage-point tree over rows of unit length."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        self.points, self.leaf = points, leaf
        self.random = np.random.default_rng(len(points))
        self.root = self._grow(np.arange(len(points)))
        self.visited = 0

    def _grow(self, own: np.ndarray):  # noqa: ANN202
        if len(own) <= self.leaf:
            return own
        # the candidate whose distances spread most is the vantage point
        tries = self.random.choice(own, size=min(8, len(own)), replace=False)
        sample = self.random.choice(own, size=min(64, len(own)), replace=False)
        at = tries[np.argmax(distance(self.points[tries] @ self.points[sample].T).var(axis=1))]
        d = distance(self.points[own] @ self.points[at])
        order = np.argsort(d, kind="stable")
        own, d, half = own[order], d[order], len(own) // 2
        return at, (d[0], d[half - 1]), (d[half], d[-1]), self._grow(own[:half]), self._grow(own[half:])

    def search(self, queries: np.ndarray, k: int, factor: float = 1.0, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and rows of the k nearest of each query; -inf and -1 where there are fewer.  Nothing farther than `known` is wanted."""
        best, rows = np.full((len(queries), k), -np.inf), np.full((len(queries), k), -1)
        self.visited = 0

        def reach(q: np.ndarray) -> np.ndarray:
            worst = best[q, -1]
            far = np.where(np.isinf(worst), np.inf, distance(np.maximum(worst, -1.0)))
            return (far if known is None else np.minimum(far, known[q])) / factor + ROUNDING

        def visit(node, q: np.ndarray) -> None:  # noqa: ANN001
            if not len(q):
                return
            if isinstance(node, np.ndarray):
                self.visited += len(q) * len(node)
                near = queries[q] @ self.points[node].T
                near = np.concatenate([best[q], near], axis=1)
                which = np.concatenate([rows[q], np.broadcast_to(node, (len(q), len(node)))], axis=1)
                top = np.argpartition(-near, k - 1, axis=1)[:, :k] if near.shape[1] > k else np.broadcast_to(np.arange(k), (len(q), k))
                near, which = np.take_along_axis(near, top, 1), np.take_along_axis(which, top, 1)
                order = np.argsort(-near, axis=1, kind="stable")
                best[q], rows[q] = np.take_along_axis(near, order, 1), np.take_along_axis(which, order, 1)
                return
            at, (in_low, in_high), (out_low, out_high), inside, outside = node
            d = distance(queries[q] @ self.points[at])
            to_in, to_out = np.maximum(in_low - d, d - in_high), np.maximum(out_low - d, d - out_high)
            first = to_in <= to_out
            for own, halves in ((first, ((inside, to_in), (outside, to_out))), (~first, ((outside, to_out), (inside, to_in)))):
                for half, bound in halves:
                    left = own & (bound <= reach(q))
                    visit(half, q[left])

        visit(self.root, np.arange(len(queries)))
        return best, rows


def distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * cosine))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Each row times a power of two that brings its largest number to between 1/2 and 1: the same cosines without overflow."""
    _, exponent = np.frexp(np.abs(x).max(axis=1))
    return np.ldexp(x, -exponent[:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


class _Shard:
    """A tree over the distinct directions of a shard, with the vectors that have them.

    Scores are worked out in extended precision and rounded to doubles, so that vectors of one direction tie.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.vectors = _scaled(vectors)
        points, of = np.unique(_unit(self.vectors), axis=0, return_inverse=True)
        self.ids, of = ids, of.ravel()
        self.order = np.lexsort((ids, of))
        self.begin = np.searchsorted(of[self.order], np.arange(len(points) + 1))
        self.tree = Tree(points)

    def _rows(self, points: np.ndarray, k: int) -> np.ndarray:
        """Vectors at some points, of each the k + 1 with the smallest ids."""
        return np.concatenate([self.order[self.begin[p] : min(self.begin[p + 1], self.begin[p] + k + 1)] for p in points])

    def nearest(self, q_ids: np.ndarray, queries: np.ndarray, k: int, factor: float, known: np.ndarray) -> list[tuple[int, int, float]]:
        """(query's row, id, score) of the k nearest."""
        keep = k + 1 + SPARE
        unit, scaled = _unit(queries), _scaled(queries)
        best, points = self.tree.search(unit, keep, factor, known)
        out = []
        for i, q in enumerate(scaled):

            def ranked(own: np.ndarray) -> list[tuple[float, int]]:
                rows = self._rows(own, k)
                rows = rows[self.ids[rows] != q_ids[i]]  # noqa: B023
                v, w = self.vectors[rows].astype(np.longdouble), q.astype(np.longdouble)  # noqa: B023
                score = ((v * w).sum(axis=1) / np.sqrt((v * v).sum(axis=1) * (w * w).sum())).astype(np.float64)
                return sorted(zip((-score).tolist(), self.ids[rows].tolist(), strict=True))[:k]

            own = points[i][points[i] >= 0]
            if not len(own):
                continue
            found = ranked(own)
            if len(own) == keep and len(found) == k and best[i, -1] >= -found[-1][0] - TIE:
                found = ranked(np.flatnonzero(self.tree.points @ unit[i] >= -found[-1][0] - TIE))
            out += [(i, v, -s) for s, v in found]
        return out


_PLACE = ["dim", "cell", "shard", "asks"]


def _answer(k: int, factor: float):  # noqa: ANN202
    """Rows sorted by _PLACE: the vectors of a shard, then the queries that visit it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, shard = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).cast(pa.int64()).to_numpy(zero_copy_only=False) for c in _PLACE], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                part, here = batch.slice(a, b - a), tuple(keys[a, :3])
                if here != place:
                    place, held, shard = here, [], None
                if not keys[a, 3]:
                    held.append((part.column("id").to_numpy(), _matrix(part)))
                    continue
                if shard is None and held:
                    shard = _Shard(*[np.concatenate(x) for x in zip(*held, strict=True)])
                    held = []
                if shard is not None:
                    found = shard.nearest(part.column("id").to_numpy(), _matrix(part), k, factor, part.column("known").to_numpy())
                    of = pa.array([i for i, _, _ in found], pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column("id").take(of), part.column("mark").take(of), pa.array([v for _, v, _ in found], pa.int64()), pa.array([s for _, _, s in found], pa.float64())], names=["query_id", "mark", "vec_id", "score"])

    return run


def _cells(pivots):  # noqa: ANN001, ANN202
    """Adds to vectors the cell of the nearest pivot of their length (-1 if there is none) and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                own = pivots.value.get(int(dim))
                cell, far = np.full(part.num_rows, -1), np.zeros(part.num_rows)
                if own is not None:
                    near = _unit(_matrix(part)) @ own.T
                    cell = near.argmax(axis=1)
                    far = distance(near[np.arange(len(near)), cell])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(far)], names=[*part.schema.names, "cell", "far"])

    return run


def _visits(pivots, ranges, factor: float):  # noqa: ANN001, ANN202
    """The cells other than its own that a query must visit: `cells`, given the distance `known` of its k-th nearest so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, home = batch.column("dim").to_numpy(), batch.column("cell").to_numpy()
            reach = batch.column("known").to_numpy() / factor + ROUNDING
            cells: list[list[int]] = [[] for _ in dims]
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                own = pivots.value.get(int(dim))
                if own is None:
                    continue
                low, high = ranges.value[int(dim)]
                d = distance(_unit(_matrix(batch.take(pa.array(at)))) @ own.T)
                go = (np.maximum(low - d, d - high) <= reach[at, None]) & (np.arange(len(own)) != home[at, None])
                for i, row in zip(at, go, strict=True):
                    cells[i] = np.flatnonzero(row).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])

    return run


def search(vectors: DataFrame, is_query: Column, *, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 5, factor: float = 1.0, shard: int = SHARD, pivot_bytes: int = PIVOT_BYTES) -> DataFrame:
    """`query_id, rank, vec_id, score`: the k nearest by cosine of every row for which `is_query` holds, among all other rows.

    The pivots are the vectors first in the order of a hash of their ids, one for each `shard` vectors and at most `pivot_bytes`.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vptree")
    v = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), v.alias("v")).filter("id is not null and v is not null")
    rows = rows.filter("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)").withColumn("dim", F.size("v"))
    copy = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    points = scratch.table(rows.withColumn("copy", copy).filter(F.col("copy") <= k + 1).select("id", "dim", "v"), "points")
    n, widest = points.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first()
    most = max(1, min(math.ceil(n / shard), pivot_bytes // (8 * widest)))
    lots: dict[int, list[list[float]]] = {}
    for r in points.orderBy(F.xxhash64("id"), "id", "v").limit(most).collect():
        lots.setdefault(r["dim"], []).append(r["v"])
    pivots = spark.sparkContext.broadcast({d: _unit(np.array(x)) for d, x in lots.items()})

    at = scratch.table(points.mapInArrow(_cells(pivots), "id long, dim int, v array<double>, cell int, far double"), "cells")
    stats = at.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).collect()  # a row for each pivot
    spans = {d: (np.full(len(x), np.inf), np.full(len(x), -np.inf)) for d, x in lots.items()}
    for r in stats:
        if r["cell"] >= 0:
            spans[r["dim"]][0][r["cell"]], spans[r["dim"]][1][r["cell"]] = r["low"], r["high"]
    ranges = spark.sparkContext.broadcast(spans)
    parts = [(r["dim"], r["cell"], math.ceil(r["n"] / shard)) for r in stats]
    parts = bounded(spark.createDataFrame(parts, "dim int, cell int, parts int"), len(parts))
    held = at.join(parts, ["dim", "cell"]).select("dim", "cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("shard"), F.lit(False).alias("asks"), "id", F.lit(None).cast("long").alias("mark"), F.lit(None).cast("double").alias("known"), "v")

    def visit(asked: DataFrame) -> DataFrame:
        spread = asked.join(parts, ["dim", "cell"]).select("dim", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("shard"), F.lit(True).alias("asks"), "id", "mark", "known", "v")
        both = held.unionByName(spread).repartition("dim", "cell", "shard").sortWithinPartitions(*_PLACE)
        return both.mapInArrow(_answer(k, factor), "query_id long, mark long, vec_id long, score double")

    asked = rows.filter("asks").dropDuplicates(["id", "v"]).select("id", "dim", F.xxhash64("v").alias("mark"), "v")
    asked = scratch.table(asked.mapInArrow(_cells(pivots), "id long, dim int, mark long, v array<double>, cell int, far double").drop("far"), "asked")
    first = scratch.table(visit(asked.withColumn("known", F.lit(math.inf))), "first")
    by = Window.partitionBy("query_id", "mark").orderBy(F.col("score").desc(), "vec_id")
    kth = first.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), "mark", "score")
    far = F.coalesce(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score"))), F.lit(math.inf))
    onward = asked.join(kth, ["id", "mark"], "left").withColumn("known", far).select("id", "dim", "mark", "v", "cell", "known")
    onward = onward.mapInArrow(_visits(pivots, ranges, factor), "id long, dim int, mark long, v array<double>, cell int, known double, cells array<int>")
    onward = scratch.table(onward.withColumn("cell", F.explode("cells")).drop("cells"), "onward")
    found = first.unionByName(visit(onward)).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
