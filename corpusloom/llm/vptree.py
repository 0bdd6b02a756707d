"""Nearest neighbours by cosine with a vantage-point tree per shard of rows.

Vectors are scaled to length one, where the Euclidean distance falls as the cosine rises, so the triangle
inequality may prune. A child on the far side of a node's radius is searched if `factor` times the
distance to the border is at most the distance of the worst neighbour so far: factor 1 is exact, a
larger one prunes more. Queries go through a tree together. Rows are dealt to shards by a hash, queries to
blocks, and each shard meets each block in a task; so a task's memory has a bound, and nothing but counts
comes to the driver. The best of all shards are merged by a window. Scores are summed in the order of the components, in doubles, after a
power of two has been taken out of each vector, which changes no digit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, read_table

#: Slack for rounding in the pruning; final scores don't depend on it.
EPS = 1e-7


def scaled(a: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each that brings the largest component near 1, so that squares neither overflow nor vanish."""
    return np.ldexp(a, -np.frexp(np.abs(a).max(axis=1))[1][:, None])


def _unit(a: np.ndarray) -> np.ndarray:
    return a / np.sqrt((a * a).sum(axis=1))[:, None]


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products row by row, summed from the first component to the last."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


class Tree:
    """Nodes over rows of unit vectors: (vantage row, radius, inner, outer), or an array of rows for a leaf."""

    def __init__(self, unit: np.ndarray, leaf: int = 128, seed: int = 7):
        self.unit, self.leaf = unit, leaf
        self.rng = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(unit)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        # The vantage point with the widest spread among a few.
        tries = self.rng.choice(rows, 5, replace=False)
        some = self.unit[self.rng.choice(rows, min(len(rows), 100), replace=False)]
        spread = np.var(np.sqrt(np.maximum(0, 2 - 2 * self.unit[tries] @ some.T)), axis=1)
        vantage = int(tries[int(np.argmax(spread))])
        d = np.sqrt(np.maximum(0, 2 - 2 * self.unit[rows] @ self.unit[vantage]))
        radius = float(np.median(d))
        inner = d < radius
        if not inner.any() or inner.all():
            return rows  # all as far: nothing to split on
        return vantage, radius, self._build(rows[inner]), self._build(rows[~inner])


class Search:
    """The k nearest of each query over any number of trees. A query's own row has its id and its vector, and isn't searched once."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, factor: float):
        vectors = scaled(vectors)
        self.ids, self.vectors, self.k, self.factor = ids, vectors, k, factor
        self.unit = _unit(vectors)
        self.norm = np.sqrt(_dot(vectors, vectors))
        self.worst = np.full(len(ids), -np.inf)  # cosine of the k-th so far
        self.found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))  # query row, vec_id, score

    def add(self, ids: np.ndarray, vectors: np.ndarray, copy: np.ndarray | None = None, leaf: int = 128) -> None:
        """copy: 0 for a row, 1, 2, ... for rows that repeat its id and vector."""
        copy = np.zeros(len(ids), np.int64) if copy is None else copy
        vectors = scaled(vectors)
        # Of equal vectors only those of the smallest ids can be among the nearest: k, and one that may be the query's own.
        same = pd.factorize(np.ascontiguousarray(vectors).view(f"V{vectors.itemsize * vectors.shape[1]}").ravel().astype(object))[0] if len(ids) > 1 else np.zeros(len(ids), np.int64)
        order = np.lexsort((copy, ids, same))
        first = np.flatnonzero(np.r_[True, same[order][1:] != same[order][:-1]])
        rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
        keep = np.sort(order[rank <= self.k])
        ids, vectors, self.copy = ids[keep], vectors[keep], copy[keep]
        tree = Tree(_unit(vectors), leaf)
        norm = np.sqrt(_dot(vectors, vectors))
        self._visit(tree, tree.root, np.arange(len(self.ids)), ids, vectors, norm)

    def _visit(self, tree: Tree, node, q: np.ndarray, ids, vectors, norm) -> None:
        if not len(q):
            return
        if isinstance(node, np.ndarray):
            self._leaf(node, tree, q, ids, vectors, norm)
            return
        vantage, radius, inner, outer = node
        d = np.sqrt(np.maximum(0, 2 - 2 * self.unit[q] @ tree.unit[vantage]))
        near = d < radius
        self._visit(tree, inner, q[near], ids, vectors, norm)
        self._visit(tree, outer, q[~near], ids, vectors, norm)
        reach = np.sqrt(np.maximum(0, 2 - 2 * np.maximum(self.worst[q], -1))) + EPS
        far = np.abs(d - radius) * self.factor <= reach
        self._visit(tree, outer, q[near & far], ids, vectors, norm)
        self._visit(tree, inner, q[~near & far], ids, vectors, norm)

    def _leaf(self, rows, tree, q, ids, vectors, norm) -> None:
        # A leaf is long only where many rows are equally far from a vantage point.
        for lo in range(0, len(rows), 2048):
            for at in range(0, len(q), 2048):
                self._compare(rows[lo : lo + 2048], tree, q[at : at + 2048], ids, vectors, norm)

    def _compare(self, rows, tree, q, ids, vectors, norm) -> None:
        sims = self.unit[q] @ tree.unit[rows].T
        a, b = np.nonzero((self.ids[q][:, None] == ids[rows][None, :]) & (self.copy[rows] == 0))
        own = (self.vectors[q[a]] == vectors[rows[b]]).all(axis=1)
        sims[a[own], b[own]] = -np.inf
        least = self.worst[q]
        if len(rows) > self.k:
            least = np.maximum(least, np.partition(sims, -self.k, axis=1)[:, -self.k])
        a, b = np.nonzero((sims >= (least - 1e-9)[:, None]) & (sims > -np.inf))
        if not len(a):
            return
        a, b = q[a], rows[b]
        score = _dot(self.vectors[a], vectors[b]) / (self.norm[a] * norm[b])
        row, vec, old = self.found
        touched = np.zeros(len(self.ids), bool)
        touched[a] = True
        kept = touched[row]
        row2, vec2, score2 = np.concatenate([row[kept], a]), np.concatenate([vec[kept], ids[b]]), np.concatenate([old[kept], score])
        order = np.lexsort((vec2, -score2, row2))
        row2, vec2, score2 = row2[order], vec2[order], score2[order]
        first = np.flatnonzero(np.r_[True, row2[1:] != row2[:-1]])
        rank = np.arange(len(row2)) - np.repeat(first, np.diff(np.r_[first, len(row2)]))
        top = rank < self.k
        last = rank == self.k - 1
        self.worst[row2[last]] = score2[last]
        self.found = (np.concatenate([row[~kept], row2[top]]), np.concatenate([vec[~kept], vec2[top]]), np.concatenate([old[~kept], score2[top]]))


def _matrices(table: pa.Table) -> dict[int, tuple[np.ndarray, ...]]:
    """Ids, vectors, numbers of rows and hashes for each dimension that a table holds, in an order that doesn't depend on the shuffle."""
    table = table.combine_chunks()
    if not table.num_rows:
        return {}
    ids, times, marks = (table.column(c).to_numpy() for c in ("vec_id", "times", "mark"))
    lists = table.column("embedding").chunk(0)
    n = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False)
    start = np.cumsum(n) - n
    out = {}
    for d in np.unique(n):
        rows = np.flatnonzero(n == d)
        vectors = values[start[rows][:, None] + np.arange(d)]
        order = np.lexsort((marks[rows], ids[rows]))
        out[int(d)] = ids[rows][order], vectors[order], times[rows][order], marks[rows][order]
    return out


_NONE = pa.table({"query_id": pa.array([], pa.int64()), "mark": pa.array([], pa.int64()), "times": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})


def _search(k: int, factor: float, shard: int):
    def work(rows: pa.Table, queries: pa.Table) -> pa.Table:
        held, out = _matrices(rows), []
        for d, (ids, vectors, times, marks) in _matrices(queries).items():
            if d not in held:
                continue
            s = Search(ids, vectors, k, factor)
            at, rows_, n, _ = held[d]
            n = np.minimum(n, k + 1)
            pick = np.repeat(np.arange(len(at)), n)
            copy = np.arange(len(pick)) - np.repeat(np.cumsum(n) - n, n)
            for lo in range(0, len(pick), shard):
                now = pick[lo : lo + shard]
                s.add(at[now], rows_[now], copy[lo : lo + shard])
            row, vec, score = s.found
            out.append(pa.table({"query_id": ids[row], "mark": marks[row], "times": times[row], "vec_id": vec, "score": score}))
        return pa.concat_tables([_NONE, *out])

    return work


def _each(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def nearest(vectors: DataFrame, queries: Column, k: int = 5, factor: float = 1.0, shard: int = 16_384, rows_a_task: int = 131_072, queries_a_task: int = 16_384) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest cosine to each row for which `queries` is true, without itself.

    vectors: vec_id long, embedding (array of numbers). Rows whose id is null, or whose vector is
    null, empty, zero or holds null or non-finite components take no part; vectors are compared with those
    of their own length only. Ties go to the smaller id. Repeated rows are searched, and answered, as often as they come. Empty
    tables give no rows; other columns are left out.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.coalesce(queries, F.lit(False)).alias("asked"))
    usable = usable.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    # Rows that are wholly alike are one, however many there are, so that a hash deals the rest evenly.
    distinct = checkpoint(usable.groupBy("vec_id", "embedding").agg(F.count("*").alias("times"), F.bool_or("asked").alias("asked")))
    n, asked = distinct.agg(F.count("*"), F.count(F.when(F.col("asked"), 1))).first()
    shards, blocks = n // rows_a_task + 1, asked // queries_a_task + 1
    columns = ["vec_id", "embedding", "times", "mark"]
    marked = distinct.withColumn("mark", F.xxhash64("vec_id", "embedding"))
    left = marked.select(*columns, F.pmod("mark", F.lit(shards)).cast("long").alias("shard"), _each(blocks).alias("block"))
    right = marked.where("asked").select(*columns, _each(shards).alias("shard"), F.pmod("mark", F.lit(blocks)).cast("long").alias("block"))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(_search(k, factor, shard), "query_id long, mark long, times long, vec_id long, score double")
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score", F.explode(F.expr("array_repeat(0, cast(times as int))"))).select("query_id", "rank", "vec_id", "score")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    return nearest(rows, F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) / (q.norm * c.norm) AS score
  FROM n q JOIN n c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
) WHERE rank <= 5
"""
