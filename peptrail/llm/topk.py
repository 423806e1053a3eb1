"""Exact top-k by inner product: dual-tree search over cover trees of queries and of data.

Every (query block, data block) pair is one group. In it both sides are indexed by a cover tree, and a
pair of nodes is left out once neither its covering radii nor the angles they span can lift a score to
the worst k-th score of the node's queries. Each query starts with the k-th score that it has among a few
thousand rows of the data, so a block prunes by what other blocks hold. Blocks bound a group's memory; no
block gives over k rows a query, and none under that first k-th score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peptrail.llm.shared import staged

LEAF = 64
DATA_BLOCK = 32_768
QUERY_BLOCK = 16_384
#: rows of the data, picked by a hash, among which each query's first k-th score is sought
FIRST_ROWS = 4096


@dataclass
class Node:
    """A cover-tree node: its centre is a point, all its points lie within ``radius`` and ``angle`` of it and have at most ``longest`` as norm."""

    centre: np.ndarray
    norm: float
    radius: float
    angle: float
    longest: float
    points: np.ndarray
    children: list[Node] = field(default_factory=list)


def cover_tree(x: np.ndarray, points: np.ndarray | None = None, base: float = 1.6, fan: int = 24, centre: int | None = None) -> Node:
    """Cover tree of the rows ``points`` of ``x``.

    A node's children are centred on a net of its points, picked farthest first from its own centre
    (which stays a child's centre), until each point is within radius / base of one; points go to
    the nearest. A net of over ``fan`` centres stops early; then radii shrink less, and stay true.
    """
    points = np.arange(len(x)) if points is None else points
    if centre is None:
        centre = int(points[0])
    gap = np.sqrt(((x[points] - x[centre]) ** 2).sum(1))
    radius = float(gap.max())
    norms = np.sqrt((x[points] ** 2).sum(1))
    norm = float(np.sqrt((x[centre] ** 2).sum()))
    # a null vector has no direction: with one the angle says nothing
    angle = float(np.arccos(np.clip((x[points] @ x[centre]) / (norms * norm), -1, 1)).max()) if norm and norms.all() else np.pi
    node = Node(x[centre], norm, radius, angle, float(norms.max()), points)
    if len(points) <= LEAF or radius == 0:
        return node
    picked, owner = [centre], np.zeros(len(points), int)
    while gap.max() > radius / base and len(picked) < fan:
        far = int(gap.argmax())
        picked.append(int(points[far]))
        to_far = np.sqrt(((x[points] - x[points[far]]) ** 2).sum(1))
        nearer = to_far < gap
        nearer[far] = True
        owner[nearer] = len(picked) - 1
        gap = np.minimum(gap, to_far)
    for k, c in enumerate(picked):
        own = points[owner == k]
        if len(own):
            node.children.append(cover_tree(x, own, base, fan, c))
    return node


class DualSearch:
    """Best ``k`` data ids for each query; scores are integers, ties go to the smaller id.

    ``floor`` holds scores under which nothing is sought, by query.
    """

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.k, self.query_ids = k, query_ids
        self.q = queries.astype(np.float64)
        order = np.argsort(data_ids, kind="stable")
        distinct, owner = np.unique(data[order], axis=0, return_inverse=True)
        # of equal vectors only the k + 1 smallest ids can be among a query's best, its own left out
        owner = owner.reshape(-1)
        by = np.argsort(owner, kind="stable")
        start = np.r_[0, np.flatnonzero(np.diff(owner[by])) + 1]
        ids = data_ids[order][by]
        self.ids = [ids[a:b][: k + 1] for a, b in zip(start, [*start[1:], len(ids)], strict=True)]
        self.d = distinct.astype(np.float64)
        biggest = max(np.abs(self.q).max(initial=0), np.abs(self.d).max(initial=0))
        self.exact = biggest * biggest * self.q.shape[1] < 2**52
        self.wide = (queries.astype(object), distinct.astype(object)) if not self.exact else None
        self.best: list[list[tuple[int, int]]] = [[] for _ in query_ids]
        self.kth = np.full(len(query_ids), -np.inf) if floor is None else floor.astype(np.float64)
        self.base_cases = 0

    def run(self) -> list[list[tuple[int, int]]]:
        if len(self.d) and len(self.q):
            self._pair(cover_tree(self.q), cover_tree(self.d))
        return self.best

    def _bound(self, q: Node, d: Node) -> float:
        """No query of q and vector of d have a larger inner product."""
        middle = float(q.centre @ d.centre)
        by_radius = middle + q.norm * d.radius + d.norm * q.radius + q.radius * d.radius
        if not (q.norm and d.norm):
            return by_radius
        between = math.acos(max(-1.0, min(1.0, middle / (q.norm * d.norm)))) - q.angle - d.angle
        lengths = q.longest * d.longest
        # a negative cosine is worst for the shortest vectors, which may be of any length
        return min(by_radius, max(0.0, lengths * (math.cos(max(0.0, between)) + 1e-6)))

    def _hopeless(self, bound: float, q: Node) -> bool:
        slack = 0.5 if self.exact else abs(bound) * 1e-9 + 0.5
        return bound + slack < self.kth[q.points].min()

    def _pair(self, q: Node, d: Node) -> None:
        stack = [(q, d, self._bound(q, d))]
        while stack:
            q, d, bound = stack.pop()
            if self._hopeless(bound, q):
                continue
            if not q.children and not d.children:
                self._base(q.points, d.points)
            elif q.children and (not d.children or q.radius >= d.radius):
                stack += [(c, d, self._bound(c, d)) for c in q.children]
            else:
                stack += sorted(((q, c, self._bound(q, c)) for c in d.children), key=lambda t: t[2])

    def _base(self, qs: np.ndarray, ds: np.ndarray) -> None:
        self.base_cases += 1
        if self.exact:
            score = self.q[qs] @ self.d[ds].T
        else:
            score = self.wide[0][qs] @ self.wide[1][ds].T
        hit = score >= self.kth[qs][:, None]
        for row in np.flatnonzero(hit.any(1)):
            q = int(qs[row])
            columns = np.flatnonzero(hit[row])
            if len(columns) > self.k + 1:  # a vector may hold the query only; one more is enough
                value = score[row, columns]
                least = np.partition(value, len(value) - self.k - 1)[len(value) - self.k - 1]
                columns = columns[value >= least]
            own = int(self.query_ids[q])
            found = self.best[q] + [(-int(score[row, c]), int(i)) for c in columns for i in self.ids[ds[c]] if i != own]
            found.sort()
            self.best[q] = found[: self.k]
            if len(found) >= self.k:
                self.kth[q] = max(self.kth[q], -self.best[q][-1][0])


def quantised(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", scale: int = 256) -> DataFrame:
    """``id, v array<long>`` with floor(scale * x); vectors that are null or hold null or non-finite parts take no part."""
    x = F.col(column)
    sound = x.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return vectors.where(F.col(id_column).isNotNull() & F.coalesce(sound, F.lit(False))).select(
        F.col(id_column).cast("long").alias("id"), F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double"))).alias("v")
    )


def top_k(
    queries: DataFrame, data: DataFrame, k: int = 5, data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK, first_rows: int = FIRST_ROWS
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries(id, v)`` the ``k`` best rows of ``data(id, v)``.

    A row's own id is no candidate, vectors of another length take no part for it, rows with one id
    count each. Both sides are dealt over blocks by a hash, so one vector that is repeated endlessly is
    spread, and equal vectors meet as one point of a block's tree. Fewer candidates give fewer rows; no
    queries or no data give none.
    """
    spark = data.sparkSession
    n, nq = data.count(), queries.count()
    blocks = max(math.ceil(n / data_block), min(math.ceil(n / 1024), 2 * spark.sparkContext.defaultParallelism), 1)
    groups = max(math.ceil(nq / query_block), 1)
    queries = queries.select("id", "v", F.lit(None).cast("long").alias("floor"))
    if blocks > 1:
        some = data.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(max(1, n // first_rows))) == 0)
        first = _searched(queries, some, 1, groups, k).groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("found"))
        # a query with k scores among some of the data has a k-th best of at least the least of them
        first = staged(first.where(F.col("found") == k).select(F.col("query_id").alias("id"), "floor"), "floors", narrow=True)
        queries = queries.drop("floor").join(first, "id", "left").select("id", "v", "floor")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    found = _searched(queries, data, blocks, groups, k)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searched(queries: DataFrame, data: DataFrame, blocks: int, groups: int, k: int) -> DataFrame:
    """``query_id, vec_id, score``: the best of each data block for each query, from its ``floor`` on."""
    own = lambda parts: F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    spread = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = queries.select("id", "v", "floor", F.size("v").alias("dim"), spread(blocks).alias("db"), own(groups).alias("qb"))
    # named anew: columns of one table on both sides of a cogroup are mixed up
    right = data.select(F.col("id").alias("id"), F.col("v").alias("v"), F.size("v").alias("dim"), own(blocks).alias("db"), spread(groups).alias("qb"))

    def search(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(d):
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0, np.int64)})
        # a floor is rounded down when it becomes a double: 2^53 and more lose bits
        floor = np.array([-np.inf if pd.isna(f) else np.nextafter(float(f), -np.inf) for f in q.floor])
        found = DualSearch(np.stack(q.v), q.id.to_numpy(), np.stack(d.v), d.id.to_numpy(), k, floor).run()
        rows = [(i, vec, -score) for i, best in zip(q.id.tolist(), found, strict=True) for score, vec in best]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype(np.int64)

    return left.groupBy("dim", "db", "qb").cogroup(right.groupBy("dim", "db", "qb")).applyInPandas(search, "query_id long, vec_id long, score long")
