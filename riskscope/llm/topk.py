"""Exact top-k search by inner product: ball-tree branch and bound per shard.

Candidates are dealt into shards of bounded size; a block of queries meets
every shard.  A shard's ball tree has a centre and a radius per node, which
bound the score of anything inside: q.c + |q| r.  Nodes are taken in the order
of that bound until it falls below the current kth score.  That score is
shared: the shards of a pilot run first, and what they reach is the start of
all others, so that they skip all but their best nodes.

Every block of queries is compared with every shard by contract; a task holds
one shard and one block.

Defined results: vectors that are null or hold a null or non-finite component
take no part, nor do rows without an id; vectors of another length don't meet
the query; rows that repeat the query's id are left out with it; of several
query rows of one id the shortest vector, then the smallest by components, is
the query; ties go to the smaller id (candidate rows that repeat an id each
count); fewer candidates than k
give them all; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskscope.llm.common import cut, ship

SCALE = 256
SHARD_ROWS = 8_192
QUERY_ROWS = 4_096
LEAF = 64


class Ball:
    """Ball tree over integer vectors; nodes in preorder."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray) -> None:
        self.order = np.arange(len(vectors))
        self.lo, self.hi, self.left, self.right, centre, radius = [], [], [], [], [], []
        exact = vectors.astype(float)
        todo = [(0, len(vectors), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            node = len(self.lo)
            if parent >= 0:
                (self.right if side else self.left)[parent] = node
            own = exact[self.order[lo:hi]]
            mid = own.mean(axis=0)
            far = np.sqrt(((own - mid) ** 2).sum(axis=1))
            self.lo.append(lo)
            self.hi.append(hi)
            self.left.append(-1)
            self.right.append(-1)
            centre.append(mid)
            radius.append(far.max())
            if hi - lo > LEAF and radius[-1] > 0:  # split by the nearer of two far points
                a = own[far.argmax()]
                from_a = ((own - a) ** 2).sum(axis=1)
                b = own[from_a.argmax()]
                half = np.argsort(from_a - ((own - b) ** 2).sum(axis=1), kind="stable")
                self.order[lo:hi] = self.order[lo:hi][half]
                todo += [(lo + (hi - lo) // 2, hi, node, 1), (lo, lo + (hi - lo) // 2, node, 0)]
        self.centre, self.radius = np.array(centre), np.array(radius)
        self.vectors, self.ids = vectors[self.order], ids[self.order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bound of the score for every query and node, rounding included."""
        q = queries.astype(float)
        norm = np.sqrt((q**2).sum(axis=1))[:, None]
        bound = q @ self.centre.T + norm * self.radius
        return bound + 1 + 1e-9 * np.abs(bound) + 1e-9 * norm * np.sqrt((self.centre**2).sum(axis=1))

    def best(self, query: np.ndarray, own_id: int, k: int, kth: float, bound: np.ndarray) -> list[tuple[int, int]]:
        """At most k (score, -id), none below ``kth``, best first."""
        found: list[tuple[int, int]] = []  # a heap: the worst kept first
        nodes = [(-bound[0], 0)]
        while nodes:
            up, node = heapq.heappop(nodes)
            if -up < kth:
                break
            if self.left[node] >= 0:
                for child in (self.left[node], self.right[node]):
                    if bound[child] >= kth:
                        heapq.heappush(nodes, (-bound[child], child))
                continue
            lo, hi = self.lo[node], self.hi[node]
            scores = self.vectors[lo:hi] @ query
            for i in np.flatnonzero(scores >= kth).tolist():
                item = (int(scores[i]), -int(self.ids[lo + i]))
                if -item[1] == own_id:
                    continue
                if len(found) < k:
                    heapq.heappush(found, item)
                elif item > found[0]:
                    heapq.heapreplace(found, item)
                if len(found) == k:
                    kth = max(kth, found[0][0])
        return sorted(found, reverse=True)


def _matrix(col: pa.Array) -> np.ndarray:
    flat = np.asarray(col.flatten(), np.int64)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)


def _searched(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """One shard (id, vec) and one block of queries (qid, qvec, kth)."""
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            left, right = left.combine_chunks(), right.combine_chunks()
            tree = Ball(_matrix(left["vec"].chunk(0)), np.asarray(left["id"]))
            queries, qids = _matrix(right["qvec"].chunk(0)), right["qid"].to_pylist()
            floor = [-np.inf if x is None else x for x in right["kth"].to_pylist()]
            for at in range(0, len(queries), 256):
                part = queries[at : at + 256]
                for i, bound in enumerate(tree.bounds(part), at):
                    for score, minus in tree.best(queries[i], qids[i], k, floor[i], bound):
                        out["query_id"].append(qids[i])
                        out["vec_id"].append(-minus)
                        out["score"].append(score)
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def usable(vectors: DataFrame, is_query: str, id_col: str, vec_col: str) -> DataFrame:
    """``id``, ``dim``, ``vec`` (integers), ``is_query`` of the rows that take part."""
    x = F.transform(F.col(vec_col), lambda v: F.floor(v.cast("double") * SCALE).cast("long"))
    fine = F.forall(F.col(vec_col), lambda v: F.coalesce(~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")), F.lit(False)))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & fine).select(
        F.col(id_col).cast("long").alias("id"), F.size(vec_col).alias("dim"), x.alias("vec"), F.expr(is_query).alias("is_query")
    )


def top_k(vectors: DataFrame, is_query: str, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k best other rows of
    every row for which the SQL condition ``is_query`` holds."""
    ship(vectors.sparkSession)
    rows = cut(usable(vectors, is_query, id_col, vec_col))
    n, asked = rows.agg(F.count(F.lit(1)), F.sum(F.col("is_query").cast("int"))).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-(asked or 0) // query_rows))
    candidates = rows.select("dim", "id", "vec", F.pmod(F.xxhash64("vec", "id"), F.lit(shards)).cast("int").alias("s"))
    queries = rows.where("is_query").groupBy(F.col("id").alias("qid")).agg(F.min(F.struct("dim", "vec")).alias("q"))
    queries = queries.select(F.col("q.dim").alias("qdim"), "qid", F.col("q.vec").alias("qvec"), F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("qb"))

    def search(shard_from: int, shard_to: int, asked: DataFrame) -> DataFrame:
        """Shards from..to-1 against all queries, which carry ``kth``."""
        left = candidates.where((F.col("s") >= shard_from) & (F.col("s") < shard_to)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        right = asked.withColumn("qs", F.explode(F.sequence(F.lit(shard_from), F.lit(shard_to - 1))))
        pairs = left.select("dim", "s", "b", "id", "vec").groupBy("dim", "s", "b").cogroup(right.select("qdim", "qs", "qb", "qid", "qvec", "kth").groupBy("qdim", "qs", "qb"))
        return pairs.applyInArrow(_searched(k), "query_id bigint, vec_id bigint, score bigint")

    pilot = cut(_best(search(0, 1, queries.withColumn("kth", F.lit(None).cast("long"))), k).drop("rank"))
    if shards > 1:
        kth = pilot.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
        rest = search(1, shards, queries.join(kth, F.col("qid") == F.col("query_id"), "left").drop("query_id"))
        pilot = _best(pilot.unionByName(rest), k).drop("rank")
    return _best(pilot, k).select("query_id", "rank", "vec_id", "score")
