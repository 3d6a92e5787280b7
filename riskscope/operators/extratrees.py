"""Extremely randomised trees (L5a), grown level by level from counts that
Spark aggregates over the rows.

Each level takes two passes.  The first gives, per open node, the label counts
and the range of every feature; ``max_features`` features that vary there are
then drawn, each with a cut uniform in its range.  The second counts the labels
left of each cut; the cut with the best class-weighted Gini gain that leaves
``min_leaf`` rows on both sides is taken.  All draws are md5 values of (seed,
tree, node, feature), so a rerun or a lost executor gives the same trees and SQL
can repeat them.  Tasks send one row per open node; the driver holds the model
(at most rows / ``min_leaf`` leaves a tree), never rows.  Trees are grown in
groups of ``group``, which bounds the nodes open at a time.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Column
from pyspark.sql import functions as F

from riskscope.session import ship_package

NODES = ("tree", "node", "n0", "n1", "feature", "cut", "left", "right")
NODE_SCHEMA = "tree int, node long, n0 long, n1 long, feature int, cut double, left int, right int"


def draw(seed: int, what: str, tree: int, node: int, feature: int) -> str:
    return hashlib.md5(f"{seed}|{what}|{tree}|{node}|{feature}".encode()).hexdigest()


def gini_sum(a, b):
    """Part of a child in the gain: the larger the purer."""
    return (a * a + b * b) / (a + b)


def _walk(x: np.ndarray, root: int, feature, cut, left, right) -> np.ndarray:
    """Index of the last node that each row reaches."""
    at = np.full(len(x), root, dtype=np.int64)
    live = np.flatnonzero(feature[at] >= 0)
    while len(live):
        here = at[live]
        at[live] = np.where(x[live, feature[here]] <= cut[here], left[here], right[here])
        live = live[feature[at[live]] >= 0]
    return at


@dataclass
class ExtraTrees:
    """Nodes of all trees as arrays; the first ``n_trees`` are the roots.
    ``node`` numbers a tree's nodes as in a heap (children 2i+1, 2i+2),
    ``left`` and ``right`` are places in the arrays."""

    n_trees: int
    weights: tuple[float, float]
    nodes: dict[str, np.ndarray]

    def value(self) -> np.ndarray:
        a, b = self.nodes["n0"] * self.weights[0], self.nodes["n1"] * self.weights[1]
        return np.divide(b, a + b, out=np.full(len(a), 0.5), where=a + b > 0)

    def probability(self, x: Column) -> Column:
        """Mean over the trees of the weighted share of label 1 in the row's
        leaf, for a column of feature arrays; only that column goes to Python."""
        ship_package()
        steps = [self.nodes[k] for k in ("feature", "cut", "left", "right")]
        value, n_trees = self.value(), self.n_trees

        @F.pandas_udf("double")
        def score(xs: pd.Series) -> pd.Series:
            if not len(xs):
                return pd.Series([], dtype="float64")
            m = np.vstack(xs.to_numpy())
            return pd.Series(sum(value[_walk(m, t, *steps)] for t in range(n_trees)) / n_trees)

        return score(x)

    def importances(self, n_features: int) -> np.ndarray:
        """Mean over the trees of each feature's share in the gain."""
        a, b = self.nodes["n0"] * self.weights[0], self.nodes["n1"] * self.weights[1]
        gain = np.zeros((self.n_trees, n_features))
        inner = np.flatnonzero(self.nodes["feature"] >= 0)
        lo, hi = self.nodes["left"][inner], self.nodes["right"][inner]
        won = gini_sum(a[lo], b[lo]) + gini_sum(a[hi], b[hi]) - gini_sum(a[inner], b[inner])
        np.add.at(gain, (self.nodes["tree"][inner], self.nodes["feature"][inner]), won)
        total = gain.sum(axis=1, keepdims=True)
        return np.divide(gain, total, out=np.zeros_like(gain), where=total > 0).mean(axis=0)

    def table(self, spark: SparkSession) -> DataFrame:
        """The model as rows, in array order (``at``)."""
        rows = pd.DataFrame({"at": np.arange(len(self.nodes["tree"]))} | self.nodes)
        return spark.createDataFrame(rows, "at int, " + NODE_SCHEMA)

    @classmethod
    def of_table(cls, table: DataFrame, weights) -> ExtraTrees:
        rows = table.orderBy("at").toPandas()
        nodes = {k: rows[k].to_numpy() for k in NODES}
        return cls(int((nodes["node"] == 0).sum()), tuple(weights), nodes)


def _per_slot(df: DataFrame, partial, schema: str) -> DataFrame:
    """Runs ``partial(x, y)`` on each Arrow batch of rows."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                got = partial(np.vstack(pdf["x"].to_numpy()), pdf["label"].to_numpy())
                if got is not None:
                    yield got

    return df.mapInPandas(run, schema)


def _open_rows(x, trees, steps, slot):
    """(row, slot) of the rows that stand in an open node, sorted by slot."""
    rows, slots = [], []
    for t in trees:
        s = slot[_walk(x, t, *steps)]
        inside = np.flatnonzero(s >= 0)
        rows.append(inside)
        slots.append(s[inside])
    rows, slots = np.concatenate(rows), np.concatenate(slots)
    order = np.argsort(slots, kind="stable")
    return rows[order], slots[order]


def _ranges(df, trees, steps, slot, n_features):
    """Pass 1: per open node its label counts and each feature's range."""

    def partial(x, y):
        rows, slots = _open_rows(x, trees, steps, slot)
        if not len(rows):
            return None
        starts = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]])
        ones = np.add.reduceat(y[rows].astype(np.int64), starts)
        sizes = np.diff(np.r_[starts, len(slots)])
        lo, hi = (np.empty((len(starts), n_features)) for _ in range(2))
        for f in range(n_features):  # a column at a time: rows stand once per tree
            v = x[rows, f]
            lo[:, f], hi[:, f] = np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts)
        return pd.DataFrame({"slot": slots[starts], "n0": sizes - ones, "n1": ones, "lo": list(lo), "hi": list(hi)})

    part = _per_slot(df, partial, "slot long, n0 long, n1 long, lo array<double>, hi array<double>")
    return part.groupBy("slot").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"),
        F.array(*[F.min(F.col("lo")[f]) for f in range(n_features)]).alias("lo"),
        F.array(*[F.max(F.col("hi")[f]) for f in range(n_features)]).alias("hi"),
    ).toPandas()


def _left_counts(df, trees, steps, slot, picked, cuts):
    """Pass 2: per open node the labels left of each of its cuts."""
    k = picked.shape[1]

    def partial(x, y):
        rows, slots = _open_rows(x, trees, steps, slot)
        if not len(rows):
            return None
        starts = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]])
        one = y[rows] == 1
        l0, l1 = (np.empty((len(starts), k), dtype=np.int64) for _ in range(2))
        for j in range(k):
            under = x[rows, picked[slots, j]] <= cuts[slots, j]
            l0[:, j] = np.add.reduceat((under & ~one).astype(np.int64), starts)
            l1[:, j] = np.add.reduceat((under & one).astype(np.int64), starts)
        return pd.DataFrame({"slot": slots[starts], "l0": list(l0), "l1": list(l1)})

    part = _per_slot(df, partial, "slot long, l0 array<long>, l1 array<long>")
    return part.groupBy("slot").agg(
        F.array(*[F.sum(F.col("l0")[j]) for j in range(k)]).alias("l0"),
        F.array(*[F.sum(F.col("l1")[j]) for j in range(k)]).alias("l1"),
    ).toPandas()


def _draw_cuts(seed, tree, node, lo, hi, k):
    """Up to ``k`` features that vary in the node, in drawn order, and a cut of each."""
    vary = [f for f in np.flatnonzero(hi > lo)]
    vary.sort(key=lambda f: (draw(seed, "pick", tree, node, f), f))
    u = [int(draw(seed, "cut", tree, node, f)[:8], 16) / 2.0**32 for f in vary[:k]]
    return [(f, lo[f] + c * (hi[f] - lo[f])) for f, c in zip(vary[:k], u)]


def fit(
    rows: DataFrame, n_features: int, *, x: str = "x", label: str = "label", n_trees: int = 700, max_depth: int = 30,
    min_leaf: int = 2, max_features: int | None = None, seed: int = 42, group: int = 100,
) -> ExtraTrees:
    """Trees over ``rows`` (``x`` array of finite doubles, ``label`` 0 or 1),
    balanced class weights.  ``rows`` is read twice a level and group: give a
    written or checkpointed table.  ``max_features`` None: square root of their
    number.  Without rows, or with one label only, each tree is a lone leaf."""
    ship_package()
    k = max_features or max(int(np.sqrt(n_features)), 1)
    df = rows.select(F.col(x).alias("x"), F.col(label).cast("int").alias("label"))
    count = {r["label"]: r["n"] for r in df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(count.values())
    weights = tuple(n / (2.0 * count[c]) if count.get(c) else 0.0 for c in (0, 1))
    # [tree, node, n0, n1, feature, cut, left, right]; a leaf has feature -1.
    grown = [[t, 0, count.get(0, 0), count.get(1, 0), -1, 0.0, -1, -1] for t in range(n_trees)]

    def arrays():
        kinds = (np.int32, np.int64, np.int64, np.int64, np.int32, np.float64, np.int32, np.int32)
        return {name: np.array([g[i] for g in grown], dtype=kind) for i, (name, kind) in enumerate(zip(NODES, kinds))}

    for first in range(0, n_trees, group):
        trees = range(first, min(first + group, n_trees))
        frontier = list(trees)
        for _ in range(max_depth):
            frontier = [i for i in frontier if grown[i][2] and grown[i][3] and grown[i][2] + grown[i][3] >= 2 * min_leaf]
            if not frontier:
                break
            now = arrays()
            steps = [now[c] for c in ("feature", "cut", "left", "right")]
            slot = np.full(len(grown), -1, dtype=np.int64)
            slot[frontier] = np.arange(len(frontier))
            picked = np.zeros((len(frontier), k), dtype=np.int64)
            cuts = np.full((len(frontier), k), -np.inf)  # no cut: nothing is left of it
            for r in _ranges(df, trees, steps, slot, n_features).itertuples():
                g = grown[frontier[r.slot]]
                for j, (f, c) in enumerate(_draw_cuts(seed, g[0], g[1], np.asarray(r.lo), np.asarray(r.hi), k)):
                    picked[r.slot, j], cuts[r.slot, j] = f, c
            opened = []
            for r in _left_counts(df, trees, steps, slot, picked, cuts).sort_values("slot").itertuples():
                i = frontier[r.slot]
                tree, node, n0, n1 = grown[i][:4]
                l0, l1 = np.asarray(r.l0), np.asarray(r.l1)
                fit_ = (l0 + l1 >= min_leaf) & (n0 + n1 - l0 - l1 >= min_leaf)
                if not fit_.any():
                    continue
                with np.errstate(invalid="ignore", divide="ignore"):
                    gain = gini_sum(l0 * weights[0], l1 * weights[1]) + gini_sum((n0 - l0) * weights[0], (n1 - l1) * weights[1])
                j = int(np.argmax(np.where(fit_, gain, -np.inf)))
                grown[i][4:] = [int(picked[r.slot, j]), float(cuts[r.slot, j]), len(grown), len(grown) + 1]
                opened += [len(grown), len(grown) + 1]
                grown.append([tree, 2 * node + 1, int(l0[j]), int(l1[j]), -1, 0.0, -1, -1])
                grown.append([tree, 2 * node + 2, int(n0 - l0[j]), int(n1 - l1[j]), -1, 0.0, -1, -1])
            frontier = opened
    return ExtraTrees(n_trees, weights, arrays())
