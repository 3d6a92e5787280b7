"""Quality rules: base rules, and an isolation forest on the rules' statistics.

Trees split random statistics at random places; documents unlike the fitted
ones end on short paths.  Cuts are drawn without looking at rows; Spark counts
every good labelled row in every tree's leaves, and the threshold is set on
every labelled row, by running counts over the scores.  The driver holds the
model alone; every document is judged over its whole text.

Defined results: null and empty texts have no words and fail the base rules;
without labelled rows only the base rules reject; repeated rows give repeated
rows; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskscope.llm import stats
from riskscope.llm.common import cut, free_name, raw_texts, ship

SCORE_BUCKETS = 1 << 12
KEEP_SHARE = 0.999  # of good labelled rows, at least this share stays
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


@dataclass
class Forest:
    """Complete trees of one depth; ``path`` has each leaf's path length, the
    expected rest of an unsplit leaf included."""

    depth: int
    feature: np.ndarray  # tree x inner node
    cut: np.ndarray
    path: np.ndarray  # tree x leaf
    usual: float
    threshold: float = np.inf

    def leaves(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """Per tree the leaf of every row, from 0."""
        rows = np.arange(len(x))
        for feature, at in zip(self.feature, self.cut, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > at[node])
            yield node - len(feature)

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        """In (0, 1); near 1: isolated after few splits."""
        total = np.zeros(len(x))
        for leaf, path in zip(self.leaves(x), self.path, strict=True):
            total += path[leaf]
        return 2.0 ** (-total / max(len(self.feature), 1) / self.usual)


def expected_path(n: float) -> float:
    """Mean path of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def rule_statistics(m: np.ndarray) -> np.ndarray:
    """Statistics between 0 and 1: symbols, repeated lines, repeated words,
    words equal to the next, capitals and exclamation marks, each as the root
    of its share, so that a small share of a mostly absent thing stands out."""
    return np.sqrt(np.clip(stats.shares(m)[:, [1, 2, 3, 4, 5, 9]], 0, 1))


def fit(x: np.ndarray, trees: int = 128, sample: int = 1024, depth: int = 8, seed: int = 7) -> Forest:
    """Random trees over the whole range 0 to 1 of every statistic: a cut falls
    anywhere in a node's range, whether rows lie there or not, so that a
    statistic all fitted rows agree on still isolates the rows that don't."""
    inner, leaves = 2**depth - 1, 2**depth
    forest = Forest(depth, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), expected_path(sample))
    rng = np.random.default_rng(seed)
    for t in range(trees):
        stack = [(0, x[rng.permutation(len(x))[:sample]], 0, np.zeros(x.shape[1]), np.ones(x.shape[1]))]
        while stack:
            node, rows, level, low, high = stack.pop()
            if level == depth or not len(rows):
                for _ in range(depth - level):  # all rows go left to the last level
                    node = 2 * node + 1
                forest.path[t, node - inner] = level + expected_path(len(rows))
                continue
            k = rng.integers(x.shape[1])
            at = rng.uniform(low[k], high[k])
            forest.feature[t, node], forest.cut[t, node] = k, at
            right, upto, from_ = rows[:, k] > at, high.copy(), low.copy()
            upto[k] = from_[k] = at
            stack += [(2 * node + 1, rows[~right], level + 1, low, upto), (2 * node + 2, rows[right], level + 1, from_, high)]
    return forest


def base_failed(m: np.ndarray) -> np.ndarray:
    words, repeated = (m[:, stats.COUNTS.index(k)] for k in ("n_words", "n_repeat_words"))
    return (words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * words)


def drawn(width: int, trees: int = 128, depth: int = 8, seed: int = 7) -> Forest:
    """Complete random trees over the whole range 0 to 1 of every statistic,
    as :func:`fit` draws them, without rows: no paths yet."""
    inner = 2**depth - 1
    forest = Forest(depth, np.zeros((trees, inner), np.int64), np.zeros((trees, inner)), np.zeros((trees, inner + 1)), 1.0)
    rng = np.random.default_rng(seed)
    for t in range(trees):
        low, high = np.zeros((2 * inner + 1, width)), np.ones((2 * inner + 1, width))
        for node in range(inner):
            k = rng.integers(width)
            at = rng.uniform(low[node, k], high[node, k])
            forest.feature[t, node], forest.cut[t, node] = k, at
            for child in (2 * node + 1, 2 * node + 2):
                low[child], high[child] = low[node], high[node]
            high[2 * node + 1, k] = low[2 * node + 2, k] = at
    return forest


def settle(forest: Forest, n: np.ndarray) -> Forest:
    """Paths from the rows of every leaf (tree x leaf): a branch without rows
    ends where it begins."""
    forest.path = forest.depth + np.vectorize(expected_path, otypes=[float])(n)
    for level in range(forest.depth, -1, -1):  # the highest empty node last
        wide = 2 ** (forest.depth - level)
        empty = n.reshape(len(n), -1, wide).sum(2) == 0
        forest.path[np.repeat(empty, wide, axis=1)] = level
    forest.usual = expected_path(max(int(n[0].sum()), 2))
    return forest


def leaf_counts(rows: DataFrame, forest: Forest) -> np.ndarray:
    """Good rows (``label``, ``c``) in every leaf; a task sends its counts alone."""
    shape = forest.path.shape

    def run(batches):
        n = np.zeros(shape, np.int64)
        for pdf in batches:
            if len(pdf):
                x = rule_statistics(np.vstack(pdf["c"].to_numpy()))
                for t, leaf in enumerate(forest.leaves(x)):
                    n[t] += np.bincount(leaf, minlength=shape[1])
        tree, leaf = np.nonzero(n)
        yield pd.DataFrame({"tree": tree, "leaf": leaf, "n": n[tree, leaf]})

    found = rows.where("label = 1").select("c").mapInPandas(run, "tree long, leaf long, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n"))
    n = np.zeros(shape, np.int64)
    for r in found.collect():  # at most trees x leaves
        n[r.tree, r.leaf] = r.n
    return n


def threshold(scores: DataFrame, keep_share: float) -> float:
    """Of the places between two scores that keep ``keep_share`` of the good
    rows, the one with the most judged right (sum of the two shares); of equals
    the mildest.  ``scores``: a row per score, ``good`` and ``bad`` rows."""
    total = scores.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    if not total.good:
        return math.inf
    keyed = scores.withColumn("_b", F.least(F.floor(F.col("score") * SCORE_BUCKETS), F.lit(SCORE_BUCKETS - 1)))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # over the buckets
    first = keyed.groupBy("_b").agg(F.sum("good").alias("_g"), F.sum("bad").alias("_w"))
    first = first.select("_b", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_g", "_w")])
    inside = Window.partitionBy("_b").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    upto = keyed.join(F.broadcast(first), "_b").select(
        "score", (F.col("_g") + F.sum("good").over(inside)).alias("good"), (F.col("_w") + F.sum("bad").over(inside)).alias("bad")
    )
    least = math.ceil(keep_share * (total.good - 1)) + 1
    right = F.col("good") / F.lit(float(total.good)) + (F.lit(1.0) - F.col("bad") / F.lit(float(total.bad)) if total.bad else F.lit(0.0))
    upto = cut(upto.where(F.col("good") >= least).select("score", right.alias("right")))
    most = upto.agg(F.max("right")).first()[0]
    last = upto.where(F.col("right") >= most - 1e-12).agg(F.max("score")).first()[0]
    above = upto.where(F.col("score") > last).agg(F.min("score")).first()[0]
    return (last + (1.0 if above is None else above)) / 2


def train(docs: DataFrame, labels: DataFrame, keep_share: float = KEEP_SHARE) -> Forest:
    """Forest of all good labelled rows.  The threshold separates all labelled
    rows best (sum of the two shares judged right) among those that keep
    ``keep_share`` of the good ones."""
    words, repeated = (F.col("c")[stats.COUNTS.index(k)] for k in ("n_words", "n_repeat_words"))
    failed = (words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * words)
    rows = cut(stats.labelled(docs, labels).where(~failed))
    forest = drawn(rule_statistics(np.zeros((1, len(stats.COUNTS)))).shape[1])
    settle(forest, leaf_counts(rows, forest))

    @F.pandas_udf("double")
    def anomaly(c: pd.Series) -> pd.Series:
        return pd.Series(forest.anomaly(rule_statistics(np.vstack(c.to_numpy()))) if len(c) else [], dtype="float64")

    scores = rows.select("label", anomaly("c").alias("score")).groupBy("score")
    scores = cut(scores.agg(F.sum("label").cast("long").alias("good"), F.sum(1 - F.col("label")).cast("long").alias("bad")))
    forest.threshold = threshold(scores, keep_share)
    return forest


def judged(forest: Forest, text: Column) -> Column:
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    @F.arrow_udf("struct<" + ",".join(f"{f}:bigint" for f in fields) + ",base_failed:boolean,anomaly:double,kept:boolean>")
    def run(col: pa.Array) -> pa.Array:
        m = stats.matrix(raw_texts(col))
        failed, anomaly = base_failed(m), forest.anomaly(rule_statistics(m))
        own = [pa.array(m[:, stats.COUNTS.index(f)]) for f in fields]
        return pa.StructArray.from_arrays([*own, pa.array(failed), pa.array(anomaly), pa.array(~failed & (anomaly <= forest.threshold))], names=[*fields, "base_failed", "anomaly", "kept"])

    return run(text)


def judge(docs: DataFrame, forest: Forest, text_col: str = "text", out: str = "rules") -> DataFrame:
    """``docs`` with struct column ``out``: the statistics and verdicts."""
    ship(docs.sparkSession)
    return docs.withColumn(out, judged(forest, F.col(text_col)))


def keep(docs: DataFrame, forest: Forest, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, columns unchanged."""
    name = free_name(docs, "rules")
    return judge(docs, forest, text_col, name).where(F.col(name)["kept"]).drop(name)
