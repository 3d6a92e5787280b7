"""Quality classifier: histogram gradient-boosted trees over document counts.

Fitted on at most ``max_fit_rows`` labelled rows (a documented bound; the
statistics of every document are computed over whole texts).  The trees are
flattened into arrays, level by level, so that a batch goes down all trees by
array lookups.

Defined results: null and empty texts have zero counts and a score like any
other; without labelled rows every score is 0.5; repeated rows give repeated
rows; a null id is no held-out row; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskscope.llm import stats
from riskscope.llm.common import raw_texts, ship

MAX_FIT_ROWS = 20_000


@dataclass
class Trees:
    """Complete binary trees: node n has children 2n+1 and 2n+2.  A row goes
    right where its feature exceeds the cut."""

    depth: int
    feature: np.ndarray  # tree x inner node
    cut: np.ndarray
    value: np.ndarray  # tree x leaf
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += value[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def features(m: np.ndarray) -> np.ndarray:
    c = dict(zip(stats.COUNTS, m.astype(float).T, strict=True))
    distinct = c["n_distinct_words"] / np.maximum(c["n_words"], 1)
    return np.column_stack([stats.shares(m), distinct, np.log1p(c["n_words"]), np.log1p(c["n_lines"])])


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0, least: float = 5.0) -> Trees:
    """Boosting on the logistic loss with per-feature histograms."""
    inner, leaves = 2**depth - 1, 2**depth
    model = Trees(depth, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), 0.0)
    if not len(y):
        return model
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model.base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(f, np.arange(1, bins) / bins)) for f in x.T]
    binned = np.stack([np.searchsorted(e, f, side="left") for e, f in zip(edges, x.T, strict=True)], axis=1)
    n, width = binned.shape
    raw = np.full(n, model.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            cell = (((node - first)[:, None] * width + np.arange(width)) * bins + binned).ravel()
            g, h = (np.bincount(cell, np.repeat(v, width), wide * width * bins).reshape(wide, width, bins) for v in (grad, hess))
            gl, hl = g.cumsum(2)[:, :, :-1], h.cumsum(2)[:, :, :-1]
            gt, ht = g.sum(2)[:, :, None], h.sum(2)[:, :, None]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl * 4 < least) | ((ht - hl) * 4 < least)] = -1
            for k, e in enumerate(edges):
                gain[:, k, len(e) :] = -1
            best = gain.reshape(wide, -1).argmax(1)
            for i, b in enumerate(best):
                k, c = divmod(int(b), bins - 1)
                if gain[i, k, c] > 1e-9:
                    model.feature[t, first + i], model.cut[t, first + i] = k, edges[k][c]
            own = model.feature[t][node]
            node = 2 * node + 1 + (x[np.arange(n), own] > model.cut[t][node])
        leaf = node - inner
        g, h = np.bincount(leaf, grad, leaves), np.bincount(leaf, hess, leaves)
        model.value[t] = rate * g / (h + ridge)
        raw += model.value[t][leaf]
    return model


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_fit_rows: int = MAX_FIT_ROWS) -> Trees:
    """Model of label ``quality`` on rows that aren't held out."""
    rows = stats.labelled_sample(docs, labels.where(~held_out()), max_fit_rows)
    return fit(features(rows[:, 1:]), rows[:, 0].astype(float))


def scored(model: Trees, text: Column) -> Column:
    @F.arrow_udf("double")
    def run(col: pa.Array) -> pa.Array:
        return pa.array(model.score(features(stats.matrix(raw_texts(col)))))

    return run(text)


def score(docs: DataFrame, model: Trees, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score in column ``out`` (replaced if there is one)."""
    ship(docs.sparkSession)
    return docs.withColumn(out, scored(model, F.col(text_col)))
