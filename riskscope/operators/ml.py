"""Training, cross-validation, calibration and model scoring.

Spark ML pipelines: median ``Imputer`` -> ``VectorAssembler`` (-> scaler) ->
classifier, with balanced class weights as ``weightCol``.  Candidates:

* ``extra_trees``: :mod:`riskscope.operators.extratrees`, as MLlib has none.
* ``random_forest``, ``gradient_boosting``, ``logistic_regression``: MLlib
  models with the original hyper-parameters (``regParam = 1 / n`` is C = 1
  under balanced weights).
  MLlib's trees look for cuts in a sample of 10,000 rows where there are more;
  then :func:`tree_cuts` finds them over all rows first.
* ``svc_rbf``: no kernel SVM in MLlib; stand-in = random Fourier features
  (Rahimi & Recht, 2007) computed per Arrow batch with numpy, then
  ``LinearSVC``.  Gamma follows from the variance of the scaled inputs; the
  probability is a sigmoid of the margin, fitted on held-out margins (Platt).

Cross-validation assigns folds with the distributed exact rank (M3), fits
each fold with Spark and writes its out-of-fold probabilities to a table;
:func:`riskscope.operators.evaluate.holdout_metrics` then reads that table only.  Isotonic calibration
follows the 3-fold ensemble scheme: base model on two folds, isotonic map on
the third, probabilities averaged.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, ElementwiseProduct, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskscope.operators import dataset as DS
from riskscope.operators import evaluate as EV
from riskscope.operators import extratrees as ET
from riskscope.session import cut_lineage, ensure_checkpoint_dir

MODEL_NAMES = ("extra_trees", "random_forest", "gradient_boosting", "logistic_regression", "svc_rbf")
SEED = 42
SPLIT_ROWS = 10_000  # rows up to which MLlib's trees look at all of them for cuts


@dataclass
class TrainConfig:
    n_extra_trees: int = 700
    n_random_forest: int = 500
    gbt_iter: int = 100
    max_depth: int = 30
    lr_max_iter: int = 2000
    svc_c: float = 2.0
    rff_dim: int = 200
    svc_max_iter: int = 200
    imputer_relative_error: float = 0.001
    parallelism: int = 4  # fits submitted to the cluster at a time
    models: Sequence[str] = field(default_factory=lambda: MODEL_NAMES)


def _imputed(feats: Sequence[str]) -> list[str]:
    return [f"{c}__imp" for c in feats]


def _prep_stages(feats: Sequence[str], cfg: TrainConfig, scaled_rows: int | None = None):
    """Median, vector and, for ``scaled_rows`` fitted rows, mean 0 and population
    standard deviation 1 (L3): MLlib divides by the sample's, which is larger by
    sqrt(n / (n - 1))."""
    scaled = scaled_rows is not None
    imp = Imputer(strategy="median", inputCols=list(feats), outputCols=_imputed(feats), relativeError=cfg.imputer_relative_error)
    asm = VectorAssembler(inputCols=_imputed(feats), outputCol="features_raw" if scaled else "features", handleInvalid="keep")
    stages = [imp, asm]
    if scaled:
        grow = (scaled_rows / (scaled_rows - 1)) ** 0.5 if scaled_rows > 1 else 1.0
        stages.append(StandardScaler(inputCol="features_raw", outputCol="features_sample", withMean=True, withStd=True))
        stages.append(ElementwiseProduct(scalingVec=[grow] * len(feats), inputCol="features_sample", outputCol="features"))
    return stages


def tree_cuts(df: DataFrame, cols: Sequence[str], bins: int, relative_error: float) -> list[list[float]]:
    """Increasing cuts of each column into ``bins`` ranges at most, over all rows:
    the middles between neighbouring values where there are ``bins`` values or
    fewer, else quantiles.  A value goes with the cut it equals to the right."""

    def few(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = [set() for _ in cols]
        for pdf in batches:
            for values, c in zip(seen, pdf.columns):
                if len(values) <= bins:
                    values.update(pdf[c].dropna().unique()[: bins + 1].tolist())
        for i, values in enumerate(seen):
            yield pd.DataFrame({"at": i, "v": sorted(values)}, columns=["at", "v"]).astype({"at": "int32", "v": "float64"})

    # bins + 1 values of a task prove that there are too many; fewer are all of its values.
    held = df.select(*[F.col(c).alias(f"v{i}") for i, c in enumerate(cols)]).mapInPandas(few, "at int, v double").distinct()
    own = held.groupBy("at").agg(F.slice(F.array_sort(F.collect_set("v")), 1, bins + 1).alias("v"))
    known = {r["at"]: r["v"] for r in own.collect()}
    many = [i for i in range(len(cols)) if len(known.get(i, [])) > bins]
    shares = [k / bins for k in range(1, bins)]
    ranks = dict(zip(many, df.approxQuantile([cols[i] for i in many], shares, relative_error))) if many else {}
    cuts = []
    for i in range(len(cols)):
        v = known.get(i, [])
        at = ranks[i] if i in ranks else [a / 2 + b / 2 for a, b in zip(v, v[1:])]
        cuts.append(sorted({x for x in at if np.isfinite(x)}))
    return cuts


def _tree_stages(train: DataFrame, n: int, feats: Sequence[str], cfg: TrainConfig, clf) -> list:
    """Stages of a tree model of MLlib.  Over ``SPLIT_ROWS`` rows its values are
    the numbers of their ranges between cuts of all rows, and ``maxBins`` is set so
    that MLlib samples no rows; it finds as many cuts as there are ranges."""
    stages = _prep_stages(feats, cfg)
    if n <= max(SPLIT_ROWS, clf.getMaxBins() ** 2):
        return [*stages, clf]
    imp = stages[0].fit(train)
    cuts = tree_cuts(imp.transform(train), _imputed(feats), clf.getMaxBins(), cfg.imputer_relative_error)
    splits = [[-np.inf, *(c or [0.0]), np.inf] for c in cuts]
    ranges = [f"{c}__range" for c in feats]
    cut = Bucketizer(splitsArray=splits, inputCols=_imputed(feats), outputCols=ranges, handleInvalid="keep")
    return [imp, cut, VectorAssembler(inputCols=ranges, outputCol="features", handleInvalid="keep"), clf.setMaxBins(isqrt(n) + 1)]


def rff_transform(df: DataFrame, n_features: int, dim: int, gamma: float, seed: int = SEED, in_col: str = "features", out_col: str = "rff") -> DataFrame:
    """Random Fourier features z(x) = sqrt(2/D) cos(W x + b), W ~ N(0, 2 gamma),
    b ~ U(0, 2 pi): an explicit map whose inner products approximate the RBF
    kernel.  W and b are fixed by the seed (no state to ship); computed per
    Arrow batch with numpy."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, np.sqrt(2.0 * gamma), size=(dim, n_features))
    b = rng.uniform(0.0, 2.0 * np.pi, size=dim)
    scale = np.sqrt(2.0 / dim)

    @F.pandas_udf("array<double>")
    def fourier(xs: pd.Series) -> pd.Series:
        if not len(xs):
            return pd.Series([], dtype="object")
        return pd.Series(list(scale * np.cos(np.vstack(xs.to_numpy()) @ w.T + b)))

    return df.withColumn(out_col, array_to_vector(fourier(vector_to_array(F.col(in_col)))))


def scale_gamma(df: DataFrame, n_features: int, in_col: str = "features") -> float:
    """1 / (features * variance over all entries): the "scale" rule."""
    x = vector_to_array(F.col(in_col))
    total = F.sum(F.aggregate(x, F.lit(0.0), lambda a, v: a + v)).alias("s")
    squares = F.sum(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)).alias("q")
    r = df.agg(total, squares, F.count(F.lit(1)).alias("n")).first()
    n = r["n"] * n_features
    var = r["q"] / n - (r["s"] / n) ** 2 if n else 0.0
    return 1.0 / (n_features * var) if var > 0 else 1.0


def fit_sigmoid(held: DataFrame, margin: str = "margin", label: str = "label") -> tuple[float, float]:
    """Platt's map p = 1 / (1 + exp(-(a * margin + c))) by logistic regression
    on held-out margins.  The smoothed targets t = (n1 + 1) / (n1 + 2) and
    1 / (n0 + 2) are given as two weighted rows each.  ``a`` is kept at zero or
    above, so the probability never falls with the margin."""
    n = {r[label]: r["n"] for r in held.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    t = F.when(F.col(label) == 1, (n.get(1, 0) + 1.0) / (n.get(1, 0) + 2.0)).otherwise(1.0 / (n.get(0, 0) + 2.0))
    rows = held.select(margin, t.alias("t")).select(margin, F.explode(F.array(
        F.struct(F.lit(1.0).alias("y"), F.col("t").alias("w")), F.struct(F.lit(0.0).alias("y"), (1.0 - F.col("t")).alias("w"))
    )).alias("r")).select(margin, "r.y", "r.w")
    rows = VectorAssembler(inputCols=[margin], outputCol="m").transform(rows)
    m = LogisticRegression(featuresCol="m", labelCol="y", weightCol="w", regParam=0.0, maxIter=200).fit(rows)
    return max(float(m.coefficients[0]), 0.0), float(m.intercept)


def _margin():
    return vector_to_array(F.col("rawPrediction"))[1]


@dataclass
class FittedModel:
    name: str
    pipeline: PipelineModel
    rff: dict | None = None
    trees: ET.ExtraTrees | None = None

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        """Adds the SCAM probability column ``out`` (a projection: every
        intermediate column is dropped again)."""
        before = set(df.columns)
        if self.rff is not None:
            pre = self.rff["prep"].transform(df)
            z = rff_transform(pre, self.rff["n_features"], self.rff["dim"], self.rff["gamma"])
            t = self.rff["svc"].transform(z)
            slope, intercept = self.rff["sigmoid"]
            t = t.withColumn(out, 1.0 / (1.0 + F.exp(-(slope * _margin() + intercept))))
        elif self.trees is not None:
            t = self.pipeline.transform(df).withColumn(out, self.trees.probability(vector_to_array(F.col("features"))))
        else:
            t = self.pipeline.transform(df).withColumn(out, vector_to_array(F.col("probability"))[1])
        return t.drop(*[c for c in t.columns if c not in before and c != out])


def fit_model(name: str, train: DataFrame, feats: Sequence[str], cfg: TrainConfig, label: str = "label", key: str = "url") -> FittedModel:
    """Fit one candidate (train must carry ``weight`` from L4; ``key`` orders
    the folds of the kernel model's sigmoid)."""
    n = train.count()
    if name == "extra_trees":
        prep = Pipeline(stages=_prep_stages(feats, cfg)).fit(train)
        rows = cut_lineage(prep.transform(train).select(vector_to_array("features").alias("x"), F.col(label).alias("label")))
        return FittedModel(name, prep, trees=ET.fit(rows, len(feats), n_trees=cfg.n_extra_trees, max_depth=cfg.max_depth, seed=SEED))
    if name == "random_forest":
        clf = RandomForestClassifier(
            numTrees=cfg.n_random_forest, featureSubsetStrategy="sqrt", minInstancesPerNode=2, maxDepth=cfg.max_depth,
            weightCol="weight", labelCol=label, seed=SEED,
        )
        stages = _tree_stages(train, n, feats, cfg, clf)
    elif name == "gradient_boosting":
        clf = GBTClassifier(maxIter=cfg.gbt_iter, stepSize=0.1, maxDepth=3, labelCol=label, seed=SEED)
        stages = _tree_stages(train, n, feats, cfg, clf)
    elif name == "logistic_regression":
        clf = LogisticRegression(
            maxIter=cfg.lr_max_iter, regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False,
            weightCol="weight", labelCol=label,
        )
        stages = _prep_stages(feats, cfg, n) + [clf]
    elif name == "svc_rbf":
        prep = Pipeline(stages=_prep_stages(feats, cfg, n)).fit(train)
        scaled = prep.transform(train)
        gamma = scale_gamma(scaled, len(feats))
        z = cut_lineage(DS.stratified_folds(rff_transform(scaled, len(feats), cfg.rff_dim, gamma).select(key, label, "weight", "rff"), 3, SEED, key, label))

        def svc_of(rows):
            reg = 1.0 / (cfg.svc_c * max(n, 1))
            return LinearSVC(featuresCol="rff", labelCol=label, weightCol="weight", regParam=reg, maxIter=cfg.svc_max_iter).fit(rows)

        held = [svc_of(z.where(F.col("fold") != f)).transform(z.where(F.col("fold") == f)) for f in range(3)]
        margins = [h.select(label, _margin().alias("margin")) for h in held]
        sigmoid = fit_sigmoid(margins[0].unionAll(margins[1]).unionAll(margins[2]), "margin", label)
        return FittedModel(name, prep, {"prep": prep, "svc": svc_of(z), "n_features": len(feats), "dim": cfg.rff_dim, "gamma": gamma, "sigmoid": sigmoid})
    else:
        raise ValueError(name)
    return FittedModel(name, Pipeline(stages=stages).fit(train))


def with_weights(df: DataFrame, label: str = "label") -> DataFrame:
    return EV.balanced_weights(df, label)


def _metrics(scored: DataFrame, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    s = scored.withColumn("prediction_label", (F.col("p") >= 0.5).cast("int")).withColumn("scam_probability", F.col("p"))
    return EV.holdout_metrics(s, label, "prediction_label", "scam_probability", by)


def _side_by_side(spark: SparkSession, jobs: Sequence[Callable], parallelism: int) -> list:
    """Results of ``jobs``, up to ``parallelism`` at a time: a fit is a chain of
    short Spark jobs, which leaves most executors idle on its own.  Each job
    keeps the caller's local properties; the first failure is raised."""
    with ThreadPoolExecutor(max(1, min(parallelism, len(jobs) or 1))) as pool:
        return list(pool.map(lambda job: job(), [inheritable_thread_target(spark)(j) for j in jobs]))


def out_of_fold(train: DataFrame, feats: Sequence[str], cfg: TrainConfig, k: int = 5, label: str = "label", key: str = "url", path: str | None = None) -> DataFrame:
    """A written table (model, fold, key, label, p) of each candidate's
    probability for every row by the model of the other folds.  ``path``: a new
    folder all executors share (default: one in the checkpoint folder, left to
    the caller).  A part is written once its model is fitted, so later steps
    never fit or score again."""
    path = path or f"{ensure_checkpoint_dir(train.sparkSession)}/out-of-fold-{uuid.uuid4().hex}"
    folded = cut_lineage(DS.stratified_folds(train, k, SEED, key, label))

    def part(name: str, f: int):
        def run():
            tr = with_weights(folded.where(F.col("fold") != f), label).drop("fold")
            scored = fit_model(name, tr, feats, cfg, label, key).score(folded.where(F.col("fold") == f))
            scored.select(key, F.col(label).cast("int").alias(label), "p").write.mode("overwrite").parquet(f"{path}/model={name}/fold={f}")

        return run

    _side_by_side(train.sparkSession, [part(name, f) for name in cfg.models for f in range(k)], cfg.parallelism)
    return train.sparkSession.read.schema(f"`{key}` {train.schema[key].dataType.simpleString()}, `{label}` int, p double, model string, fold int").parquet(path)


def cross_validate(train: DataFrame, feats: Sequence[str], cfg: TrainConfig, k: int = 5, label: str = "label", key: str = "url", path: str | None = None) -> tuple[DataFrame, list[dict]]:
    """K stratified folds x candidates; per-fold metrics of the
    :func:`out_of_fold` table and the leaderboard (mean and population sd, ranked
    by F1 then AUC)."""
    oof = out_of_fold(train, feats, cfg, k, label, key, path)
    # One pass over the table; models x folds rows come back.
    rows = [r.asDict() for r in _metrics(oof, label, ("model", "fold")).orderBy("model", "fold").collect()]
    spark = train.sparkSession
    per_fold = spark.createDataFrame(rows, "model string, fold int, accuracy double, precision double, recall double, f1 double, roc_auc double")
    aggs = []
    for mname in ("accuracy", "precision", "recall", "f1", "roc_auc"):
        aggs += [F.avg(mname).alias(f"{mname}_mean"), F.stddev_pop(mname).alias(f"{mname}_std")]
    board = per_fold.groupBy("model").agg(*aggs).orderBy(F.desc("f1_mean"), F.desc("roc_auc_mean"))
    return board, rows


@dataclass
class CalibratedEnsemble:
    """K (base, isotonic) pairs; probability = mean of calibrated values."""

    members: list[tuple[FittedModel, object]]
    features: list[str]

    def transform(self, df: DataFrame, out: str = "scam_probability") -> DataFrame:
        """Members applied one after another on the same rows (map-only, no
        join), then averaged."""
        res = df
        names = []
        for i, (m, iso) in enumerate(self.members):
            res = m.score(res, out="iso_in")
            res = iso.transform(res).withColumnRenamed("prediction", f"_c{i}").drop("iso_in")
            names.append(f"_c{i}")
        avg = sum((F.col(c) for c in names[1:]), F.col(names[0])) / len(names)
        return res.withColumn(out, avg).drop(*names)


def isotonic_map(held: DataFrame, in_col: str = "iso_in", label: str = "label"):
    """Isotonic map of a score onto the label's mean.  Equal scores are
    pooled first, so that the fit sees one weighted row per distinct score."""
    pooled = held.groupBy(in_col).agg(F.avg(label).alias(label), F.count(F.lit(1)).cast("double").alias("weight"))
    return IsotonicRegression(featuresCol=in_col, labelCol=label, weightCol="weight", predictionCol="prediction", isotonic=True).fit(pooled)


def calibrate_isotonic(train: DataFrame, feats: Sequence[str], name: str, cfg: TrainConfig, k: int = 3, label: str = "label", key: str = "url") -> CalibratedEnsemble:
    folded = cut_lineage(DS.stratified_folds(train, k, SEED + 1, key, label))

    def member(f: int):
        def run():
            m = fit_model(name, with_weights(folded.where(F.col("fold") != f), label).drop("fold"), feats, cfg, label, key)
            return m, isotonic_map(m.score(folded.where(F.col("fold") == f), out="iso_in"), "iso_in", label)

        return run

    members = _side_by_side(train.sparkSession, [member(f) for f in range(k)], cfg.parallelism)
    return CalibratedEnsemble(members, list(feats))


def feature_importance(ens: CalibratedEnsemble, top: int = 20) -> list[tuple[str, float]]:
    """Mean importance over the calibrated fold models (trees:
    ``featureImportances``; linear: |coefficient|), largest first."""
    acc = np.zeros(len(ens.features))
    for m, _ in ens.members:
        last = m.pipeline.stages[-1] if m.rff is None else None
        if m.trees is not None:
            acc += m.trees.importances(len(ens.features))
        elif last is not None and hasattr(last, "featureImportances"):
            acc += last.featureImportances.toArray()
        elif last is not None and hasattr(last, "coefficients"):
            acc += np.abs(last.coefficients.toArray())
    acc /= max(len(ens.members), 1)
    order = sorted(range(len(acc)), key=lambda i: (-acc[i], ens.features[i]))
    return [(ens.features[i], float(acc[i])) for i in order[:top]]


def display_name(model: str) -> str:
    """``extra_trees`` -> ``Extra Trees``."""
    return " ".join(w.capitalize() for w in model.split("_"))
