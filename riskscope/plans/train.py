"""Lifecycle B, second half: cleaned dataset -> split -> cross-validation
-> best model -> isotonic calibration -> holdout metrics -> saved models and
a JSON training report (L1-L7, A5, S6)."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVCModel
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskscope.operators import dataset as DS
from riskscope.operators import evaluate as EV
from riskscope.operators import extratrees as ET
from riskscope.operators import ml as ML
from riskscope.operators import scoring as SC
from riskscope.operators import store as ST
from riskscope.session import cut_lineage
from riskscope.sources.io import write_report_json


def train_and_report(
    prepared: DataFrame,
    out_dir: str | None = None,
    *,
    cfg: ML.TrainConfig | None = None,
    test_size: float = 0.2,
    calibrate: bool = True,
    key: str = "url",
) -> tuple[ML.CalibratedEnsemble | ML.FittedModel, dict]:
    """Train on a prepared table (54 columns or any superset with ``label``).
    Returns the final model and the report; with ``out_dir`` the models and
    ``report.json`` are written there (a shared location on a cluster)."""
    cfg = cfg or ML.TrainConfig()
    prepared = ST.one_per_key(prepared, key)  # the same rows in every run
    clean, feats = EV.select_numeric_features(prepared)
    keyed = prepared.select(key, *[F.col(c).cast("string").try_cast("double").alias(c) for c in feats], F.col("label").cast("int"))
    split = cut_lineage(DS.stratified_split(keyed, test_size, ML.SEED, key))
    train = split.where(~F.col("is_test")).drop("is_test")
    test = split.where("is_test").drop("is_test")
    board, _ = ML.cross_validate(train, feats, cfg, key=key)
    cv_rows = [r.asDict() for r in board.collect()]
    best = cv_rows[0]["model"]
    if calibrate:
        model = ML.calibrate_isotonic(train, feats, best, cfg, key=key)
        scored = model.transform(test)
    else:
        model = ML.fit_model(best, ML.with_weights(train), feats, cfg)
        scored = model.score(test, out="scam_probability")
    metrics = EV.holdout_metrics(SC.score_batch(scored, valid_col=None), "label", "prediction_label", "scam_probability").first().asDict()
    report = {
        "rows": clean.count(),
        "features": list(feats),
        "best_model": best,
        "calibrated": bool(calibrate),
        "cv_results": cv_rows,
        "holdout_metrics": metrics,
    }
    if out_dir:
        spark = prepared.sparkSession
        if calibrate:
            save_ensemble(model, f"{out_dir}/model")
        write_report_json(spark, report, f"{out_dir}/report.json")
    return model, report


def save_ensemble(ens: ML.CalibratedEnsemble, path: str) -> None:
    """Persist every (base, isotonic) member with MLlib writers plus a small
    metadata document."""
    spark = SparkSession.getActiveSession()
    meta = {"features": ens.features, "members": []}
    for i, (m, iso) in enumerate(ens.members):
        base = f"{path}/member{i}"
        entry = {"name": m.name, "rff": None, "tree_weights": None}
        if m.rff is None:
            m.pipeline.write().overwrite().save(f"{base}/pipeline")
        else:
            m.rff["prep"].write().overwrite().save(f"{base}/pipeline")
            m.rff["svc"].write().overwrite().save(f"{base}/svc")
            entry["rff"] = {k: m.rff[k] for k in ("n_features", "dim", "gamma", "sigmoid")}
        if m.trees is not None:
            m.trees.table(spark).write.mode("overwrite").parquet(f"{base}/trees")
            entry["tree_weights"] = m.trees.weights
        iso.write().overwrite().save(f"{base}/isotonic")
        meta["members"].append(entry)
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_ensemble(spark: SparkSession, path: str) -> ML.CalibratedEnsemble:
    meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    members = []
    for i, entry in enumerate(meta["members"]):
        base = f"{path}/member{i}"
        pipe = PipelineModel.load(f"{base}/pipeline")
        rff = None
        if entry["rff"]:
            rff = {**entry["rff"], "prep": pipe, "svc": LinearSVCModel.load(f"{base}/svc")}
        trees = None
        if entry["tree_weights"]:
            trees = ET.ExtraTrees.of_table(spark.read.parquet(f"{base}/trees"), entry["tree_weights"])
        members.append((ML.FittedModel(entry["name"], pipe, rff, trees), IsotonicRegressionModel.load(f"{base}/isotonic")))
    return ML.CalibratedEnsemble(members, meta["features"])
