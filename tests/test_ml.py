import numpy as np
from pyspark.sql import functions as F

from riskscope.operators import ml as ML
from riskscope.plans import catalog as CAT

from conftest import SF_ORACLE

SMALL = ML.TrainConfig(n_extra_trees=10, n_random_forest=10, gbt_iter=5, max_depth=5, lr_max_iter=50, rff_dim=16,
                       svc_max_iter=10, models=("random_forest", "logistic_regression"))


def test_calibrated_model_learns(spark):
    train, test, feats = CAT._train_test(spark, SF_ORACLE)
    ens = ML.calibrate_isotonic(train, feats, "random_forest", SMALL)
    scored = ens.transform(test)
    probs = [r["scam_probability"] for r in scored.select("scam_probability").collect()]
    assert probs and all(0.0 <= p <= 1.0 for p in probs)
    m = ML._metrics(scored.withColumn("p", F.col("scam_probability"))).first()
    assert m["roc_auc"] > 0.6
    for _, iso in ens.members:
        pred = list(iso.predictions)
        assert pred == sorted(pred)


def test_cross_validation_board(spark):
    train, _, feats = CAT._train_test(spark, SF_ORACLE)
    board, rows = ML.cross_validate(train, feats, SMALL, k=3)
    b = board.collect()
    assert len(rows) == 6 and {r["model"] for r in b} == {"random_forest", "logistic_regression"}
    assert b[0]["f1_mean"] >= b[-1]["f1_mean"]
    assert ML.display_name("extra_trees") == "Extra Trees"


def test_standardized_rows_are_prepared_once(spark):
    from riskscope.plans.catalog import QUERIES

    out = QUERIES["standardized_features"](spark, "/root/testdata/sf0.001")
    assert not out.inputFiles() and out.count() > 0  # read from what was written, not prepared again


def test_every_training_row_is_fitted_on(spark, tmpdir_path):
    n = 26_000  # 80 % of them are more than 20,000
    ids = spark.range(n).select(F.col("id").alias("doc_id"))
    label = (F.col("doc_id") % 2).cast("int")
    ids.select("doc_id", F.concat(F.lit("word "), "doc_id").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(9).cast("long").alias("n_chars")).write.parquet(f"{tmpdir_path}/documents.parquet")
    ids.select("doc_id", label.alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{tmpdir_path}/labels.parquet")
    train, test, _ = CAT._train_test(spark, tmpdir_path)
    assert (train.count(), test.count()) == (20_800, 5_200)
    assert train.select("url").unionAll(test.select("url")).distinct().count() == n


def test_cuts_of_trees_come_from_all_rows(spark):
    rows = spark.range(40_000).select(
        (F.col("id") % 40_000 < 2).cast("double").alias("rare"), (F.col("id") % 7).cast("double").alias("few"), (F.pow("id", F.lit(2)) - 5e8).alias("many"),
        F.lit(3.0).alias("one"), F.when(F.col("id") < 0, 1.0).alias("none"), (F.col("id") < 2).cast("int").alias("label"), F.col("id").cast("string").alias("url"),
    )
    rare, few, many, one, none = ML.tree_cuts(rows, ["rare", "few", "many", "one", "none"], 32, 0.001)
    assert (rare, few, one, none) == ([0.5], [0.5, 1.5, 2.5, 3.5, 4.5, 5.5], [], [])
    x = np.arange(40_000.0) ** 2 - 5e8
    ranks = np.searchsorted(x, many) / len(x)
    assert len(many) == 31 and np.abs(ranks - np.arange(1, 32) / 32).max() < 0.002
    # Two rows of 40,000 hold the label; a sample of 10,000 has mostly neither.
    feats = ["rare", "few", "many"]
    m = ML.fit_model("gradient_boosting", ML.with_weights(rows), ["rare", "few", "one"], ML.TrainConfig(gbt_iter=1))
    assert m.pipeline.stages[-1].featureImportances.toArray().tolist() == [1.0, 0.0, 0.0]
    p = m.score(rows).groupBy("label").agg(F.min("p").alias("lo"), F.max("p").alias("hi")).orderBy("label").collect()
    assert p[0]["hi"] < p[1]["lo"]
    forest = ML.fit_model("random_forest", ML.with_weights(rows), feats, ML.TrainConfig(n_random_forest=3, max_depth=3))
    assert forest.pipeline.stages[-1].getMaxBins() ** 2 >= 40_000
    assert set(forest.score(rows.limit(50)).columns) == {*rows.columns, "p"}
