import os

from riskscope.operators import ml as ML
from riskscope.operators import store as ST
from riskscope.plans import build_dataset, collect, train
from riskscope.plans.catalog import reference_rows
from riskscope.sources import fixtures as FX
from riskscope.session import read_table

from conftest import SF_ORACLE

SMALL = ML.TrainConfig(n_extra_trees=8, n_random_forest=8, gbt_iter=4, max_depth=4, lr_max_iter=30, rff_dim=8,
                       svc_max_iter=5, models=("random_forest", "logistic_regression"))


def test_build_train_save_load(spark, tmpdir_path):
    prepared = build_dataset.build_prepared(reference_rows(spark, SF_ORACLE), 200)
    assert len(prepared.columns) == 54 and prepared.count() == 200
    model, report = train.train_and_report(prepared, tmpdir_path, cfg=SMALL)
    assert report["best_model"] in SMALL.models and 0.0 <= report["holdout_metrics"]["roc_auc"] <= 1.0
    assert os.path.isdir(os.path.join(tmpdir_path, "report.json"))
    loaded = train.load_ensemble(spark, os.path.join(tmpdir_path, "model"))
    sample = prepared.limit(20)
    a = {r["url"]: r["scam_probability"] for r in model.transform(sample).collect()}
    b = {r["url"]: r["scam_probability"] for r in loaded.transform(sample).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_collect_and_store(spark):
    pages = read_table(spark, SF_ORACLE, "pages").select("url")
    first = collect.collect(pages, FX.captures(spark, SF_ORACLE), None)
    assert first.count() == pages.count() and len(first.columns) == 46
    urls = FX.url_list(spark, SF_ORACLE).select("url")
    second = collect.collect(urls, FX.captures(spark, SF_ORACLE), first)
    assert second.count() == second.select("url").distinct().count() == urls.distinct().count()


def test_one_row_per_url_is_the_same_in_every_run(spark):
    """Rows of one URL in any order and partitions: the split sees the same row."""
    rows = [(u, float(i % 7), (i * 3) % 2) for i, u in enumerate(["a", "b", "c", "a", "b", "a", None, "d"] * 5)]
    df = spark.createDataFrame(rows, "url string, x double, label int")
    got = [sorted(ST.one_per_key(d).collect()) for d in (df, df.repartition(7), df.orderBy("x", "label").coalesce(1))]
    assert got[0] == got[1] == got[2] and [r["url"] for r in got[0]] == ["a", "b", "c", "d"]
