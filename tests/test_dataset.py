from pyspark.sql import Window
from pyspark.sql import functions as F

from riskscope.operators import dataset as DS
from riskscope.plans.catalog import QUERIES, deduped_reference

from conftest import SF_ORACLE


def test_exact_rank_equals_window_rank(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.md5(F.col("id").cast("string")).alias("h"))
    r = DS.exact_rank(df, "h", ["g"], out="r")
    w = df.withColumn("w", F.row_number().over(Window.partitionBy("g").orderBy("h")) - 1)
    bad = r.join(w, ["g", "h"]).where(F.col("r") != F.col("w")).count()
    assert bad == 0 and r.count() == 5000


def test_dedupe_is_idempotent(spark):
    d = deduped_reference(spark, SF_ORACLE)
    again = DS.dedupe_reference(d)
    assert d.count() == again.count() == d.select("url").distinct().count()
    assert d.exceptAll(again.select(*d.columns)).count() == 0


def test_split_disjoint_and_proportional(spark):
    d = deduped_reference(spark, SF_ORACLE)
    s = DS.stratified_split(d, 0.2, 42)
    assert s.count() == d.count()
    per = {(r["label"], r["is_test"]): r["count"] for r in s.groupBy("label", "is_test").count().collect()}
    for lab in (0, 1):
        n = per.get((lab, True), 0) + per.get((lab, False), 0)
        assert per.get((lab, True), 0) == round(n * 0.2)


def test_folds_balanced(spark):
    f = DS.stratified_folds(deduped_reference(spark, SF_ORACLE), 5, 42)
    by_label = {}
    for r in f.groupBy("label", "fold").count().collect():
        by_label.setdefault(r["label"], []).append(r["count"])
    for counts in by_label.values():
        assert len(counts) == 5 and max(counts) - min(counts) <= 1


def test_balanced_sample_sizes(spark):
    s = QUERIES["balanced_sample"](spark, SF_ORACLE)
    per = {r["label"]: r["count"] for r in s.groupBy("label").count().collect()}
    assert per == {0: 125, 1: 125}
    # label 1 has too few rows with text: all of them are used, rest drawn
    assert s.where("label = 1 AND has_reference_text").count() == s.where("label = 1 AND draw = 0 AND has_reference_text").count()


def test_balanced_sample_empty_label_raises(spark):
    d = deduped_reference(spark, SF_ORACLE).where("label = 0")
    try:
        DS.balanced_sample(d, 10, 1)
    except ValueError as e:
        assert "label 1" in str(e)
    else:
        raise AssertionError("expected ValueError")
