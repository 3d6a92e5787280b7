"""The checked URL columns vary, so that a wrong rule shows."""

from pyspark.sql import functions as F

from riskscope.operators import dataset as DS
from riskscope.operators import evaluate as EV
from riskscope.operators import scoring as SC
from riskscope.operators.url_features import URL_FEATURES
from riskscope.plans.catalog import QUERIES

from conftest import SF_ORACLE


def test_no_probe_column_is_constant(spark):
    df = QUERIES["url_features_probes"](spark, SF_ORACLE)
    r = df.agg(*[F.count_distinct(c).alias(c) for c in URL_FEATURES]).first().asDict()
    assert [c for c, n in r.items() if n < 2] == []


def test_probability_is_not_rounded(spark):
    df = spark.createDataFrame([(0.499951,), (0.69996,)], "scam_probability double")
    got = [(r.scam_probability, r.prediction, r.confidence) for r in SC.score_batch(df, valid_col=None).collect()]
    assert got == [(0.499951, "LEGIT", 0.5), (0.69996, "SCAM", 0.7)]


def test_histogram_keeps_empty_bins(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("b", 0.95), ("b", None)], "expected_name string, confidence double")
    got = {(r.expected_name, r.bin): r.n for r in EV.confidence_histogram(df).collect()}
    assert len(got) == 20 and {k: n for k, n in got.items() if n} == {("a", 0): 1, ("a", 9): 1, ("b", 9): 1}


def test_rank_below_moves_only_the_winners(spark):
    df = spark.range(5000).select("id", DS.md5_order(7, F.col("id")).alias("h"))
    got = sorted(r.id for r in DS.exact_rank(df, "h", out="r", below=40).collect())
    want = sorted(r.id for r in df.orderBy("h").limit(40).collect())
    assert got == want
