"""A fitted TF-IDF model applied to other documents."""

import math

from riskscope.operators import content as C


def test_model_weights_unseen_documents(spark, tmpdir_path):
    corpus = spark.createDataFrame([(1, "pay bank now"), (2, "bank bank river"), (3, None), (4, "river")], "id long, text string")
    C.fit_tfidf(corpus, "id", "text", stop_words=("now",)).write.parquet(f"{tmpdir_path}/model")
    model = spark.read.parquet(f"{tmpdir_path}/model")
    idf = {r.term: (r.df, r.idf) for r in model.collect()}
    assert {t: d for t, (d, _) in idf.items()} == {"pay": 1, "bank": 2, "river": 2}
    assert math.isclose(idf["pay"][1], math.log(5 / 2) + 1)
    other = spark.createDataFrame([(9, "Bank, bank! PAY unknown"), (8, "unknown"), (7, None)], "k long, t string")
    for limit in (100_000, 1):  # with every term hot, too
        got = {(r.k, r.term): (r.tf, r.weight) for r in C.transform_tfidf(other, "k", "t", model, hot_key_rows=limit).collect()}
        raw = {"bank": 2 * idf["bank"][1], "pay": idf["pay"][1]}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        assert got == {(9, "bank"): (2, round(raw["bank"] / norm, 6)), (9, "pay"): (1, round(raw["pay"] / norm, 6))}


def test_model_of_an_empty_corpus(spark):
    model = C.fit_tfidf(spark.createDataFrame([], "id long, text string"), "id", "text")
    assert model.count() == 0 and C.transform_tfidf(spark.createDataFrame([(1, "a b")], "id long, text string"), "id", "text", model).count() == 0


def test_top_terms_alike_with_and_without_a_term_broadcast(spark):
    docs = spark.createDataFrame([(1, "pay bank now now"), (2, "bank bank river"), (3, None), (1, "river")], "id long, text string")
    small = C.tfidf_top_terms(docs, "id", "text", top_n=2)
    large = C.tfidf_top_terms(docs, "id", "text", top_n=2, broadcast_terms=0)
    assert sorted(small.collect()) == sorted(large.collect()) and small.count() == 4
    assert "hashpartitioning(term" not in small._jdf.queryExecution().executedPlan().toString()
