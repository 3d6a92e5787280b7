"""Public-suffix rule tables of any size."""

import time

import pytest
from pyspark.sql import functions as F

from riskscope.functions import urls as U
from riskscope.operators import suffixes as SX
from riskscope.operators import url_features as UF
from riskscope.sources import io as IO

RULES = [("com", "exact"), ("uk", "exact"), ("co.uk", "exact"), ("ck", "wildcard"), ("www.ck", "exception"), ("a.b.c.kobe.jp", "exact"), ("kobe.jp", "wildcard"), ("city.kobe.jp", "exception"), ("jp", "exact")]
HOSTS = ["", None, "com", "x.com", "a.x.com", "co.uk", "x.co.uk", "ck", "a.ck", "b.a.ck", "www.ck", "x.www.ck", "q.city.kobe.jp", "city.kobe.jp", "z.kobe.jp", "y.z.kobe.jp", "w.a.b.c.kobe.jp", "1.2.3.4", "::1", "nope", "x.nope", "a..com", "x.com."]


@pytest.mark.parametrize("limit", [SX.BROADCAST_BYTES, 0])
def test_rule_table_equals_the_column_expression(spark, limit):
    table = SX.suffix_table(SX.builtin_rules(spark, [(r.upper(), k) for r, k in RULES]))
    df = spark.createDataFrame([(i, h) for i, h in enumerate(HOSTS)] * 3, "i int, host string")
    got = SX.with_lookup_domain(SX.with_registered_domain(df, "host", table, broadcast_bytes=limit), "host", table, broadcast_bytes=limit)
    want = df.withColumns({"registered_domain": U.registered_domain(F.col("host"), RULES), "lookup_domain": U.lookup_domain(F.col("host"), RULES)})
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_an_empty_table_matches_nothing(spark):
    table = SX.suffix_table(SX.builtin_rules(spark).limit(0))
    df = spark.createDataFrame([("a.com",)], "host string")
    assert SX.with_registered_domain(df, "host", table).first().registered_domain == "a.com"


def test_ten_thousand_rules_build_fast_and_without_a_shuffle(spark):
    rules = spark.range(10_000).select(F.concat(F.lit("s"), F.col("id").cast("string"), F.lit(".co.uk")).alias("suffix"), F.lit("exact").alias("kind"))
    table = SX.suffix_table(rules.unionByName(SX.builtin_rules(spark)))
    df = spark.createDataFrame([("http://a.b.s77.co.uk/x",), ("http://a.b.com/",)], "url string")
    UF.with_url_features(df, suffix_rules=table)  # expression trees of the JVM
    t0 = time.perf_counter()
    out = UF.with_url_features(df, suffix_rules=table)
    built = time.perf_counter() - t0
    assert {r.url: r.registered_domain for r in out.collect()} == {"http://a.b.s77.co.uk/x": "b.s77.co.uk", "http://a.b.com/": "b.com"}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert built < 3


def test_rules_of_a_list_file(spark, tmpdir_path):
    path = f"{tmpdir_path}/psl.dat"
    with open(path, "w", encoding="utf-8") as f:
        f.write("// x\n\ncom\n*.ck\n!www.ck\n// ===END ICANN DOMAINS===\nblogspot.com\n")
    icann = {(r.suffix, r.kind) for r in IO.read_suffix_rules(spark, path).collect()}
    assert icann == {("com", "exact"), ("ck", "wildcard"), ("www.ck", "exception")}
    assert ("blogspot.com", "exact") in {(r.suffix, r.kind) for r in IO.read_suffix_rules(spark, path, icann_only=False).collect()}


def test_large_tables_are_dealt_by_rows_and_hot_suffixes_broadcast(spark, monkeypatch):
    monkeypatch.setattr(SX, "TASK_ROWS", 50)
    monkeypatch.setattr(SX, "HOT_ROWS", 100)
    made = spark.range(200).select(F.concat(F.lit("s"), F.col("id").cast("string"), F.lit(".com")).alias("suffix"), F.lit("exact").alias("kind"))
    table = SX.suffix_table(made.unionByName(SX.builtin_rules(spark, [("com", "exact")])))
    df = spark.range(300).select(F.concat(F.lit("x.y.s"), F.col("id").cast("string"), F.lit(".com")).alias("host"))
    out = SX.with_suffix_labels(df, "host", table, broadcast_bytes=0)
    assert sorted(r.suffix_labels for r in out.collect()) == [1] * 100 + [2] * 200
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [suffix" in plan and "LeftAnti" in plan
