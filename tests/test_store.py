"""Versioned store and the stream that writes to it."""

import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from riskscope.operators import store as ST
from riskscope.streaming import jobs


@pytest.fixture()
def store(spark):
    name = f"sites_{uuid.uuid4().hex[:8]}"
    yield name
    spark.sql(f"DROP VIEW IF EXISTS {name}")
    for v in ST.versions(spark, name):
        spark.sql(f"DROP TABLE IF EXISTS {v}")


def rows(spark, *r):
    return spark.createDataFrame(list(r), "url string, title string, label int")


def content(spark, store):
    return {r.url: (r.title, r.label) for r in spark.table(store).collect()}


def test_merge_writes_versions_and_keeps_two(spark, store):
    ST.merge_into(rows(spark, ("a", "A", 1), ("b", "B", None), ("b", "B0", None), (None, "x", 0)), store, buckets=4)
    assert content(spark, store) == {"a": ("A", 1), "b": ("B", None)}
    ST.merge_into(rows(spark, ("b", "B2", 0), ("c", "C", 1), ("a", "A2", None)), store, buckets=4)
    assert content(spark, store) == {"a": ("A2", 1), "b": ("B2", 0), "c": ("C", 1)}
    ST.merge_into(rows(spark, ("c", "C2", 1)), store, mode="ignore", buckets=4)
    assert content(spark, store)["c"] == ("C", 1) and len(ST.versions(spark, store)) == 2


def test_a_failed_job_leaves_the_version_before_it(spark, store):
    ST.merge_into(rows(spark, ("a", "A", 1)), store, buckets=4)
    broken = rows(spark, ("b", "B", 1)).withColumn("title", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        ST.publish(broken, store, buckets=4)
    assert content(spark, store) == {"a": ("A", 1)}
    ST.merge_into(rows(spark, ("b", "B", 1)), store, buckets=4)
    assert content(spark, store) == {"a": ("A", 1), "b": ("B", 1)}


def test_the_stored_side_is_not_shuffled(spark, store):
    ST.merge_into(rows(spark, *[(f"u{i}", "t", 0) for i in range(50)]), store, buckets=8)
    merged = ST.merge_websites(spark.table(store), rows(spark, ("u1", "n", 1)))
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    assert merged.count() == 50


def test_store_names_are_checked(spark):
    with pytest.raises(ValueError):
        ST.properties(spark, "a; DROP TABLE b")


def test_one_per_key_is_the_latest_then_the_smallest(spark):
    df = spark.createDataFrame([("a", "2", "2024-01-02"), ("a", "1", "2024-01-02"), ("a", "0", "2024-01-01"), ("a", "9", None), ("b", "x", None)], "url string, title string, ts string")
    got = ST.one_per_key(df.withColumn("ts", F.col("ts").cast("timestamp")), latest="ts").orderBy("url").collect()
    assert [(r.url, r.title, str(r.ts)[:10]) for r in got] == [("a", "1", "2024-01-02"), ("b", "x", "None")]


def feed(path, name, *urls):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w", encoding="utf-8") as f:
        for i, u in enumerate(urls):
            f.write(json.dumps({"url": u, "ts": f"2024-01-01T00:00:{i:02d}"}) + "\n")


def test_stream_into_the_store_through_a_failure(spark, store, tmpdir_path, monkeypatch):
    """Three batches; the second is merged but not committed, then the query is restarted."""
    source, checkpoint = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "ck")
    run = lambda: jobs.stream_into_store(spark, source, store, checkpoint, max_files=1, buckets=4, keep=9).awaitTermination(120)
    feed(source, "1.json", "https://a.example/", "https://b.example/", "https://a.example/")
    run()
    assert spark.table(store).count() == 2
    feed(source, "2.json", "https://b.example/", "https://paypal-login.xyz/verify")
    merge = jobs.ST.merge_into

    def killed(*args, **options):
        merge(*args, **options)
        raise RuntimeError("killed after the switch")

    monkeypatch.setattr(jobs.ST, "merge_into", killed)
    with pytest.raises(Exception, match="killed"):
        run()
    monkeypatch.setattr(jobs.ST, "merge_into", merge)
    feed(source, "3.json", "https://c.example/")
    run()
    urls = sorted(r.url for r in spark.table(store).collect())
    assert urls == ["https://a.example/", "https://b.example/", "https://c.example/", "https://paypal-login.xyz/verify"]
    assert len(ST.versions(spark, store)) == 3 and ST.properties(spark, store)["batch.urls"] == "2"
    batch = jobs.score_urls(spark.read.schema(jobs.URL_FEED_SCHEMA).json(source)).select("url", "scam_probability").distinct()
    assert spark.table(store).select("url", "scam_probability").exceptAll(batch).count() == 0


def test_first_seen_under_late_data_and_a_restart(spark, tmpdir_path):
    """A URL counts once while its state lives; a row past the watermark is dropped; the state outlives a restart."""
    source, sink, checkpoint = (os.path.join(tmpdir_path, x) for x in ("in", "out", "ck"))
    os.makedirs(source)

    def batch(n, *events):
        with open(os.path.join(source, f"{n}.json"), "w", encoding="utf-8") as f:
            f.writelines(json.dumps({"url": u, "ts": t}) + "\n" for u, t in events)
        jobs.stream_first_seen(spark, source, sink, checkpoint, watermark="1 hour").awaitTermination(120)

    batch(1, ("https://a.example/", "2024-01-01T10:00:00"), ("https://b.example/", "2024-01-01T10:10:00"))
    batch(2, ("https://a.example", "2024-01-01T10:30:00"), ("https://c.example/", "2024-01-01T12:00:00"))
    batch(3, ("https://late.example/", "2024-01-01T09:00:00"), ("https://c.example/", "2024-01-01T12:20:00"), ("https://d.example/", "2024-01-01T12:30:00"))
    got = sorted(r.url for r in spark.read.parquet(sink).collect())
    assert got == ["https://a.example/", "https://b.example/", "https://c.example/", "https://d.example/"]
