"""Structured Streaming jobs (ST1, ST2).

ST1 ``stream_score``: an arriving URL feed (files landing in a folder) is
scored with the same column functions as the batch job: stateless, so every
micro-batch is a projection.

``stream_into_store`` upserts the scored URLs into a versioned store instead,
each micro-batch once, also after a failure.

ST2 ``stream_first_seen``: each URL (by its dedupe key) is processed once
within a watermark bound: ``dropDuplicatesWithinWatermark`` keeps the state
bounded by the watermark; URLs already stored in the ``websites`` table are
removed by a stream-static ``left_anti`` join.

Checkpoints go to the caller's location (a shared folder on a cluster), so a
restarted query resumes exactly where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskscope.functions.urls import dedupe_key, normalize_url
from riskscope.operators import content as C
from riskscope.operators import scoring as S
from riskscope.operators import store as ST
from riskscope.operators import url_features as UF

URL_FEED_SCHEMA = "url string, ts timestamp"


def score_urls(df: DataFrame, url_col: str = "url") -> DataFrame:
    """URL-only scoring (L9): URL features, zero content features, family
    scores, the deterministic stand-in score (or a model), labels, band."""
    f = C.zero_content_features(UF.with_url_features(df, url_col)).withColumn("status", F.lit("url_only"))
    fam = S.mean_family_score(S.family_scores(f))
    scored = S.score_batch(fam)
    return scored.withColumn("risk_label", S.risk_band(F.col("scam_probability"))["label"])


def read_url_stream(spark: SparkSession, source_dir: str, fmt: str = "json", max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(URL_FEED_SCHEMA).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(source_dir)


def stream_score(
    spark: SparkSession,
    source_dir: str,
    sink_dir: str,
    checkpoint_dir: str,
    *,
    fmt: str = "json",
    available_now: bool = True,
) -> StreamingQuery:
    """ST1: score every arriving URL and append the results as Parquet."""
    scored = score_urls(read_url_stream(spark, source_dir, fmt)).select(
        "url", "ts", "prediction", "prediction_label", "confidence", "scam_probability", "risk_label", *UF.URL_FEATURES
    )
    w = scored.writeStream.format("parquet").option("path", sink_dir).option("checkpointLocation", checkpoint_dir).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def store_batch(batch: DataFrame, batch_id: int, store: str, stream: str, **options) -> bool:
    """Merge one micro-batch into a store, once: the version that holds a batch
    notes its number, and a batch up to that number is passed over.  The note
    and the version appear in one step, so a batch repeated after a failure is
    either merged whole or already there."""
    done = ST.properties(batch.sparkSession, store).get(f"batch.{stream}")
    if done is not None and batch_id <= int(done):
        return False
    ST.merge_into(batch, store, notes={f"batch.{stream}": str(batch_id)}, **options)
    return True


def stream_into_store(
    spark: SparkSession, source_dir: str, store: str, checkpoint_dir: str, *, stream: str = "urls", fmt: str = "json", max_files: int | None = None, **options
) -> StreamingQuery:
    """ST1 into the store: every arriving URL is scored and upserted by URL,
    the latest arrival of a batch winning.  ``stream`` names this feed among
    those that write to the store."""
    scored = score_urls(read_url_stream(spark, source_dir, fmt, max_files)).select("url", "ts", "prediction", "scam_probability", "risk_label")
    write = scored.writeStream.option("checkpointLocation", checkpoint_dir).trigger(availableNow=True)
    return write.foreachBatch(lambda df, i: store_batch(df, i, store, stream, latest="ts", **options) and None).start()


def first_seen(stream: DataFrame, websites: DataFrame | None, watermark: str = "1 day") -> DataFrame:
    """ST2 as a transformation: normalised URLs, empties dropped, first
    arrival per dedupe key within the watermark, stored URLs removed."""
    s = stream.withColumn("url", normalize_url(F.col("url"))).where(F.col("url") != "")
    s = s.withColumn("dedupe_key", dedupe_key(F.col("url")))
    s = s.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["dedupe_key"])
    if websites is not None:
        s = s.join(websites.select(F.col("url")), "url", "left_anti")
    return s


def stream_first_seen(
    spark: SparkSession,
    source_dir: str,
    sink_dir: str,
    checkpoint_dir: str,
    websites: DataFrame | None = None,
    *,
    watermark: str = "1 day",
    fmt: str = "json",
) -> StreamingQuery:
    """ST2: write each new URL once (append mode, state bounded by the
    watermark)."""
    out = first_seen(read_url_stream(spark, source_dir, fmt), websites, watermark)
    return (
        out.writeStream.format("parquet")
        .option("path", sink_dir)
        .option("checkpointLocation", checkpoint_dir)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
