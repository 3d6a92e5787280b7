"""Lifecycle B, first half: reference rows -> validated, de-duplicated,
balanced sample -> 54-column prepared table (8 meta + 28 URL + 9 domain +
9 content), optionally enriched with domain features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskscope.operators import content as C
from riskscope.operators import dataset as DS
from riskscope.operators import domains as DM
from riskscope.operators import url_features as UF


def build_prepared(
    reference_rows: DataFrame,
    rows: int,
    *,
    seed: int = 42,
    prefer_text: bool = True,
    domain_table: DataFrame | None = None,
) -> DataFrame:
    """``reference_rows``: url, label (any type), text_content, source_dataset,
    line (e.g. from :func:`riskscope.sources.io.read_reference_csvs`)."""
    valid = DS.valid_labeled_rows(reference_rows)
    sample = DS.balanced_sample(DS.dedupe_reference(valid), rows, seed, prefer_text)
    feats = C.with_content_features(UF.with_url_features(sample, "url"), F.lit(""), "text_content", F.lit(""))
    if domain_table is None:
        feats = feats.withColumns(DM.empty_domain_defaults())
    else:
        feats = DM.with_domain_features(feats, domain_table, "url")
    meta = [
        F.col("url"), F.col("url").alias("final_url"), F.col("label"), F.col("source_dataset"),
        F.col("has_reference_text").cast("int").alias("has_reference_text"),
        F.lit("not_scraped").alias("scrape_status"), F.lit("").alias("scrape_error"), F.lit(0).alias("redirect_count"),
    ]
    return feats.select(*meta, *UF.URL_FEATURES, *DM.DOMAIN_FEATURES, *C.CONTENT_FEATURES)


def write_prepared(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
