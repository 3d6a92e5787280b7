"""Lifecycle C: collect and store.  New URLs (J3) are resolved against the
capture table (H10/H11), featurised (U26, C9, optional D*), merged into the
``websites`` table (J4 + J5) and exported (F2/F4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskscope.functions.urls import normalize_url
from riskscope.operators import content as C
from riskscope.operators import domains as DM
from riskscope.operators import pages as P
from riskscope.operators import store as ST
from riskscope.operators import url_features as UF


def collect(
    urls: DataFrame,
    captures: DataFrame,
    websites: DataFrame | None,
    *,
    labels: DataFrame | None = None,
    domain_table: DataFrame | None = None,
    force: bool = False,
    mode: str = "merge",
    scraped_at: str = "1970-01-01 00:00:00",
) -> DataFrame:
    """Return the new ``websites`` table version (url-keyed), for
    ``store.publish``.  URLs are normalised and made unique first, by the same
    choice in every run."""
    urls = ST.one_per_key(urls.withColumn("url", normalize_url(F.col("url"))).where("url <> ''"))
    todo = urls if websites is None else ST.not_seen(urls, websites, force=force)
    res = P.resolve_captures(todo, captures)
    res = res.withColumn("_furl", F.when(F.col("final_url") != "", F.col("final_url")).otherwise(F.col("url")))
    f = UF.with_url_features(res, "_furl")
    f = C.with_content_features(f, "title", "text", None, has_flags=False)
    if domain_table is not None:
        f = DM.with_domain_features(f, domain_table, "_furl")
    else:
        f = f.withColumns(DM.empty_domain_defaults())
    if labels is not None:
        f = f.join(labels.select("url", F.col("label").cast("int")), "url", "left")
    else:
        f = f.withColumn("label", F.lit(None).cast("int"))
    rows = f.select(
        "url", "final_url", "title", "meta_description", F.col("text").alias("text_content"), "status",
        F.col("error").alias("error_message"), "redirect_count", "label", *ST.STORED_URL_FEATURES,
        *ST.DOMAIN_COLUMNS, *C.CONTENT_FEATURES, F.to_timestamp(F.lit(scraped_at)).alias("scraped_at"),
    )
    rows = ST.empty_to_null(rows, ("title", "meta_description", "text_content", "final_url", "status", "error_message"))
    if websites is None:
        return rows
    return ST.merge_websites(websites, rows, mode)
