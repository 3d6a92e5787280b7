"""The ``websites`` table (T1): existence checks, upsert and feature updates
(J3-J5), export (F2, F4).

The table is keyed by ``url``.  A merge is a full outer join of the stored
table with the incoming batch followed by per-column choices.  A store is a
view over the latest of its versions, tables of Parquet bucketed by ``url``: the
stored side of the join is read bucket by bucket and never shuffled (with at
least as many buckets as shuffle partitions), only the incoming batch is.  A
merge writes a table of a new name and replaces the view last, so a failed job
leaves the version before it readable, and readers see whole versions.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskscope.operators.content import CONTENT_FEATURES
from riskscope.operators.url_features import URL_FEATURES

SCRAPE_COLUMNS = ("title", "meta_description", "text_content", "final_url", "status", "error_message", "redirect_count", "scraped_at")
DOMAIN_COLUMNS = ("domain_age_days", "domain_expiry_days", "registrar", "has_ssl", "ssl_valid", "ssl_days_remaining", "is_new_domain", "short_expiry_domain")
# The 19 URL features the original table stores, in its column order.
STORED_URL_FEATURES = URL_FEATURES[:19]
WEBSITE_COLUMNS = (
    "url", "final_url", "title", "meta_description", "text_content", "status", "error_message", "redirect_count",
    "label", *STORED_URL_FEATURES, *DOMAIN_COLUMNS, *CONTENT_FEATURES, "scraped_at",
)
TEXT_COLUMNS = ("title", "meta_description", "text_content", "registrar", "error_message")


def empty_to_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Blank strings are stored as NULL (trimmed first)."""
    return df.withColumns(
        {c: F.when(F.trim(F.col(c).cast("string")) == "", None).otherwise(F.trim(F.col(c).cast("string"))) for c in cols if c in df.columns}
    )


def not_seen(urls: DataFrame, websites: DataFrame, url_col: str = "url", force: bool = False) -> DataFrame:
    """URLs not stored yet (``left_anti``); with ``force`` every URL."""
    if force:
        return urls
    return urls.join(websites.select(F.col("url").alias(url_col)), url_col, "left_anti")


def merge_websites(stored: DataFrame, incoming: DataFrame, mode: str = "merge", key: str = "url") -> DataFrame:
    """J4 + J5.

    ``mode='merge'``: a matched URL takes every incoming column (scrape
    fields and features); the label is updated only when the incoming one is
    not NULL.  ``mode='ignore'``: an insert that finds the URL keeps the
    stored scrape fields (insert-ignore) while features and label are
    updated.  Unmatched incoming rows are inserted; unmatched stored rows
    stay.  Columns absent from ``incoming`` keep their stored values."""
    if mode not in ("merge", "ignore"):
        raise ValueError("mode must be 'merge' or 'ignore'")
    cols = [c for c in stored.columns if c != key]
    inc_cols = set(incoming.columns)
    s = stored.select(key, F.lit(True).alias("_s"), *[F.col(c).alias(f"s_{c}") for c in cols])
    i = incoming.select(key, F.lit(True).alias("_i"), *[F.col(c).alias(f"i_{c}") for c in cols if c in inc_cols])
    j = s.join(i, key, "full")
    out = []
    for c in cols:
        sv, iv = F.col(f"s_{c}"), (F.col(f"i_{c}") if c in inc_cols else None)
        if iv is None:
            v = sv
        elif c == "label":
            v = F.coalesce(iv, sv)
        elif mode == "ignore" and c in SCRAPE_COLUMNS:
            v = F.when(F.col("_s").isNotNull(), sv).otherwise(iv)
        else:
            v = F.when(F.col("_i").isNotNull(), iv).otherwise(sv)
        out.append(v.alias(c))
    return j.select(key, *out)


def one_per_key(rows: DataFrame, key: str = "url", latest: str | None = None) -> DataFrame:
    """A row per key, the same in every run: the latest by column ``latest``
    (nulls last), among these the smallest by all other columns.  Rows without
    a key are left out.  Minima combine before the shuffle."""
    order = [c for c in rows.columns if c not in (key, latest)]
    rank = [(-F.unix_micros(F.col(latest).cast("timestamp"))).alias("_late")] if latest else []
    late = [F.col(latest).isNull().alias("_none"), *rank] if latest else []
    pick = F.min(F.struct(*late, *order, *([latest] if latest else []))).alias("_r")
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(pick).select(*[key if c == key else F.col("_r")[c].alias(c) for c in rows.columns])


def _name(store: str) -> str:
    if not re.fullmatch(r"\w+(\.\w+)?", store):
        raise ValueError(f"not a table name: {store!r}")
    return store


def versions(spark: SparkSession, store: str) -> list[str]:
    """Names of a store's version tables, oldest first."""
    *space, table = _name(store).split(".")
    known = spark.catalog.listTables(space[0] if space else None)
    found = [t.name for t in known if re.fullmatch(rf"{table.lower()}__v\d{{9}}_[0-9a-f]{{8}}", t.name.lower())]
    return [".".join([*space, t]) for t in sorted(found)]


def properties(spark: SparkSession, store: str) -> dict[str, str]:
    """What :func:`publish` noted with the current version."""
    if not spark.catalog.tableExists(_name(store)):
        return {}
    return json.loads(spark.catalog.getTable(store).description or "{}")


def publish(rows: DataFrame, store: str, *, key: str = "url", buckets: int = 64, keep: int = 2, notes: dict[str, str] | None = None) -> str:
    """Write ``rows`` as a new version and point the store to it; ``notes`` are
    set in the same step.  The ``keep`` latest versions stay."""
    spark = rows.sparkSession
    old = versions(spark, store)
    number = 1 + (int(re.search(r"__v(\d{9})_", old[-1])[1]) if old else 0)
    version = f"{store}__v{number:09d}_{uuid.uuid4().hex[:8]}"
    rows.write.mode("errorifexists").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(version)
    noted = json.dumps(properties(spark, store) | (notes or {}) | {"version": version}).replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE OR REPLACE VIEW {store} COMMENT '{noted}' AS SELECT * FROM {version}")
    for name in [*old, version][:-keep]:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return version


def merge_into(incoming: DataFrame, store: str, mode: str = "merge", key: str = "url", latest: str | None = None, **options) -> str:
    """Merge a batch into a store (J4, J5), or begin the store with it;
    repeated keys of the batch count once (:func:`one_per_key`)."""
    spark, incoming = incoming.sparkSession, one_per_key(incoming, key, latest)
    if spark.catalog.tableExists(_name(store)):
        incoming = merge_websites(spark.table(store), incoming, mode, key)
    return publish(incoming, store, key=key, **options)


def export_dataset(websites: DataFrame, labeled_only: bool = True, drop_text: bool = False) -> DataFrame:
    """F2 + F4: export rows (only labelled ones by default), optionally
    without the text-heavy columns."""
    out = websites.where(F.col("label").isNotNull()) if labeled_only else websites
    if drop_text:
        out = out.drop(*[c for c in TEXT_COLUMNS if c in out.columns])
    return out
