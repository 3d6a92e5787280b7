"""Mapping of the generic test tables onto the shapes this engine consumes.

Every table here is derived by Spark from the given parquet tables, so its
size grows with them:

* ``captures``  <- pages: one capture per page URL (content type and HTTP
  status derived from ``page_id``), plus one homepage capture per host (the
  longest page of that host served at ``scheme://host/``).
* ``labeled_reference`` <- documents JOIN labels: url
  ``https://{source}.example.com/{doc_id}``, label = toxic or low quality,
  two "files" with overlapping rows (file B re-lists every fourth document,
  with other text blanks) so de-duplication has work to do.
* ``whois_raw`` / ``certs`` <- orders: registration text and certificate
  facts for ``shop{custkey}.{tld}`` domains; several orders per domain give
  several records, some lines left out.
* ``url_history`` <- pages JOIN events on ``page_id = event_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskscope.functions.urls import homepage_url, parse_url_parts
from riskscope.session import read_table

AS_OF = "2026-01-01 00:00:00"
CONTENT_TYPES = (
    "text/html; charset=utf-8", "text/html", "application/xhtml+xml", "", "text/plain",
    "application/pdf", "image/png",
)
WEAK_SCAM_HOSTS = ("cheap-pills", "casino-win", "free-bets")


def captures(spark: SparkSession, sf: str) -> DataFrame:
    pages = read_table(spark, sf, "pages")
    ct = F.element_at(F.array(*[F.lit(c) for c in CONTENT_TYPES]), (F.col("page_id") % len(CONTENT_TYPES) + 1).cast("int"))
    direct = pages.select(
        F.col("url"),
        ((F.col("page_id") % 13) != 0).alias("ok"),
        ct.alias("content_type"),
        F.col("url").alias("final_url"),
        (F.col("page_id") % 3).cast("int").alias("redirect_count"),
        F.col("html"),
    )
    home = (
        pages.select(homepage_url(F.col("url")).alias("url"), "html", "page_id")
        .groupBy("url")
        .agg(F.max_by(F.struct("html", "page_id"), F.struct(F.length("html"), F.col("page_id"))).alias("b"))
        .select(
            "url",
            F.lit(True).alias("ok"),
            F.lit("text/html").alias("content_type"),
            F.col("url").alias("final_url"),
            F.lit(0).alias("redirect_count"),
            F.col("b.html").alias("html"),
        )
    )
    return direct.unionByName(home)


def url_list(spark: SparkSession, sf: str) -> DataFrame:
    """URLs to resolve: every page URL, its ``www``-toggled form for every
    fifth page, a missing path for every seventh, and one URL per labelled
    document on a host without captures (so candidates, misses, homepage
    fallbacks and partial results all occur)."""
    pages = read_table(spark, sf, "pages").select("page_id", "url")
    p = parse_url_parts(F.col("url"))
    toggled = pages.where(F.col("page_id") % 5 == 0).select(
        (F.col("page_id") * 10 + 1).alias("page_id"),
        F.when(p["netloc"].startswith("www."), F.regexp_replace("url", "//www\\.", "//"))
        .otherwise(F.regexp_replace("url", "//", "//www.", ))
        .alias("url"),
    )
    missing = pages.where(F.col("page_id") % 7 == 0).select(
        (F.col("page_id") * 10 + 2).alias("page_id"),
        F.concat(F.col("url"), F.lit("/missing")).alias("url"),
    )
    unknown = read_table(spark, sf, "labels").select(
        (F.col("doc_id") * 10 + 3).alias("page_id"),
        F.concat(F.lit("http://docs.example.net/d/"), F.col("doc_id").cast("string")).alias("url"),
    )
    return pages.unionByName(toggled).unionByName(missing).unionByName(unknown)


def labeled_reference_files(spark: SparkSession, sf: str) -> DataFrame:
    """Rows as read from two reference CSV files: ``url, label (string),
    text_content, source_dataset, line`` (line = position in the file)."""
    docs = read_table(spark, sf, "documents").select("doc_id", "text", "source")
    labels = read_table(spark, sf, "labels")
    j = docs.join(labels, "doc_id")
    url = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/"), F.col("doc_id").cast("string"))
    label = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit("1")).otherwise(F.lit("0"))
    a = j.select(
        url.alias("url"),
        label.alias("label"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.col("text")).alias("text_content"),
        F.lit("ref/a.csv").alias("source_dataset"),
        F.col("doc_id").alias("line"),
    )
    b = j.where(F.col("doc_id") % 4 == 0).select(
        url.alias("url"),
        label.alias("label"),
        F.when(F.col("doc_id") % 3 == 1, F.lit("")).otherwise(F.col("text")).alias("text_content"),
        F.lit("ref/b.csv").alias("source_dataset"),
        F.col("doc_id").alias("line"),
    )
    return a.unionByName(b)


def _domain(orders: DataFrame) -> F.Column:
    tld = F.element_at(F.array(*[F.lit(t) for t in ("com", "net", "org", "xyz", "co.uk")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return F.concat(F.lit("shop"), F.col("o_custkey").cast("string"), F.lit("."), tld)


def whois_raw(spark: SparkSession, sf: str) -> DataFrame:
    """``domain, raw, ord``: registration text in several layouts."""
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    d = F.col("o_orderdate")
    exp = F.add_months(F.to_date(d), 12)
    k = F.col("o_orderkey")
    created = (
        F.when(k % 4 == 0, F.concat(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
        .when(k % 4 == 1, F.date_format(d, "dd-MMM-yyyy"))
        .when(k % 4 == 2, F.concat(F.date_format(d, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")))
        .otherwise(F.date_format(d, "dd.MM.yyyy"))
    )
    lines = F.array(
        F.when(k % 5 != 1, F.concat(F.when(k % 2 == 0, F.lit("Creation Date: ")).otherwise(F.lit("Registered On: ")), created)),
        F.when(k % 5 != 2, F.concat(F.lit("Registry Expiry Date: "), F.date_format(exp, "yyyy-MM-dd"))),
        F.when(k % 5 != 3, F.concat(F.lit("Registrar: R"), F.col("o_custkey").cast("string"))),
        F.when(k % 11 == 0, F.lit("Connecting to whois.example")),
    )
    return o.select(_domain(o).alias("domain"), F.array_join(lines, "\n").alias("raw"), k.alias("ord"))


def certs(spark: SparkSession, sf: str) -> DataFrame:
    """``domain, reachable, verified, not_after`` (one row per domain: the
    first order of that domain)."""
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    k = F.col("o_orderkey")
    rows = o.select(
        _domain(o).alias("domain"),
        k.alias("ord"),
        (k % 3 != 0).alias("reachable"),
        (k % 3 == 1).alias("verified"),
        F.when(k % 7 != 0, F.col("o_orderdate") + F.expr("INTERVAL 400 DAYS")).alias("not_after"),
    )
    return rows.groupBy("domain").agg(F.min_by(F.struct("reachable", "verified", "not_after"), "ord").alias("c")).select(
        "domain", "c.*"
    )


def url_history(spark: SparkSession, sf: str) -> DataFrame:
    """``url, ts``: page URLs with the time of the matching event."""
    pages = read_table(spark, sf, "pages").select("page_id", "url")
    ev = read_table(spark, sf, "events").select(F.col("event_id").alias("page_id"), "ts")
    return pages.join(ev, "page_id").select("page_id", "url", "ts")


def weak_labels(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Expected label from a host block list (1 = scam)."""
    host = parse_url_parts(F.col(url_col))["hostname"]
    hit = F.lit(False)
    for h in WEAK_SCAM_HOSTS:
        hit = hit | host.contains(h)
    return df.withColumn("expected_label", hit.cast("int"))
