"""Page operators over a capture table.

The capture table replaces live crawling: one row per fetched URL with
``url, ok, content_type, final_url, redirect_count, html``.  Extraction is a
projection; the HTML column is dropped right after it, before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskscope import dictionaries as D
from riskscope.functions import html as H
from riskscope.functions.memo import jvm_memo
from riskscope.operators.joins import join_skew_safe
from riskscope.session import cut_lineage
from riskscope.operators.url_features import candidate_urls
from riskscope.functions.urls import canonical_url, homepage_url

PAGE_COLUMNS = ("title", "meta_description", "text", "text_length", "low_content", "link_count")


def extract_pages(
    df: DataFrame,
    html_col: str = "html",
    *,
    min_text_length: int = D.LOW_CONTENT_CHARS,
    keep_html: bool = False,
    flags: bool = True,
) -> DataFrame:
    """H8 (+H9): title, meta description, visible text, text length,
    low-content flag and link count; ``has_form``/``has_iframe`` on the raw
    HTML.  The cleaned HTML is computed once in its own projection."""
    clean, flag_exprs, page_exprs, len_exprs = _page_exprs(html_col, min_text_length)
    staged = df.withColumn("_clean", clean)
    if flags:
        staged = staged.withColumns(flag_exprs)
    out = staged.withColumns(page_exprs).withColumns(len_exprs).drop("_clean")
    if not keep_html:
        out = out.drop(html_col)
    return out


@jvm_memo
def _page_exprs(html_col: str, min_text_length: int):
    raw = F.col(html_col)
    c = F.col("_clean")
    flags = {"has_form": H.has_tag(raw, "form"), "has_iframe": H.has_tag(raw, "iframe")}
    page = {
        "title": H.title(c),
        "meta_description": H.meta_description(c),
        "text": H.visible_text(c),
        "link_count": H.link_count(c),
    }
    lens = {
        "text_length": F.length("text").cast("int"),
        "low_content": (F.length("text") < min_text_length).cast("int"),
    }
    return H.strip_boilerplate(raw), flags, page, lens


def filter_html(captures: DataFrame) -> DataFrame:
    """H1: keep OK captures whose content looks like an HTML page."""
    return captures.filter(F.col("ok") & H.looks_like_html(F.col("content_type"), F.col("html")))


def usable_pages(captures: DataFrame, *, min_text_length: int = D.LOW_CONTENT_CHARS) -> DataFrame:
    """H1 + H8 on captures, one row per capture URL (first by final URL when
    a URL was captured more than once); the HTML is dropped here."""
    pages = extract_pages(filter_html(captures), min_text_length=min_text_length)
    best = F.min_by(
        F.struct(*[c for c in pages.columns if c != "url"]),
        F.struct(F.col("final_url"), F.col("redirect_count"), F.col("text")),
    )
    return pages.groupBy("url").agg(best.alias("_b")).select("url", "_b.*")


def first_capture(keys: DataFrame, key_col: str, pages: DataFrame) -> DataFrame:
    """First usable capture of each distinct key by candidate rank (itself,
    http variant, www toggled), as struct ``_pg`` of ``pages``' columns.  Works
    on distinct keys, so a URL repeated a million times is resolved once; give
    narrow ``pages``, as every hit is shuffled."""
    cands = candidate_urls(keys.select(key_col).where(F.col(key_col).isNotNull()).distinct(), key_col)
    found = pages.select(F.col("url").alias("candidate"), F.struct(*pages.columns).alias("_c"))
    hit = cands.join(found, "candidate", "inner")
    return hit.groupBy(key_col).agg(F.min_by("_c", F.col("rank")).alias("_pg"))


FAILED = "Invalid URL"
PARTIAL = "Scraping blocked, non-HTML content, or request failed"
FALLBACK = "Homepage fallback used"


def resolve_captures(
    urls: DataFrame,
    captures: DataFrame,
    url_col: str = "url",
    *,
    min_text_length: int = D.LOW_CONTENT_CHARS,
    hot_key_rows: int = 100_000,
) -> DataFrame:
    """H10 + H11 over a capture table instead of live fetches.

    Each URL is canonicalised (U1b); no netloc -> ``failed`` / Invalid URL.
    Its first usable capture by candidate rank is taken; without one, the
    homepage (resolved through its own candidates) is tried; a low-content
    page is replaced by its homepage when that has longer text.  No capture
    at all -> ``partial``.  Output: input columns + status, final_url,
    error, redirect_count, title, meta_description, text, text_length,
    low_content, link_count, has_form, has_iframe.

    The decision is made once per distinct URL on the captures' keys and
    lengths alone and written as a narrow table (URL, capture taken, rows).
    The rows then meet it, and the captures' texts, by one join each; that
    table's counts tell both joins' hot keys, which :func:`join_skew_safe`
    broadcasts.  A URL without a capture is joined under a key of its own that
    no capture has, so nothing gathers at a null key."""
    # Extracted captures (HTML already dropped) are read by both candidate
    # joins and by the last one: materialise them once.
    pages = cut_lineage(usable_pages(captures, min_text_length=min_text_length))
    lean = pages.select("url", "final_url", "text_length", "low_content")
    base = urls.withColumn("_nurl", canonical_url(F.col(url_col)))
    keys = base.groupBy("_nurl").agg(F.count(F.lit(1)).alias("_n"))
    pg, hp = F.col("_pg"), F.col("_hp")
    home_of = F.when(pg.isNull(), homepage_url(F.col("_nurl"))).when(
        pg["low_content"] == 1, homepage_url(pg["final_url"])
    )
    own = keys.join(first_capture(keys, "_nurl", lean), "_nurl", "left")
    own = cut_lineage(own.withColumn("_hkey", F.when(F.col("_nurl") != "", home_of)))
    home = first_capture(own, "_hkey", lean).withColumnRenamed("_pg", "_hp")
    origin = F.when(pg.isNull(), F.col("_nurl")).otherwise(pg["final_url"])
    use_home = hp.isNotNull() & (F.col("_hkey") != origin) & (pg.isNull() | (hp["text_length"] > pg["text_length"]))
    none = F.concat(F.lit("\0"), F.col("_nurl"))  # no URL has a zero byte in front
    taken = cut_lineage(
        join_skew_safe(own, home, "_hkey", hot_key_rows=hot_key_rows)
        .withColumn("_fallback", F.coalesce(use_home, F.lit(False)))
        .select("_nurl", "_n", "_fallback", F.coalesce(F.when(F.col("_fallback"), hp["url"]).otherwise(pg["url"]), none).alias("_src"))
    )
    hot = taken.where(F.col("_n") >= hot_key_rows).select("_nurl")
    res = join_skew_safe(base, taken.drop("_n"), "_nurl", "inner", hot_keys=hot)
    hot = taken.groupBy("_src").agg(F.sum("_n").alias("_n")).where(F.col("_n") >= hot_key_rows).select("_src")
    texts = pages.select(F.col("url").alias("_src"), F.struct(*[c for c in pages.columns if c != "url"]).alias("_pg"))
    res = join_skew_safe(res, texts, "_src", hot_keys=hot, nulls=False)
    invalid = F.col("_nurl") == ""
    found = F.col("_pg").isNotNull()
    text_cols = ("title", "meta_description", "text")
    int_cols = ("text_length", "low_content", "link_count", "has_form", "has_iframe")
    return res.select(
        *urls.columns,
        F.when(invalid, "failed").when(found, "success").otherwise("partial").alias("status"),
        F.when(invalid, "").when(found, F.col("_pg.final_url")).otherwise(F.col("_nurl")).alias("final_url"),
        F.when(invalid, FAILED).when(F.col("_fallback"), FALLBACK).when(~found, PARTIAL).alias("error"),
        F.when(found & ~invalid, F.col("_pg.redirect_count")).otherwise(F.lit(0)).cast("int").alias("redirect_count"),
        *[F.when(found & ~invalid, F.col(f"_pg.{c}")).otherwise(F.lit("")).alias(c) for c in text_cols],
        *[F.when(found & ~invalid, F.col(f"_pg.{c}")).otherwise(F.lit(0)).cast("int").alias(c) for c in int_cols],
    )
