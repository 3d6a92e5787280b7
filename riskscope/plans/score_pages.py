"""Flagship: score every captured page.

pages(url, html) -> H8 page extraction (HTML dropped right after) -> C9
content features -> U26 URL features -> L12 family scores -> score (model or
the deterministic mean-of-families stand-in) -> L8 labels -> L11-L15
explanations.  One map-only plan: no shuffle, no Python worker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskscope.operators import content as C
from riskscope.operators import pages as P
from riskscope.operators import scoring as S
from riskscope.operators import url_features as UF


def page_features(pages: DataFrame, url_col: str = "url", html_col: str = "html", **kw) -> DataFrame:
    """URL + page + content features for a capture table (keeps input keys)."""
    extracted = P.extract_pages(pages, html_col)
    content = C.with_content_features(extracted, "title", "text", has_flags=False, **kw)
    return UF.with_url_features(content, url_col)


def score_pages(pages: DataFrame, model=None, url_col: str = "url", html_col: str = "html") -> DataFrame:
    feats = page_features(pages, url_col, html_col).withColumn("status", F.lit("success"))
    fam = S.family_scores(feats)
    if model is None:
        fam = S.mean_family_score(fam)
    scored = S.score_batch(fam, model)
    return S.explain(scored)


def flagship_report(pages: DataFrame) -> DataFrame:
    """Flat report: which pages look riskiest, and why."""
    ex = score_pages(pages)
    drivers = F.col("insights.top_drivers")
    active = F.filter(F.col("signals"), lambda s: s["active"])
    return ex.select(
        "page_id",
        "url",
        "registered_domain",
        "title",
        *S.FAMILY_COLUMNS,
        F.bround("scam_probability", 4).alias("scam_probability"),
        "prediction",
        "confidence",
        F.col("risk_band.label").alias("risk_label"),
        F.col("risk_band.tone").alias("risk_tone"),
        drivers[0]["label"].alias("driver_1"),
        drivers[1]["label"].alias("driver_2"),
        drivers[2]["label"].alias("driver_3"),
        F.array_join(F.col("insights.notes"), " | ").alias("notes"),
        F.array_join(F.transform(active, lambda s: s["label"]), ", ").alias("active_signals"),
    )
