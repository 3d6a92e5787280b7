"""Scoring and explanation operators.

All are projections over a feature table; nothing shuffles.  ``score_batch``
takes either a fitted Spark ML ``PipelineModel`` or an existing probability
column.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskscope import dictionaries as D
from riskscope.functions.memo import jvm_memo

# ---------------------------------------------------------------------------
# FIXED VALUES — family score weights, labels and texts (must match).
# ---------------------------------------------------------------------------
FAMILIES = (
    # (label, detail, [(feature, divisor, weight), ...])
    ("URL complexity", "length, entropy, digits",
     [("url_entropy", 5.5, 0.35), ("num_digits", 18, 0.2), ("num_hyphen", 5, 0.15), ("url_length", 120, 0.3)]),
    ("Host reputation", "TLD, hosting, subdomains",
     [("subdomains", 4, 0.28), ("suspicious_tld", 1, 0.26), ("uses_free_hosting", 1, 0.22), ("has_ip", 1, 0.24)]),
    ("Brand mismatch", "brand terms outside official domains",
     [("brand_in_url", 1, 0.22), ("brand_domain_mismatch", 1, 0.5), ("brand_on_free_hosting", 1, 0.28)]),
    ("Content pressure", "scam words and page text",
     [("scam_keyword_count", 4, 0.45), ("suspicious_word_count", 5, 0.25), ("caps_ratio", 1, 0.15),
      ("exclamation_count", 4, 0.15)]),
    ("Redirect structure", "paths, queries, obfuscation",
     [("num_query_params", 6, 0.25), ("path_depth", 6, 0.25), ("has_at_symbol", 1, 0.2), ("tld_in_path", 1, 0.3)]),
)
FAMILY_COLUMNS = ("url_complexity", "host_reputation", "brand_mismatch", "content_pressure", "redirect_structure")

BANDS = ((0.75, "High risk", "danger"), (0.5, "Elevated risk", "warning"), (0.3, "Needs review", "watch"))
LOW_BAND = ("Low risk", "safe")

NOTE_LIMITED = "Page content was limited, so URL and hostname signals carry more weight."
NOTE_TEXT = "Content text was available and included in the model input."
NOTE_BRAND = "A known brand appears outside its official registered domain."
NOTE_DEFAULT = "No single high-risk signal dominated this scan."
# ---------------------------------------------------------------------------


def _f(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def family_scores(df: DataFrame) -> DataFrame:
    """Five clamped weighted sums, 3 dp (missing features count as 0)."""
    return df.withColumns(_family_exprs())


@jvm_memo
def _family_exprs() -> dict[str, Column]:
    exprs = {}
    for (label, _detail, parts), name in zip(FAMILIES, FAMILY_COLUMNS):
        total = F.lit(0.0)
        for feat, div, w in parts:
            total = total + _f(feat) / F.lit(float(div)) * F.lit(w)
        exprs[name] = F.bround(F.greatest(F.lit(0.0), F.least(total, F.lit(1.0))), 3)
    return exprs


def radar(df: DataFrame | None = None) -> Column:
    """Radar bars as array<struct<label, value, detail>> (listed order)."""
    return F.array(
        *[
            F.struct(F.lit(label).alias("label"), F.col(name).alias("value"), F.lit(detail).alias("detail"))
            for (label, detail, _), name in zip(FAMILIES, FAMILY_COLUMNS)
        ]
    )


def top_drivers(n: int = 3) -> Column:
    """The ``n`` largest family scores; ties keep the listed order.
    Uses the family columns from :func:`family_scores`."""
    bars = F.array(
        *[
            F.struct(F.col(name).alias("value"), F.lit(i).alias("pos"), F.lit(label).alias("label"), F.lit(detail).alias("detail"))
            for i, ((label, detail, _), name) in enumerate(zip(FAMILIES, FAMILY_COLUMNS))
        ]
    )
    ordered = F.array_sort(
        bars,
        lambda a, b: F.when(a["value"] > b["value"], -1)
        .when(a["value"] < b["value"], 1)
        .otherwise(a["pos"] - b["pos"]),
    )
    return F.transform(
        F.slice(ordered, 1, n),
        lambda x: F.struct(x["label"].alias("label"), x["value"].alias("value"), x["detail"].alias("detail")),
    )


def reliability_notes(status: Column, text_length: Column, brand_mismatch: Column) -> Column:
    """Up to three notes, or the default one."""
    notes = F.filter(
        F.array(
            F.when(F.coalesce(status, F.lit("")) != "success", F.lit(NOTE_LIMITED)),
            F.when(F.coalesce(text_length, F.lit(0)) > 0, F.lit(NOTE_TEXT)),
            F.when(F.coalesce(brand_mismatch, F.lit(0)) != 0, F.lit(NOTE_BRAND)),
        ),
        lambda x: x.isNotNull(),
    )
    return F.when(F.size(notes) == 0, F.array(F.lit(NOTE_DEFAULT))).otherwise(notes)


def risk_band(p: Column) -> Column:
    """struct(label, tone) by probability thresholds."""
    label = F.when(p >= BANDS[0][0], BANDS[0][1]).when(p >= BANDS[1][0], BANDS[1][1]).when(
        p >= BANDS[2][0], BANDS[2][1]
    ).otherwise(LOW_BAND[0])
    tone = F.when(p >= BANDS[0][0], BANDS[0][2]).when(p >= BANDS[1][0], BANDS[1][2]).when(
        p >= BANDS[2][0], BANDS[2][2]
    ).otherwise(LOW_BAND[1])
    return F.struct(label.alias("label"), tone.alias("tone"))


def signal_cards() -> Column:
    """Six cards (label, value as string, active) from the result columns
    suspicious_word_count, scam_keyword_count, suspicious_tld, url_length,
    text_length, status."""
    g = lambda c: F.coalesce(F.col(c), F.lit(0))
    status = F.col("status")
    return F.array(
        F.struct(F.lit("Suspicious words").alias("label"), g("suspicious_word_count").cast("string").alias("value"),
                 (g("suspicious_word_count") > 0).alias("active")),
        F.struct(F.lit("Scam keywords").alias("label"), g("scam_keyword_count").cast("string").alias("value"),
                 (g("scam_keyword_count") > 0).alias("active")),
        F.struct(F.lit("Suspicious TLD").alias("label"),
                 F.when(g("suspicious_tld") != 0, "Yes").otherwise("No").alias("value"),
                 (g("suspicious_tld") != 0).alias("active")),
        F.struct(F.lit("URL length").alias("label"), g("url_length").cast("string").alias("value"),
                 (g("url_length") >= 80).alias("active")),
        F.struct(F.lit("Page text").alias("label"), g("text_length").cast("string").alias("value"),
                 (g("text_length") > 0).alias("active")),
        F.struct(F.lit("Scrape status").alias("label"),
                 F.coalesce(F.when(status != "", status), F.lit("unknown")).alias("value"),
                 (F.coalesce(status, F.lit("")) == "success").alias("active")),
    )


def mean_family_score(df: DataFrame, out: str = "scam_probability") -> DataFrame:
    """Deterministic stand-in score for tests and demos: mean of the five
    family scores (4 dp).  Not a trained model."""
    total = sum((F.col(c) for c in FAMILY_COLUMNS), F.lit(0.0))
    return df.withColumn(out, F.bround(total / len(FAMILY_COLUMNS), 4))


def align_features(df: DataFrame, feature_columns: Sequence[str], keep: Iterable[str] = ()) -> DataFrame:
    """exactly the model columns in order (missing -> NULL double), plus
    ``keep`` columns in front."""
    present = set(df.columns)
    return df.select(
        *keep,
        *[(F.col(c).cast("double") if c in present else F.lit(None).cast("double")).alias(c) for c in feature_columns],
    )


def feature_preview(df: DataFrame, feature_columns: Sequence[str], keep: Iterable[str] = ()) -> DataFrame:
    """Aligned features with NULL -> 0."""
    return align_features(df, feature_columns, keep).na.fill(0.0, subset=list(feature_columns))


def score_batch(
    df: DataFrame,
    model=None,
    *,
    probability_col: str = "scam_probability",
    valid_col: str | None = "url_valid",
) -> DataFrame:
    """Probability -> prediction (p >= 0.5 is SCAM), confidence (p or
    1 - p, 4 dp).  The probability stays as it is, for metrics and bands;
    reports round it.  Rows failing ``valid_col`` become ERROR rows
    (prediction_label -1, confidence 0, probability 0).  With a ``model``
    (a fitted ``PipelineModel`` with a ``probability`` vector output) the
    probability comes from ``model.transform``."""
    if model is not None:
        from pyspark.ml.functions import vector_to_array

        df = model.transform(df).withColumn(probability_col, vector_to_array(F.col("probability"))[1]).drop(
            "probability", "rawPrediction", "prediction", "features"
        )
    p = F.col(probability_col).cast("double")
    ok = F.col(valid_col) if valid_col and valid_col in df.columns else F.lit(True)
    label = F.when(p >= 0.5, 1).otherwise(0)
    return df.withColumns(
        {
            "prediction_label": F.when(ok, label).otherwise(F.lit(-1)).cast("int"),
            "prediction": F.when(~ok, F.lit("ERROR")).when(label == 1, F.lit("SCAM")).otherwise(F.lit("LEGIT")),
            "confidence": F.when(ok, F.bround(F.when(label == 1, p).otherwise(1.0 - p), 4)).otherwise(F.lit(0.0)),
            probability_col: F.when(ok, p).otherwise(F.lit(0.0)),
        }
    )


def explain(df: DataFrame, probability_col: str = "scam_probability") -> DataFrame:
    """L11-L15 on a scored table: ``risk_band``, ``signals`` and
    ``insights`` (radar, top_drivers, notes)."""
    fam = family_scores(df) if not set(FAMILY_COLUMNS) <= set(df.columns) else df
    return fam.withColumns(_explain_exprs(probability_col))


@jvm_memo
def _explain_exprs(probability_col: str) -> dict[str, Column]:
    return {
        "risk_band": risk_band(F.col(probability_col)),
        "signals": signal_cards(),
        "insights": F.struct(
            radar(None).alias("radar"),
            top_drivers().alias("top_drivers"),
            reliability_notes(F.col("status"), F.col("text_length"), F.col("brand_domain_mismatch")).alias("notes"),
        ),
    }


def batch_verdict(df: DataFrame, expected_col: str = "expected", probability_col: str = "scam_probability") -> DataFrame:
    """Verdict LEGITIMATE/SCAM, confidence = max class probability in
    percent (2 dp text), PASS/FAIL against the expected name."""
    p = F.col(probability_col).cast("double")
    verdict = F.when(p >= 0.5, "SCAM").otherwise("LEGITIMATE")
    conf = F.format_string("%.2f%%", F.greatest(p, 1 - p) * 100)
    exp = F.upper(F.col(expected_col))
    correct = F.col("predicted_verdict").contains(exp)
    return (
        df.withColumn("predicted_verdict", verdict)
        .withColumn("confidence_text", conf)
        .withColumn("check", F.when(correct, "[PASS]").otherwise("[FAIL]"))
    )


def whitelist_split(
    df: DataFrame, netloc_col: str = "netloc", whitelist: Iterable[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """(whitelisted rows, rows to score).  The whitelist is a literal set,
    so both sides are filters, not joins."""
    wl = tuple(w.lower() for w in whitelist)
    hit = F.coalesce(F.lower(F.col(netloc_col)).isin(*wl), F.lit(False))  # a null host is scored
    return df.filter(hit), df.filter(~hit)
