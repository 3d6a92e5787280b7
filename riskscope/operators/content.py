"""Content feature operators (C9, C10) and TF-IDF terms."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskscope import dictionaries as D
from riskscope.functions import html as H
from riskscope.functions import text as T
from riskscope.functions.memo import freeze, jvm_memo
from riskscope.functions.urls import py_strip
from riskscope.operators.joins import join_skew_safe
from riskscope.session import cut_lineage

CONTENT_FEATURES = (
    "text_length", "token_count", "scam_keyword_count", "scam_keyword_density", "has_form",
    "has_iframe", "exclamation_count", "caps_ratio", "avg_word_length",
)
DOUBLE_CONTENT_FEATURES = ("scam_keyword_density", "caps_ratio", "avg_word_length")


def _col(c: str | Column | None) -> Column:
    if c is None:
        return F.lit(None).cast("string")
    return F.col(c) if isinstance(c, str) else c


def with_content_features(
    df: DataFrame,
    title: str | Column | None = "title",
    text: str | Column | None = "text",
    html: str | Column | None = None,
    *,
    keywords: Iterable[str] = D.SCAM_KEYWORDS,
    stop_words: Iterable[str] = D.ENGLISH_STOP_WORDS,
    title_weight: int = D.TITLE_WEIGHT,
    has_flags: bool = True,
) -> DataFrame:
    """The nine content features.

    Stages: weighted text and normalised text, then the token array (built
    once), then the features.  ``has_form``/``has_iframe`` come from the raw
    HTML (0 without HTML) unless ``has_flags`` is False and the columns exist
    already (pages extracted by H8)."""
    staged = df.withColumns(
        {
            "_txt": py_strip(F.coalesce(_col(text), F.lit(""))),
            "_norm": T.normalize_text(T.weighted_text(_col(title), _col(text), title_weight)),
        }
    )
    tok, exprs, density = _content_exprs(freeze(keywords), freeze(stop_words), has_flags)
    if has_flags:
        h = F.coalesce(_col(html), F.lit(""))
        exprs = {**exprs, "has_form": H.has_tag(h, "form"), "has_iframe": H.has_tag(h, "iframe")}
    staged = staged.withColumn("_tok", tok).withColumns(exprs).withColumn("scam_keyword_density", density)
    ordered = [c for c in staged.columns if c not in CONTENT_FEATURES and c not in ("_norm", "_tok", "_txt")]
    return staged.select(*ordered, *[c for c in CONTENT_FEATURES if c in staged.columns])


@jvm_memo
def _content_exprs(keywords, stop_words, has_flags):
    tok = T.clean_tokens(F.col("_norm"), stop_words)
    t, txt = F.col("_tok"), F.col("_txt")
    n = F.size(t)
    exprs = {
        "text_length": F.least(F.length(txt), F.lit(D.MAX_TEXT_LENGTH_FEATURE)).cast("int"),
        "token_count": F.least(n, F.lit(D.MAX_TOKEN_COUNT_FEATURE)).cast("int"),
        "scam_keyword_count": T.keyword_hits(t, F.col("_norm"), keywords),
        "exclamation_count": F.least(T.exclamations(txt), F.lit(D.MAX_EXCLAMATION_FEATURE)).cast("int"),
        "caps_ratio": T.caps_ratio(txt),
        "avg_word_length": T.avg_word_length(t),
    }
    density = F.when(n == 0, F.lit(0.0)).otherwise(F.bround(F.col("scam_keyword_count") / n, 6))
    return tok, exprs, density


def zero_content_features(df: DataFrame) -> DataFrame:
    """The nine features as constants (rows that were not scraped)."""
    return df.withColumns(
        {
            c: (F.lit(0.0) if c in DOUBLE_CONTENT_FEATURES else F.lit(0).cast("int"))
            for c in CONTENT_FEATURES
        }
    )


def term_counts(docs: DataFrame, id_col: str, text_col: str, stop_words: Iterable[str] = D.ENGLISH_STOP_WORDS) -> DataFrame:
    """(doc, term, tf): tokens of C2 + C3 counted with map-side combine."""
    # explode first, then filter on the flat column: the stop-word test is a
    # code-generated hash-set lookup instead of a lambda over a long array
    words = F.split(T.normalize_text(F.coalesce(F.col(text_col), F.lit(""))), " ")
    rows = docs.select(F.col(id_col).alias("doc"), F.explode(words).alias("term"))
    return rows.where((F.col("term") != "") & ~F.col("term").isin(*tuple(stop_words))).groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))


def fit_tfidf(docs: DataFrame, id_col: str, text_col: str, *, min_df: int = 1, stop_words: Iterable[str] = D.ENGLISH_STOP_WORDS) -> DataFrame:
    """C12 model: ``term``, ``df``, ``idf`` (smoothed) of the terms in at least
    ``min_df`` documents.  An ordinary table: write it, read it, transform with
    it.  Every row of ``docs`` counts as a document; an empty corpus gives an
    empty model."""
    n_docs = docs.count()  # one number for the formula
    df = term_counts(docs, id_col, text_col, stop_words).groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    return df.withColumn("idf", F.log(F.lit(1.0 + n_docs) / (1 + F.col("df"))) + 1)


def transform_tfidf(
    docs: DataFrame, id_col: str, text_col: str, model: DataFrame, *, stop_words: Iterable[str] = D.ENGLISH_STOP_WORDS, hot_key_rows: int = 100_000
) -> DataFrame:
    """``id_col``, ``term``, ``tf``, ``weight`` (L2-normalised per document)
    of any documents under a fitted model; terms the model doesn't know are left
    out, and so are documents without a known term.  Terms that are hot in
    ``docs`` meet their model row by broadcast."""
    tf = cut_lineage(term_counts(docs, id_col, text_col, stop_words))
    known = join_skew_safe(tf, model.select("term", "idf"), "term", "inner", hot_key_rows=hot_key_rows)
    raw = known.withColumn("raw", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("doc")))
    return raw.select(F.col("doc").alias(id_col), "term", "tf", F.bround(F.col("raw") / norm, 6).alias("weight"))


def tfidf_top_terms(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    *,
    top_n: int = 10,
    min_docs: int = 2,
    stop_words: Iterable[str] = D.ENGLISH_STOP_WORDS,
    hot_key_rows: int = 100_000,
    broadcast_terms: int = 500_000,
) -> DataFrame:
    """Top ``n`` TF-IDF terms per document.

    tf = term count in the document, idf = ln((1 + N) / (1 + df)) + 1 (the
    smoothed form), weights L2-normalised per document.  Tokens come from C2 +
    C3.  Everything is a Spark aggregation: (doc, term) counts with map-side
    combine, term document frequencies (sent to all where there are at most
    ``broadcast_terms``), then a per-document top-n with a window.  The window partitions by document, so one long document is
    still bounded by its distinct terms.  Fewer than ``min_docs`` documents
    -> empty result."""
    # explode first, then filter on the flat column: the stop-word test is a
    # code-generated hash-set lookup instead of a lambda over a long array
    toks = docs.select(
        F.col(id_col).alias("doc"),
        F.explode(F.split(T.normalize_text(F.coalesce(F.col(text_col), F.lit(""))), " ")).alias("term"),
    ).where((F.col("term") != "") & ~F.col("term").isin(*tuple(stop_words)))
    # (doc, term) counts are read three times (document frequency, hot
    # terms, weights): materialise them once in the checkpoint directory.
    tf = cut_lineage(toks.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf")))
    n_docs = docs.select(id_col).count()  # one scalar for the idf formula
    # Written once too: it is sized, gives the hot terms and is joined.
    dfreq = cut_lineage(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    if dfreq.count() <= broadcast_terms:  # the (doc, term) rows stay where they are
        known = tf.join(F.broadcast(dfreq), "term")
    else:
        # A common term is a hot key on the tf side; its tf row count is its
        # document frequency, so hot terms come straight from ``dfreq``.
        hot = dfreq.where(F.col("df") >= hot_key_rows).select("term")
        known = join_skew_safe(tf, dfreq, "term", "inner", hot_keys=hot)
    w = known.where(F.lit(n_docs >= min_docs)).withColumn("raw", F.col("tf") * (F.log(F.lit(1.0 + n_docs) / (1 + F.col("df"))) + 1))
    # Weights fall with ``raw`` in a document: one sort serves norm and rank.
    by_raw = Window.partitionBy("doc").orderBy(F.desc("raw"), F.asc("term"))
    whole = by_raw.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = w.withColumns({"_norm": F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(whole)), "rank": F.row_number().over(by_raw)})
    ranked = ranked.withColumn("weight", F.col("raw") / F.col("_norm"))
    return ranked.where(F.col("rank") <= top_n).select(
        F.col("doc").alias(id_col), F.col("rank").cast("int"), "term", F.bround("weight", 6).alias("weight")
    )
