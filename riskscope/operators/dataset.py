"""Dataset building: filters, unions, de-duplication, sampling, splitting
(F1-F5, X1-X3, M1-M4).

Randomness is an md5 order: ``md5(seed || ':' || key)``.  It is stable under
recomputation (an executor lost mid-job recomputes the same rows) and equal
in every SQL engine, unlike ``rand()``.

Exact ranks inside a group (a label holds half the table) never go through
one task: :func:`exact_rank` histograms the first 16 bits of the hash per
group, turns the (bounded, broadcast) histogram into prefix offsets, and
numbers rows only inside one hash bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskscope.functions.urls import dedupe_key, normalize_url, py_strip
from riskscope.operators.joins import broadcast_if_small

HASH_BITS = 60
BUCKET_BITS = 16


def md5_order(seed: int | str, *parts: Column) -> Column:
    """Hex md5 of ``seed:part1:part2...`` (the sampling order)."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hash60(hex_md5: Column) -> Column:
    """First 15 hex digits of an md5 as a non-negative long."""
    return F.conv(F.substring(hex_md5, 1, 15), 16, 10).cast("long")


def exact_rank(
    df: DataFrame,
    order_col: str,
    group_cols: Sequence[str] = (),
    out: str = "rank",
    max_groups: int | None = 2,
    below: int | None = None,
) -> DataFrame:
    """0-based rank of each row inside its group by ``order_col`` (an md5
    hex string), computed without a whole-group window.  With ``below``, only
    rows of a smaller rank are returned: buckets past it drop out before the
    shuffle, so that only winners (and one bucket more) are moved.

    The offsets table has at most ``max_groups`` x 2^16 rows; with a known
    bound it is broadcast directly, otherwise after a size check."""
    g = list(group_cols)
    b = F.shiftright(hash60(F.col(order_col)), HASH_BITS - BUCKET_BITS).alias("_bucket")
    keyed = df.withColumn("_bucket", b)
    hist = keyed.groupBy(*g, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*g).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = hist.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    if below is not None:
        offsets = offsets.where(F.col("_off") < below)
    small = F.broadcast(offsets) if max_groups is not None and max_groups <= 16 else broadcast_if_small(offsets)
    j = keyed.join(small, [*g, "_bucket"])
    inner = Window.partitionBy(*g, "_bucket").orderBy(order_col)
    ranked = j.withColumn(out, (F.col("_off") + F.row_number().over(inner) - 1).cast("long")).drop("_bucket", "_off")
    return ranked if below is None else ranked.where(F.col(out) < below)


# ------------------------------------------------------------------ F1 / F3


def valid_labeled_rows(df: DataFrame, url_col: str = "url", label_col: str = "label") -> DataFrame:
    """normalised URL not empty, numeric label 0 or 1 (cast to int);
    ``text_content`` NULL -> '' and ``has_reference_text``."""
    lab = F.col(label_col).cast("string").try_cast("double")
    text = F.coalesce(F.col("text_content").cast("string"), F.lit("")) if "text_content" in df.columns else F.lit("")
    out = df.withColumns(
        {
            url_col: normalize_url(F.col(url_col)),
            "_lab": lab,
            "text_content": text,
        }
    )
    out = out.where((F.col(url_col) != "") & F.col("_lab").isin(0.0, 1.0))
    return out.withColumn(label_col, F.col("_lab").cast("int")).withColumn(
        "has_reference_text", py_strip(F.col("text_content")) != ""
    ).drop("_lab")


def text_corpus(df: DataFrame, title_col: str = "title", text_col: str = "text_content") -> DataFrame:
    """rows with non-blank text; ``corpus_text`` = title + text (C11)."""
    from riskscope.functions.text import combined_text

    return df.where(F.trim(F.coalesce(F.col(text_col), F.lit(""))) != "").withColumn(
        "corpus_text", combined_text(F.col(title_col), F.col(text_col))
    )


# --------------------------------------------------------------- X1 - X3


def dedupe_reference(df: DataFrame, url_col: str = "url") -> DataFrame:
    """One row per URL, preferring rows with text, then the smaller
    source name, then the earlier line.  ``min_by`` combines map-side, so a
    URL repeated millions of times costs no more than a count."""
    cols = [c for c in df.columns if c != url_col]
    order = F.struct(~F.col("has_reference_text"), F.col("source_dataset"), F.col("line"))
    return df.groupBy(url_col).agg(F.min_by(F.struct(*cols), order).alias("_r")).select(url_col, "_r.*")


def dedupe_urls(df: DataFrame, url_col: str = "url", pos_col: str = "pos") -> DataFrame:
    """Normalise, drop empties, keep the first row (by ``pos``) per
    ``rstrip('/').lower()`` key."""
    n = df.withColumn(url_col, normalize_url(F.col(url_col))).where(F.col(url_col) != "")
    n = n.withColumn("dedupe_key", dedupe_key(F.col(url_col)))
    cols = [c for c in n.columns if c != "dedupe_key"]
    return n.groupBy("dedupe_key").agg(F.min_by(F.struct(*cols), F.col(pos_col)).alias("_r")).select("dedupe_key", "_r.*")


def union_with_shortfall(primary: DataFrame, secondary: DataFrame, limit: int, url_col: str = "url", pos_col: str = "pos") -> DataFrame:
    """X1 + M4 for feeds: the first ``limit`` distinct URLs of the primary
    feed, filled up from the secondary feed.  Duplicates across the feeds
    are removed before the limit (the shortfall is then really filled)."""
    both = primary.withColumn("_prio", F.lit(0)).unionByName(secondary.withColumn("_prio", F.lit(1)))
    both = both.withColumn("_ord", F.struct("_prio", pos_col))
    d = dedupe_urls(both, url_col, "_ord")
    return take_first(d, limit, ["_prio", pos_col]).drop("_ord")


def take_first(df: DataFrame, n: int, order_cols: Sequence[str]) -> DataFrame:
    """M4: the first ``n`` rows by an explicit position (a top-k; the limit
    is the feature)."""
    return df.orderBy(*order_cols).limit(n)


# ------------------------------------------------------------------ M1 - M3


def balanced_sample(
    df: DataFrame,
    rows: int,
    seed: int = 42,
    prefer_text: bool = True,
    url_col: str = "url",
    label_col: str = "label",
) -> DataFrame:
    """M1: ``rows // 2`` per label (label 0 gets the odd one).

    With ``prefer_text``: enough text rows -> sample only those; some -> all
    of them plus the rest from rows without text; none -> the whole label.
    Draws are without replacement while the pool is large enough, else with
    replacement (draw ``i`` takes pool position md5(seed:label:i) mod size).
    Adds ``draw`` (0 for plain picks) and ``sample_order``.  A label without
    rows raises ``ValueError``."""
    per, rem = rows // 2, rows % 2
    needed = {0: per + rem, 1: per}
    text = F.col("has_reference_text") if prefer_text else F.lit(False)
    base = df.withColumn("_text", text.cast("boolean")).withColumn(
        "_h", md5_order(seed, F.col(label_col), F.col(url_col))
    )
    counts = {
        (r[label_col], r["_text"]): r["n"]
        for r in base.groupBy(label_col, "_text").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    parts = []
    for label, need in needed.items():
        n_text = counts.get((label, True), 0)
        n_other = counts.get((label, False), 0)
        if n_text + n_other == 0:
            raise ValueError(f"No rows found for label {label}")
        grp = base.where(F.col(label_col) == label)
        if prefer_text and n_text >= need:
            pools = [(grp.where(F.col("_text")), need, n_text, "t")]
        elif prefer_text and n_text > 0:
            pools = [(grp.where(F.col("_text")), n_text, n_text, "t"), (grp.where(~F.col("_text")), need - n_text, n_other, "f")]
        else:
            pools = [(grp, need, n_text + n_other, "a")]
        for pool, k, size, tag in pools:
            if k <= 0:
                continue
            if size >= k:
                parts.append(exact_rank(pool, "_h", out="_rank", below=k).withColumn("draw", F.lit(0).cast("long")))
            else:
                ranked = exact_rank(pool, "_h", out="_rank")
                spark = df.sparkSession
                draws = spark.range(k).select(
                    (F.col("id") + 1).alias("draw"),
                    F.pmod(hash60(md5_order(seed, F.lit(f"draw:{label}:{tag}"), F.col("id"))), F.lit(size)).alias("_rank"),
                )
                parts.append(ranked.join(draws, "_rank"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("sample_order", md5_order(seed, F.col(url_col), F.col("draw"))).drop("_h", "_rank", "_text")


def stratified_split(df: DataFrame, test_size: float = 0.2, seed: int = 42, url_col: str = "url", label_col: str = "label") -> DataFrame:
    """M2: ``is_test`` for the first round(test_size * n_label) rows of each
    label in md5(url) order (copies of one URL share the hash, so they land
    on the same side up to ties at the cut)."""
    h = df.withColumn("_h", md5_order(seed, F.col(url_col)))
    ranked = exact_rank(h, "_h", [label_col], out="_rank")
    n = ranked.groupBy(label_col).agg(F.count(F.lit(1)).alias("_n"))
    j = ranked.join(F.broadcast(n), label_col)
    cut = F.round(F.col("_n") * F.lit(test_size))
    return j.withColumn("is_test", F.col("_rank") < cut).drop("_h", "_rank", "_n")


def stratified_folds(df: DataFrame, k: int = 5, seed: int = 42, url_col: str = "url", label_col: str = "label") -> DataFrame:
    """M3: ``fold`` = rank within the label (md5 order) mod k."""
    h = df.withColumn("_h", md5_order(seed, F.lit("fold"), F.col(url_col)))
    return exact_rank(h, "_h", [label_col], out="_rank").withColumn(
        "fold", F.pmod(F.col("_rank"), F.lit(k)).cast("int")
    ).drop("_h", "_rank")
