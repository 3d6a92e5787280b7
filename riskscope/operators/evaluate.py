"""Evaluation and exploratory aggregates (A1-A18) and cleaning (L1-L4).

Every operator is one or two aggregations; statistics over many columns are
computed in a single ``agg`` and unpivoted, never one job per column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskscope.operators.joins import broadcast_if_small
from riskscope.operators.quantiles import exact_quantiles
from riskscope.session import cut_lineage

# Columns that are never features (dropped before training).
METADATA_COLUMNS = (
    "url", "final_url", "source_dataset", "has_reference_text", "scrape_status", "scrape_error",
    "redirect_count", "registrar",
)
LABEL_NAMES = {0: "LEGIT", 1: "SCAM"}


def label_counts(df: DataFrame, label_col: str = "label", labels: Sequence[int] = (0, 1)) -> DataFrame:
    """A1: rows and share per label over a fixed label set (0 rows kept)."""
    spark = df.sparkSession
    fixed = spark.createDataFrame([(int(x),) for x in labels], f"{label_col} int")
    c = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    out = fixed.join(c, label_col, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select(
        label_col, "n", F.bround(F.when(total > 0, F.col("n") / total).otherwise(F.lit(0.0)), 6).alias("share")
    )


def _long(df: DataFrame, stats: dict[str, dict[str, F.Column]]) -> DataFrame:
    """One aggregation pass; result unpivoted to (column, stat...)."""
    flat = []
    for c, ss in stats.items():
        for s, e in ss.items():
            flat.append(e.alias(f"{c}\u0001{s}"))
    row = df.agg(*flat)
    names = list(stats)
    stat_names = list(next(iter(stats.values())).keys())
    structs = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}\u0001{s}`").alias(s) for s in stat_names]) for c in names
    ]
    return row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def null_counts(df: DataFrame, top: int = 20) -> DataFrame:
    """A2: NULL count per column, largest first (top ``n``; ties by name)."""
    stats = {c: {"nulls": F.sum(F.col(f"`{c}`").isNull().cast("long"))} for c in df.columns}
    return _long(df, stats).orderBy(F.desc("nulls"), "column").limit(top)


def constant_columns(df: DataFrame) -> DataFrame:
    """A3: columns with at most one distinct non-NULL value."""
    stats = {
        c: {"n": F.count(F.col(f"`{c}`")), "lo": F.min(F.col(f"`{c}`").cast("string")), "hi": F.max(F.col(f"`{c}`").cast("string"))}
        for c in df.columns
    }
    return _long(df, stats).where((F.col("n") == 0) | (F.col("lo") == F.col("hi"))).select("column")


def describe_features(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A4: mean, sample sd, min, max per feature."""
    stats = {
        c: {
            "mean": F.avg(F.col(c).cast("double")),
            "std": F.stddev_samp(F.col(c).cast("double")),
            "min": F.min(F.col(c).cast("double")),
            "max": F.max(F.col(c).cast("double")),
        }
        for c in cols
    }
    return _long(df, stats)


def feature_variance_topk(df: DataFrame, cols: Sequence[str], k: int = 16) -> DataFrame:
    """A10: sample variance per feature, the ``k`` largest (ties by name)."""
    stats = {c: {"variance": F.var_samp(F.col(c).cast("double"))} for c in cols}
    return _long(df, stats).orderBy(F.desc_nulls_last("variance"), "column").limit(k)


def correlation_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation for every pair (strict lower triangle), one
    aggregation pass."""
    cols = list(cols)
    exprs, keys = [], []
    for i, a in enumerate(cols):
        for b in cols[:i]:
            exprs.append(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}\u0001{b}"))
            keys.append((a, b))
    row = df.agg(*exprs)
    structs = [
        F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"`{a}\u0001{b}`").alias("corr"))
        for a, b in keys
    ]
    return row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def _cells(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, feature, value): a row per value, from the named columns alone."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols])
    return df.select(*keys, F.explode(cells).alias("m")).select(*keys, "m.feature", "m.value")


def _quantiles(rows: DataFrame, keys: list[str], probs: dict[str, float], exact: bool, accuracy: int) -> DataFrame:
    """Exact by refined histograms, or from a bounded sketch in one pass."""
    if exact:
        return exact_quantiles(rows, keys, "value", probs)
    return rows.groupBy(*keys).agg(*[F.percentile_approx("value", p, accuracy).cast("double").alias(n) for n, p in probs.items()])


def box_stats(
    df: DataFrame, cols: Sequence[str], label_col: str = "label", *, exact: bool = True, accuracy: int = 10_000
) -> DataFrame:
    """Long form (feature, label) -> quartiles and 1.5 IQR whiskers
    (the most extreme values inside the fences)."""
    long = cut_lineage(_cells(df, cols, [label_col]))
    q = _quantiles(long, ["feature", label_col], {"q1": 0.25, "median": 0.5, "q3": 0.75}, exact, accuracy)
    of = cut_lineage(q).select(F.col("feature").alias("_f"), F.col(label_col).alias("_l"), "q1", "median", "q3")
    j = long.join(broadcast_if_small(of), (F.col("feature") == F.col("_f")) & F.col(label_col).eqNullSafe(F.col("_l")))
    iqr = F.col("q3") - F.col("q1")
    lo_f, hi_f = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    return j.groupBy("feature", label_col, "q1", "median", "q3").agg(
        F.min(F.when(F.col("value") >= lo_f, F.col("value"))).alias("whisker_low"),
        F.max(F.when(F.col("value") <= hi_f, F.col("value"))).alias("whisker_high"),
    )


def holdout_metrics(df: DataFrame, label_col: str = "label", pred_col: str = "prediction_label", prob_col: str = "scam_probability", by: Sequence[str] = ()) -> DataFrame:
    """A5: accuracy, precision, recall, F1 (0 on zero division) and ROC AUC
    by the rank-sum formula with mid-ranks for ties (exact).  ``by``: columns
    without nulls, one row of metrics for each of their combinations."""
    y, p, by = F.col(label_col), F.col(pred_col), list(by)
    base = df.select(*by, y.alias("y"), p.alias("p"), F.col(prob_col).cast("double").alias("s"))
    # Mid-rank of every distinct score.  The prefix count of lower scores is
    # a histogram over 2^16 score buckets (small, broadcast) plus a running
    # sum inside one bucket, so no single task sees all distinct scores.
    by_s = base.groupBy(*by, "s").agg(
        F.count(F.lit(1)).alias("n_s"),
        F.sum("y").alias("pos_s"),
        F.sum(((F.col("y") == 1) & (F.col("p") == 1)).cast("long")).alias("tp_s"),
        F.sum(((F.col("y") == 0) & (F.col("p") == 1)).cast("long")).alias("fp_s"),
        F.sum(((F.col("y") == 1) & (F.col("p") != 1)).cast("long")).alias("fn_s"),
        F.sum((F.col("y") == F.col("p")).cast("long")).alias("ok_s"),
    )
    nb = 1 << 16
    by_s = by_s.withColumn("_b", F.least(F.greatest(F.floor(F.col("s") * nb), F.lit(0)), F.lit(nb - 1)))
    hist = by_s.groupBy(*by, "_b").agg(F.sum("n_s").alias("_nb"))
    w_off = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = hist.withColumn("_off", F.coalesce(F.sum("_nb").over(w_off), F.lit(0))).drop("_nb")
    w_in = Window.partitionBy(*by, "_b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranks = (
        by_s.join(broadcast_if_small(offs) if by else F.broadcast(offs), [*by, "_b"])  # at most 2^16 rows a combination by construction
        .withColumn("below", F.col("_off") + F.coalesce(F.sum("n_s").over(w_in), F.lit(0)))
        .withColumn("midrank", F.col("below") + (F.col("n_s") + 1) / 2.0)
    )
    j = ranks.groupBy(*by).agg(
        F.sum("n_s").alias("n"),
        F.sum("tp_s").alias("tp"),
        F.sum("fp_s").alias("fp"),
        F.sum("fn_s").alias("fn"),
        F.sum("ok_s").alias("correct"),
        F.sum("pos_s").alias("n_pos"),
        F.sum(F.col("midrank") * F.col("pos_s")).alias("rank_sum"),
    )
    prec = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(F.lit(0.0))
    rec = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(F.lit(0.0))
    n_neg = F.col("n") - F.col("n_pos")
    auc = F.when(
        (F.col("n_pos") > 0) & (n_neg > 0),
        (F.col("rank_sum") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0) / (F.col("n_pos") * n_neg),
    )
    return j.select(
        *by,
        F.bround(F.col("correct") / F.col("n"), 6).alias("accuracy"),
        F.bround(prec, 6).alias("precision"),
        F.bround(rec, 6).alias("recall"),
        F.bround(F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0)), 6).alias("f1"),
        F.bround(auc, 6).alias("roc_auc"),
    )


def confusion_matrix(df: DataFrame, label_col: str = "expected_label", pred_col: str = "predicted_label", labels: Sequence[int] = (0, 1)) -> DataFrame:
    """Expected x predicted counts, zero-filled, fixed order."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, b) for a in labels for b in labels], "expected int, predicted int")
    c = df.groupBy(F.col(label_col).cast("int").alias("expected"), F.col(pred_col).cast("int").alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return grid.join(c, ["expected", "predicted"], "left").select("expected", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def classification_report(df: DataFrame, label_col: str = "expected_label", pred_col: str = "predicted_label", labels: Sequence[int] = (0, 1)) -> DataFrame:
    """Per class precision/recall/F1/support, then macro and weighted
    averages (0 on zero division)."""
    cm = confusion_matrix(df, label_col, pred_col, labels)
    agg = []
    for k in labels:
        tp = F.sum(F.when((F.col("expected") == k) & (F.col("predicted") == k), F.col("n")).otherwise(0))
        pp = F.sum(F.when(F.col("predicted") == k, F.col("n")).otherwise(0))
        sup = F.sum(F.when(F.col("expected") == k, F.col("n")).otherwise(0))
        agg += [tp.alias(f"tp{k}"), pp.alias(f"pp{k}"), sup.alias(f"sup{k}")]
    row = cm.agg(*agg)
    per = []
    for k in labels:
        p = F.when(F.col(f"pp{k}") > 0, F.col(f"tp{k}") / F.col(f"pp{k}")).otherwise(F.lit(0.0))
        r = F.when(F.col(f"sup{k}") > 0, F.col(f"tp{k}") / F.col(f"sup{k}")).otherwise(F.lit(0.0))
        f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
        per.append(F.struct(F.lit(str(k)).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"), F.col(f"sup{k}").cast("long").alias("support")))
    classes = row.select(F.explode(F.array(*per)).alias("r")).select("r.*")
    total = F.sum("support").over(Window.partitionBy())
    avgs = classes.withColumn("_t", total).agg(
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / F.first("_t")).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / F.first("_t")).alias("wr"),
        (F.sum(F.col("f1") * F.col("support")) / F.first("_t")).alias("wf"),
        F.sum("support").alias("s"),
    )
    avg_rows = avgs.select(
        F.explode(
            F.array(
                F.struct(F.lit("macro avg").alias("class"), F.col("mp").alias("precision"), F.col("mr").alias("recall"), F.col("mf").alias("f1"), F.col("s").cast("long").alias("support")),
                F.struct(F.lit("weighted avg").alias("class"), F.col("wp").alias("precision"), F.col("wr").alias("recall"), F.col("wf").alias("f1"), F.col("s").cast("long").alias("support")),
            )
        ).alias("r")
    ).select("r.*")
    out = classes.unionByName(avg_rows)
    return out.select("class", *[F.bround(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


def real_summary(df: DataFrame) -> DataFrame:
    """Per expected class: total, correct, mean confidence, accuracy."""
    return df.groupBy("expected_name").agg(
        F.count(F.lit(1)).alias("total"),
        F.sum("correct").cast("long").alias("correct"),
        F.bround(F.avg("confidence"), 6).alias("mean_confidence"),
        F.bround(F.avg("correct"), 6).alias("accuracy"),
    )


def eval_summary(df: DataFrame) -> DataFrame:
    """Correct / total overall and per expected class (a rollup)."""
    r = df.rollup("expected_label").agg(F.sum("correct").cast("long").alias("correct"), F.count(F.lit(1)).alias("total"))
    scope = F.when(F.col("expected_label").isNull(), "Total").when(F.col("expected_label") == 0, "Legit").otherwise("Scam")
    return r.select(scope.alias("scope"), "correct", "total", F.format_string("- %s: %d/%d correct", scope, F.col("correct"), F.col("total")).alias("line"))


def confidence_histogram(df: DataFrame, col: str = "confidence", group_col: str = "expected_name", bins: int = 10) -> DataFrame:
    """``bins`` equal-width bins over the data range of ``col`` (last
    edge closed), counted per group, empty bins included.  ``df`` is read
    once: its counts per group and value are written, and the range and the
    bins are taken from those."""
    values = cut_lineage(df.groupBy(group_col, col).agg(F.count(F.lit(1)).alias("_n")))
    # Only now: before, the filter would be pushed into the scoring and run it twice.
    values = values.where(F.col(col).isNotNull())
    lo, hi = values.agg(F.min(col), F.max(col)).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], f"{group_col} string, bin int, lower double, upper double, n long")
    width = (hi - lo) / bins if hi > lo else 0.0
    b = F.lit(0) if width == 0 else F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    filled = values.select(group_col, b.alias("bin"), "_n")
    empty = values.select(group_col).distinct().select(group_col, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), F.lit(0).alias("_n"))
    c = filled.unionByName(empty).groupBy(group_col, "bin").agg(F.sum("_n").alias("n"))
    return c.select(
        group_col, "bin",
        F.bround(F.lit(lo) + F.col("bin") * F.lit(width), 6).alias("lower"),
        F.bround(F.lit(lo) + (F.col("bin") + 1) * F.lit(width), 6).alias("upper"),
        "n",
    )


def top_confident_examples(df: DataFrame, n: int = 12) -> DataFrame:
    """Wrong predictions first, then the most confident (top-k)."""
    return df.orderBy(F.asc("correct"), F.desc("confidence"), F.asc("url")).limit(n).select(
        "url", "expected_name", "predicted_name", "correct", F.format_string("%.2f%%", F.col("confidence") * 100).alias("confidence_pct")
    )


def case_history(df: DataFrame, n: int = 12, ts_col: str = "checked_at") -> DataFrame:
    """The latest ``n`` scans (top-k by time, ties by URL)."""
    return df.orderBy(F.desc(ts_col), F.asc("url")).limit(n)


def dataset_summary(df: DataFrame, text_flag: str = "has_reference_text") -> DataFrame:
    """Rows, columns, rows with text, URL-only rows."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        F.sum(F.col(text_flag).cast("int")).cast("long").alias("rows_with_text"),
        F.sum((~F.col(text_flag).cast("boolean")).cast("int")).cast("long").alias("url_only_rows"),
    )


# ------------------------------------------------------------------ L1 - L4


def feature_profile(df: DataFrame, label_col: str = "label") -> DataFrame:
    """L1: per candidate column (not metadata, not the label): numeric
    non-NULL count, min, max, and ``kept`` = some value and more than one
    distinct value counting NULL as a value.  One aggregation pass."""
    cands = [c for c in df.columns if c not in METADATA_COLUMNS and c != label_col]
    n = F.count(F.lit(1))
    stats = {
        c: {
            "n": n,
            "non_null": F.count(F.col(f"`{c}`").cast("string").try_cast("double")),
            "min": F.min(F.col(f"`{c}`").cast("string").try_cast("double")),
            "max": F.max(F.col(f"`{c}`").cast("string").try_cast("double")),
        }
        for c in cands
    }
    prof = _long(df, stats)
    kept = (F.col("non_null") > 0) & ((F.col("min") != F.col("max")) | (F.col("non_null") < F.col("n")))
    order = {c: i for i, c in enumerate(cands)}
    pos = F.element_at(F.create_map(*[x for c, i in order.items() for x in (F.lit(c), F.lit(i))]), F.col("column"))
    return prof.withColumn("kept", kept).withColumn("position", pos.cast("int"))


def select_numeric_features(df: DataFrame, label_col: str = "label") -> tuple[DataFrame, list[str]]:
    """L1: (clean table = label + kept features as double, feature list)."""
    prof = feature_profile(df, label_col).where("kept").orderBy("position").select("column").collect()
    feats = [r["column"] for r in prof]  # at most the number of columns
    lab = F.col(label_col).cast("string").try_cast("double")
    clean = df.where(lab.isin(0.0, 1.0)).select(
        lab.cast("int").alias(label_col), *[F.col(c).cast("string").try_cast("double").alias(c) for c in feats]
    )
    return clean, feats


def median_table(df: DataFrame, cols: Sequence[str], *, exact: bool = True, accuracy: int = 10_000) -> DataFrame:
    """L2: ``feature``, ``median`` (exact, interpolated, or approximate from a sketch)."""
    return _quantiles(_cells(df, cols), ["feature"], {"median": 0.5}, exact, accuracy)


def medians(df: DataFrame, cols: Sequence[str], **options) -> dict[str, float]:
    """The same as a dictionary; a value per column, so they are collected."""
    found = {r["feature"]: r["median"] for r in median_table(df, cols, **options).collect()}
    return {c: found.get(c) for c in cols}


def median_impute(df: DataFrame, med: dict[str, float]) -> DataFrame:
    return df.na.fill({c: float(v) for c, v in med.items() if v is not None})


def standard_scale(df: DataFrame, cols: Sequence[str], stats: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """L3: (x - mean) / population sd (sd 0 -> 1), statistics from ``df`` or given."""
    if stats is None:
        row = df.agg(*[x for c in cols for x in (F.avg(c).alias(f"{c}__m"), F.stddev_pop(c).alias(f"{c}__s"))]).first()
        stats = {c: (row[f"{c}__m"], row[f"{c}__s"]) for c in cols}
    exprs = {}
    for c in cols:
        m, s = stats[c]
        s = s if s else 1.0
        exprs[c] = (F.col(c) - F.lit(m or 0.0)) / F.lit(s)
    return df.withColumns(exprs)


def balanced_weights(df: DataFrame, label_col: str = "label", out: str = "weight") -> DataFrame:
    """L4: weight n / (2 * n_label) per row (two-row aggregate, broadcast)."""
    c = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("_nl"))
    total = F.sum("_nl").over(Window.partitionBy())
    w = c.withColumn(out, total / (F.lit(2.0) * F.col("_nl"))).drop("_nl")
    return df.join(F.broadcast(w), label_col)
