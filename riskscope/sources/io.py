"""Readers and writers (S1-S6) and the public-suffix list loader.

Readers use explicit all-string schemas (no inference pass) and keep the
position of each line where order matters: the file and the record's number in
it (CSV), or a monotonically increasing id (URL lists); later steps never depend
on partition order.
"""

from __future__ import annotations

import csv
import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskscope.functions.urls import normalize_url
from riskscope.session import cut_lineage

def _with_line(df: DataFrame) -> DataFrame:
    """Position inside the source: (file, id) -- ``monotonically_increasing_id``
    grows with the split order and the row order inside a split."""
    return df.withColumn("line", F.monotonically_increasing_id())


def _ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the files under ``path`` with their place: ``source_dataset`` (the file),
    ``block`` (start of the split) and ``i`` (growing within the split).  Hadoop's
    line reader gives a line to the split in which it starts."""
    meta = F.col("_metadata")
    return spark.read.text(path).select(
        F.col("value"), meta["file_path"].alias("source_dataset"), meta["file_block_start"].alias("block"),
        F.monotonically_increasing_id().alias("i"),
    )


def read_quoted_csv(spark: SparkSession, path: str) -> DataFrame:
    """Records of CSV files whose quoted fields may hold line breaks, without
    reading a file in one task: ``source_dataset``, ``record`` (text), ``line``
    (number of the record in its file; 0 is the header).

    A line starts a record where an even number of quotes stands before it in the
    file (a doubled quote counts two).  Quotes and lines are summed per split, the
    sums (one row a split) run on per file, and within a split a window counts on;
    so no window holds more than a split.  A record cut by a split's end is put
    together by its number.  ``\\r\\n`` inside quotes becomes ``\\n``.  Blank lines
    between records are dropped.  Quotes belong around fields only, doubled inside
    them; one that is never closed takes the rest of its file into one record."""
    # The places must not change between the passes: written once.
    lines = cut_lineage(_ordered_lines(spark, path).withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))))
    file, block = F.col("source_dataset"), F.col("block")
    split = lines.groupBy(file, block).agg(F.sum("quotes").alias("_q"))
    before = Window.partitionBy(file).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    parity = split.select(file, block, F.coalesce(F.sum("_q").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(file, block).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    odd = (F.coalesce(F.sum("quotes").over(inside), F.lit(0)) + F.col("_before")) % 2
    # One row a split: at most the number of input splits.
    marked = cut_lineage(lines.join(F.broadcast(parity), ["source_dataset", "block"]).withColumn("_starts", (odd == 0) & (F.trim("value") != "")).withColumn("_open", odd == 1))
    marked = marked.where(F.col("_starts") | F.col("_open"))
    started = marked.groupBy(file, block).agg(F.sum(F.col("_starts").cast("long")).alias("_s"))
    first = started.select(file, block, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_first"))
    upto = Window.partitionBy(file, block).orderBy("i")
    numbered = marked.join(F.broadcast(first), ["source_dataset", "block"]).withColumn(
        "line", F.col("_first") + F.sum(F.col("_starts").cast("long")).over(upto) - 1
    )
    parts = F.array_sort(F.collect_list(F.struct("block", "i", "value")))["value"]
    return numbered.groupBy("source_dataset", "line").agg(F.array_join(parts, "\n").alias("record"))


def read_reference_csvs(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Read labelled CSV files; files without ``url``/``label`` columns
    are skipped; keep ``url, label, text_content`` (missing -> '') and add
    ``source_dataset`` (the path) and ``line`` (the record's number in its file).
    Files are split by :func:`read_quoted_csv`, so a large one takes many tasks;
    (``source_dataset``, ``line``) is the order of the files.  A short row has
    nulls for what it lacks.  Headers may differ: they are few and small."""
    frames = []
    for path in paths:
        records = read_quoted_csv(spark, path)
        heads = records.where("line = 0").select("source_dataset", "record").collect()  # one row a file
        for names, files in _by_header(heads).items():
            if "url" not in names or "label" not in names:
                continue
            kinds = ", ".join(f"c{i} string" for i in range(len(names)))
            rows = records.where((F.col("line") > 0) & F.col("source_dataset").isin(files))
            # multiLine: a quoted line break is part of the one record that is parsed here.
            row = F.from_csv("record", kinds, {"escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"})
            field = lambda c: row[f"c{names.index(c)}"]
            text = F.coalesce(field("text_content"), F.lit("")) if "text_content" in names else F.lit("")
            source = F.lit(str(path)) if len(heads) == 1 else F.col("source_dataset")
            frames.append(rows.select(field("url").alias("url"), field("label").alias("label"), text.alias("text_content"), source.alias("source_dataset"), "line"))
    if not frames:
        raise FileNotFoundError("No usable reference CSV files found")
    return reduce(DataFrame.unionByName, frames)


def _by_header(heads) -> dict[tuple[str, ...], list[str]]:
    """Files of each header."""
    out: dict[tuple[str, ...], list[str]] = {}
    for r in heads:
        names = next(csv.reader([r["record"].lstrip("﻿")]))
        out.setdefault(tuple(names), []).append(r["source_dataset"])
    return out


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """One URL per line (trimmed, blanks dropped) or a CSV with a ``url``
    column (NULLs dropped; error if the column is missing); normalised (U1),
    empties dropped."""
    if path.lower().endswith(".csv"):
        df = spark.read.option("header", True).csv(path)
        if "url" not in df.columns:
            raise ValueError("Input CSV must contain a 'url' column.")
        df = df.select(F.col("url").cast("string")).where(F.col("url").isNotNull())
    else:
        df = spark.read.text(path).select(F.trim(F.col("value")).alias("url")).where(F.col("url") != "")
    return _with_line(df.select(normalize_url(F.col("url")).alias("url"))).where(F.col("url") != "").withColumnRenamed("line", "pos")


def read_feed_lines(spark: SparkSession, path: str) -> DataFrame:
    """S3: a plain feed, one URL per line (trimmed, blanks dropped)."""
    df = spark.read.text(path).select(F.trim(F.col("value")).alias("url")).where(F.col("url") != "")
    return _with_line(df).withColumnRenamed("line", "pos")


def read_feed_csv(spark: SparkSession, path: str) -> DataFrame:
    """S3: a ``#``-commented CSV feed; rows with at least three fields whose
    third field starts with ``http://``/``https://``."""
    # A fixed width: shorter rows get nulls, longer ones lose what follows.
    raw = spark.read.option("comment", "#").schema("first string, second string, url string").csv(path)
    url = F.col("url")
    df = raw.where(url.startswith("http://") | url.startswith("https://")).select("url")
    return _with_line(df).withColumnRenamed("line", "pos")


def read_suffix_rules(spark: SparkSession, path: str, icann_only: bool = True) -> DataFrame:
    """Rules of a public-suffix list file as rows (``suffix``, ``kind``), for
    :func:`riskscope.operators.suffixes.suffix_table`."""
    lines = spark.read.text(path).select(F.trim(F.col("value")).alias("v"), F.monotonically_increasing_id().alias("i"))
    if icann_only:
        end = lines.where(F.col("v").startswith("// ===END ICANN DOMAINS===")).agg(F.min("i")).first()[0]
        if end is not None:
            lines = lines.where(F.col("i") < end)
    rule = F.lower(F.split("v", r"\s")[0])
    kind = F.when(rule.startswith("!"), "exception").when(rule.startswith("*."), "wildcard").otherwise("exact")
    return lines.where((F.col("v") != "") & ~F.col("v").startswith("//")).select(
        F.when(kind == "exception", F.substr(rule, F.lit(2))).when(kind == "wildcard", F.substr(rule, F.lit(3))).otherwise(rule).alias("suffix"), kind.alias("kind")
    )


def read_public_suffix_list(spark: SparkSession, path: str, icann_only: bool = True) -> list[tuple[str, str]]:
    """The same as ``(suffix, kind)`` tuples for
    :func:`riskscope.functions.urls.registered_domain`, which writes the rules
    into the plan: for short lists."""
    rules = read_suffix_rules(spark, path, icann_only)
    n = rules.count()
    if n > 2_000:
        raise ValueError(f"suffix list too large for a column expression: {n} rules; use riskscope.operators.suffixes")
    return [(r.suffix, r.kind) for r in rules.collect()]


def write_csv(df: DataFrame, path: str) -> None:
    """Header CSV, UTF-8."""
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def report_lines(evaluation: DataFrame) -> DataFrame:
    """Markdown report as rows (``section``, ``ord``, ``line``): title,
    three summary lines, table header, one row per prediction."""
    summ = evaluation.agg(
        F.sum("correct").alias("c"),
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("expected_label") == 0, F.col("correct"))).alias("lc"),
        F.sum((F.col("expected_label") == 0).cast("int")).alias("ln"),
        F.sum(F.when(F.col("expected_label") == 1, F.col("correct"))).alias("sc"),
        F.sum((F.col("expected_label") == 1).cast("int")).alias("sn"),
    )
    head = summ.select(
        F.posexplode(
            F.array(
                F.lit("# Real Site Prediction Results"),
                F.lit(""),
                F.format_string("- Total: %d/%d correct", F.col("c"), F.col("n")),
                F.format_string("- Legit: %d/%d correct", F.coalesce(F.col("lc"), F.lit(0)), F.col("ln")),
                F.format_string("- Scam: %d/%d correct", F.coalesce(F.col("sc"), F.lit(0)), F.col("sn")),
                F.lit(""),
                F.lit("| Expected | Predicted | Correct | Confidence | URL |"),
                F.lit("|---|---|---:|---:|---|"),
            )
        ).alias("ord", "line")
    ).withColumn("section", F.lit(0))
    rows = evaluation.select(
        F.lit(1).alias("section"),
        F.col("url").alias("ord_key"),
        F.format_string(
            "| %s | %s | %s | %.2f%% | %s |",
            F.col("expected_name"),
            F.col("predicted_name"),
            F.when(F.col("correct") == 1, "yes").otherwise("no"),
            F.col("confidence") * 100,
            F.col("url"),
        ).alias("line"),
    )
    return head.select("section", F.col("ord").cast("string").alias("ord_key"), "line").unionByName(rows)


def write_report_md(evaluation: DataFrame, path: str) -> None:
    """Write the Markdown report as one text file (lines ordered by
    section, then position / URL)."""
    report_lines(evaluation).orderBy("section", "ord_key").select("line").coalesce(1).write.mode("overwrite").text(path)


def write_report_json(spark: SparkSession, report: dict, path: str) -> None:
    """Training report (rows, features, best model, CV rows, holdout
    metrics) as one JSON document."""
    spark.createDataFrame([(json.dumps(report, indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(path)
