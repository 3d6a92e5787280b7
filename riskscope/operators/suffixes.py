"""J1, U23, D1 with a public-suffix table of any size.

A host's candidate suffixes are its last 1, 2, ... labels, up to the deepest
rule.  Each is looked up in the rule table by a broadcast hash join: no
shuffle, so a host that holds a third of all rows costs what others cost, and
the plan has the same few nodes for ten rules or a hundred thousand.  A table
over ``BROADCAST_BYTES`` meets the distinct hosts by shuffle joins instead.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskscope import dictionaries as D
from riskscope.functions.urls import host_labels
from riskscope.operators.joins import join_skew_safe
from riskscope.session import cut_lineage

BROADCAST_BYTES = 16 << 20
TASK_ROWS, HOT_ROWS = 250_000, 50_000
KINDS = ("exact", "wildcard", "exception")


def suffix_table(rules: DataFrame) -> DataFrame:
    """Rules (``suffix``, ``kind``) -> a row per lower-case suffix with a flag per kind."""
    suffix = F.lower("suffix").alias("suffix")
    return rules.where(F.col("suffix").isNotNull()).groupBy(suffix).agg(*[F.max(F.col("kind") == k).alias(k) for k in KINDS])


def builtin_rules(spark: SparkSession, rules: Iterable[tuple[str, str]] = D.BUILTIN_SUFFIXES) -> DataFrame:
    return spark.createDataFrame(list(rules), "suffix string, kind string")


def _n_labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _last(host: Column, n: Column | int) -> Column:
    """The last ``n`` labels."""
    return F.call_function("substring_index", host, F.lit("."), -n if isinstance(n, Column) else F.lit(-n))


def _labels_by_broadcast(df: DataFrame, host: str, table: DataFrame, depth: int, out: str) -> DataFrame:
    """A broadcast join per depth, with the rules of that depth; wildcard ``p`` covers one label more than
    ``p``, exception ``e`` one less than ``e`` and wins."""
    n, kept = _n_labels(F.col(host)), df.columns
    for j in range(1, depth + 1):
        here = table.where(_n_labels(F.col("suffix")) == j).select(F.col("suffix").alias(f"_suffix{j}"), *[F.col(k).alias(f"_{k}{j}") for k in KINDS])
        df = df.join(F.broadcast(here), (n >= j) & (_last(F.col(host), j) == F.col(f"_suffix{j}")), "left")
    rule, exception = F.lit(0), F.lit(0)
    for j in range(1, depth + 1):  # the longest wins: later ones override
        rule = F.when((n > j) & F.col(f"_wildcard{j}"), j + 1).when(F.col(f"_exact{j}") & (rule < j), j).otherwise(rule)
        exception = F.when(F.col(f"_exception{j}"), j - 1).otherwise(exception)
    return df.select(*[f"`{c}`" for c in kept], F.when(exception > 0, exception).otherwise(rule).alias(out))


def _labels_by_shuffle(df: DataFrame, host: str, table: DataFrame, depth: int, out: str) -> DataFrame:
    """The same through the distinct hosts.  Tasks get about ``TASK_ROWS``
    candidates and rules each, whatever the input's size; suffixes that
    ``HOT_ROWS`` hosts end on meet their rule by broadcast."""
    hosts = cut_lineage(df.select(F.col(host).alias("_h")).where(F.col(host).isNotNull()).distinct())
    cand = hosts.withColumn("_n", _n_labels(F.col("_h")))
    cand = cand.withColumn("_j", F.explode(F.sequence(F.lit(1), F.least("_n", F.lit(depth))))).withColumn("suffix", _last(F.col("_h"), F.col("_j")))
    hot = F.broadcast(cut_lineage(cand.groupBy("suffix").agg(F.count(F.lit(1)).alias("_hosts")).where(F.col("_hosts") >= HOT_ROWS).select("suffix")))
    parts = (hosts.count() * depth + table.count()) // TASK_ROWS + 1
    warm = cand.join(hot, "suffix", "left_anti").repartition(parts, "suffix").join(table.repartition(parts, "suffix"), "suffix")
    found = warm.unionByName(cand.join(F.broadcast(table.join(hot, "suffix", "left_semi")), "suffix"))
    per = found.groupBy(F.col("_h").alias(host)).agg(
        F.max(F.when(F.col("exception") & (F.col("_j") > 1), F.col("_j") - 1)).alias("_exc"),
        F.max(F.greatest(F.when(F.col("exact"), F.col("_j")), F.when(F.col("wildcard") & (F.col("_n") > F.col("_j")), F.col("_j") + 1))).alias("_rule"),
    )
    return join_skew_safe(df, per.select(host, F.coalesce("_exc", "_rule").alias(out)), host).withColumn(out, F.coalesce(out, F.lit(0))).select(*df.columns, out)


def with_suffix_labels(df: DataFrame, host: str, table: DataFrame, out: str = "suffix_labels", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with the number of labels of the host's public suffix (0: none).
    ``table`` is a :func:`suffix_table`."""
    size, depth = table.agg(F.sum(F.octet_length("suffix") + 64), F.max(_n_labels(F.col("suffix")))).first()
    if not depth:
        return df.withColumn(out, F.lit(0))
    join = _labels_by_broadcast if size <= broadcast_bytes else _labels_by_shuffle
    return join(df, host, table, depth, out).withColumn(out, F.when(F.coalesce(F.col(host), F.lit("")) == "", 0).otherwise(F.col(out)))


def registered(host: Column, labels: Column) -> Column:
    """One label more than the suffix; the host where there is none."""
    return F.when((labels > 0) & (_n_labels(host) > labels), _last(host, labels + 1)).otherwise(host)


def with_registered_domain(df: DataFrame, host: str, table: DataFrame, out: str = "registered_domain", **options) -> DataFrame:
    """U23 over a rule table."""
    found = with_suffix_labels(df, host, table, "_suffix_labels", **options)
    return found.withColumn(out, registered(F.col(host), F.col("_suffix_labels"))).drop("_suffix_labels")


def lookup(host: Column, suffix_labels: Column) -> Column:
    """U23, but without a known suffix the last three labels of ``x.co.uk``
    shapes, else the last two."""
    labels = host_labels(host)
    second = (F.size(labels) >= 3) & (F.length(F.element_at(labels, -1)) == 2) & F.element_at(labels, -2).isin(*D.COMMON_SECOND_LEVEL)
    guess = F.when(second, F.array_join(F.slice(labels, -3, 3), ".")).when(F.size(labels) >= 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(host)
    return F.when((suffix_labels > 0) & (_n_labels(host) > suffix_labels), _last(host, suffix_labels + 1)).otherwise(guess)


def with_lookup_domain(df: DataFrame, host: str, table: DataFrame, out: str = "lookup_domain", **options) -> DataFrame:
    """D1 over a rule table."""
    found = with_suffix_labels(df, host, table, "_suffix_labels", **options)
    return found.withColumn(out, lookup(F.col(host), F.col("_suffix_labels"))).drop("_suffix_labels")
