"""Exact quantiles of any number of values, by refining histograms.

A quantile is one or two ranks of its group.  A pass counts the values in
``BINS`` equal bins of the range a rank can lie in, with their least and
greatest value; the running count tells the rank's bin, whose values are the
range of the next pass.  When a range holds ``FEW`` values at most, or one value
over and over, the rank is read off.  Every aggregation combines before its
shuffle, and no task holds more than a range's bins or ``FEW`` values.

Each pass splits what is left into at least two parts and in general into
``BINS``: 10^12 values take three or four passes, and values that spread over
very many powers of ten one more for every three or four of these.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskscope.operators.joins import broadcast_if_small
from riskscope.session import cut_lineage

BINS = 4_096
FEW = 10_000
INF = float("inf")


def _bin(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """0..bins-1 within finite lo..hi, infinities beyond.  Halves don't overflow;
    where their difference is no number above zero, lo is parted from the rest."""
    share = F.try_divide(value * 0.5 - lo * 0.5, hi * 0.5 - lo * 0.5)
    at = F.coalesce(F.floor(share * bins), F.when(value <= lo, 0).otherwise(bins - 1))
    return F.when(value == -INF, -1).when(value == INF, bins).when(hi <= lo, 0).otherwise(F.least(at, F.lit(bins - 1))).cast("int")


def _same(names: Sequence[str], a: DataFrame, b: DataFrame) -> Column:
    return reduce(lambda x, y: x & y, [a[n].eqNullSafe(b[n]) for n in names], F.lit(True))


def rank_values(rows: DataFrame, ranks: DataFrame, keys: list[str], bins: int = BINS, few: int = FEW) -> DataFrame:
    """(``keys``, value) and (``keys``, ``rank``: from 0, below the group's
    count) -> (``keys``, ``rank``, ``value``).  ``rows`` is read once a pass."""
    finite = F.when(F.abs("value") < INF, F.col("value"))
    ends = rows.groupBy(*keys).agg(F.min(finite).alias("lo"), F.max(finite).alias("hi"), F.count(F.lit(1)).alias("n"))
    zero = F.lit(0.0)
    todo = ranks.join(ends, _same(keys, ranks, ends)).select(
        *[ranks[k] for k in keys], "rank", F.lit(0).cast("long").alias("below"), F.coalesce("lo", zero).alias("lo"), F.coalesce("hi", zero).alias("hi"), "n", F.lit(True).alias("first")
    )
    todo, done = cut_lineage(todo), None
    while True:
        wide = todo.where(F.col("n") > few)
        short = todo.where(F.col("n") <= few)
        got = _read_off(rows, short, keys)
        done = got if done is None else done.unionByName(got)
        if wide.isEmpty():
            return done
        # One histogram per range, however many ranks lie in it.
        spans = wide.select(*[F.col(k).alias(f"_{k}") for k in keys], "below", "lo", "hi", "first").distinct()
        inside = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.lit(True))
        inside = inside & (F.col("first") | F.col("value").between(F.col("lo"), F.col("hi")))
        counted = rows.join(broadcast_if_small(spans), inside).withColumn("bin", _bin(F.col("value"), F.col("lo"), F.col("hi"), bins))
        span = [f"_{k}" for k in keys] + ["below"]
        hist = counted.groupBy(*span, "bin").agg(F.count(F.lit(1)).alias("m"), F.min("value").alias("from"), F.max("value").alias("to"))
        upto = F.sum("m").over(Window.partitionBy(*span).orderBy("bin"))
        hist = hist.withColumn("start", F.col("below") + upto - F.col("m")).withColumnRenamed("below", "_below")
        match = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.col("below") == F.col("_below"))
        match = match & (F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + F.col("m"))
        todo = cut_lineage(
            wide.select(*keys, "rank", "below").join(hist, match).select(*keys, "rank", F.col("start").alias("below"), F.col("from").alias("lo"), F.col("to").alias("hi"), F.col("m").alias("n"), F.lit(False).alias("first"))
        )
        one = todo.where("lo = hi").select(*keys, "rank", F.col("lo").alias("value"))
        done, todo = done.unionByName(one), todo.where("lo < hi")


def _read_off(rows: DataFrame, todo: DataFrame, keys: list[str]) -> DataFrame:
    """Ranks whose range holds few values."""
    spans = todo.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("below").alias("_below"), "lo", "hi", "first").distinct()
    same = lambda: reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.lit(True))
    inside = same() & (F.col("first") | F.col("value").between(F.col("lo"), F.col("hi")))
    span = [f"_{k}" for k in keys] + ["_below"]
    each = rows.join(broadcast_if_small(spans), inside).groupBy(*span, "value").agg(F.count(F.lit(1)).alias("m"))
    start = F.col("_below") + F.sum("m").over(Window.partitionBy(*span).orderBy("value")) - F.col("m")
    each = each.withColumn("start", start)
    hit = same() & (F.col("below") == F.col("_below")) & (F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + F.col("m"))
    return todo.select(*keys, "rank", "below").join(each, hit).select(*keys, "rank", "value")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: Mapping[str, float], bins: int = BINS, few: int = FEW) -> DataFrame:
    """A row per group (null is a group) with a column per name of ``probs``:
    the exact quantile, interpolated between neighbouring ranks.  Nulls and
    NaN are left out; a group without values has null quantiles."""
    number = F.col(value).cast("double")
    rows = cut_lineage(df.select(*keys, number.alias("value")))
    groups = rows.groupBy(*keys).agg(F.count(F.when(F.col("value").isNotNull() & ~F.isnan("value"), 1)).alias("n"))
    rows = rows.where(F.col("value").isNotNull() & ~F.isnan("value"))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), ((F.col("n") - 1) * F.lit(float(p))).alias("at")) for name, p in probs.items()])
    points = cut_lineage(groups.where("n > 0").select(*keys, F.explode(wanted).alias("p")).select(*keys, "p.name", "p.at"))
    low, high = F.floor("at"), F.ceil("at")
    ranks = points.select(*keys, F.explode(F.array(low, high)).alias("rank")).distinct()
    found = cut_lineage(rank_values(rows, ranks, keys, bins, few))
    a = found.select(*[F.col(k).alias(f"_a{k}") for k in keys], F.col("rank").alias("_a"), F.col("value").alias("v0"))
    b = found.select(*[F.col(k).alias(f"_b{k}") for k in keys], F.col("rank").alias("_b"), F.col("value").alias("v1"))
    at = lambda side, rank: reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{side}{k}")) for k in keys], rank == F.col(f"_{side}"))
    points = points.join(a, at("a", low)).join(b, at("b", high))
    mixed = F.when((low == high) | (F.col("v0") == F.col("v1")), F.col("v0")).otherwise((high - F.col("at")) * F.col("v0") + (F.col("at") - low) * F.col("v1"))
    out = points.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, mixed)).alias(n) for n in probs])
    empty = groups.where("n = 0").select(*keys, *[F.lit(None).cast("double").alias(n) for n in probs])
    return out.unionByName(empty)
