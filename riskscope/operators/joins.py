"""Join helpers with explicit skew handling and size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest number of rows we ever ship to every executor.
MAX_BROADCAST_ROWS = 2_000_000


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only after checking the row count (one cheap action on
    a dimension-sized input); otherwise the planner picks a shuffle join."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def join_skew_safe(
    left: DataFrame,
    right_unique: DataFrame,
    key: str,
    how: str = "left",
    *,
    hot_key_rows: int = 100_000,
    max_hot_keys: int = MAX_BROADCAST_ROWS,
    hot_keys: DataFrame | None = None,
    nulls: bool = True,
) -> DataFrame:
    """Join a large ``left`` to a ``right_unique`` table (one row per key)
    without letting a hot key land in one task.

    Keys with at least ``hot_key_rows`` left rows are found by a partial
    aggregation (map-side combine, so the count itself is not skewed).
    Their right rows number at most ``rows / hot_key_rows`` and go out by
    broadcast; the hot left rows then join locally with no shuffle.  The
    remaining keys take an ordinary shuffle join.  ``hot_keys`` may be given
    when the caller already knows the key counts (e.g. a document
    frequency), which saves the counting pass; ``nulls=False`` says that no
    left key is null, which saves the pass over these rows."""
    apart = how == "left" and nulls
    if apart:  # null keys match nothing: they need no shuffle, let alone one partition
        alone = left.where(F.col(key).isNull())
        for name, kind in right_unique.drop(key).dtypes:
            alone = alone.withColumn(name, F.lit(None).cast(kind))
    if apart or how != "left":
        left = left.where(F.col(key).isNotNull())
    if hot_keys is None:
        counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= hot_key_rows)
        # The hottest keys up to the bound of what is broadcast.
        hot = counts.orderBy(F.col("_n").desc(), key).limit(max_hot_keys).select(key)
    else:
        hot = hot_keys.limit(max_hot_keys)
    if hot.isEmpty():
        joined = left.join(right_unique, key, how)
        return joined.unionByName(alone.select(joined.columns)) if apart else joined
    hot_b = F.broadcast(hot)
    left_hot = left.join(hot_b, key, "left_semi")
    left_cold = left.join(hot_b, key, "left_anti")
    right_hot = F.broadcast(right_unique.join(hot_b, key, "left_semi"))
    joined = left_cold.join(right_unique, key, how).unionByName(left_hot.join(right_hot, key, how))
    return joined.unionByName(alone.select(joined.columns)) if apart else joined
