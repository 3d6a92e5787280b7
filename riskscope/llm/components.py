"""Connected components of an edge table, wholly in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskscope.llm.common import cut

HUB = 100_000  # rows of one key
MAX_HUBS = 100_000  # keys that are broadcast


def meet(rows: DataFrame, low: DataFrame, key: str, n_rows: int) -> DataFrame:
    """``rows`` joined to ``low``, which has one row per ``key`` and the number
    ``n`` of the key's rows.  Keys with over ``HUB`` rows, or over one part in
    ``MAX_HUBS`` of all, go out by broadcast (so they number ``MAX_HUBS`` at
    most) and their rows stay where they are; no task gets a whole hub."""
    values = low.drop("n")
    if n_rows <= HUB:
        return rows.join(values, key)
    hubs = low.where(F.col("n") > max(HUB, n_rows // MAX_HUBS)).drop("n")
    rest = rows.join(F.broadcast(hubs.select(key)), key, "left_anti").join(values, key)
    return rest.unionByName(rows.join(F.broadcast(hubs), key))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").bitwiseAND(0xFFFFFFFF))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node``, ``root`` for every node of an edge: root is the smallest node
    that can be reached.

    Large-star and small-star rounds (every larger neighbour, then every
    smaller one, is tied to the smallest neighbour) until the edges rest; the
    number of rounds grows with the logarithm of the longest path.  Only
    minima are aggregated, so no neighbour list is ever collected, and the
    edges of a hub meet its minimum without a shuffle (``meet``).  Each round
    is checkpointed in the shared folder.  Self links are dropped; repeated
    links count once; an empty table gives an empty table."""
    now = cut(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .distinct()
    )
    state = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = meet(both.where("b > a"), low, "a", 2 * state[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = meet(large, low, "a", state[0]).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = cut(small.select("e.a", "e.b").where("a != b").distinct())
        last, state = state, _state(now)
        if state == last:
            break
    roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
