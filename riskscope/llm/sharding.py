"""Sharding by sampled splitters.

Rows are ordered by the hash of their text, then by id.  Splitters are
quantiles of a size-weighted sample of the hashes; ranges that turn out
overfull (one hot text) are divided again by splitters over hash and id.  From
the exact bytes of the ranges every row gets its place in the whole order, and
the shard whose equal share of all bytes holds its middle.  Rows of equal text
stay in one shard unless they are over ``whole_share`` of a shard.

Only DataFrame operations.  A window sees one range, or the table of ranges;
splitters number at most ``MAX_RANGES``.  The sample moves work between tasks
only: the result doesn't depend on it.

Defined results: a null text has size 16, crc 0 and is a group of its own;
equal rows may swap their slots; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskscope.llm.common import cut

OVERHEAD = 16  # bytes a row takes besides its text
RANGE_BYTES = 32 << 20
MAX_RANGES = 16_384
MAX_PARTS = 1_024  # of one overfull range
PER_RANGE = 16  # sampled keys
CELL_BITS = 10


def _copies(step) -> F.Column:
    """How often a row stands in the sample: its size over the step, rounded
    up or down by a hash."""
    u = F.xxhash64("uid", F.lit(11)).bitwiseAND((1 << 30) - 1) / float(1 << 30)
    return F.floor(F.col("size") / step + u).cast("long")


def _quantiles(sample: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The sampled keys at which another ``PER_RANGE`` copies are full."""
    run = F.sum("copies").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return sample.withColumn("run", run).where(F.floor(F.col("run") / PER_RANGE) > F.floor((F.col("run") - F.col("copies")) / PER_RANGE))


def ranged(rows: DataFrame, total: int, n_ranges: int, whole_bytes: float) -> DataFrame:
    """``rows`` with ``range`` (by splitters over ``k``), ``part`` (0, or by
    splitters over ``k``, ``id``, ``uid`` where the range is overfull) and
    ``hot``: of a text with over ``whole_bytes`` in an overfull range.  Only
    hot texts are divided, and there are at most total / whole_bytes of them."""
    share = max(total, 1) / n_ranges
    sample = rows.select("k", _copies(F.lit(share / PER_RANGE)).alias("copies")).where("copies > 0")
    splitters = _quantiles(sample, [], ["k"]).select("k").distinct()
    # Found by the leading bits of the key: 1,024 cells, each with its few splitters.
    shift, half = 64 - CELL_BITS, 1 << (CELL_BITS - 1)
    per_cell = splitters.groupBy(F.shiftright("k", shift).alias("cell")).agg(F.array_sort(F.collect_list("k")).alias("within"))
    cells = rows.sparkSession.range(-half, half).select(F.col("id").alias("cell")).join(per_cell, "cell", "left")
    cells = cells.withColumn("n", F.coalesce(F.when(F.col("within").isNotNull(), F.size("within")), F.lit(0)))
    cells = cells.withColumn("base", F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))
    within = F.coalesce(F.size(F.filter("within", lambda s: s <= F.col("k"))), F.lit(0))
    found = rows.withColumn("cell", F.shiftright("k", shift)).join(F.broadcast(cells), "cell")
    found = found.withColumn("range", (F.col("base") + F.when(F.col("n") > 0, within).otherwise(0)).cast("int")).drop("cell", "within", "n", "base")

    full = found.groupBy("range").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > 4 * share)
    full = full.withColumn("parts", F.least(F.lit(MAX_PARTS), F.ceil(F.col("bytes") / share)))
    hot = found.join(F.broadcast(full.select("range")), "range", "left_semi").groupBy("k").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > whole_bytes)
    found = found.join(F.broadcast(hot.select("k", F.lit(True).alias("hot"))), "k", "left").withColumn("hot", F.col("hot").isNotNull())
    again = found.join(F.broadcast(full), "range").withColumn("copies", _copies(F.col("bytes") / (F.col("parts") * PER_RANGE))).where("copies > 0")
    key = F.struct("k", F.when(F.col("hot"), F.col("id")).alias("id"), F.when(F.col("hot"), F.col("uid")).alias("uid"))
    inner = _quantiles(again.select("range", "k", "id", "uid", "hot", "copies"), ["range"], ["k", "id", "uid"]).groupBy("range").agg(F.collect_list(key).alias("inner"))
    part = F.size(F.filter("inner", lambda s: s <= key))
    return found.join(F.broadcast(inner), "range", "left").withColumn("part", F.when(F.col("inner").isNotNull(), part).otherwise(0)).drop("inner")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 40, whole_share: float = 0.05, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Per row: ``id_col``, ``size``, ``text_crc32``, ``law`` (`bytes`),
    ``shard``, ``slot`` and ``grown_shard`` (null under this law)."""
    text = F.col(text_col)
    rows = cut(
        docs.select(
            F.col(id_col).alias("id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("crc"),
            F.xxhash64(text).alias("k"),
            F.monotonically_increasing_id().alias("uid"),
        )
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    n_ranges = min(MAX_RANGES, max(8 * shards, -(-total // range_bytes)))
    at = ["range", "part"]
    inside = Window.partitionBy(*at).orderBy("k", "id", "uid")
    whole_bytes = whole_share * max(total, 1) / shards
    found = ranged(rows, total, n_ranges, whole_bytes)
    counted = found.withColumn("end", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    counted = counted.withColumn("row", F.row_number().over(inside))
    group = Window.partitionBy(*at, "k")
    counted = cut(counted.withColumns({"group_bytes": F.sum("size").over(group), "group_start": F.min(F.col("end") - F.col("size")).over(group)}))

    ahead = Window.orderBy(*at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = counted.groupBy(*at).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    ranges = ranges.select(*at, (F.sum("b").over(ahead) - F.col("b")).alias("bytes_before"), (F.sum("n").over(ahead) - F.col("n")).alias("rows_before"))
    whole = ~F.col("hot") & (F.col("group_bytes") <= whole_bytes)
    twice_mid = F.when(whole, 2 * F.col("group_start") + F.col("group_bytes")).otherwise(2 * F.col("end") - F.col("size")) + 2 * F.col("bytes_before")
    placed = counted.join(F.broadcast(ranges), at).withColumn("twice_mid", twice_mid)
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"(twice_mid * {shards}L) div {2 * max(total, 1)}L")).cast("int"))
    placed = placed.select("id", "size", "crc", "shard", (F.col("rows_before") + F.col("row") - 1).alias("place"))

    starts = placed.groupBy("shard").agg(F.min("place").alias("start"))
    return placed.join(F.broadcast(starts), "shard").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("place") - F.col("start")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
