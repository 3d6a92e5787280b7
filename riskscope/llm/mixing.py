"""Mixing sources to target weights by Sainte-Laguë apportionment.

The mix is cut into equal-token blocks, one for every word, at every size.
Sources get blocks by highest quotients target / (2j + 1), then each source's
blocks go to its shards by the shards' sizes in the same way.  All but the last
few blocks follow from a formula, so their number costs nothing; blocks beyond
twice a size pass to the others.  In a shard the documents stand in a seeded
order and the mix takes the words of its quota of blocks from the front, going
round at most twice, so that at most one document per shard is taken in part.

Only DataFrame operations.  Windows see one range of the order in a shard of
one source (``RANGE_ROWS`` rows or so, whatever the input's size and however
often an id, or none, stands in it), the table of
these ranges' sizes, that of the sources, or about two quotients for each
source, or for each shard of one.

Defined results: a null text has size 0 and is never taken; null sources are
one source, the last; equal rows may swap their shares; a table without words
gives targets and taken words of 0; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskscope.llm.common import WORD_PATTERN, checked_broadcast, cut, free_name

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SHARDS = 64
NEAR = 1e-9  # of a quotient: more than doubles are off
RANGE_ROWS = 50_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """``place``, ``source_size`` of every source -> also ``target``.  Targets
    follow the weights and stop at twice the source's size: with sources in
    the order of size / weight, the level is that of the first source which
    its share of what is left doesn't exceed."""
    cap, everything = MOST * F.col("source_size"), Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.col("place") - 1) % len(WEIGHTS) + 1).cast("int"))
    by = Window.orderBy("most", "place")
    out = sources.withColumn("weight", weight).withColumn("most", cap / F.col("weight"))
    out = out.withColumn("before", F.sum(cap).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - cap)
    out = out.withColumn("ahead", F.sum("weight").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    level = (F.lit(SHARE) * F.sum("source_size").over(everything) - F.col("before")) / F.col("ahead")
    out = out.withColumn("level", level)
    out = out.withColumn("level", F.max(F.when(F.col("level") <= F.col("most"), F.col("level"))).over(everything))
    return out.withColumn("target", F.least(cap.cast("double"), F.col("level") * F.col("weight"))).select("place", "source_size", "target")


def apportioned(rows: DataFrame, by: list[str], weight: Column, seats: Column, whole: Column, n: int, order: list[str], room: Column) -> DataFrame:
    """``rows`` with ``won``: of the ``seats`` of its group ``by``, those of the
    highest quotients weight / (2j + 1).  A group has at most ``n`` rows, whose
    weights sum to ``whole``.  Seats over ``room`` pass to the rows with most
    room left."""
    group, weight = Window.partitionBy(*by), weight.cast("double")
    # At least ``seats`` quotients reach the lower bound, as each row has more than (weight / bound - 1) / 2 of them, and at most ``seats`` the upper.
    reach = lambda bound: F.floor((weight / bound + 1) / 2).cast("long")
    some = (weight > 0) & (seats > 0)
    rows = rows.withColumn("sure", F.when(some & (2 * seats > n), reach(whole / (2 * seats - n) * (1 + NEAR))).otherwise(F.lit(0).cast("long")))
    rows = rows.withColumn("left", seats - F.sum("sure").over(group))
    upto = reach(whole / (2 * seats + n) * (1 - NEAR))
    near = rows.where(some).where(upto > F.col("sure")).withColumn("j", F.explode(F.sequence(F.col("sure"), upto - 1)))
    best = Window.partitionBy(*by).orderBy((weight / (2 * F.col("j") + 1)).desc(), *order, "j")
    more = near.withColumn("n", F.row_number().over(best)).where(F.col("n") <= F.col("left"))
    key = list(dict.fromkeys([*by, *order]))
    more = more.groupBy(*key).agg(F.count(F.lit(1)).alias("more"))
    rows = rows.join(more, key, "left").withColumn("got", F.col("sure") + F.coalesce("more", F.lit(0)))
    rows = rows.withColumn("spare", F.greatest(F.lit(0), room - F.col("got")))
    over = F.sum(F.greatest(F.lit(0), F.col("got") - room)).over(group)
    ahead = F.sum("spare").over(Window.partitionBy(*by).orderBy(F.col("spare").desc(), *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("spare")
    rows = rows.withColumn("passed", F.least(F.col("spare"), F.greatest(F.lit(0), over - ahead)))
    return rows.withColumn("won", F.least(F.col("got"), room) + F.col("passed")).drop("sure", "left", "more", "got", "spare", "passed")


def prefix_digits(n_rows: int, shards: int, range_rows: int) -> int:
    """Leading digits of the key whose ranges hold about ``range_rows`` rows.
    The first four digits tell the shard too: they and it make 16^4 ranges."""
    digits = 0
    while digits < 12 and n_rows > range_rows * max(min(shards * 16**digits, 16**4), 16**digits):
        digits += 1
    return digits


def ranged(sized: DataFrame, shards: int, range_rows: int) -> DataFrame:
    """``sized`` with ``range``, a stretch of the order by key, id and size.  A
    key of over ``range_rows`` rows (null, or one id repeated) has a range for
    every size, and rows that are equal in all of them are dealt by ``uid``."""
    digits = prefix_digits(sized.count(), shards, range_rows)
    often = sized.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > range_rows)
    keys = sorted(r.key for r in often.collect())  # at most a row for every ``range_rows``
    prefix, no = F.substring("key", 1, digits), F.lit(0).cast("long")
    if not keys:
        return sized.withColumn("range", F.struct(prefix.alias("prefix"), no.alias("stretch"), no.alias("known"), no.alias("of_size"), no.alias("deal")))
    known = F.col("id").isNotNull().cast("long")
    below = F.size(F.filter(F.array(*map(F.lit, keys)), lambda k: k < F.col("key"))).cast("long")
    hot = F.col("key").isin(keys)
    alike = sized.where(hot).groupBy(F.col("key").alias("of_key"), F.col("size").alias("alike_size")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > range_rows)
    out = sized.join(F.broadcast(alike), (F.col("key") == F.col("of_key")) & (F.col("size") == F.col("alike_size")), "left")
    deal = F.coalesce(F.pmod(F.xxhash64("uid"), F.ceil(F.col("n") / range_rows)), no)
    parts = [(2 * below + hot.cast("long")).alias("stretch"), *(F.when(hot, x).otherwise(no).alias(a) for x, a in ((known, "known"), (F.col("size"), "of_size"), (deal, "deal")))]
    return out.withColumn("range", F.struct(prefix.alias("prefix"), *parts)).drop("of_key", "alike_size", "n")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, shards: int = SHARDS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Per row: ``id_col``, ``size``, ``source_size``, ``target`` and ``taken``."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    sized = cut(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), key.alias("key"), F.monotonically_increasing_id().alias("uid"))
        .withColumn("shard", (F.conv(F.substring("key", 1, 4), 16, 10).cast("int") % shards))
    )
    sized = ranged(sized, shards, range_rows)
    ranges = cut(sized.groupBy("source", "shard", "range").agg(F.sum("size").alias("range_size")))
    cells = ranges.groupBy("source", "shard").agg(F.sum("range_size").alias("cell_size"))
    sources = cells.groupBy("source").agg(F.sum("cell_size").alias("source_size"))
    places = sources.select("source", "source_size", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).alias("place"))
    placed = cut(places.join(targets(places.select("place", "source_size")).drop("source_size"), "place"))
    n_sources, total = placed.agg(F.count(F.lit(1)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    seats = max(1, int(SHARE * total))
    room = lambda size: MOST * F.col(size)

    # Blocks to sources, then a source's blocks to its shards.
    quotas = apportioned(placed, [], F.col("target"), F.lit(seats).cast("long"), F.lit(max(SHARE * total, 1.0)), n_sources, ["place"], room("source_size")).withColumnRenamed("won", "quota")
    quotas = checked_broadcast(cut(quotas), n_sources, 100)
    parts = cells.join(quotas, cells.source.eqNullSafe(quotas.source)).select(cells.source, "place", "shard", "cell_size", "source_size", "target", "quota")
    shares = apportioned(parts, ["place"], F.col("cell_size"), F.col("quota"), F.col("source_size"), shards, ["shard"], room("cell_size"))
    shares = shares.withColumnRenamed("won", "words").drop("quota")
    shares = checked_broadcast(cut(shares).withColumnRenamed("source", "of"), n_sources * shards, 100)

    # Words before a row in its shard: those of the ranges before its own, and those before it in its range.
    shard, rank = Window.partitionBy("place", "shard").orderBy("range"), Window.partitionBy("place", "shard", "range").orderBy("key", "id", "size")
    upto = [w.rowsBetween(Window.unboundedPreceding, Window.currentRow) for w in (shard, rank)]
    in_shard = F.col("source").eqNullSafe(F.col("of")) & (F.col("shard") == F.col("in"))
    shares = shares.withColumnRenamed("shard", "in")
    offsets = ranges.join(shares.select("of", "in", "place"), in_shard).withColumn("ahead", F.sum("range_size").over(upto[0]) - F.col("range_size"))
    out = sized.join(shares, in_shard).withColumn("end", F.sum("size").over(upto[1]))
    out = out.join(offsets.select("place", "shard", "range", "ahead"), ["place", "shard", "range"]).withColumn("end", F.col("end") + F.col("ahead"))
    rounds = F.when(F.col("cell_size") > 0, F.floor(F.col("words") / F.col("cell_size"))).otherwise(0).cast("long")
    rest = F.col("words") - rounds * F.col("cell_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("end") - F.col("size"))))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (rounds * F.col("size") + part).cast("long").alias("taken"))


def repeat_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them, to the nearest whole
    document; rows it takes less than half of are left out."""
    name, times, again, size, of_size = (free_name(docs, x) for x in ("mix_id", "mix_times", "mix_again", "mix_size", "mix_of_size"))
    # One count per id and size: rows that repeat an id share what they were given.
    taken = mix(docs, id_col, text_col, source_col, **options)
    per = taken.where("taken > 0").groupBy(F.col(id_col).alias(name), "size").agg(F.round(F.avg(F.col("taken") / F.col("size"))).cast("int").alias(times))
    out = docs.withColumn(size, n_words(F.col(text_col))).join(
        per.withColumnRenamed("size", of_size), F.col(f"`{id_col}`").eqNullSafe(F.col(name)) & (F.col(size) == F.col(of_size))
    )
    return out.withColumn(again, F.explode(F.sequence(F.lit(1), F.col(times)))).where(F.col(times) > 0).select(*[f"`{c}`" for c in docs.columns])
