"""Places and running sums in an order, with no task that sees a whole group.

Rows are range-partitioned by group and order, so that a large group lies in
several partitions; each partition numbers its rows in one streaming pass.  Only
the first group of a partition can have begun in an earlier one: what these
groups hold in earlier partitions (a row for each partition) is added by a
broadcast join on the partition's number.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskscope.llm.common import cut, free_name, ship


def changes(batch: pa.RecordBatch, names: Sequence[str], last: list | None) -> np.ndarray:
    """Where a row's group differs from that of the row before; ``last`` is the
    group before the batch (None: there is none)."""
    new = np.zeros(batch.num_rows, bool)
    for i, name in enumerate(names):
        col = batch.column(name)
        a, b = col.slice(1), col.slice(0, len(col) - 1)
        other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(a.is_null(), b.is_null()))
        new[1:] |= np.asarray(other)
        new[0] |= last is None or last[i] != col[0].as_py()
    if not names:
        new[0] = last is None
    return new


def group_of(batch: pa.RecordBatch, names: Sequence[str], row: int) -> list:
    return [batch.column(n)[row].as_py() for n in names]


def _numbered(group: list[str], sums: dict[str, str], place: str, part: str, head: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first_group = None, True
        carry = np.zeros(1 + len(sums), np.int64)  # rows and sums of the group so far
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = changes(batch, group, last)
            at = np.arange(n)
            start = np.maximum.accumulate(np.where(new, at, -1))  # first row of the group; -1: in an earlier batch
            old = start < 0
            columns = []
            for i, values in enumerate([np.ones(n, np.int64), *(np.asarray(batch.column(c)) for c in sums)]):
                total = np.concatenate([[0], np.cumsum(values)])
                running = total[1:] - total[np.maximum(start, 0)] + np.where(old, carry[i], 0)
                carry[i] = running[-1]
                columns.append(running)
            begun = np.cumsum(new)
            if last is None:
                begun -= 1  # the partition's first row begins its first group
            heads = (begun == 0) & first_group
            first_group = bool(heads[-1])
            last = group_of(batch, group, n - 1)
            added = [columns[0] - 1, *columns[1:]]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(x) for x in added), pa.array(heads)], names=[*batch.schema.names, place, *sums.values(), head]
            )

    return run


def scan(df: DataFrame, group: list[str], order: list[str], sums: dict[str, str] | None = None, place: str = "place", parts: int | None = None) -> DataFrame:
    """``df`` with ``place``, a row's number from 0 in its group by ``order``
    (nulls first; equal rows in any order), and for each ``column: name`` of
    ``sums`` the sum up to the row, itself included.  Summed columns are bigint
    without nulls.  ``df`` is read twice and must be a written table."""
    spark, names_out = ship(df.sparkSession), df.columns
    inner = {c: f"k{i}" for i, c in enumerate(names_out)}  # names without dots, which mapInArrow can't have
    new = {n: f"n{i}" for i, n in enumerate([place, *(sums or {}).values()])}
    back = [*names_out, *new]
    df, group, order = df.toDF(*inner.values()), [inner[c] for c in group], [inner[c] for c in order]
    sums, place = {inner[c]: new[n] for c, n in (sums or {}).items()}, new[place]
    uid, part, head = (free_name(df, x) for x in ("scan_uid", "scan_part", "scan_head"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn(uid, F.monotonically_increasing_id()).repartitionByRange(parts, *group, *order, uid)
    rows = rows.sortWithinPartitions(*group, *order, uid).drop(uid).withColumn(part, F.spark_partition_id())
    extra = [T.StructField(c, T.LongType()) for c in (place, *sums.values())] + [T.StructField(head, T.BooleanType())]
    rows = cut(rows.mapInArrow(_numbered(group, sums, place, part, head), T.StructType([*rows.schema.fields, *extra])))

    # What the groups at the partitions' heads hold in each partition; at most a row per partition and head.
    keys = [F.col(g).alias(f"head_{i}") for i, g in enumerate(group)]
    heads = rows.where(head).select(*keys).distinct()
    same = F.lit(True)
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"head_{i}"))
    held = (rows.join(F.broadcast(heads), same, "left_semi") if group else rows).groupBy(*group, part)
    ends = held.agg(F.max_by(F.struct((F.col(place) + 1).alias(place), *sums.values()), place).alias("end"))
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    names = [place, *sums.values()]
    offsets = ends.select(F.col(part).alias("offset_part"), *[F.sum(F.col("end")[c]).over(before).alias(f"offset_{i}") for i, c in enumerate(names)], F.row_number().over(Window.partitionBy(*group).orderBy(part)).alias("nth"))
    # A partition's head is the only group of it that isn't in its first partition.
    offsets = offsets.where("nth > 1").drop("nth")
    out = rows.join(F.broadcast(offsets), F.col(head) & (F.col(part) == F.col("offset_part")), "left")
    return out.withColumns({c: F.col(c) + F.coalesce(F.col(f"offset_{i}"), F.lit(0)) for i, c in enumerate(names)}).select(*df.columns, *names).toDF(*back)
