"""Merkle manifest of a dataset, its proofs gathered by butterfly exchange.

Leaves of a group stand in order, ``FANOUT`` consecutive nodes make a parent
until one is left, and the groups' roots make the root in the same way.  Blocks
of ``FANOUT ** height`` leaves hash their own subtree in one task.  Then the
blocks exchange subtree roots: in round r the aligned groups of ``FANOUT``
subtrees of ``FANOUT ** r`` blocks swap their roots, each block with the block
at its own place in every other subtree, and every block hashes the parent
itself.  After the last round each block holds the root and all siblings above
it; nothing is sent down.  Where the last subtree has fewer blocks, the block
at the place modulo their number answers.

A task holds one block's digests; a round moves ``FANOUT`` digests per block.

Defined results: ids of null come first in their group, rows of one id in the
order of their digests; the null group comes first; equal rows are leaves each;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskscope.llm.common import checked_broadcast, cut, free_name, ship
from riskscope.llm.order import changes, group_of, scan

FANOUT = 16
LEVELS = 3
FAN_OUT_ROWS = 4_096  # of one message list
OUT_ROWS = 512  # rows of an output batch, some kilobytes each
PROOF = "array<struct<before:string,after:string>>"


def field(col: Column) -> Column:
    """``-`` for null, else byte count, colon and value."""
    text = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    """Digest of a row's columns."""
    return F.sha2(F.concat(*[field(c) for c in columns]).cast("binary"), 256)


def _digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def _parents(nodes: list[str]) -> list[str]:
    return [_digest("".join(nodes[i : i + FANOUT])) for i in range(0, len(nodes), FANOUT)]


def subtree(leaves: list[str], height: int | None) -> list[list[str]]:
    """Levels of a block's tree, its leaves first: ``height`` levels above them,
    or (None) as many as it takes to one node."""
    levels = [leaves]
    while len(levels[-1]) > 1 if height is None else len(levels) <= height:
        levels.append(_parents(levels[-1]))
    return levels


def _around(nodes: list[str], at: int) -> tuple[str, str]:
    """Digests before and after a node in its run."""
    run = at - at % FANOUT
    return "".join(nodes[run:at]), "".join(nodes[at + 1 : run + FANOUT])


def _batches_by_block(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[pa.RecordBatch]]:
    """Consecutive rows of equal ``names``, as slices of batches."""
    last, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        edges = np.flatnonzero(changes(batch, names, last)).tolist()
        for nth, (lo, hi) in enumerate(zip([0, *edges], [*edges, batch.num_rows], strict=True)):
            if nth and held:  # an edge ends the block before it
                yield held
                held = []
            if hi > lo:
                held.append(batch.slice(lo, hi - lo))
        last = group_of(batch, names, batch.num_rows - 1)
    if held:
        yield held


def _values(parts: list[pa.RecordBatch], name: str) -> list:
    return [x for p in parts for x in p.column(name).to_pylist()]


def _block_nodes(height: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(group, block, leaf) in order -> a row per block: its node as the only
        block of its group, and as one of several."""
        for parts in _batches_by_block(batches, ["g", "block"]):
            leaves = _values(parts, "leaf")
            g, block = group_of(parts[0], ["g", "block"], 0)
            ends = [pa.array([subtree(leaves, h)[-1][0]]) for h in (None, height)]
            yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([block], pa.int64()), *ends], names=["g", "block", "alone", "node"])

    return run


def _exchange(state: DataFrame, stride: int, parts: int) -> DataFrame:
    """One round: subtrees of ``stride`` blocks swap roots in runs of ``FANOUT``."""
    own = state.withColumn("j", F.floor(F.col("block") / stride)).withColumn("n", F.ceil(F.col("blocks") / stride))
    own = own.withColumn("open", F.col("n") > 1)
    size = F.least(F.lit(stride), F.col("blocks") - F.col("j") * stride)
    low = F.col("block") - F.col("j") * stride
    run = F.col("j") - F.col("j") % FANOUT
    sent = own.where("open").select("g", "blocks", "j", "node", run.alias("run"), F.least(run + FANOUT, F.col("n")).alias("stop"), low.alias("low"), size.alias("size"))
    # Places this block answers for: its own, in steps of its subtree's size; lists of bounded length.
    steps = F.floor((F.lit(stride) - 1 - F.col("low")) / F.col("size"))
    sent = sent.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(steps / FAN_OUT_ROWS))))
    sent = sent.withColumn("step", F.explode(F.sequence(F.col("chunk") * FAN_OUT_ROWS, F.least(steps, (F.col("chunk") + 1) * FAN_OUT_ROWS - 1))))
    sent = sent.withColumn("to", F.explode(F.sequence(F.col("run"), F.col("stop") - 1))).where("to <> j")
    sent = sent.withColumn("block", F.col("to") * stride + F.col("low") + F.col("step") * F.col("size")).where("block < blocks")
    none = lambda t: F.lit(None).cast(t)
    got = own.select("g", "block", "j", "node", "blocks", "proof", "open", F.lit(True).alias("mine"))
    got = got.unionByName(sent.select("g", "block", "j", "node", none("bigint").alias("blocks"), none(PROOF).alias("proof"), none("boolean").alias("open"), F.lit(False).alias("mine")))
    # Dealt here by name: where both sides of a union are dealt alike, Spark 4.1 takes
    # their partitions as aligned, also when each side's were merged in its own way;
    # then digests miss their block, and a group would lie in one task.
    met = got.repartition(parts, "g", "block").groupBy("g", "block").agg(
        F.max("blocks").alias("blocks"),
        F.first("proof", ignorenulls=True).alias("proof"),
        F.max("open").alias("open"),
        F.max(F.when(F.col("mine"), F.col("j"))).alias("j"),
        F.max(F.when(F.col("mine"), F.col("node"))).alias("node"),
        F.sort_array(F.collect_list(F.struct("j", "node"))).alias("run"),  # FANOUT at most
    )
    side = lambda keep: F.array_join(F.transform(F.filter("run", keep), lambda x: x["node"]), "")
    level = F.struct(side(lambda x: x["j"] < F.col("j")).alias("before"), side(lambda x: x["j"] > F.col("j")).alias("after"))
    parent = F.sha2(F.array_join(F.transform("run", lambda x: x["node"]), "").cast("binary"), 256)
    return met.select(
        "g", "block", "blocks",
        F.when(F.col("open"), F.concat("proof", F.array(level))).otherwise(F.col("proof")).alias("proof"),
        F.when(F.col("open"), parent).otherwise(F.col("node")).alias("node"),
    )


def climb(leaves: DataFrame, height: int) -> DataFrame:
    """(g, place, leaf) -> a row per block: ``g``, ``block``, ``blocks`` of the
    group, ``node`` (the group's root) and ``proof`` (the levels above the block)."""
    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = leaves.select("g", F.floor(F.col("place") / FANOUT**height).alias("block"), "place", "leaf")
    rows = rows.repartition(parts, "g", "block").sortWithinPartitions("g", "block", "place")
    nodes = cut(rows.mapInArrow(_block_nodes(height), "g string, block bigint, alone string, node string"))
    per = cut(nodes.groupBy("g").agg(F.count(F.lit(1)).alias("blocks")))
    most, n = per.agg(F.max("blocks"), F.count(F.lit(1))).first()
    state = nodes.join(checked_broadcast(per, n, 500), "g").select(
        "g", "block", "blocks", F.array().cast(PROOF).alias("proof"), F.when(F.col("blocks") == 1, F.col("alone")).otherwise(F.col("node")).alias("node")
    )
    stride = 1
    while stride < (most or 0):
        state = cut(_exchange(state, stride, parts))  # read twice in the next round
        stride *= FANOUT
    return cut(state) if stride == 1 else state


def _proofs(carry: list[str], height: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's own row (place -1: its upper proof), then its leaves."""
        for parts in _batches_by_block(batches, ["g", "block"]):
            up = parts[0].slice(0, 1)
            upper = up.column("proof")[0].as_py()
            blocks, subroot, root = group_of(up, ["blocks", "subroot", "root"], 0)
            parts[0] = parts[0].slice(1)
            levels = subtree(_values(parts, "leaf"), None if blocks == 1 else height)[:-1]
            at = 0
            for part in parts:
                for lo in range(0, part.num_rows, OUT_ROWS):
                    some = part.slice(lo, OUT_ROWS)
                    sides = [s for i in range(at, at + some.num_rows) for s in [*(_around(x, i // FANOUT**k) for k, x in enumerate(levels)), *((u["before"], u["after"]) for u in upper)]]
                    at += some.num_rows
                    pair = pa.StructArray.from_arrays([pa.array([s[k] for s in sides], pa.string()) for k in (0, 1)], names=["before", "after"])
                    edges = np.arange(some.num_rows + 1, dtype=np.int32) * (len(levels) + len(upper))
                    proof = pa.ListArray.from_arrays(pa.array(edges), pair)
                    ends = [pa.array([x] * some.num_rows, pa.string()) for x in (subroot, root)]
                    yield pa.RecordBatch.from_arrays([*(some.column(c) for c in (*carry, "leaf", "place")), *ends, proof], names=[*carry, "leaf", "place", "subroot", "root", "proof"])

    return run


def unfold(leaves: DataFrame, blocks: DataFrame, carry: list[str], height: int) -> DataFrame:
    """Leaves (g, place, leaf and ``carry``) with ``subroot``, ``root`` and
    ``proof`` of their block's row and their own levels below it."""
    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = leaves.select("g", F.floor(F.col("place") / FANOUT**height).alias("block"), "place", "leaf", *carry)
    heads = blocks.select("g", "block", F.lit(-1).cast("long").alias("place"), "blocks", "subroot", "root", "proof")
    both = heads.unionByName(rows, allowMissingColumns=True).repartition(parts, "g", "block").sortWithinPartitions("g", "block", "place")
    types = {f.name: f.dataType for f in leaves.schema.fields}
    schema = T.StructType([T.StructField(c, types[c]) for c in (*carry, "leaf", "place")] + [T.StructField(c, T.StringType()) for c in ("subroot", "root")])
    pair = T.StructType([T.StructField("before", T.StringType()), T.StructField("after", T.StringType())])
    return both.mapInArrow(_proofs(carry, height), schema.add("proof", T.ArrayType(pair)))


def manifest(rows: DataFrame, id_col: str = "doc_id", group_col: str = "source", leaf_col: str = "leaf", height: int = LEVELS) -> DataFrame:
    """``rows`` (slim: every column is carried through the shuffles) with
    ``slot`` (the leaf's place in its group), ``subroot``, ``root`` and ``proof``: for each
    level up to the root the joined digests before and after the node in its run."""
    ship(rows.sparkSession)
    plain = [f"c{i}" for i in range(len(rows.columns))]  # inner names can't clash with the caller's
    at = {c: p for c, p in zip(rows.columns, plain, strict=True)}
    # A key that orders like the group, null first.
    g = F.coalesce(F.concat(F.lit("="), F.col(at[group_col]).cast("string")), F.lit("-"))
    leaves = cut(rows.toDF(*plain).withColumn("g", g).withColumn("leaf", F.col(at[leaf_col])))
    leaves = cut(scan(leaves, ["g"], [at[id_col], "leaf"]))
    below = climb(leaves, height)
    roots = below.where("block = 0").select("g", F.col("node").alias("leaf"))
    n = roots.count()
    groups = cut(scan(roots.withColumn("source", F.col("g")).withColumn("g", F.lit("all")), ["g"], ["source"]))
    top = climb(groups, height).withColumn("subroot", F.col("node")).withColumnRenamed("node", "root")
    above = cut(unfold(groups, top, ["source"], height).select(F.col("source").alias("of"), "root", F.col("proof").alias("rest")))
    blocks = below.join(checked_broadcast(above, n, 5_000), F.col("g") == F.col("of")).select("g", "block", "blocks", F.col("node").alias("subroot"), "root", F.concat("proof", "rest").alias("proof"))
    out = unfold(leaves, blocks, plain, height)
    slot, taken = free_name(rows, "slot"), [free_name(rows, c) for c in ("subroot", "root", "proof")]
    return out.select(*[F.col(p).alias(c) for c, p in at.items()], F.col("place").alias(slot), *[F.col(c).alias(t) for c, t in zip(("subroot", "root", "proof"), taken, strict=True)])


def folded(leaf: Column, proof: Column) -> Column:
    """Root that a leaf and its proof make."""
    return F.aggregate(proof, leaf, lambda h, p: F.sha2(F.concat(p["before"], h, p["after"]).cast("binary"), 256))


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda p: F.concat(p["before"], p["after"])), "").cast("binary"), 256)
