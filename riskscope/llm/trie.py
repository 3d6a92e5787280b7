"""Prefix trie of conversations: double-array tries per prefix shard.

A conversation is a sequence of turns, a turn the digest of role and text.  A
prefix has a fingerprint, the running sums of hashes of turn and depth, which
come from one pass in the order of conversations (``order.scan``), so that a
conversation of any length lies in several tasks.  Conversations that are equal
as a whole go on as one, with their number.

A node with over ``SUBTREE_ROWS`` turns at or below it is an upper node; the
subtrees below them are dealt to prefix shards.  A shard numbers its turns
densely, packs BASE and CHECK level by level, walks all its sequences through
them and sums up from the leaves.  Upper nodes belong to several shards: their
members are counted over all rows, and what lies below them is merged from the
rows of the smallest member, which passes every ancestor just once.

Tasks hold one shard, ``SHARD_ROWS`` turns or so, whatever shares a prefix; the
ids of equal conversations are joined in pieces of ``PIECE`` bytes.

Defined results: rows without an id take no part; turns of null come first,
equal turn numbers in the order of their digests; repeated rows are turns of
their own; null role or text is empty; an empty table gives an empty table, not
even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskscope.llm.common import checked_broadcast, cut, ship
from riskscope.llm.order import changes, group_of, scan

SUBTREE_ROWS = 4_096
SHARD_ROWS = 20_000
PIECE = 1 << 20
TRIES = 64
PRINT = ["p0", "p1", "p2", "p3"]
NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends bigint, top boolean"


class DoubleArray:
    """State s goes by id x to BASE[s] + x if CHECK there is s.  State 0 is the
    root; free places have CHECK -1."""

    def __init__(self) -> None:
        self.base, self.check, self.low = np.zeros(1, np.int64), np.full(1, -2, np.int64), 1

    def _reserve(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _put(self, parent: int, ids: np.ndarray) -> None:
        """The children of one state at the first place that fits."""
        ids = np.sort(ids)
        for slot in (np.flatnonzero(self.check[self.low :] == -1)[:TRIES] + self.low).tolist():
            spots = slot - ids[0] + ids
            if spots[-1] < len(self.check) and (self.check[spots] == -1).all():
                break
        else:
            spots = len(self.check) - ids[0] + ids
            self._reserve(int(spots[-1]) + 1)
        self.base[parent], self.check[spots] = spots[0] - ids[0], parent

    def add(self, parents: np.ndarray, ids: np.ndarray) -> None:
        """Children of a level: distinct (state, id), by state."""
        first = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]]))
        count = np.diff(np.concatenate([first, [len(parents)]]))
        several = np.flatnonzero(count > 1)
        for i in several[np.argsort(-count[several], kind="stable")].tolist():
            self._put(int(parents[first[i]]), ids[first[i] : first[i] + count[i]])
        single = first[count == 1]  # fits anywhere: the lowest free places
        free = np.flatnonzero(self.check[self.low :] == -1)[: len(single)] + self.low
        if len(free) < len(single):
            end = len(self.check)
            self._reserve(end + len(single) - len(free))
            free = np.concatenate([free, np.arange(end, end + len(single) - len(free))])
        self.base[parents[single]], self.check[free] = free - ids[single], parents[single]
        rest = np.flatnonzero(self.check[self.low :] == -1)
        self.low = int(rest[0]) + self.low if rest.size else len(self.check)

    def step(self, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Where states go by ids; -1: nowhere."""
        to = self.base[states] + ids
        inside = (to >= 0) & (to < len(self.check))
        return np.where(inside & (self.check[np.where(inside, to, 0)] == states), to, -1)


def shard_trie(sym: np.ndarray, start: np.ndarray, lens: np.ndarray) -> tuple[DoubleArray, np.ndarray, list[np.ndarray]]:
    """Trie of sequences of dense ids (from ``start``, ``lens`` ids each); the
    state of every row; the states of every level."""
    trie, at, levels = DoubleArray(), np.zeros(len(sym), np.int64), []
    order = np.argsort(-lens, kind="stable")
    state, start, lens = np.zeros(len(order), np.int64), start[order], lens[order]
    for depth in range(int(lens[0]) if len(lens) else 0):
        n = int(np.searchsorted(-lens, -depth))  # sequences longer than this
        rows = start[:n] + depth
        here, ids = state[:n], sym[rows]
        by = np.lexsort((ids, here))
        a, b = here[by], ids[by]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        trie.add(a[new], b[new])
        at[rows] = state[:n] = trie.step(here, ids)
        levels.append(trie.step(a[new], b[new]))
    return trie, at, levels


def _shard_nodes(part: pa.Table) -> pa.RecordBatch:
    """(c, depth, sym, bytes, m, len) of a shard's sequences -> its nodes."""
    sym = np.asarray(part["sym"].combine_chunks().dictionary_encode().indices, np.int64)
    c, depth, size, m, length = (np.asarray(part[k]) for k in ("c", "depth", "bytes", "m", "len"))
    start = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    lens = np.diff(np.concatenate([start, [len(c)]]))
    trie, at, levels = shard_trie(sym, start, lens)
    n = len(trie.check)
    convs, own, text, deep, ends = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1)
    np.add.at(convs, at, m)
    np.minimum.at(own, at, c)
    text[at], deep[at] = size, depth
    last = depth == length
    has_end = np.zeros(n, bool)
    ends[at[last]], has_end[at[last]] = c[last], True
    nodes = np.concatenate(levels)
    up = trie.check[nodes]
    children = np.bincount(up, minlength=n)
    leaves, saved = np.zeros(n, np.int64), np.zeros(n, np.int64)
    leaves[nodes] = children[nodes] == 0
    saved[nodes] = (convs[nodes] - 1) * text[nodes]
    for level in reversed(levels):
        np.add.at(leaves, trie.check[level], leaves[level])
        np.add.at(saved, trie.check[level], saved[level])
    top = up == 0
    columns = [own[nodes], deep[nodes], pa.array(own[up], mask=top), convs[nodes], children[nodes], leaves[nodes], saved[nodes], pa.array(ends[nodes], mask=~has_end[nodes]), top]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=[x.split()[0] for x in NODE.split(", ")])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        edges = np.flatnonzero(changes(batch, ["shard"], last)).tolist()
        for nth, (lo, hi) in enumerate(zip([0, *edges], [*edges, batch.num_rows], strict=True)):
            if nth and held:
                yield _shard_nodes(pa.Table.from_batches(held))
                held = []
            if hi > lo:
                held.append(batch.slice(lo, hi - lo))
        last = group_of(batch, ["shard"], batch.num_rows - 1)
    if held:
        yield _shard_nodes(pa.Table.from_batches(held))


def numbered(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(c, i, key, bytes): the turns of every conversation from 0 on."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = turns.select(F.col(id_col).cast("long").alias("c"), F.col(turn_col).alias("turn"), key.alias("key"), F.octet_length(text).cast("long").alias("bytes"))
    return cut(scan(cut(rows.where(F.col("c").isNotNull())), ["c"], ["turn", "key"], place="i").select("c", "i", "key", "bytes"))


def rebuilt(rows: DataFrame, group: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that share a head: (c, depth, key, bytes), and all ids (c).
    The first h turns are those of conversation c - c % group, h the CRC-32 of
    the decimal id modulo ``heads``."""
    h = lambda c: F.crc32(c.cast("string").cast("binary")) % heads
    convs = cut(rows.groupBy("c").agg(F.count(F.lit(1)).alias("n")))
    with_base = convs.select("c", (F.col("c") - F.col("c") % group).alias("base"), h(F.col("c")).alias("h"))
    held = with_base.join(convs.select(F.col("c").alias("base"), F.col("n").alias("has")), "base", "left")
    held = held.select("c", "base", "h", F.least("h", F.coalesce("has", F.lit(0).cast("long"))).alias("got"))
    head = rows.where(F.col("i") < heads - 1).withColumnRenamed("c", "base").join(held, "base").where("i < h").select("c", (F.col("i") + 1).alias("depth"), "key", "bytes")
    own = rows.where(F.col("i") >= h(F.col("c"))).join(held, "c").select("c", (F.col("got") + F.col("i") - F.col("h") + 1).alias("depth"), "key", "bytes")
    return head.unionByName(own), convs.select("c")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(len, p0-3, part, c) in order -> the ids of equal conversations, comma-joined, in pieces."""
    group = ["len", *PRINT, "part"]
    last, ids, held, nth = None, [], 0, 0

    def piece() -> pa.RecordBatch:
        row = [*last, nth, int(ids[0]), len(ids), ",".join(ids)]
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=[*group, "nth", "first", "n", "text"])

    for batch in batches:
        if not batch.num_rows:
            continue
        edges = np.flatnonzero(changes(batch, group, last)).tolist()
        texts = [str(x) for x in batch.column("c").to_pylist()]
        for k, (lo, hi) in enumerate(zip([0, *edges], [*edges, batch.num_rows], strict=True)):
            if k and ids:
                yield piece()
                ids, held, nth = [], 0, 0
            if hi > lo:
                last = group_of(batch, group, lo)
            for i in range(lo, hi):
                ids.append(texts[i])
                held += len(texts[i]) + 1
                if held > PIECE:
                    yield piece()
                    ids, held, nth = [], 0, nth + 1
    if ids:
        yield piece()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order -> smallest id, number and digest of each group."""
    group = ["len", *PRINT]
    last, own, n, digest = None, None, 0, None
    done = lambda: pa.RecordBatch.from_arrays([pa.array([x]) for x in (last[0], own, n, digest.hexdigest())], names=["len", "c", "m", "digest"])
    for batch in batches:
        if not batch.num_rows:
            continue
        new = changes(batch, group, last)
        for i in range(batch.num_rows):
            text = batch.column("text")[i].as_py().encode()
            if new[i]:
                if digest is not None:
                    yield done()
                last, own, n, digest = group_of(batch, group, i), batch.column("first")[i].as_py(), 0, hashlib.sha256(text)
            else:
                digest.update(b"," + text)
            n += batch.column("n")[i].as_py()
    if digest is not None:
        yield done()


def _alike(convs: DataFrame, parts: int) -> DataFrame:
    """(c, len, p0-3) -> a row for conversations that are equal: the smallest
    ``c``, ``len``, their number ``m`` and the digest of their ids."""
    key = ["len", *PRINT]
    rows = convs.repartitionByRange(parts, *key, "c").sortWithinPartitions(*key, "c").withColumn("part", F.spark_partition_id().cast("long"))
    longs = ", ".join(f"{k} bigint" for k in key)
    pieces = rows.select(*key, "part", "c").mapInArrow(_pieces, f"{longs}, part bigint, nth bigint, first bigint, n bigint, text string")
    pieces = pieces.repartition(parts, *key).sortWithinPartitions(*key, "part", "nth")
    return cut(pieces.mapInArrow(_joined, "len bigint, c bigint, m bigint, digest string"))


def trie_nodes(rows: DataFrame, ids: DataFrame, subtree_rows: int = SUBTREE_ROWS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Nodes of the trie of sequences (c, depth, key, bytes); ``ids`` (c) has
    every conversation, turnless ones too.  ``ends_sha256`` digests the ids of
    the conversations that end in the node."""
    spark = ship(rows.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seed = lambda n: F.xxhash64(F.lit(n), "depth", "key")
    terms = [F.shiftrightunsigned(seed(1), 33), seed(1).bitwiseAND(0x7FFFFFFF), F.shiftrightunsigned(seed(2), 33), seed(2).bitwiseAND(0x7FFFFFFF)]
    rows = cut(rows.select("c", "depth", "key", "bytes", *[t.alias(f"t{i}") for i, t in enumerate(terms)]))
    rows = cut(scan(rows, ["c"], ["depth"], {f"t{i}": p for i, p in enumerate(PRINT)}, "row").drop("row", "t0", "t1", "t2", "t3"))
    last = rows.groupBy("c").agg(F.max_by(F.struct(F.col("depth").alias("len"), *PRINT), "depth").alias("e"))
    zero = F.lit(0).cast("long")
    convs = ids.join(last, "c", "left").select("c", *[F.coalesce(F.col("e")[k], zero).alias(k) for k in ("len", *PRINT)])
    alike = _alike(convs, parts)
    rows = cut(rows.join(alike.where("len > 0").select("c", "len", "m"), "c"))

    # Upper nodes: too much at or below them for one shard.
    heavy = rows.groupBy("depth", *PRINT).agg(F.sum(F.col("len") - F.col("depth") + 1).alias("w")).where(F.col("w") > subtree_rows)
    heavy = cut(heavy.select("depth", *PRINT, F.lit(True).alias("upper")))
    n_heavy, n_rows = heavy.count(), rows.count()
    if n_heavy:
        rows = cut(rows.join(checked_broadcast(heavy, n_heavy, 60), ["depth", *PRINT], "left").withColumn("upper", F.coalesce("upper", F.lit(False))))
    else:
        rows = rows.withColumn("upper", F.lit(False))
    below = rows.where(~F.col("upper"))
    prefix = F.unhex(F.sha2(F.concat_ws(",", "depth", *PRINT).cast("binary"), 256))
    shards = max(parts, -(-n_rows // shard_rows))
    tops = below.groupBy("c").agg(F.min_by(F.struct(F.col("depth").alias("from"), *PRINT), "depth").alias("at"))
    tops = tops.select("c", F.col("at.from").alias("from"), F.pmod(F.xxhash64(F.col("at")), F.lit(shards)).alias("shard"))
    below = below.join(tops, "c").withColumn("sym", F.when(F.col("depth") == F.col("from"), prefix).otherwise(F.col("key")))
    below = below.select("shard", "c", "depth", "sym", "bytes", "m", "len").repartition(parts, "shard").sortWithinPartitions("shard", "c", "depth")
    nodes = cut(below.mapInArrow(_shards, NODE))
    root_id, members = ids.agg(F.min("c"), F.count(F.lit(1))).first()
    if n_heavy:
        nodes = cut(_merged(rows.where("upper"), nodes))
    nodes = nodes.withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(root_id)).otherwise(F.col("parent_conv_id"))).drop("top")
    if not members:
        return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.lit("").alias("ends_sha256"))
    sums = nodes.where("depth = 1").agg(F.count(F.lit(1)).alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(1)).cast("long").alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), zero).alias("saved_tokens"))
    empty = alike.where("len = 0").agg(F.min("c").alias("ends"))
    root = sums.crossJoin(empty).select(  # one row each
        F.lit(root_id).cast("long").alias("conv_id"), zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(members).cast("long").alias("n_convs"),
        "n_children", "n_leaves", "saved_tokens", "ends",
    )
    digests = alike.select(F.col("c").alias("ends"), F.col("digest").alias("ends_sha256"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.unionByName(root).join(digests, "ends", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none)).drop("ends")


def _merged(upper: DataFrame, nodes: DataFrame) -> DataFrame:
    """All nodes, from the rows of upper nodes and the nodes of the shards."""
    key, zero = ["depth", *PRINT], F.lit(0).cast("long")
    own = upper.groupBy(*key).agg(
        F.sum("m").alias("n_convs"), F.min("c").alias("conv_id"), F.max("bytes").alias("bytes"), F.max(F.when(F.col("depth") == F.col("len"), F.col("c"))).alias("ends")
    )
    own = cut(own)
    rows = upper.join(checked_broadcast(own.select(*key, "conv_id", F.col("n_convs").alias("n")), own.count(), 80), key)
    mine = F.col("c") == F.col("conv_id")
    rows = cut(rows.withColumn("saves", F.when(mine, (F.col("n") - 1) * F.col("bytes")).otherwise(zero)).withColumn("back", -F.col("depth")))
    rows = scan(rows, ["c"], ["back"], {"saves": "saves_below"}, "row")  # what the row's conversation owns from here on
    tops = nodes.where("top").select(F.col("conv_id").alias("c"), F.col("depth").alias("top_depth"), F.col("n_leaves").alias("top_leaves"), F.col("saved_tokens").alias("top_saved"))
    rows = cut(rows.join(tops, "c", "left"))
    # A child is owned by its smallest member, whose row one turn earlier is the parent's.
    child = rows.where(mine).select("c", (F.col("depth") - 1).alias("depth"), F.lit(1).cast("long").alias("child"))
    rows = rows.join(child, ["c", "depth"], "left")
    add = rows.groupBy(*key).agg(
        F.sum(F.coalesce("child", zero) + F.coalesce((F.col("top_depth") == F.col("depth") + 1).cast("long"), zero)).alias("n_children"),
        F.sum(F.coalesce("top_leaves", zero)).alias("n_leaves"),
        F.sum(F.col("saves_below") + F.coalesce("top_saved", zero)).alias("saved_tokens"),
    )
    both = own.join(add, key).select("conv_id", "depth", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends", F.lit(True).alias("top"))
    parents = rows.select(F.col("c").alias("conv_id"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent"))
    found = both.unionByName(nodes.where("top")).join(parents, ["conv_id", "depth"], "left").withColumn("parent_conv_id", F.col("parent")).drop("parent")
    return found.unionByName(nodes.where("not top"))


def prefix_trie(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", share_heads: bool = False, **options) -> DataFrame:
    """Nodes of the trie of all conversations; ``share_heads`` rebuilds them first (``rebuilt``)."""
    rows = numbered(turns, id_col, turn_col, role_col, text_col)
    if share_heads:
        return trie_nodes(*rebuilt(rows), **options)
    return trie_nodes(rows.withColumn("depth", F.col("i") + 1).drop("i"), rows.select("c").distinct(), **options)
