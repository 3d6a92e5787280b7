"""SimHash near-duplicates: byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes.  Fingerprints that differ in
at most three bits share at least five of the eight (``LEAST_SHARED``), and so
at least four of the first seven: every fingerprint is posted once for each of
the 35 ways to choose four of those seven, under the four bytes chosen.  A
list of one byte would hold 1/256 of all fingerprints; a list of four holds
little but near copies.  Within a list the shared positional bytes of a pair
are tallied, pairs below five are dropped, and the rest is verified by the
exact bit distance.

Equal fingerprints are one posting, so a large group of exact copies costs one
row.  A long list (many near copies) is searched breadth-first and tied to one
root per cluster, which keeps the links linear in its length; it holds only
distinct fingerprints that agree in four bytes.

Defined results: a null or blank text has fingerprint zero, linked like any
other; rows with a null id take part, but only other ids can name the
component (null if there is none); repeated rows give repeated rows; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskscope.llm.common import cut, raw_texts, ship, word_blocks
from riskscope.llm.components import components, meet

SEED = 42
MAX_BITS = 3
LEAST_SHARED = 8 - MAX_BITS
CHOSEN, AMONG = 4, 7
SHORT_LIST = 8  # up to here all pairs of a list are looked at directly
BFS_LIST = 4096  # beyond, a list is divided by each of its four free bytes
INDEX = list(combinations(range(AMONG), CHOSEN))


def fingerprint(raw: bytes, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of the text's word shingles."""
    from xxhash import xxh64_digest

    total, ones, carry = 0, np.zeros(64, np.int64), []
    for words in word_blocks(raw.lower()):
        words = carry + words
        if len(words) >= shingle:
            joined = b" ".join(words)
            end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            begin = np.concatenate([[0], end[:-1] + 1])
            spans = zip(begin[: len(words) - shingle + 1].tolist(), end[shingle - 1 :].tolist(), strict=True)
            digests = b"".join([xxh64_digest(joined[s:e], SEED) for s, e in spans])
            bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
            ones += bits.sum(axis=0, dtype=np.int64)
            total += len(bits)
        carry = words[-(shingle - 1) :] if shingle > 1 else []
    if not total and carry:  # fewer words than a shingle has
        ones += np.unpackbits(np.frombuffer(xxh64_digest(b" ".join(carry), SEED), np.uint8))
        total = 1
    return int(np.packbits(2 * ones > total).view(">i8")[0])


def fingerprints(text: Column, shingle: int = 3) -> Column:
    @F.arrow_udf("bigint")
    def run(col: pa.Array) -> pa.Array:
        return pa.array([fingerprint(x, shingle) for x in raw_texts(col)], pa.int64())

    return run(text)


def _mask(places: tuple[int, ...]) -> int:
    mask = sum(0xFF << (8 * p) for p in places)
    return mask - (1 << 64) if mask >> 63 else mask


def _near(x: np.ndarray) -> np.ndarray:
    """Of XORs: enough positional bytes shared, and few enough bits apart."""
    tally = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    near = tally >= LEAST_SHARED
    near[near] = np.bitwise_count(x[near]) <= MAX_BITS
    return near


def _search(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that tie each cluster of a list to one of its members."""
    many, one, left = [], [], members
    while left.size > 1:
        root, left = left[0], left[1:]
        waiting = [root]
        while waiting and left.size:
            near = _near(left ^ waiting.pop())
            if near.any():
                hit, left = left[near], left[~near]
                many.append(hit)
                one.append(np.full(hit.size, root))
                waiting.extend(hit)
    return (np.concatenate(many), np.concatenate(one)) if many else (left[:0], left[:0])


def _long_list(members: np.ndarray, places: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """As _search.  Three bits can't touch all four free bytes, so a linked
    pair shares one of them: the list is divided by each in turn."""
    if members.size <= BFS_LIST:
        return _search(members)
    found = []
    for p in set(range(8)) - set(places):
        byte = (members >> np.uint64(8 * p)) & np.uint64(0xFF)
        order = np.argsort(byte, kind="stable")
        found += [_search(x) for x in np.split(members[order], np.flatnonzero(np.diff(byte[order])) + 1)]
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _links(way: np.ndarray, key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within whole lists; rows come sorted by way and key."""
    new = np.flatnonzero(np.concatenate([[True], (way[1:] != way[:-1]) | (key[1:] != key[:-1])]))
    size = np.diff(np.concatenate([new, [len(fp)]]))
    many, one = [], []
    short = np.repeat((size > 1) & (size <= SHORT_LIST), size)
    number = np.repeat(np.arange(len(new)), size)
    for d in range(1, min(SHORT_LIST, len(fp))):
        i = np.flatnonzero(short[:-d] & (number[:-d] == number[d:]))
        if not i.size:
            break
        near = _near(fp[i] ^ fp[i + d])
        i = i[near]
        many.append(fp[i + d])
        one.append(fp[i])
    for n in np.flatnonzero(size > SHORT_LIST):
        x, y = _long_list(fp[new[n] : new[n] + size[n]], INDEX[way[new[n]]])
        many.append(x)
        one.append(y)
    empty = fp[:0]
    return np.concatenate([empty, *many]), np.concatenate([empty, *one])


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] | None = None

    def out(part: list[np.ndarray]) -> pa.RecordBatch:
        a, b = _links(*part)
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])

    for batch in batches:
        part = [np.asarray(batch.column(k)) for k in range(3)]
        part[2] = part[2].view(np.uint64)
        if held is not None:
            part = [np.concatenate(x) for x in zip(held, part, strict=True)]
        last = np.flatnonzero((part[0] != part[0][-1:]) | (part[1] != part[1][-1:]))
        whole = int(last[-1]) + 1 if last.size else 0  # the last list may go on in the next batch
        held = [x[whole:] for x in part]
        if whole:
            yield out([x[:whole] for x in part])
    if held is not None and len(held[0]):
        yield out(held)


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints of column ``fp`` whose
    components are those of all pairs within the bit distance."""
    postings = fps.select(
        F.col("fp"),
        F.explode(F.array([F.struct(F.lit(n).alias("way"), F.col("fp").bitwiseAND(F.lit(_mask(p))).alias("key")) for n, p in enumerate(INDEX)])).alias("post"),
    ).select("post.way", "post.key", "fp")
    return postings.repartition("way", "key").sortWithinPartitions("way", "key").mapInArrow(_link_batches, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Per row of ``docs``: ``id_col``, ``fingerprint`` (16 hex digits) and
    ``component_id``, the smallest id reachable over links."""
    ship(docs.sparkSession)
    rows = cut(docs.select(F.col(id_col).alias("id"), fingerprints(F.col(text_col), shingle).alias("fp")))
    first = rows.groupBy("fp").agg(F.min("id").alias("first"))
    roots = components(links(first.select("fp")), "a", "b")
    named = cut(first.join(roots, first.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n"))
    # Written, so that both sides of the join are shuffled by it alone and a hot fingerprint can be split.
    by_fp = cut(meet(named, lowest, "root", named.count()).select("fp", "component_id"))
    return rows.join(by_fp, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row of each component: that with the smallest id (ties: the smaller
    hash of the whole row; equal rows: any one).  A component of null ids
    keeps one row too."""
    from riskscope.llm.common import free_name

    ship(docs.sparkSession)
    mark = free_name(docs, "row_hash")
    hashed = docs.withColumn(mark, F.xxhash64(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))
    rows = cut(hashed.select(F.col(id_col).alias("id"), F.col(mark).alias("h"), fingerprints(F.col(text_col), shingle).alias("fp")))
    roots = components(links(rows.select("fp").distinct()), "a", "b")
    best = F.struct(F.col("id").isNull().alias("n"), "id", "h")
    per_fp = rows.groupBy("fp").agg(F.min(best).alias("w"))
    per_root = per_fp.join(roots, per_fp.fp == roots.node, "left").groupBy(F.coalesce("root", "fp").alias("r")).agg(F.min("w").alias("w"))
    winners = per_root.select(F.col("w.id").alias("wid"), F.col("w.h").alias("wh"))
    one = hashed.dropDuplicates([id_col, mark])
    return one.join(winners, one[id_col].eqNullSafe(winners.wid) & (one[mark] == winners.wh), "left_semi").drop(mark)
