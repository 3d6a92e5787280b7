"""Counts over whole texts, one row of a matrix per document.

A null or empty text has zero everywhere.  Memory per document: its bytes,
its distinct words and eight bytes per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskscope.llm.common import cut, raw_texts, ship, word_blocks

COUNTS = (
    "n_bytes", "n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
    "n_distinct_words", "n_same_next", "n_upper", "n_digits", "n_stops", "n_commas", "n_marks", "longest_word",
)


def _chars(s: bytes) -> np.ndarray:
    return np.frombuffer(s, np.uint8)


BLANKS, SYMBOLS = _chars(b" \t\n\x0b\x0c\r"), _chars(b"#*$%&|<>")
UPPER, DIGITS = np.arange(65, 91), np.arange(48, 58)
STOPS, COMMAS, MARKS = _chars(b".?"), _chars(b",;:"), _chars(b"!")


def word_numbers(raw: bytes) -> tuple[np.ndarray, int, int]:
    """Number of the distinct word at every place; how many there are; the
    longest word's bytes."""
    seen: dict[bytes, int] = {}
    parts = [np.zeros(0, np.int64)]
    for words in word_blocks(raw):
        parts.append(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words)))
    return np.concatenate(parts), len(seen), max(map(len, seen), default=0)


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words in windows of three that occur twice or more."""
    if len(ids) < 4:
        return 0
    pair = ids[:-1] * distinct + ids[1:]
    if distinct >= 1 << 20:  # three numbers would not fit 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    _, group, n = np.unique(pair[:-1] * distinct + ids[2:], return_inverse=True, return_counts=True)
    start = np.flatnonzero(n[group] > 1)
    covered = np.zeros(len(ids), bool)
    for d in range(3):
        covered[start + d] = True
    return int(covered.sum())


def counts(raw: bytes) -> tuple[int, ...]:
    if not raw:
        return (0,) * len(COUNTS)
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = int(by[:128].sum() + by[192:].sum())
    ids, distinct, longest = word_numbers(raw)
    lines = dups = 0
    earlier = set()
    for line in raw.split(b"\n"):
        if line.strip(b" \t\x0b\x0c\r"):
            lines += 1
            dups += line in earlier
            earlier.add(line)
    total = lambda which: int(by[which].sum())
    return (
        len(raw), chars, len(ids), chars - total(BLANKS), total(SYMBOLS), lines, dups, repeated_words(ids, distinct),
        distinct, int((ids[1:] == ids[:-1]).sum()), total(UPPER), total(DIGITS), total(STOPS), total(COMMAS), total(MARKS), longest,
    )


def matrix(texts: list[bytes]) -> np.ndarray:
    return np.array([counts(t) for t in texts], np.int64).reshape(-1, len(COUNTS))


def shares(m: np.ndarray) -> np.ndarray:
    """Statistics that don't depend on a text's length, from its counts."""
    c = dict(zip(COUNTS, m.astype(float).T, strict=True))
    words, chars, lines = (np.maximum(c[k], 1) for k in ("n_words", "word_chars", "n_lines"))
    return np.stack(
        [
            c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words,
            c["n_same_next"] / words, c["n_upper"] / chars, c["n_digits"] / chars, c["n_stops"] / words,
            c["n_commas"] / words, c["n_marks"] / words, np.minimum(c["longest_word"], 100) / (c["word_chars"] / words + 1),
            c["n_bytes"] / np.maximum(c["n_chars"], 1),
        ],
        axis=1,
    )


def counted(text: Column) -> Column:
    """Array column of the counts, in the order of COUNTS."""

    @F.arrow_udf("array<bigint>")
    def run(col: pa.Array) -> pa.Array:
        m = matrix(raw_texts(col))
        edges = np.arange(len(m) + 1, dtype=np.int32) * len(COUNTS)
        return pa.ListArray.from_arrays(pa.array(edges), pa.array(m.reshape(-1)))

    return run(text)


def _label_per_id(labels: DataFrame) -> DataFrame:
    """Null ids and labels other than 0 and 1 are left out; of several labels
    of an id the smallest holds."""
    return labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("label"))


def labelled(docs: DataFrame, labels: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(label, c) of every labelled document: its label and counts, of rows
    that repeat an id the largest.  Texts are never shuffled: few ids are
    broadcast, many meet the counts."""
    ship(docs.sparkSession)
    ids = cut(_label_per_id(labels))
    c = counted(F.col("text")).alias("c")
    if ids.count() <= broadcast_rows:
        rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "label", c)
    else:
        rows = docs.select("doc_id", c).join(ids, "doc_id")
    return rows.groupBy("doc_id").agg(F.max(F.struct("label", "c")).alias("one")).select("one.label", "one.c")


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> np.ndarray:
    """At most ``max_rows`` labelled documents (the smallest hashes of the id),
    in the order of the id: label, then the counts.  Null ids and labels other
    than 0 and 1 are left out; of several labels of an id the smallest holds."""
    ship(docs.sparkSession)
    chosen = _label_per_id(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # Rows that repeat an id can exceed the bound: the largest counts of each.
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "label", counted(F.col("text")).alias("c")).groupBy("doc_id").agg(F.max(F.struct("label", "c")).alias("one")).collect()
    )
    one = {r.doc_id: [r.one.label, *r.one.c] for r in rows}
    return np.array([one[k] for k in sorted(one)], np.int64).reshape(-1, 1 + len(COUNTS))
