"""Byte-level BPE encoding and decoding over Arrow batches.

The rank file becomes a ``tokenizers`` BPE model: every byte maps to a
printable character, every token of two or more bytes to the merge that makes
it.  A worker keeps the ids of text units it has met (a unit starts at a blank
that follows a non-blank, where no match of the pattern can cross), so that a
repeated word is encoded once per worker and not once per occurrence.

Defined results: a null text is the empty text (no ids, empty offsets, empty
bytes); null ids decode to null; rows are independent, so ties, repeated rows
and extra columns don't matter; an output column replaces one of that name;
an empty table gives an empty table.  Memory: one Arrow batch (bounded by
``spark.sql.execution.arrow.maxBytesPerBatch``) and ``UNIT_BYTES`` of units.
"""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskscope.llm.common import ragged, raw_texts, ship

UNIT_BYTES = 16 << 20  # remembered units per worker, in bytes of text and ids
OPEN = re.compile(r"\s[ \n]")
CUT = re.compile(r"(?<=\S)(?=[ \n])")


def byte_characters() -> list[str]:
    """A printable character for every byte: itself if printable in Latin-1,
    else the next code point from 256 on."""
    out, extra = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


def read_ranks(lines: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x.strip())}


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts whose merge makes ``token``: merge its bytes by the ranks
    below its own until two parts are left."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], len(ranks)), i) for i in range(len(parts) - 1))
        if rank >= ranks[token]:
            raise ValueError(f"rank {ranks[token]} can't be made of lower ranks")
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


class Units(dict):
    """Text unit -> number; new units wait in ``new`` for encoding.  A str key
    is a unit after a blank (the blank left off, a line feed kept); a tuple
    holds a unit as it stands."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key):
        self[key] = n = len(self)
        self.new.append(key[0] if isinstance(key, tuple) else key if key[:1] == "\n" else " " + key)
        return n


class Codec:
    def __init__(self, lines: bytes, pattern: str) -> None:
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = read_ranks(lines)
        chars = byte_characters()
        name = {t: "".join(chars[b] for b in t) for t in ranks}
        merges = [tuple(name[p] for p in last_merge(t, ranks)) for t in sorted(ranks, key=ranks.get) if len(t) > 1]
        self.tokenizer = Tokenizer(models.BPE({name[t]: r for t, r in ranks.items()}, merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        # Bytes of every id, from the vocabulary's characters by the reversed byte table.
        back = {c: b for b, c in enumerate(chars)}
        vocab = self.tokenizer.get_vocab()
        self.length = np.zeros(max(vocab.values()) + 1, np.int64)
        for t, i in vocab.items():
            self.length[i] = len(t)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.zeros(int(self.length.sum()), np.uint8)
        for t, i in vocab.items():
            self.bytes[self.start[i] : self.start[i] + len(t)] = [back[c] for c in t]
        self.forget()

    def forget(self) -> None:
        self.units, self.held = Units(), 0
        self.unit_ids = np.zeros(0, np.int32)
        self.unit_len = np.zeros(0, np.int64)

    def learn(self) -> None:
        new = self.units.new
        if not new:
            return
        parts = [self.unit_ids]
        for i in range(0, len(new), 50_000):
            got = [e.ids for e in self.tokenizer.encode_batch_fast(new[i : i + 50_000], add_special_tokens=False)]
            lens = np.fromiter(map(len, got), np.int64, len(got))
            parts.append(np.fromiter((x for ids in got for x in ids), np.int32, int(lens.sum())))
            self.unit_len = np.concatenate([self.unit_len, lens])
        self.unit_ids = np.concatenate(parts)
        self.held += sum(map(len, new)) + 100 * len(new)
        self.units.new = []

    def number(self, text: str) -> list[int]:
        """Unit numbers of a text."""
        look = self.units.__getitem__
        if OPEN.search(text) is None:  # every blank or line feed follows a non-blank
            first, *rest = text.replace("\n", " \n").split(" ")
            return [look((first,)), *map(look, rest)]
        return [look((u,)) for u in CUT.split(text)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        if self.held > UNIT_BYTES:
            self.forget()
        numbers = [self.number(t) if t else [] for t in texts]
        self.learn()
        per_text = np.fromiter(map(len, numbers), np.int64, len(numbers))
        flat = np.fromiter((n for x in numbers for n in x), np.int64, int(per_text.sum()))
        lens = self.unit_len[flat]
        begin = np.cumsum(self.unit_len) - self.unit_len
        ids = self.unit_ids[ragged(begin[flat], lens)]
        edge = np.concatenate([[0], np.cumsum(lens)])
        stop = np.cumsum(per_text)
        return ids, edge[stop] - edge[stop - per_text]

    def offsets(self, ids: np.ndarray, counts: np.ndarray, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last character of every id.  A character split
        over several ids lies in each of their spans."""
        buffer = np.frombuffer(b"".join(raw), np.uint8)
        head = (buffer & 0xC0) != 0x80
        char = np.cumsum(head) - 1  # byte -> character, over the whole batch
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        base = np.cumsum(sizes) - sizes
        chars_before = np.concatenate([[0], np.cumsum(head)])[base]
        end = np.cumsum(self.length[ids])
        start = end - self.length[ids]
        shift = np.repeat(chars_before, counts)
        return (char[start] - shift).astype(np.int32), (char[end - 1] + 1 - shift).astype(np.int32)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[ragged(self.start[ids], self.length[ids])]


@lru_cache(maxsize=2)
def codec(file: str, pattern: str) -> Codec:
    """One codec per worker.  ``file`` was sent to the executors."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    with open(SparkFiles.get(file), "rb") as f:
        return Codec(f.read(), pattern)


def _send(spark: SparkSession, path: str) -> str:
    """Send the vocabulary file (under 2 MB) to every executor; its name there."""
    ship(spark).sparkContext.addFile(path)
    return os.path.basename(path)


def _lists(values: np.ndarray, counts: np.ndarray, kind=None) -> pa.Array:
    edges = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(values, kind))


def encoded(spark: SparkSession, text: Column, path: str, pattern: str, offsets: bool = True) -> Column:
    """Struct column ``ids``, ``starts``, ``ends`` (character offsets, null
    unless asked for) of a string column."""
    file = _send(spark, path)

    @F.arrow_udf("struct<ids:array<int>,starts:array<int>,ends:array<int>>")
    def run(col: pa.Array) -> pa.Array:
        raw = raw_texts(col)
        own = codec(file, pattern)
        ids, counts = own.encode([x.decode() for x in raw])
        if offsets:
            starts, ends = (_lists(x, counts) for x in own.offsets(ids, counts, raw))
        else:
            starts = ends = pa.nulls(len(raw), pa.list_(pa.int32()))
        return pa.StructArray.from_arrays([_lists(ids, counts), starts, ends], names=["ids", "starts", "ends"])

    return run(text)


def decoded(spark: SparkSession, ids: Column, path: str, pattern: str) -> Column:
    """Binary column: the bytes of a column of ids."""
    file = _send(spark, path)

    @F.arrow_udf("binary")
    def run(col: pa.Array) -> pa.Array:
        own = codec(file, pattern)
        counts = np.asarray(col.value_lengths().fill_null(0), np.int64)
        flat = np.asarray(col.flatten(), np.int64)
        data = own.decode(flat)
        edge = np.concatenate([[0], np.cumsum(own.length[flat])])
        stop = np.cumsum(counts)
        edges = np.concatenate([[0], edge[stop]]).astype(np.int32)
        null = np.asarray(col.is_null())
        valid = None if not null.any() else pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
        return pa.Array.from_buffers(pa.binary(), len(col), [valid, pa.py_buffer(edges.tobytes()), pa.py_buffer(data.tobytes())])

    return run(ids)


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", offsets: bool = True) -> DataFrame:
    """``docs`` with ``ids`` and, if asked for, ``starts`` and ``ends``."""
    out = docs.withColumn("ids", encoded(docs.sparkSession, F.col(text_col), path, pattern, offsets))
    if offsets:
        out = out.withColumns({"starts": F.col("ids.starts"), "ends": F.col("ids.ends")})
    return out.withColumn("ids", F.col("ids.ids"))


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes of its ids in binary column ``out``."""
    return df.withColumn(out, decoded(df.sparkSession, F.col(ids_col), path, pattern))
