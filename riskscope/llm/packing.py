"""Best-fit packing of token pieces into sequences of a fixed length.

Texts are tokenised and cut into pieces over Arrow batches; the histogram of
piece lengths, one number per length, goes to the driver, where a configuration
linear program (``configlp``) tells what the sequences hold.  A piece's place
among the pieces of its length, counted without a task that sees them all
(``order.scan``), then names its sequence and offset by a look-up.

The plan has a few thousand stretches of places, whatever the number of pieces
(its size follows from the sequence length alone), so it may be sent to all.

Defined results: a null text is empty and has the end id only; repeated rows
are pieces each; an empty table gives an empty table; a document of a whole
number of sequences has only full pieces, any other a shorter first one.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskscope.llm import configlp
from riskscope.llm.bpe import byte_characters
from riskscope.llm.common import cut, free_name, raw_texts, ship
from riskscope.llm.order import scan

CAPACITY = 1_024
END = 2
OUT_BYTES = 4 << 20
# What a byte-level pre-tokenizer with use_regex splits by.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_RUN = re.compile(r"\s{1000}|\S{20000}")  # left to the tokenizers library, which doesn't backtrack or merge by rescanning


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Ranks of a plain byte-level BPE whose ids are in the order of its
    merges; None for any other tokenizer."""
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if not plain or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    back = {c: b for b, c in enumerate(byte_characters())}
    special = {t["content"] for t in spec["added_tokens"]}
    made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if made != sorted(made) or any(not set(t) <= back.keys() for t in model["vocab"] if t not in special):
        return None
    return {bytes(back[c] for c in t): i for t, i in model["vocab"].items() if t not in special}


class Encoder:
    """Ids of a tokenizers file, by the tiktoken library where it gives the
    same ids (several times as fast), special tokens as ordinary text."""

    def __init__(self, file: str) -> None:
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(file)
        self.slow.encode_special_tokens = True
        with open(file, encoding="utf-8") as f:
            ranks = _ranks(json.load(f))
        self.fast = ranks and Encoding("own", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast and (len(text) < 1_000 or not LONG_RUN.search(text)):
            return np.array(self.fast.encode_ordinary(text), "<u4")
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")


@lru_cache(maxsize=2)
def encoder(file: str) -> Encoder:
    """One per worker.  ``file`` was sent to the executors."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(SparkFiles.get(file))


def _cut_pieces(file: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(file)

        def flush(rows: list[tuple], batch: pa.RecordBatch) -> pa.RecordBatch:
            at, piece, start, length, ids = (list(c) for c in zip(*rows, strict=True))
            kept = [batch.column(i).take(pa.array(at)) for i in range(batch.num_columns - 1)]
            new = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())]
            return pa.RecordBatch.from_arrays([*kept, *new], names=[*batch.schema.names[:-1], "piece", "start", "length", "ids"])

        for batch in batches:
            rows, held = [], 0
            for i, raw in enumerate(raw_texts(batch.column(batch.num_columns - 1))):
                ids = np.append(own.ids(raw.decode()), np.uint32(end)).astype("<u4")
                first = len(ids) % capacity or capacity
                for piece, stop in enumerate(range(first, len(ids) + 1, capacity)):
                    start = max(0, stop - (capacity if piece else first))
                    rows.append((i, piece, start, stop - start, ids[start:stop].tobytes()))
                    held += 4 * (stop - start)
                    if held > OUT_BYTES:
                        yield flush(rows, batch)
                        rows, held = [], 0
            if rows:
                yield flush(rows, batch)

    return run


def pieces(docs: DataFrame, path: str, text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The other columns of ``docs``, once per piece, with ``piece`` (from 0),
    ``start``, ``length`` and ``ids`` (binary, little-endian unsigned 32-bit);
    such columns of ``docs`` are replaced."""
    spark: SparkSession = ship(docs.sparkSession)
    spark.sparkContext.addFile(path)
    own = [c for c in docs.columns if c.lower() not in ("piece", "start", "length", "ids", text_col.lower())]
    kinds = [T.StructField(n, t()) for n, t in (("piece", T.IntegerType), ("start", T.LongType), ("length", T.LongType), ("ids", T.BinaryType))]
    plain = [f"c{i}" for i in range(len(own))]  # names without dots, which mapInArrow can't have
    schema = T.StructType([*(T.StructField(p, docs.schema[c].dataType) for p, c in zip(plain, own, strict=True)), *kinds])
    rows = docs.select(*[f"`{c}`" for c in own], f"`{text_col}`").toDF(*plain, "text")
    return rows.mapInArrow(_cut_pieces(os.path.basename(path), capacity, end), schema).toDF(*own, *(k.name for k in kinds))


def stretches(plan: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """Contents of sequences -> for stretches of places of a length: the first
    sequence, pieces of the length in each, and the offset of the first."""
    out: list[tuple[int, ...]] = []
    sequence, used = 0, dict.fromkeys({k for config, _ in plan for k in config}, 0)
    for config, n in plan:
        offset = 0
        for length, times in sorted(config.items(), reverse=True):
            out.append((length, used[length], sequence, times, offset))
            used[length] += n * times
            offset += length * times
        sequence += n
    table = np.array(sorted(out), np.int64).reshape(-1, 5)
    return dict(zip(("length", "from", "sequence", "times", "offset"), table.T, strict=True))


def place(rows: DataFrame, capacity: int = CAPACITY, order: list[str] | None = None) -> DataFrame:
    """``rows`` (a written table with a ``length`` of 1 to ``capacity``) with
    ``sequence_id`` and ``offset`` (there is no gap between the pieces of a sequence)."""
    spark = ship(rows.sparkSession)
    counts = np.zeros(capacity + 1, np.int64)
    for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # a row per length
        counts[r["length"]] = r["n"]
    plan, _ = configlp.packed(counts)
    table = spark.sparkContext.broadcast(stretches(plan))

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def found(length: pa.Array, at: pa.Array) -> pa.Array:
        t, length, at = table.value, np.asarray(length), np.asarray(at)
        step = 1 + max(int(t["from"].max(initial=0)), int(at.max(initial=0)))
        i = np.searchsorted(t["length"] * step + t["from"], length * step + at, "right") - 1
        q, r = np.divmod(at - t["from"][i], t["times"][i])
        return pa.StructArray.from_arrays([pa.array(t["sequence"][i] + q), pa.array(t["offset"][i] + r * length)], names=["sequence_id", "offset"])

    at, hit = free_name(rows, "pack_at"), free_name(rows, "pack_hit")
    out = scan(rows, ["length"], order or [], place=at).withColumn(hit, found("length", at))
    return out.select(*[f"`{c}`" for c in rows.columns], F.col(hit)["sequence_id"].alias("sequence_id"), F.col(hit)["offset"].alias("offset"))


def pack(docs: DataFrame, path: str, text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of all documents with their sequence and offset, ids included."""
    return place(cut(pieces(docs, path, text_col, capacity, end)), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id``, ``ids``: whole sequences, each of bounded length."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.unhex(F.lit("")), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
