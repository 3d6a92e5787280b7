"""Exact substring dedup by super-k-mer partitioning.

A window is ``window`` consecutive words of a document.  Its minimiser is the
run of ``MER`` words with the smallest hash (one word would make buckets of
frequent words hot); consecutive windows that share one form a
super-k-mer, whose words travel as one packed string to the bucket of the
minimiser.  Equal windows have equal minimisers and so meet in one bucket,
where sorting finds the first start of every window exactly (hashes order the
windows, bytes decide).

Packed strings of one Arrow batch and bucket go as one compressed block.
Buckets hold about ``BUCKET_BYTES`` and are sorted within their partition, so
that a task has one bucket in memory at a time; there are as many as that
takes.  Minimisers with more than ``hot`` super-k-mers (a passage that very many
documents share), or more than one in ``HOT_KEYS`` of all, are found by a count
beforehand; their windows go singly, pre-aggregated to the smallest id before
they are shuffled.  At most ``HOT_KEYS`` minimisers can hold that much, so all
of them are sent to the executors.  The count is of a sample of documents
(``SAMPLE``); it only decides which of the two exact ways a window goes.

A document is a row key: the id, and ``row``, which is 0 for an id with one
text, below 0 (by the text's hash) for an id with several texts, and a row
number from 1 on for a null id.  Super-k-mers carry both, documents stand in
the order of both, and runs are grouped and joined by both.

Defined results: ids are integers, other types raise TypeError; a null text has
no words; null ids come after all others, each
row a document of its own, in no defined order; rows of one id and text are one
document (repeated rows stay alike), other texts of an id other documents; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskscope.llm.common import checked_broadcast, cut, free_name, lean, ragged, raw_texts, ship

WINDOW = 20
MER = 4
BUCKET_BYTES = 6 << 20
PACKED = 3.2  # bytes of packed strings for a byte of text
HOT = 20_000
SAMPLE = 1 / 32
HOT_KEYS = 8_000_000  # hot minimisers that can exist (64 MB to the executors)
NULL_ID = np.iinfo(np.int64).max
SLICE = 2 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word data[begin:end], about ``SLICE`` bytes at a time."""
    out = np.zeros(len(begin), np.uint64)
    at = 0
    while at < len(begin):
        to = max(at + 1, int(np.searchsorted(end, begin[at] + SLICE)))
        first, last = int(begin[at]), int(end[to - 1])
        part = data[first:last].astype(np.uint64) + np.uint64(1)
        lens = end[at:to] - begin[at:to]
        # Powers of an odd number by the place in the word; gaps between words count zero.
        place = np.arange(last - first) - np.repeat(begin[at:to] - first, np.diff(np.concatenate([begin[at:to], [last]])))
        power = np.cumprod(np.full(int(lens.max()) + 1, _ODD, np.uint64))
        part *= power[np.minimum(place, int(lens.max()))]
        part[place >= np.repeat(lens, np.diff(np.concatenate([begin[at:to], [last]])))] = 0
        out[at:to] = np.add.reduceat(part, begin[at:to] - first)
        at = to
    return _mix(out)


def _spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of normalised text (one blank between words) begin and end."""
    gap = np.flatnonzero(data == 32)
    return np.concatenate([[0], gap + 1]), np.concatenate([gap, [len(data)]])


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, by doubling."""
    have = 1
    while have < w:
        step = min(have, w - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def _mers(hashes: np.ndarray, mer: int) -> np.ndarray:
    """Hash of every ``mer`` neighbours."""
    n = len(hashes) - mer + 1
    total = hashes[:n].copy()
    for d in range(1, mer):
        total = total * _ODD + hashes[d : d + n]
    return _mix(total)


class Kmers:
    """The super-k-mers of some texts: minimiser, id, row, first word, windows and
    the bytes from ``begin`` to ``end`` of ``data``."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], window: int, rows: np.ndarray | None = None) -> None:
        plain = [b" ".join(t.split()) for t in texts]
        counts = np.fromiter((t.count(b" ") + 1 if t else 0 for t in plain), np.int64, len(plain))
        some = np.flatnonzero(counts >= window)
        self.raw = b" ".join([plain[i] for i in some])
        self.data = np.frombuffer(self.raw, np.uint8)
        if not some.size:
            self.minimiser = np.zeros(0, np.uint64)
            self.ids = self.rows = self.first = self.windows = self.begin = self.end = np.zeros(0, np.int64)
            return
        counts, ids = counts[some], ids[some]
        begin, end = _spans(self.data)
        low = _sliding_min(_mers(word_hashes(self.data, begin, end), min(MER, window)), window - min(MER, window) + 1)
        start = ragged(np.cumsum(counts) - counts, counts - window + 1)  # first word of every window that stays in one text
        low = low[start]
        text = np.repeat(np.arange(len(some)), counts - window + 1)
        new = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (text[1:] != text[:-1])]))
        self.windows = np.diff(np.concatenate([new, [len(start)]]))
        self.minimiser, owner, word = low[new], text[new], start[new]
        self.ids, self.first = ids[owner], word - (np.cumsum(counts) - counts)[owner]
        self.rows = np.zeros(len(owner), np.int64) if rows is None else rows[some][owner]
        self.begin, self.end = begin[word], end[word + self.windows + window - 2]

    def take(self, which: np.ndarray) -> tuple[np.ndarray, ...]:
        lens = (self.end - self.begin)[which]
        return self.ids[which], self.first[which], self.windows[which], lens, self.data[ragged(self.begin[which], lens)]


def _pieces(batch: pa.RecordBatch, window: int, size: int = 8 << 20) -> Iterator[Kmers]:
    """Super-k-mers of a batch of (id, row, text), some megabytes of text at a time."""
    ids, rows = np.asarray(batch.column(0)), np.asarray(batch.column(1))
    texts = raw_texts(batch.column(2))
    at = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size or i + 1 == len(texts):
            yield Kmers(ids[at : i + 1], texts[at : i + 1], window, rows[at : i + 1])
            at, held = i + 1, 0


def _in(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not sorted_values.size:
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def _minimisers(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in _pieces(batch, window):
                keys, n = np.unique(k.minimiser, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["minimiser", "n"])

    return run


def _blocks(window: int, buckets: int, hot):
    """Blocks of packed strings of minimisers that aren't hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdCompressor

        pack = ZstdCompressor(level=3).compress
        for batch in batches:
            rows: dict[str, list] = {"bucket": [], "block": []}
            for k in _pieces(batch, window):
                bucket = (k.minimiser % np.uint64(buckets)).astype(np.int64)
                cold = np.flatnonzero(~_in(hot.value, k.minimiser))
                cold = cold[np.argsort(bucket[cold], kind="stable")]
                for part in np.split(cold, np.flatnonzero(np.diff(bucket[cold])) + 1):
                    if part.size:
                        rows["bucket"].append(int(bucket[part[0]]))
                        rows["block"].append(pack(b"".join([np.int64(len(part)).tobytes(), k.rows[part].tobytes(), *(x.tobytes() for x in k.take(part))])))
            yield pa.RecordBatch.from_arrays([pa.array(rows["bucket"], pa.int64()), pa.array(rows["block"], pa.binary())], names=["bucket", "block"])

    return run


def _unpack(block: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(block, np.int64, 1)[0])
    head = np.frombuffer(block, np.int64, 5 * n, 8).reshape(5, n)
    return [*head, np.frombuffer(block, np.uint8, -1, 8 + 40 * n)]


def repeated(parts: list[list[np.ndarray]], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all windows of a bucket's super-k-mers: id and first word of those
    whose words also start earlier."""
    ids, first, windows, lens = (np.concatenate([p[i] for p in parts]) for i in range(4))
    joined = b" ".join(x for p in parts for x in _strings(p))
    data = np.frombuffer(joined, np.uint8)
    begin, end = _spans(data)
    hashes = word_hashes(data, begin, end)
    words = windows + window - 1
    at = ragged(np.cumsum(words) - words, windows)  # every window's first word in ``data``
    total = np.zeros(len(at), np.uint64)
    for d in range(window):
        total = total * _ODD + hashes[at + d]
    owner = np.repeat(np.arange(len(ids)), windows)
    start = first[owner] + ragged(np.zeros(len(ids), np.int64), windows)
    order = np.lexsort((start, ids[owner], total))
    total, at, start, own = total[order], at[order], start[order], ids[owner][order]
    same = np.flatnonzero(total[1:] == total[:-1]) + 1
    hit = np.zeros(len(at), bool)
    if same.size:
        new = np.concatenate([[True], total[1:] != total[:-1]])
        head = np.flatnonzero(new)[np.cumsum(new) - 1]  # first of each run of equal hashes
        s, e = begin[at], end[at + window - 1]
        clash = set()
        for i, h in zip(same.tolist(), head[same].tolist(), strict=True):
            if joined[s[i] : e[i]] != joined[s[h] : e[h]]:
                clash.add(h)
        # Rows of one id come from one text, or from rows that repeat an id and don't remove from each other.
        hit[same] = (own[same] != own[head[same]]) | (start[same] != start[head[same]])
        for h in clash:  # different words of one hash: by the words themselves
            seen: dict[bytes, tuple[int, int]] = {}
            for i in range(h, len(at)):
                if total[i] != total[h]:
                    break
                here = (int(own[i]), int(start[i]))
                hit[i] = seen.setdefault(joined[s[i] : e[i]], here) != here
    return own[hit], start[hit]


def _ranked(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, list[list[np.ndarray]]]:
    """Row and id of a bucket's documents in their order; the parts with the
    place there instead of row and id."""
    rows, ids = (np.concatenate([p[i] for p in parts]) for i in range(2))
    order = np.lexsort((rows, ids))
    new = np.concatenate([[True], (ids[order][1:] != ids[order][:-1]) | (rows[order][1:] != rows[order][:-1])])
    place = np.empty(len(ids), np.int64)
    place[order] = np.cumsum(new) - 1
    split = np.split(place, np.cumsum([len(p[0]) for p in parts])[:-1])
    return rows[order][new], ids[order][new], [[at, *p[2:]] for at, p in zip(split, parts, strict=True)]


def _strings(part: list[np.ndarray]) -> list[bytes]:
    raw = part[4].tobytes()
    end = np.cumsum(part[3])
    return [raw[s:e] for s, e in zip((end - part[3]).tolist(), end.tolist(), strict=True)]


def _runs(parts: list[list[np.ndarray]], window: int) -> pa.RecordBatch:
    """Repeated windows of a bucket as runs of words (id, row, from, to),
    neighbours as one."""
    rows, ids, parts = _ranked(parts)
    place, start = repeated(parts, window)
    order = np.lexsort((start, place))
    place, start = place[order], start[order]
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (start[1:] > start[:-1] + 1)])[: len(place)]
    head = np.flatnonzero(new)
    tail = np.concatenate([head[1:], [len(place)]])[: len(head)] - 1
    own = place[head]
    return pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(rows[own]), pa.array(start[head]), pa.array(start[tail] + window)], names=["id", "row", "from", "to"])


def _found(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdDecompressor

        unpack = ZstdDecompressor().decompress
        now, parts = None, []
        for batch in batches:
            for bucket, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != now and parts:
                    yield _runs(parts, window)
                    parts = []
                    lean()
                now = bucket
                parts.append(_unpack(unpack(block.as_py())))
        if parts:
            yield _runs(parts, window)

    return run


def _hot_windows(window: int, hot):
    """Windows of hot minimisers: their words, and the first word's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in _pieces(batch, window):
                for part in np.array_split(np.flatnonzero(_in(hot.value, k.minimiser)), 1 + len(k.minimiser) // 20_000):
                    rows: list[tuple] = []
                    for i in part.tolist():
                        words = k.raw[k.begin[i] : k.end[i]].split(b" ")
                        rows += [(int(k.ids[i]), int(k.rows[i]), int(k.first[i]) + j, b" ".join(words[j : j + window])) for j in range(int(k.windows[i]))]
                    cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], names=["id", "row", "start", "words"])

    return run


def _hot_runs(docs: DataFrame, window: int, hot) -> DataFrame:
    """Runs of repeated windows of hot minimisers.  The first start of a
    window is the first start in its smallest id; both are plain minima that
    combine before the shuffle."""
    rows = cut(docs.mapInArrow(_hot_windows(window, hot), "id bigint, row bigint, start bigint, words binary"))
    per_id = rows.groupBy("words", "id", "row").agg(F.min("start").alias("in_id"))
    first = cut(per_id.groupBy("words").agg(F.min(F.struct("id", "row", "in_id")).alias("first")).withColumnRenamed("words", "w"))
    hit = rows.join(first, F.col("words") == F.col("w")).where(F.struct("id", "row", F.col("start").alias("in_id")) != F.col("first"))
    return hit.select("id", "row", F.col("start").alias("from"), (F.col("start") + window).alias("to"))


def keyed(docs: DataFrame, id_col: str, text_col: str, key: str, row: str) -> DataFrame:
    """``docs`` with the row key: ``key`` (the id, ``NULL_ID`` for null) and
    ``row``.  Rows of null ids are written, so that their numbers stay."""
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be an integer column, it is {docs.schema[id_col].dataType.simpleString()}; number the documents first")
    number, text, of = F.col(f"`{id_col}`").cast("long"), F.xxhash64(text_col), free_name(docs, "dedup_several")
    known = docs.where(number.isNotNull()).withColumn(key, number)
    several = known.groupBy(F.col(key).alias(of)).agg(F.min(text).alias("a"), F.max(text).alias("b")).where("a <> b").select(of)
    several = cut(several)
    known = known.join(checked_broadcast(several, several.count(), 16), F.col(key) == F.col(of), "left")
    known = known.withColumn(row, F.when(F.col(of).isNotNull(), text.bitwiseOR(F.lit(-(1 << 63)))).otherwise(F.lit(0).cast("long"))).drop(of)
    null = cut(docs.where(number.isNull()).withColumn(key, F.lit(int(NULL_ID))).withColumn(row, F.monotonically_increasing_id() + 1))
    return known.unionByName(null)


def repeats(docs: DataFrame, key: str, row: str, text_col: str = "text", window: int = WINDOW, hot: int = HOT, bucket_bytes: int = BUCKET_BYTES, sample: float = SAMPLE, hot_keys: int = HOT_KEYS) -> DataFrame:
    """``id``, ``row``, ``from``, ``to``: runs of words covered by windows that
    also start earlier.  Runs may overlap."""
    spark = ship(docs.sparkSession)
    rows = docs.select(F.col(key).alias("id"), F.col(row).alias("row"), F.col(text_col).alias("text"))
    counted = rows.sample(False, sample, 5) if sample < 1 else rows
    counted = cut(counted.mapInArrow(_minimisers(window), "minimiser bigint, n bigint").groupBy("minimiser").agg(F.sum("n").alias("n")))
    every = counted.agg(F.sum("n")).first()[0] or 0  # of the sample, as are the counts
    often = counted.where(F.col("n") > max(hot * sample, every / hot_keys)).select("minimiser").toArrow()
    keys = np.sort(np.asarray(often.column(0).combine_chunks(), np.int64).view(np.uint64))
    size = PACKED * (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    sent = spark.sparkContext.broadcast(keys)
    buckets = int(max(1, size // bucket_bytes))
    parts = min(buckets, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-buckets // 16)))
    blocks = rows.mapInArrow(_blocks(window, buckets, sent), "bucket bigint, block binary")
    found = blocks.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_found(window), "id bigint, row bigint, from bigint, to bigint")
    return found.unionByName(_hot_runs(rows, window, sent)) if len(keys) else found


def _kept(texts: list[bytes], runs: pa.ListArray) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
    """Words, words removed, and the kept words joined by one blank (null
    where none is removed)."""
    n, gone, kept = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), []
    flat = runs.flatten()
    lo, hi = (np.asarray(flat.field(k)) for k in (0, 1))
    edge = np.concatenate([[0], np.cumsum(np.asarray(runs.value_lengths().fill_null(0)))])
    for i, t in enumerate(texts):
        words = t.split()
        n[i] = len(words)
        a, b = lo[edge[i] : edge[i + 1]], hi[edge[i] : edge[i + 1]]
        if not a.size:
            kept.append(None)
            continue
        depth = np.bincount(a, minlength=len(words) + 1) - np.bincount(b, minlength=len(words) + 1)
        stays = np.flatnonzero(np.cumsum(depth)[: len(words)] == 0)
        gone[i] = len(words) - stays.size
        kept.append(b" ".join([words[j] for j in stays.tolist()]))
    return n, gone, kept


def removed(text: Column, runs: Column) -> Column:
    """Struct column ``n_words``, ``n_removed``, ``kept_text`` (null: as it was)."""

    @F.arrow_udf("struct<n_words:bigint,n_removed:bigint,kept_text:string>")
    def run(col: pa.Array, lists: pa.Array) -> pa.Array:
        n, gone, kept = _kept(raw_texts(col), lists)
        return pa.StructArray.from_arrays([pa.array(n), pa.array(gone), pa.array(kept, pa.binary()).cast(pa.string())], names=["n_words", "n_removed", "kept_text"])

    return run(text, runs)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "dedup", **options) -> DataFrame:
    """``docs`` with struct column ``out``: n_words, n_removed and kept_text
    (the kept words joined by one blank; null where nothing is removed)."""
    name, key, row, of, of_row = (free_name(docs, x) for x in ("dedup_runs", "dedup_id", "dedup_row", "dedup_of", "dedup_of_row"))
    docs = keyed(docs, id_col, text_col, key, row)
    runs = repeats(docs, key, row, text_col, **options)
    # A set: rows that repeat a document find its runs again.
    per = runs.groupBy(F.col("id").alias(of), F.col("row").alias(of_row)).agg(F.collect_set(F.struct("from", "to")).alias(name))
    whole = docs.join(per, (F.col(key) == F.col(of)) & (F.col(row) == F.col(of_row)), "left")
    return whole.withColumn(out, removed(F.col(text_col), F.col(name))).drop(name, key, row, of, of_row)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", **options) -> DataFrame:
    """``docs`` with the text of rows that lose words replaced by the words
    kept, and ``length_col`` (if there is one) by its length."""
    out = free_name(docs, "dedup")
    rows = remove_repeats(docs, id_col, text_col, out, **options).withColumn(text_col, F.coalesce(F.col(out)["kept_text"], F.col(text_col)))
    if length_col in docs.columns:
        rows = rows.withColumn(length_col, F.when(F.col(out)["n_removed"] > 0, F.char_length(text_col)).otherwise(F.col(length_col)).cast(docs.schema[length_col].dataType))
    return rows.select(*[f"`{c}`" for c in docs.columns])
