"""Packing: pieces against the tokenizers library, plans against bounds."""

import collections
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskscope.llm import configlp, packing, queries
from riskscope.llm.common import cut

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text, add_special_tokens=False).ids, 2]


def check_places(rows, capacity):
    """Every sequence is filled from 0 without gap or overlap; how many there are."""
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(by)


def test_packing_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    encode, got = library(), queries.op12_packing(spark, SF).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert by.keys() == texts.keys()
    total = 0
    for i, text in texts.items():
        ids, own = encode(text), sorted(by[i], key=lambda r: r.piece)
        total += len(ids)
        assert [r.piece for r in own] == list(range(-(-len(ids) // 1024)))
        assert [r.length for r in own[1:]] == [1024] * (len(own) - 1) and sum(r.length for r in own) == len(ids)
        for r in own:
            part = np.array(ids[r.start : r.start + r.length], "<u4")
            assert r.start == sum(x.length for x in own[: r.piece]) and r.ids_crc32 == zlib.crc32(part.tobytes())
    assert -(-total // 1024) <= check_places(got, 1024) <= -(-total // 1024) + 1


def test_odd_texts_extra_columns_and_sequences(spark):
    texts = [None, "", "a" * 25_000, " " * 2_500 + "x", "<|endoftext|> it's  \n\n ok", "né 漢字 🙂" * 40, "x " * 3_000, "it"] * 2
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumns({"start": F.lit("s"), "pack_at": F.lit(1), "a.b": F.lit(2)})
    out = packing.pack(frame, PATH, capacity=64)
    assert out.columns == ["id", "pack_at", "a.b", "piece", "start", "length", "ids", "sequence_id", "offset"]
    rows, encode = out.collect(), library()
    check_places(rows, 64)
    for i, text in enumerate(texts):
        own = sorted((r for r in rows if r.id == i), key=lambda r: r.piece)
        assert np.frombuffer(b"".join(r.ids for r in own), "<u4").tolist() == encode(text or "")
    whole = {r.sequence_id: r.ids for r in packing.sequences(out).collect()}
    for r in rows:
        assert whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == r.ids
    assert packing.pack(frame.limit(0), PATH).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_the_histogram_and_is_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = [rng.integers(1, 65, 4_000), rng.integers(20, 40, 3_000), np.repeat([31, 33, 17], 1_000), np.minimum(64, rng.geometric(0.1, 5_000))][seed]
    counts = np.bincount(lengths, minlength=65)
    plan, bound = configlp.packed(counts)
    held = np.zeros(65, np.int64)
    for config, n in plan:
        assert n > 0 and sum(k * t for k, t in config.items()) <= 64
        for k, t in config.items():
            held[k] += n * t
    bins = sum(n for _, n in plan)
    assert (held == counts).all()
    assert bound <= bins <= sum(n for _, n in configlp.best_fit(counts))
    assert bins <= (1.06 if seed in (1, 2) else 1.01) * bound + 2  # the prices' bound isn't tight where nothing fits exactly


def test_plan_beats_best_fit_where_that_is_bad():
    # Thirds and sixths and a half: best-fit decreasing pairs the large pieces badly.
    counts = np.zeros(102, np.int64)
    counts[[51, 27, 26, 23, 10]] = [6_000, 6_000, 6_000, 6_000, 12_000]
    plan, bound = configlp.packed(counts)
    assert bound <= sum(n for _, n in plan) < sum(n for _, n in configlp.best_fit(counts))


def test_knapsack_against_all_multisets():
    prices = np.array([0, 0, 0.21, 0, 0.39, 0.52, 0, 0.7, 0])
    best, last = configlp.knapsack(prices)
    for c in range(9):
        want = max(2 * a * 0 + 0.21 * a + 0.39 * b + 0.52 * d + 0.7 * e for a in range(5) for b in range(3) for d in range(2) for e in range(2) if 2 * a + 4 * b + 5 * d + 7 * e <= c)
        assert abs(best[c] - want) < 1e-9
    assert configlp.configuration(2, last) in ({2: 2, 4: 1}, {2: 4}, {2: 1, 4: 1, 1: 2}, {2: 1, 5: 1})


def test_a_length_that_holds_all_rows(spark):
    frame = spark.createDataFrame([(i,) for i in range(3_000)], "id long").withColumn("length", F.lit(300).cast("long"))
    assert check_places(packing.place(cut(frame)).collect(), 1024) == 1_000
