"""Repeated query ids, clashing column names, other id types, limits without caps."""

import pytest
from pyspark.sql import functions as F

from riskscope.llm import substring, topk


def test_topk_of_a_repeated_query_id(spark):
    """The smallest vector of an id is the query, once; candidates that repeat an id each count."""
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [2.0, 0.0]), (0, [0.0] * 3), (1, [3.0, 1.0]), (2, [2.0, 9.0]), (2, [1.0, 9.0]), (3, [0.5, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    two = df.where("size(embedding) = 2")
    got = [tuple(r) for r in topk.top_k(two, "vec_id = 0", k=3, shard_rows=2).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 3 * 65536), (0, 2, 2, 2 * 65536), (0, 3, 2, 65536)]
    assert [r.vec_id for r in topk.top_k(two, "vec_id = 0", k=9).orderBy("rank").collect()] == [1, 2, 2, 3]


def test_substring_with_a_column_named_like_its_own(spark):
    words = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, words), (2, words), (2, "other"), (None, words)], "doc_id long, text string")
    plain = sorted(map(str, substring.without_repeats(df).collect()))
    odd = df.withColumns({c: F.lit("x") for c in ("of", "dedup_several", "a", "b", "key")})
    out = substring.without_repeats(odd)
    assert out.columns == odd.columns and sorted(map(str, out.select("doc_id", "text").collect())) == plain


def test_substring_wants_integer_ids(spark):
    with pytest.raises(TypeError, match="integer"):
        substring.remove_repeats(spark.createDataFrame([("a", "x y")], "doc_id string, text string"))


@pytest.mark.parametrize("hot, hot_keys, bucket", [(20_000, 8_000_000, 6 << 20), (1, 8_000_000, 50), (1, 40, 50), (1, 3, 1_000)])
def test_substring_limits_change_no_row(spark, hot, hot_keys, bucket):
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [(i, f"a{i} b{i} {shared if i % 3 else shared[:120]} c{i % 2} {shared}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = substring.remove_repeats(df, hot=hot, hot_keys=hot_keys, bucket_bytes=bucket, sample=1.0).select("doc_id", "dedup.*").collect()
    seen, want = set(), {}
    for i, text in sorted(rows):
        words, gone = text.split(), set()
        for p in range(len(words) - 19):
            key = tuple(words[p : p + 20])
            if key in seen:
                gone |= set(range(p, p + 20))
            seen.add(key)
        want[i] = (len(words), len(gone), " ".join(w for j, w in enumerate(words) if j not in gone) if gone else None)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == want
