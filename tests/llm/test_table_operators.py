"""Shards, mix, archives, URL lists, search and the pipeline against brute force."""

import collections
import math
import os
import re
import tempfile
import zlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from riskscope.llm import mixing, queries, sharding, topk, urlfilter, warc
from riskscope.llm.common import shared_dir

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shards_of(rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return by


def test_sharding_query(spark):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op2_sharding(spark, SF).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"}
    for r in got:
        raw = rows[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), None)
    shards_of(got)


def brute_shards(rows, shards):
    """(id, text) -> id: (shard, slot), by one sort of all rows and the bytes before each."""
    size = lambda t: len((t or "").encode()) + 16
    key = lambda t: 42 if t is None else (xxhash.xxh64_intdigest(t.encode(), 42) ^ 1 << 63) - (1 << 63)
    rows, total = sorted((key(t), i, size(t)) for i, t in rows), sum(size(t) for _, t in rows)
    group, start, out, at, slots = collections.Counter(), {}, {}, 0, collections.Counter()
    for k, _, n in rows:
        group[k] += n
    for k, i, n in rows:
        start.setdefault(k, at)
        whole = group[k] <= 0.05 * total / shards
        s = min(shards - 1, (2 * start[k] + group[k] if whole else 2 * at + n) * shards // (2 * total))
        out[i] = (s, slots[s])
        slots[s] += 1
        at += n
    return out


def test_sharding_against_a_plain_sort(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.shard, r.slot) for r in queries.op2_sharding(spark, SF).collect()}
    assert got == brute_shards([(r.doc_id, r.text) for r in docs.collect()], 40)
    rows = [(i, "hot " * 20 if i % 3 == 0 else None if i % 100 == 7 else f"t {i % 2000}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for range_bytes in (1 << 10, 32 << 20):
        assert {r.doc_id: (r.shard, r.slot) for r in sharding.shard(df, shards=9, range_bytes=range_bytes).collect()} == brute_shards(rows, 9)


def test_sharding_is_the_whole_order_cut_at_equal_bytes(spark):
    """Against a plain sort; a hot text is divided, other groups stay whole."""
    df = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot " * 20)).when(F.col("id") == 7, None).otherwise(F.concat(F.lit("t "), (F.col("id") % 2000).cast("string"))).alias("text"), F.lit(1).alias("k"), F.lit(2).alias("range")
    )
    got = sharding.shard(df, range_bytes=1 << 10).collect()
    by = shards_of(got)
    sizes = [sum(r.size for r in by[i]) for i in range(40)]
    assert max(sizes) - min(sizes) <= 0.11 * sum(sizes) / 40
    text = {r.doc_id: r.text for r in df.collect()}
    where = collections.defaultdict(set)
    for r in got:
        where[text[r.doc_id]].add(r.shard)
    assert [t for t, s in where.items() if len(s) > 1] == ["hot " * 20]


def test_sharding_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c")] * 500 + [(None, None)] * 5, "doc_id long, text string")
    by = shards_of(sharding.shard(df, shards=7).collect())
    sizes = [sum(r.size for r in v) for v in by.values()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) < 60
    assert sharding.shard(df.limit(0)).count() == 0


def test_mix_near_targets_and_stable(spark):
    got = queries.op10_mixing(spark, SF).collect()
    again = queries.op10_mixing(spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    source = {r.doc_id: (r.source, len(WORD.findall(r.text or ""))) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    taken, target, size = collections.Counter(), {}, collections.Counter()
    for r in got:
        s, n = source[r.doc_id]
        assert r.size == n and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
        size[s] += n
        target[s] = r.target
    assert all(abs(taken[s] - t) <= 0.02 * t + 64 and t <= 2 * size[s] + 1e-6 for s, t in target.items())
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-3


def test_mix_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b c", "x", 1)] * 300 + [(None, None, None, 2)] * 5 + [(5, "", "x", None), (6, "long " * 50_000, None, 3)], "doc_id long, text string, source string, place int")
    got = mixing.mix(df).collect()
    assert len(got) == 307 and all(r.taken <= 2 * r.size for r in got)
    assert mixing.repeat_rows(df).columns == df.columns
    assert mixing.mix(df.limit(0)).count() == 0 == mixing.repeat_rows(df.limit(0)).count()
    assert {r.taken for r in mixing.mix(df.where("text is null")).collect()} == {0}


def test_mix_ranges_dont_change_the_rows(spark):
    """Places counted over many short ranges of the order are those of one."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 50 != 7, F.col("id") % 2900).alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), F.col("id") % 4)).alias("source"),
        F.when(F.col("id") % 11 > 0, F.repeat(F.lit("w "), (F.col("id") % 37).cast("int"))).alias("text"), F.lit(1).alias("range"), F.lit(2).alias("ahead"),
    )
    rows = lambda d: sorted(map(repr, d.collect()))
    assert [mixing.prefix_digits(n, 64, 50_000) for n in (0, 3_200_000, 3_200_001, 8 * 10**8, 10**9, 5 * 10**10)] == [0, 0, 1, 2, 3, 5]
    assert rows(mixing.mix(df, shards=2)) == rows(mixing.mix(df, shards=2, range_rows=1)) == rows(mixing.mix(df, shards=2, range_rows=40))


def test_sainte_lague_quotas():
    """The bound that selects quotients is low enough for every seat."""
    for weights in ([5.0, 2.0, 1.0], [1e6, 1.0, 1.0], [3.0]):
        seats = 50
        bound = sum(weights) / (2 * seats + len(weights))
        assert sum(int((w / bound + 1) // 2) for w in weights) >= seats


def mixed_sums(docs, **options):
    """Words taken, target and size of every source."""
    got = docs.join(mixing.mix(docs, **options), "doc_id").groupBy("source")
    return {r.source: (r.t, r.target, r.n) for r in got.agg(F.sum("taken").alias("t"), F.max("target").alias("target"), F.sum("size").alias("n")).collect()}


def test_mix_keeps_tiny_sources_beside_a_huge_one(spark):
    """No source loses its target, however small it is beside the others."""
    rows = [("huge", 20_000)] * 40 + [("s0", 1)] + [("s1", 1)] * 2 + [("s2", 30)] * 10 + [("s3", 7)] * 90
    docs = spark.createDataFrame([(i, s, "w " * n) for i, (s, n) in enumerate(rows)], "doc_id long, source string, text string")
    for options in ({}, {"shards": 64}, {"shards": 3}):
        sums = mixed_sums(docs, **options)
        assert sum(t for t, _, _ in sums.values()) == int(1.5 * sum(n for _, n in rows))
        assert all(abs(t - target) <= 1 for t, target, _ in sums.values()), sums
        assert all(sums[s][0] == 2 * sums[s][2] for s in ("s0", "s1", "s2", "s3"))


def test_mix_passes_on_what_is_over_twice_a_size(spark):
    """Against Sainte-Laguë one seat at a time; seats over the room go to the most room left."""
    rows = [(g, i, w) for g, ws in enumerate(([700, 90, 9, 1, 0], [3, 3, 3, 3], [10**9, 1, 1], [5])) for i, w in enumerate(ws)]
    df = spark.createDataFrame([(g, i, w, seats, sum(x[2] for x in rows if x[0] == g)) for seats in (1, 7, 50, 999) for g, i, w in rows], "g int, i int, w long, seats long, whole long")
    cap = F.ceil(F.col("w") / 2 + 1)
    wide = mixing.apportioned(df.where("g < 4"), ["g", "seats"], F.col("w"), F.col("seats"), F.col("whole"), 5, ["i"], F.lit(10**6)).collect()
    tight = mixing.apportioned(df, ["g", "seats"], F.col("w"), F.col("seats"), F.col("whole"), 5, ["i"], cap).collect()
    for seats in (1, 7, 50, 999):
        for g in range(4):
            own = [w for h, _, w in rows if h == g]
            won = [0] * len(own)
            for _ in range(seats):
                won[min(range(len(own)), key=lambda i: (-own[i] / (2 * won[i] + 1), i))] += 1
            assert [r.won for r in sorted(wide) if (r.g, r.seats) == (g, seats)] == won
            kept = [r for r in tight if (r.g, r.seats) == (g, seats)]
            most = [math.ceil(r.w / 2 + 1) for r in kept]
            assert all(r.won <= m for r, m in zip(kept, most, strict=True)) and sum(r.won for r in kept) == min(seats, sum(most))


def test_mix_ranges_divide_repeated_ids(spark):
    """A third of the rows without an id, a third of one id, half of these alike."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 1, 7).when(F.col("id") % 3 == 2, F.col("id")).alias("doc_id"), F.lit("s").alias("source"), F.repeat(F.lit("w "), F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id") % 90).cast("int")).alias("text")
    )
    sized = df.select(F.col("doc_id").alias("id"), "source", mixing.n_words(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key"), F.monotonically_increasing_id().alias("uid"))
    rows = mixing.ranged(sized, 2, 40)
    assert rows.count() == 3000 and rows.groupBy("range").count().agg(F.max("count")).first()[0] <= 80
    ordered = [(r.key, r.id is not None, r.size) for r in rows.orderBy("range", "key", "id", "size").collect()]
    assert ordered == sorted(ordered)
    rows = lambda d: sorted(map(repr, d.collect()))
    assert rows(mixing.mix(df, shards=2)) == rows(mixing.mix(df, shards=2, range_rows=40))


def test_warc_records_are_standard_gzip_members(spark):
    path = shared_dir(spark, "test-warc")
    pages = spark.createDataFrame(
        [(3, "http://a/\r\nX: y", "p" * 200), (1, None, "p" * 200), (2, "u", "p" * 200), (2, "u", "p" * 200), (4, "v", "short"), (5, "v", "short"), (6, "w", None), (7, "é", "é" * 60_000), (None, "n", "p" * 200)],
        "page_id long, url string, html string",
    )
    warc.write(warc.records_of(pages), path)
    rows = {(r.record_id, r.warc_type): r for r in warc.read(spark, path).collect()}
    assert {k for k in rows} == {("urn:page:1", "response"), *((f"urn:page:{i}", "revisit") for i in (2, 3, "")), *((f"urn:page:{i}", "response") for i in (4, 5, 6, 7))}
    assert rows["urn:page:3", "revisit"].refers_to == "urn:page:1" and rows["urn:page:3", "revisit"].payload_length == 200
    assert rows["urn:page:3", "revisit"].target_uri == "http://a/%0D%0AX: y"
    assert bytes(rows["urn:page:7", "response"].payload) == ("é" * 60_000).encode()
    local = path.removeprefix("file://")
    raw = b"".join(open(f"{local}/{n}", "rb").read() for n in os.listdir(local) if n.endswith(".gz"))
    count = 0
    while raw:  # any reader of gzip members can read it
        inflate = zlib.decompressobj(31)
        data = inflate.decompress(raw)
        assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")
        raw, count = inflate.unused_data, count + 1
    assert count == 9
    foreign = tempfile.mkdtemp(prefix="run-")
    record = warc.record(dict(record_id="a", warc_type="response", date=None, target_uri="u", refers_to=None, payload_digest=None, payload_length=2, payload=b"hi"))
    open(f"{foreign}/x.warc", "wb").write(record * 3)
    import gzip

    open(f"{foreign}/y.warc.gz", "wb").write(gzip.compress(record) * 2)
    assert [bytes(r.payload) for r in warc.read(spark, foreign).collect()] == [b"hi"] * 5
    empty = shared_dir(spark, "test-warc")
    warc.write(warc.records_of(pages.limit(0)), empty)
    assert warc.read(spark, empty).count() == 0


def test_warc_members_of_several_records(spark):
    """An archive compressed as a whole, and members of one and of three records."""
    import gzip

    record = lambda i, kind, body: warc.record(dict(record_id=i, warc_type=kind, date=None, target_uri="u", refers_to=None, payload_digest=None, payload_length=len(body), payload=body))
    big = os.urandom(3_000_000)
    all_of = [record("a", "response", b"hi"), record("b", "resource", big), record("c", "response", b"")]
    path = tempfile.mkdtemp(prefix="run-")
    open(f"{path}/x.warc.gz", "wb").write(gzip.compress(b"".join(all_of)) + gzip.compress(all_of[0]) + gzip.compress(b"".join(all_of)))
    got = warc.read(spark, path)
    assert sorted((r.record_id, bytes(r.payload)) for r in got.collect()) == sorted([("a", b"hi")] * 3 + [("b", big)] * 2 + [("c", b"")] * 2)
    assert got.where("warc_type = 'response'").count() == 5


def test_warc_pushes_filters_and_skips_payloads(spark):
    reader = warc.WarcReader("/nowhere", False, 1)
    from pyspark.sql.datasource import EqualTo, GreaterThan

    rest = list(reader.pushFilters([EqualTo(("warc_type",), "revisit"), GreaterThan(("payload_length",), 5)]))
    assert len(rest) == 1 and reader.wanted == [("warc_type", frozenset(["revisit"]))]
    path = shared_dir(spark, "test-warc")
    warc.write(warc.records_of(spark.read.parquet(f"{SF}/pages.parquet")), path)
    got = warc.read(spark, path, payload=False).where("record_id in ('urn:page:1', 'urn:page:2')").collect()
    assert len(got) == 2 and all(r.payload is None and r.payload_length for r in got)


def test_bloom_has_no_misses_and_the_join_no_false_hits(spark):
    listed = spark.range(0, 4000, 2).select(F.concat(F.lit("h/"), "id").alias("u"))
    rows = spark.range(4000).select(F.concat(F.lit("h/"), "id").alias("key"), F.lit(1).alias("block"), F.lit("z").alias("w0")).unionByName(spark.range(3).select(F.lit(None).cast("string").alias("key"), F.lit(1).alias("block"), F.lit("z").alias("w0")))
    got = urlfilter.on_list(rows, "key", listed, "hit").collect()
    assert len(got) == 4003
    assert all(r.hit == (r.key is not None and int(r.key[2:]) % 2 == 0) for r in got)


def test_url_rules(spark):
    urls = ["http://A.Example.NET/en/x?q#f", "http://example.net/de/", "https://example.net", "x://sub.example.com/de/a", "y://fake-example.com/de/", "z://w.org/fr/", "no scheme", None, "", "http://h/p/?b=2&a=1&utm_x=3#z", "https://www.H/p?a=1&b=2"]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    listed = spark.createDataFrame([("h/p?a=1&b=2",), (None,)], "u string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, queries.RULES, listed).collect()}
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[1] == ("example.net", "/de/", "net/", "block")
    assert got[2] == ("example.net", "", None, "allow")
    assert got[3][2:] == ("example.com/de/", "block") and got[4][2:] == (None, "allow") and got[5][2:] == ("org/fr/", "allow")
    assert got[6] == got[7] == got[8] == ("", "", None, "allow")
    assert got[9][2:] == got[10][2:] == (None, "block")
    assert urlfilter.judge(pages.limit(0), queries.RULES, listed.limit(0)).count() == 0


def brute_top(rows, k, asked):
    fine = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = collections.Counter()
    for i, v in fine:
        if asked(i):
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in fine if j != i and len(w) == len(v))[:k]
            out.update((i, r, j, -s) for r, (s, j) in enumerate(best, 1))
    return out


def test_topk_with_ties_nulls_and_small_shards(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 4) / 4]) for i in range(300)]
    rows += [(None, [1.0] * 4), (400, None), (410, [1.0, None, 0.0, 0.0]), (420, [float("nan")] * 4), (430, [float("inf")] * 4), (440, []), (450, [1.0, 2.0]), (350, [0.25] * 4)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<float>, id int")
    want = brute_top(rows, 7, lambda i: i % 10 == 0)
    for shard_rows, query_rows in ((50, 7), (10**6, 10**6)):
        assert collections.Counter(map(tuple, topk.top_k(df, "vec_id % 10 = 0", k=7, shard_rows=shard_rows, query_rows=query_rows).collect())) == want
    assert topk.top_k(df.limit(0), "vec_id % 10 = 0").count() == 0


def test_ball_bounds_hold():
    rng = np.random.default_rng(2)
    v = rng.integers(-200, 200, (500, 8))
    tree = topk.Ball(v, np.arange(500))
    bound = tree.bounds(v[:20])
    for n, (lo, hi) in enumerate(zip(tree.lo, tree.hi, strict=True)):
        assert (tree.vectors[lo:hi] @ v[:20].T <= bound[:, n]).all()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("rules", F.lit(1))
    columns = docs.columns
    seen = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        path = shared_dir(spark, "test-stage")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        seen.append(docs.count())
    assert seen[0] > seen[1] > seen[2] == seen[3]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    want = collections.Counter(zlib.crc32((r.text or "").encode()) for r in docs.collect())
    assert sum(want.values()) == out.count()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.run(spark, SF).count() > 0
