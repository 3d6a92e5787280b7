"""Tokens, fingerprints, substring dedup, classifier and rules against brute force."""

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash

from riskscope.llm import bpe, quality, queries, rules, simhash, stats, substring
from riskscope.llm.components import components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD_TEXTS = [None, "", "  ", "a  b \n\n  é日本 x\xa0y \U0001f600\U0001f9ff", "\n x", " \n \t a", "it's 12ab!!", "a\x85b \x1c c", "word " * 30_000, "x" * 200_000]


def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def frame(spark, rows):
    """Rows of (id, text) with extra columns named as the operators' own."""
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, ids string, fp int")


@pytest.fixture(scope="module")
def reference_encoding():
    path = P.path(queries.VOCABULARY)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_query(spark, reference_encoding):
    got = {r.doc_id: r for r in queries.op1_byte_bpe(spark, SF).collect()}
    for i, t in texts(spark).items():
        ids = reference_encoding.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_odd_texts_offsets_and_round_trip(spark, reference_encoding):
    path = P.path(queries.VOCABULARY)
    df = frame(spark, list(enumerate(ODD_TEXTS)))
    for r in bpe.decode(bpe.encode(df, path, P.PATTERN), path, P.PATTERN).collect():
        text = r.text or ""
        assert r.ids == reference_encoding.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode()
        for i, s, e in zip(r.ids, r.starts, r.ends, strict=True):
            assert reference_encoding.decode_single_token_bytes(i) in text[s:e].encode()
    assert bpe.encode(df.limit(0), path, P.PATTERN).count() == 0
    assert bpe.decode(df.selectExpr("cast(null as array<int>) ids"), path, P.PATTERN).first().decoded is None


def brute_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, most=3):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= most):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash_query(spark):
    got = {r.doc_id: r for r in queries.op3_simhash(spark, SF).collect()}
    rows = sorted(texts(spark).items())
    fps = np.array([brute_fingerprint(t) for _, t in rows], np.uint64)
    root = brute_components(fps)
    for (i, _), f, r in zip(rows, fps, root, strict=True):
        assert (got[i].fingerprint, got[i].component_id) == (f"{int(f):016x}", rows[r][0])


def test_simhash_dense_lists(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BFS_LIST", 200)
    rng = np.random.default_rng(1)
    fps = set()
    for base in rng.integers(0, 2**63, 3):
        for _ in range(700):
            x = int(base)
            for k in rng.integers(0, 64, rng.integers(1, 7)):
                x ^= 1 << int(k)
            fps.add(x)
    signed = np.sort(np.array(sorted(fps), np.uint64).view(np.int64))
    many = simhash.links(spark.createDataFrame([(int(x),) for x in signed], "fp long"))
    assert many.count() < 80 * len(signed)  # linear, not all pairs
    got = {r.node: r.root for r in components(many, "a", "b").collect()}
    root = brute_components(signed.view(np.uint64))
    assert all(got.get(int(x), int(x)) == signed[r] for x, r in zip(signed, root, strict=True))


def test_components_with_hubs(spark, monkeypatch):
    """Hubs met by broadcast: a star, a path, a dense group, repeated and self links."""
    monkeypatch.setattr("riskscope.llm.components.HUB", 4)
    edges = [(500, i) for i in range(400, 460)] + [(i, i + 1) for i in range(40)] + [(i, j) for i in range(100, 109) for j in range(100, i)]
    edges += [(500, 400), (7, 7), (900, 900), (460, 399), (459, 460)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    want = dict.fromkeys(range(41), 0) | dict.fromkeys(range(100, 109), 100) | dict.fromkeys([*range(399, 461), 500], 399)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_simhash_odd_rows(spark):
    long = "one two three four five six " * 20_000
    df = frame(spark, [(5, None), (3, ""), (None, " "), (7, long), (7, long), (None, "q w e r t"), (9, "a b")])
    got = simhash.near_duplicates(df).collect()
    assert len(got) == 7
    assert {r.doc_id: r.component_id for r in got if r.doc_id} == {5: 3, 3: 3, 7: 7, 9: 9}
    assert next(r for r in got if r.doc_id == 3).fingerprint == "0" * 16
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "7", "9", "None"]
    assert simhash.keep_one(df.limit(0)).count() == 0 == simhash.near_duplicates(df.limit(0)).count()


def brute_repeats(rows, window):
    seen, out = set(), {}
    for i, t in sorted(rows):
        words = WORD.findall(t or "")
        gone = [False] * len(words)
        for p in range(len(words) - window + 1):
            k = tuple(words[p : p + window])
            if k in seen:
                gone[p : p + window] = [True] * window
            seen.add(k)
        out[i] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize(("window", "hot", "bucket"), [(3, 5, 2_000), (8, 10**6, 500), (1, 3, 1_000)])
def test_substring_random_texts(spark, window, hot, bucket):
    random.seed(3)
    rows = [(i, " ".join(random.choice("abc") for _ in range(random.randint(0, 60)))) for i in range(150)] + [(1000, None), (1001, " \t\x85x  y\n")]
    want = brute_repeats(rows, window)
    for r in substring.remove_repeats(frame(spark, rows), window=window, hot=hot, bucket_bytes=bucket, sample=1.0).collect():
        kept = " ".join(WORD.findall(r.text or "")) if r.dedup.kept_text is None else r.dedup.kept_text
        assert (r.dedup.n_words, r.dedup.n_removed, kept) == want[r.doc_id]


def test_substring_collisions_are_settled_by_the_words(monkeypatch):
    monkeypatch.setattr(substring, "word_hashes", lambda data, begin, end: np.ones(len(begin), np.uint64))
    k = substring.Kmers(np.array([1, 2, 3]), [b"a b c", b"a b d", b"a b c"], 3)
    ids, start = substring.repeated([list(k.take(np.arange(len(k.ids))))], 3)
    assert (ids.tolist(), start.tolist()) == ([3], [0])


def test_substring_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d", 7), (1, "a b c d", 7), (1, "a b c d", 7), (2, "a b c d", 7), (3, None, None)], "doc_id long, text string, n_chars long")
    got = sorted((str(r.doc_id), r.text, r.n_chars) for r in substring.without_repeats(df, window=2).collect())
    assert got == [("1", "a b c d", 7), ("1", "a b c d", 7), ("2", "", 0), ("3", None, None), ("None", "", 0)]
    assert substring.without_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [2, 10**6])
def test_substring_null_and_repeated_ids_with_other_texts(spark, hot):
    """Runs meet the row they were found in; null ids are documents of their own."""
    words = lambda a, n: [f"{a}{i}" for i in range(n)]
    text = lambda *parts: " ".join(sum(parts, []))
    seven = words("p", 100)
    one = text(words("a", 100), seven, words("b", 100))
    rows = [(7, text(seven)), (None, one), (None, text(words("c", 50))), (None, text(words("d", 250))), (3, text(words("e", 60))), (3, text(words("f", 10), seven)), (3, None)]
    rows += [(None, text(words("z", 40)))] * 2 + [(9, text(words("g", 30)))] * 2 + [(2**63 - 1, text(words("h", 30), words("a", 30)))]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), window=20, hot=hot, bucket_bytes=1_000, sample=1.0)
    gone = sorted((str(r.doc_id), r.text or "", r.dedup.n_removed) for r in got.collect())
    # Ids come before: 3's passage is the first, those of 7 and of a null id repeat it; of two equal rows without an id one stays.
    want = dict.fromkeys(rows, 0) | {rows[0]: 100, rows[1]: 130}
    twice = sorted((str(i), t or "", want[i, t]) for i, t in rows)
    at = max(n for n, r in enumerate(twice) if r[1].startswith("z0 "))
    assert gone == sorted([*twice[:at], ("None", twice[at][1], 40), *twice[at + 1 :]])


def test_counts_against_plain_python():
    for t in ["a b c a b c d", "x\nx\n\n y # $\nx", "É É É É\n!! ..", "one", "", "p q r " * 5 + "\x85"]:
        words, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        covered = {i + d for i, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)}
        c = dict(zip(stats.COUNTS, stats.counts(t.encode()), strict=True))
        assert c["n_words"] == len(words) and c["word_chars"] == sum(map(len, words))
        assert c["n_symbols"] == sum(t.count(x) for x in "#*$%&|<>")
        assert c["n_dup_lines"] == sum(x in lines[:i] for i, x in enumerate(lines))
        assert c["n_repeat_words"] == len(covered)


def test_labelled_sample_collects_one_row_of_an_id(spark, monkeypatch):
    rows = [(1, "a " * (i % 40 + 1)) for i in range(500)] + [(2, "b"), (3, None), (None, "c")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    real, seen = type(docs).collect, []
    monkeypatch.setattr(type(docs), "collect", lambda self: seen.append(real(self)) or seen[-1])
    got = stats.labelled_sample(docs, labels, 20_000)
    assert max(map(len, seen)) == 3
    counts = [max(stats.counts(("a " * n).encode()) for n in range(1, 41)), stats.counts(b"b"), stats.counts(b"")]
    assert got.tolist() == [[label, *c] for label, c in zip((1, 0, 1), counts, strict=True)]


def test_quality_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in queries.op4_quality(spark, d).collect() if r.held_out and r.doc_id in labels]
    assert len(rows) > 50 and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == labels[r.doc_id] for r in rows) >= 0.9 * len(rows)


def test_quality_and_rules_odd_rows(spark):
    df = frame(spark, [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "a b"), (1, "")])
    none = spark.createDataFrame([(None, 1), (1, None), (2, 7)], "doc_id long, quality int")
    model = quality.train(df, none)
    assert {r.score for r in quality.score(df, model).collect()} == {0.5}
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, quality int")
    assert quality.score(df, quality.train(df, labels)).count() == len(ODD_TEXTS) + 2
    forest = rules.train(df, none)
    got = rules.judge(df, forest).collect()
    assert [r.rules.kept for r in got] == [not r.rules.base_failed for r in got]
    kept = rules.keep(df, forest)
    assert kept.columns == df.columns and kept.count() == sum(r.rules.kept for r in got)
    assert rules.keep(df.limit(0), forest).count() == 0


def test_rules_reject_junk_and_keep_good(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in queries.op7_quality_rules(spark, d).collect() if r.doc_id in labels and not r.base_failed]
    good = [r.kept for r in rows if labels[r.doc_id] == 1]
    bad = [r.kept for r in rows if labels[r.doc_id] == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_rules_learn_from_every_labelled_row(spark):
    rng = np.random.default_rng(3)
    good = ["".join(f"w{k} " for k in rng.integers(0, 400, 80)) + "# " * int(rng.integers(0, 6)) for _ in range(60)]
    texts = good + ["".join(f"w{k} " for k in rng.integers(0, 400, 80)) + "# " * 60 for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(80)], "doc_id long, quality int")
    forest = rules.train(docs, labels)
    m = stats.matrix([t.encode() for t in texts])
    x, fine = rules.rule_statistics(m), ~rules.base_failed(m)
    rows = sum(fine[:60])
    n = np.stack([np.bincount(leaf, minlength=256) for leaf in forest.leaves(x[:60][fine[:60]])])
    again = rules.settle(rules.drawn(x.shape[1]), n)
    assert (n.sum(1) == rows).all() and np.array_equal(again.path, forest.path) and again.usual == rules.expected_path(rows)
    score, is_good = forest.anomaly(x[fine]), np.arange(80)[fine] < 60
    places = np.unique(score[score >= np.quantile(score[is_good], rules.KEEP_SHARE, method="higher")])
    places = np.append((places[:-1] + places[1:]) / 2, (places[-1] + 1) / 2)
    right = [(score[is_good] <= c).mean() + (score[~is_good] > c).mean() for c in places]
    assert forest.threshold == places[np.flatnonzero(np.isclose(right, max(right), rtol=0, atol=1e-12))[-1]]
    few, many = (sorted(map(str, stats.labelled(docs, labels, limit).collect())) for limit in (0, 1000))
    assert few == many and len(few) == 80
