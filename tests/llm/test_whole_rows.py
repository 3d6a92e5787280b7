"""Classifier, rules and the whole pipeline, row by row, against plain Python."""

import base64
import collections
import hashlib
import heapq
import math
import re

import numpy as np
import public_tokenizers as P
import tiktoken
import xxhash

import corpus_pipeline
from riskscope.llm import quality, queries, rules, stats

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    places = collections.defaultdict(list)
    for i in range(len(words) - 2):
        places[tuple(words[i : i + 3])].append(i)
    repeated = {i + d for at in places.values() if len(at) > 1 for i in at for d in range(3)}
    some = lambda of: sum((text or "").count(c) for c in of)
    return {
        "n_bytes": len((text or "").encode()), "n_chars": len(text or ""), "n_words": len(words), "word_chars": sum(map(len, words)),
        "n_symbols": some("#*$%&|<>"), "n_lines": len(lines), "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)),
        "n_repeat_words": len(repeated), "n_distinct_words": len(set(words)), "n_same_next": sum(a == b for a, b in zip(words, words[1:])),
        "n_upper": some("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "n_digits": some("0123456789"), "n_stops": some(".?"), "n_commas": some(",;:"),
        "n_marks": some("!"), "longest_word": max((len(w.encode()) for w in words), default=0),
    }


def plain_shares(c):
    words, chars, lines = (max(c[k], 1) for k in ("n_words", "word_chars", "n_lines"))
    return [
        c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words, c["n_same_next"] / words,
        c["n_upper"] / chars, c["n_digits"] / chars, c["n_stops"] / words, c["n_commas"] / words, c["n_marks"] / words,
        min(c["longest_word"], 100) / (c["word_chars"] / words + 1), c["n_bytes"] / max(c["n_chars"], 1),
    ]


def leaf_of(feature, cut, depth, row):
    node = 0
    for _ in range(depth):
        node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
    return node - (2**depth - 1)


def plain_kept(forest, text):
    """Base rules and forest for one text, one tree after another."""
    c = plain_counts(text)
    if c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]:
        return False
    row = [math.sqrt(min(max(plain_shares(c)[k], 0), 1)) for k in (1, 2, 3, 4, 5, 9)]
    paths = [path[leaf_of(f, cut, forest.depth, row)] for f, cut, path in zip(forest.feature, forest.cut, forest.path)]
    return 2.0 ** (-sum(paths) / len(paths) / forest.usual) <= forest.threshold


def rows_of(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_counts_are_the_plain_ones(spark):
    for r in rows_of(spark, "documents").select("text").collect():
        assert dict(zip(stats.COUNTS, stats.counts((r.text or "").encode()))) == plain_counts(r.text)


def test_rules_verdicts(spark):
    docs = rows_of(spark, "documents").select("doc_id", "text")
    forest = rules.train(docs, rows_of(spark, "labels"))
    text = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.kept for r in queries.op7_quality_rules(spark, SF).collect()}
    assert got == {i: plain_kept(forest, t) for i, t in text.items()} and 0 < sum(got.values()) < len(got)


def test_forest_paths_follow_from_the_rows():
    """A leaf's path: the splits above it and what its rows would still take."""
    x = np.random.default_rng(5).random((300, 3)) ** 2
    forest = rules.fit(x, trees=9, sample=1024, depth=5)
    for feature, cut, path in zip(forest.feature, forest.cut, forest.path):
        n = collections.Counter(leaf_of(feature, cut, 5, row) for row in x)
        for leaf in range(2**5):
            node, splits = leaf + 2**5 - 1, 0
            while node:
                node = (node - 1) // 2
                splits += math.isfinite(cut[node])
            if n[leaf]:
                k = n[leaf]
                rest = 0 if k == 1 else 1 if k == 2 else 2 * (math.log(k - 1) + 0.5772156649015329) - 2 * (k - 1) / k
                assert abs(path[leaf] - splits - rest) < 1e-12
    assert forest.usual == 2 * (math.log(1023) + np.euler_gamma) - 2 * 1023 / 1024
    far = forest.anomaly(np.array([[0.99, 0.99, 0.99], [0.05, 0.05, 0.05]]))
    assert far[0] > far[1]


def plain_boosting(x, y, trees, depth, bins, rate, ridge, least):
    """Scores of the rows themselves: each node searched feature by feature, edge by edge."""
    share = min(max(sum(y) / len(y), 1e-3), 1 - 1e-3)
    raw = [math.log(share / (1 - share))] * len(y)
    edges = [sorted({float(v) for v in np.quantile(f, np.arange(1, bins) / bins)}) for f in x.T]
    for _ in range(trees):
        p = [1 / (1 + math.exp(-r)) for r in raw]
        grad, hess = [a - b for a, b in zip(y, p)], [q * (1 - q) for q in p]

        def grow(rows, level):
            g, h = math.fsum(grad[i] for i in rows), math.fsum(hess[i] for i in rows)
            best = None
            if level < depth:
                for k in range(x.shape[1]):
                    for e in edges[k]:
                        left = [i for i in rows if x[i, k] <= e]
                        gl, hl = math.fsum(grad[i] for i in left), math.fsum(hess[i] for i in left)
                        if hl * 4 < least or (h - hl) * 4 < least:
                            continue
                        gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
                        if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                            best = (gain, left, [i for i in rows if x[i, k] > e])
            if best:
                grow(best[1], level + 1)
                grow(best[2], level + 1)
            else:
                for i in rows:
                    raw[i] += rate * g / (h + ridge)

        grow(list(range(len(y))), 0)
    return [1 / (1 + math.exp(-r)) for r in raw]


def test_boosting_equals_a_plain_search():
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(160, 3)), 2)
    x[:, 2] = np.round(x[:, 2])  # many ties
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=160) * 0.4) > 0).astype(float)
    got = quality.fit(x, y, trees=4, depth=3, bins=9).score(x)
    want = plain_boosting(x, y, 4, 3, 9, 0.15, 1.0, 5.0)
    assert np.allclose(got, want, atol=1e-9) and 0.05 < np.std(want)


def test_quality_scores(spark):
    docs = rows_of(spark, "documents").select("doc_id", "text")
    model = quality.train(docs, rows_of(spark, "labels"))
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = {r.doc_id: r for r in queries.op4_quality(spark, SF).collect()}
    assert rows.keys() == text.keys()
    for i, t in text.items():
        c = plain_counts(t)
        row = [*plain_shares(c), c["n_distinct_words"] / max(c["n_words"], 1), math.log1p(c["n_words"]), math.log1p(c["n_lines"])]
        raw = model.base + sum(v[leaf_of(f, cut, model.depth, row)] for f, cut, v in zip(model.feature, model.cut, model.value))
        assert abs(rows[i].score - 1 / (1 + math.exp(-raw))) < 1e-9 and rows[i].predicted == (rows[i].score >= 0.3)


def fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_firsts(docs):
    """The smallest id of each group that links at three or fewer bits."""
    fp, kept, seen = {i: fingerprint(d["text"]) for i, d in docs.items()}, {}, set()
    for i in sorted(docs):
        if i in seen:
            continue
        kept[i], queue = docs[i], [i]
        seen.add(i)
        while queue:
            a = queue.pop()
            near = [b for b in docs if b not in seen and (fp[a] ^ fp[b]).bit_count() <= 3]
            seen.update(near)
            queue += near
    return kept


def plain_passages(docs, window=20):
    earlier, out = set(), {}
    for i in sorted(docs):
        words = WORD.findall(docs[i]["text"] or "")
        gone = set()
        for at in range(len(words) - window + 1):
            key = tuple(words[at : at + window])
            gone.update(range(at, at + window) if key in earlier else ())
            earlier.add(key)
        text = " ".join(w for at, w in enumerate(words) if at not in gone) if gone else docs[i]["text"]
        out[i] = docs[i] | {"text": text}
    return out


def seats_won(weights, seats, room):
    """One seat at a time to the highest quotient; seats over the room go to those with most room left."""
    heap = [(-float(w), k, 0) for k, w in enumerate(weights) if w > 0]
    heapq.heapify(heap)
    won = [0] * len(weights)
    for _ in range(seats if heap else 0):
        _, k, j = heapq.heappop(heap)
        won[k] += 1
        heapq.heappush(heap, (-float(weights[k]) / (2 * j + 3), k, j + 1))
    over = sum(max(0, a - b) for a, b in zip(won, room))
    spare = [max(0, b - a) for a, b in zip(won, room)]
    won = [min(a, b) for a, b in zip(won, room)]
    for k in sorted(range(len(won)), key=lambda k: (-spare[k], k)):
        more = min(spare[k], over)
        won[k], over = won[k] + more, over - more
    return won


def plain_copies(docs):
    """How often the mix takes each document, to the nearest whole one."""
    size = {i: len(WORD.findall(d["text"] or "")) for i, d in docs.items()}
    sources = sorted({d["source"] for d in docs.values()}, key=lambda s: (s is None, s or ""))
    of = {s: [i for i, d in docs.items() if d["source"] == s] for s in sources}
    total = [sum(size[i] for i in of[s]) for s in sources]
    weight, target, open_, left = [(5, 2, 1)[k % 3] for k in range(len(sources))], {}, set(range(len(sources))), 1.5 * sum(total)
    while open_:  # sources over twice their size stop there, the rest is shared anew
        level = left / sum(weight[k] for k in open_)
        full = {k for k in open_ if 2 * total[k] < level * weight[k]}
        target |= {k: 2.0 * total[k] for k in full} if full else {k: level * weight[k] for k in open_}
        left -= sum(2 * total[k] for k in full)
        open_ = open_ - full if full else set()
    quota = seats_won([target[k] for k in range(len(sources))], int(1.5 * sum(total)), [2 * n for n in total])
    copies = {}
    for s, q in zip(sources, quota):
        key = {i: hashlib.md5(f"17:{i}".encode()).hexdigest() for i in of[s]}
        shards = sorted({int(key[i][:4], 16) % 64 for i in of[s]})
        rows = [sorted((i for i in of[s] if int(key[i][:4], 16) % 64 == h), key=key.get) for h in shards]
        cells = [sum(size[i] for i in r) for r in rows]
        for r, cell, words in zip(rows, cells, seats_won(cells, q, [2 * c for c in cells])):
            rounds, rest = divmod(words, cell) if cell else (0, 0)
            for i in r:
                taken = rounds * size[i] + max(0, min(size[i], rest))
                rest -= size[i]
                copies[i] = math.floor(taken / size[i] + 0.5) if size[i] else 0
    return copies


def test_pipeline_rows(spark):
    """Every row of ``run()``: documents, repeats and ids, all stages in plain Python."""
    table = rows_of(spark, "documents")
    docs = {r.doc_id: r.asDict() for r in table.collect()}
    assert len(docs) == table.count()
    forest = rules.train(table, rows_of(spark, "labels"))
    kept = {i: d for i, d in docs.items() if plain_kept(forest, d["text"])}
    first = plain_firsts(kept)
    left = plain_passages(first)
    copies = plain_copies(left)
    assert len(docs) > len(kept) > len(first) and {0, 1, 2} <= set(copies.values())
    assert any(left[i]["text"] != first[i]["text"] for i in left)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(corpus_pipeline.VOCABULARY), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = collections.Counter()
    for i, n in copies.items():
        text, ids = left[i]["text"] or "", encoding.encode_ordinary(left[i]["text"] or "")
        if n:
            want[i, left[i]["lang"], left[i]["source"], len(ids), tuple(ids), hashlib.sha256(text.encode()).hexdigest()] = n
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256"]
    got = collections.Counter((r.doc_id, r.lang, r.source, r.n_tokens, tuple(r.ids), r.decoded_sha256) for r in out.collect())
    assert got == want
