"""Merkle manifest and conversation trie against brute force."""

import collections
import hashlib
import random
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskscope.llm import merkle, order, queries, trie
from riskscope.llm.common import cut

SF = "/root/testdata/sf0.001"
LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, i):
    out = []
    for nodes in tree[:-1]:
        run = i - i % 16
        out.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 16])))
        i //= 16
    return out


def brute_manifest(rows):
    """(id, group, leaf) -> sorted (id, leaf, subroot, root, proof)."""
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        trees[g] = levels([r[2] for r in groups[g]])
    top = levels([trees[g][-1][0] for g in names])
    return [
        (r[0], r[2], trees[g][-1][0], top[-1][0], siblings(trees[g], i) + siblings(top, n)) for n, g in enumerate(names) for i, r in enumerate(groups[g])
    ]


@pytest.mark.parametrize("height", [1, 2, 3])
def test_manifest_of_ragged_groups(spark, height):
    sizes = {None: 1, "a": 1, "b": 16, "c": 17, "d": 289, "é": 530, "": 5}
    rows = [(i if i % 50 else None, g, sha(f"{g}-{i % 200}")) for g, n in sizes.items() for i in range(n)]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "id long, g string, leaf string").withColumns({"block": F.lit(1), "root": F.lit(2), "place": F.lit(3)})
    out = merkle.manifest(frame, "id", "g", height=height)
    assert out.columns == [*frame.columns, "slot", "subroot", "root_", "proof"]
    got = sorted(((r.id, r.leaf, r.subroot, r.root_, [tuple(p) for p in r.proof]) for r in out.collect()), key=repr)
    assert got == sorted(brute_manifest(rows), key=repr)


def test_manifest_of_a_group_of_three_rounds(spark):
    sizes = {"a": 273, "b": 26, "c": 1, "d": 257}  # blocks: a third round from 257 on
    rows = [(i, g, sha(f"{g}-{i}")) for g, n in sizes.items() for i in range(n)]
    random.Random(2).shuffle(rows)
    out = merkle.manifest(spark.createDataFrame(rows, "id long, g string, leaf string"), "id", "g", height=0)
    got = sorted((r.id, r.leaf, r.subroot, r.root, [tuple(p) for p in r.proof]) for r in out.collect())
    assert got == sorted(brute_manifest(rows))


def test_rounds_deal_digests_by_block(spark):
    rows = [("a", i, sha(f"a-{i}")) for i in range(273)] + [("b", i, sha(f"b-{i}")) for i in range(26)]
    out = merkle.climb(spark.createDataFrame(rows, "g string, place long, leaf string"), 0)
    got = collections.defaultdict(list)
    for r in out.collect():
        got[r.g].append((r.block, r.blocks, r.node, [tuple(p) for p in r.proof]))
    for g in "ab":
        tree = levels([x[2] for x in rows if x[0] == g])
        n = len(tree[0])
        assert sorted(got[g], key=repr) == sorted(((i, n, tree[-1][0], siblings(tree, i)) for i in range(n)), key=repr)


def test_manifest_query(spark):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    leaf = lambda r, t: sha("".join(map(field, (r.doc_id, r.source, r.lang, r.n_chars, t))))
    want = {w[0]: w for w in brute_manifest([(i, r.source, leaf(r, r.text)) for i, r in docs.items()])}
    tampered = 0
    for r in queries.op11_merkle(spark, SF).collect():
        _, own, subroot, root, proof = want[r.doc_id]
        h = own
        if zlib.crc32(str(r.doc_id).encode()) % 5 == 0:
            h = leaf(docs[r.doc_id], docs[r.doc_id].text and docs[r.doc_id].text.translate(LOW))
        for a, b in proof:
            h = sha(a + h + b)
        assert (r.leaf, r.subroot, r.root, r.proof_sha256) == (own, subroot, root, sha("".join(a + b for a, b in proof)))
        assert (r.folded_root, r.verified) == (h, h == root)
        tampered += not r.verified
    assert 0 < tampered < len(want)


def test_manifest_of_an_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], "doc_id long, source string, leaf string")).collect() == []


def test_scan_of_a_group_over_many_partitions(spark):
    rows = [(g, o, g * 1000 + o) for g, n in ((0, 900), (1, 1), (2, 40)) for o in range(n)] + [(None, 5, 7), (None, None, 9)]
    frame = cut(spark.createDataFrame(rows, "g long, o long, x long").repartition(5))
    got = {(r.g, r.o): (r.place, r.upto) for r in order.scan(frame, ["g"], ["o"], {"x": "upto"}, parts=11).collect()}
    want = {}
    for g in (None, 0, 1, 2):
        total = 0
        for i, (_, o, x) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0))):
            total += x
            want[g, o] = (i, total)
    assert got == want


def brute_trie(sequences):
    """{conv: ((role, text), ...)} -> a row per node."""
    members = collections.defaultdict(list)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    children = collections.defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    rows = []
    for p, m in members.items():
        todo, leaves, saved = [p], 0, 0
        while todo:
            q = todo.pop()
            leaves += not children[q]
            saved += (len(members[q]) - 1) * len(q[-1][1].encode()) if q else 0
            todo += children[q]
        ends = ",".join(map(str, sorted(c for c in m if len(sequences[c]) == len(p))))
        rows.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves, saved, sha(ends)))
    return sorted(rows, key=repr)


def brute_rebuilt(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(s, key=lambda x: (x[:2], sha(f"{len(x[2].encode())}:{x[2]}{x[3]}")))] for c, s in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    base = lambda c: c - int(np.fmod(c, 5))
    return {c: tuple(own.get(base(c), [])[: h[c]] + s[h[c] :]) for c, s in own.items()}


def made_conversations():
    """A hot first turn, copies, a long conversation, nulls, ties, negative ids, repeated rows."""
    rng, rows = random.Random(5), []
    for c in range(-12, 120):
        if c % 11 == 3:
            continue
        n = 60 if c == 40 else rng.randrange(0, 9) + 1
        hot = c % 3 == 0
        for t in range(n):
            text = "hello" if hot and t == 0 else "same" if c % 7 == 0 else None if rng.random() < 0.1 else f"{rng.randrange(3)}é"
            rows.append((c, t if t else None, rng.choice(["user", None, ""]) if not hot and c % 7 else "user", text))
    return rows + [(7, 2, "user", "tie"), (7, 2, "user", "tie"), (None, 1, "user", "x")]


@pytest.mark.parametrize("subtree_rows", [1, 5, 4_096])
def test_trie_against_brute_force(spark, subtree_rows):
    rows = made_conversations()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"c": F.lit(1), "depth": F.lit("x")})
    got = trie.prefix_trie(frame, share_heads=True, subtree_rows=subtree_rows, shard_rows=30)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_trie(brute_rebuilt(rows))


def test_trie_without_shared_heads(spark):
    rows = [(c, t, "user", "x" * (1 + (c * t) % 3)) for c in range(30) for t in range(c % 4)] + [(c, 0, "user", "y") for c in (0, 4)]
    sequences = {c: tuple(("user", x) for cc, t, _, x in sorted(rows) if cc == c) for c in {r[0] for r in rows}}
    got = trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), subtree_rows=3)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_trie(sequences)


def test_trie_of_an_empty_table(spark):
    assert trie.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), share_heads=True).collect() == []


def test_double_array_packs_and_walks():
    rng = np.random.default_rng(3)
    lens = rng.integers(1, 12, 400)
    sym = rng.integers(0, 6, int(lens.sum()))
    start = np.cumsum(lens) - lens
    array, at, found = trie.shard_trie(sym, start, lens)
    prefixes = {}
    for s, n in zip(start, lens, strict=True):
        for d in range(n):
            assert prefixes.setdefault(tuple(sym[s : s + d + 1]), at[s + d]) == at[s + d]
    assert len(set(prefixes.values())) == len(prefixes) == sum(map(len, found))
    assert (array.check >= 0).sum() == len(prefixes)


def test_trie_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, queries.op13_trie(spark, SF).collect()), key=repr) == brute_trie(brute_rebuilt(rows))
