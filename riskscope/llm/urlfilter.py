"""URL filter: rules by host and path, then a list of canonical URLs behind a
blocked Bloom filter.

The filter is a table: a listed URL sets eight bits in one block of 256 bits,
and a block's words are the OR of its URLs', so it is built by an aggregation
that combines before the shuffle.  Rows whose bits are all set pass on to an
exact hash join with the list, which removes false positives; the others are
done.  The filter has a block for 16 URLs; up to ``BROADCAST_BYTES`` it is
broadcast, beyond that it is joined by block.

Defined results: a null URL, or one without ``://``, has an empty host and
path, fits no rule and no list; equal lengths of rules: the first by code
point; repeated rows give repeated rows; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskscope.llm.common import checked_broadcast, free_name

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEYS_PER_BLOCK = 16
WORDS = 4
BROADCAST_BYTES = 32 << 20


def host(url: Column) -> Column:
    found = F.regexp_extract(url, r"://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without closing slashes,
    and the sorted parameters but for ``utm_``; scheme and fragment go.  Null
    without ``://``."""
    params = F.split(F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1), "&")
    kept = F.array_sort(F.filter(params, lambda p: (p != "") & ~p.startswith("utm_")))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    plain = F.concat(F.regexp_replace(host(url), r"^www\.", ""), F.regexp_replace(path(url), r"/+$", ""), query)
    return F.when(F.contains(url, F.lit("://")), plain)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule (host, path, verdict) that fits, as ``host+path``, and
    its verdict.  The rules are a short list of the caller's."""
    order = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for h, p, _ in order]
    pick = lambda values: F.coalesce(*[F.when(f, F.lit(v)) for f, v in zip(fits, values, strict=True)], F.lit(None).cast("string"))
    return pick([h + p for h, p, _ in order]), pick([v for _, _, v in order])


def _bits(key: Column, blocks: int) -> list[Column]:
    """Block, then the words of a key: two bits in each of four 64-bit words."""
    where = F.xxhash64(key)
    bits = F.xxhash64(key, F.lit("bits"))
    place = lambda i: F.shiftright(bits, 5 * i).bitwiseAND(F.lit(31)).cast("int")
    one = F.lit(1).cast("long")
    low = lambda i: F.call_function("shiftleft", one, place(i))
    high = lambda i: F.call_function("shiftleft", one, place(i) + 32)
    words = [low(2 * w).bitwiseOR(high(2 * w + 1)).alias(f"w{w}") for w in range(WORDS)]
    return [F.pmod(where, F.lit(blocks)).alias("block"), *words]


def bloom(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """Blocked Bloom filter of a column: ``block`` and its words."""
    return listed.select(*_bits(F.col(key), blocks)).groupBy("block").agg(*[F.bit_or(f"w{w}").alias(f"f{w}") for w in range(WORDS)])


def on_list(rows: DataFrame, key: str, listed: DataFrame, out: str) -> DataFrame:
    """``rows`` with boolean ``out``: is the key among the one column of
    ``listed``?  Null keys aren't."""
    names = listed.columns
    own = listed.select(F.col(names[0]).alias("listed_key")).where("listed_key is not null").distinct()
    n = own.count()
    blocks = max(1, -(-n // KEYS_PER_BLOCK))
    table = checked_broadcast(bloom(own, "listed_key", blocks), blocks, 8 * (WORDS + 1), BROADCAST_BYTES)
    # The caller's columns travel as one struct, so that no name can clash.
    probe = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(f"`{key}`").alias("row_key"))
    probe = probe.withColumn("bits", F.struct(*_bits(F.col("row_key"), blocks)))
    hit = F.col("row_key").isNotNull()
    for w in range(WORDS):
        hit = hit & (F.col(f"f{w}").bitwiseAND(F.col(f"bits.w{w}")) == F.col(f"bits.w{w}"))
    seen = probe.join(table, F.col("bits.block") == F.col("block"), "left").withColumn("passed", F.coalesce(hit, F.lit(False)))
    misses = seen.where(~F.col("passed")).select("row", F.lit(False).alias("is_listed"))
    hits = seen.where("passed").select("row", "row_key").join(own.hint("shuffle_hash"), F.col("row_key") == F.col("listed_key"), "left")
    both = misses.unionByName(hits.select("row", F.col("listed_key").isNotNull().alias("is_listed")))
    return both.select("row.*", F.col("is_listed").alias(out))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, url_col: str = "url", listed_verdict: str = "block") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` (columns of
    those names are replaced): the longest fitting rule's verdict, else
    ``listed_verdict`` for canonical URLs on the list, else the other one.
    ``listed`` has one column of canonical URLs."""
    key, flag, own = (free_name(pages, x) for x in ("canonical_url", "is_listed", "rule_verdict"))
    url = F.col(f"`{url_col}`")
    rows = on_list(pages.withColumn(key, canonical(url)), key, listed, flag)
    rule, verdict = fitting_rule(host(url), path(url), rules)
    other = "allow" if listed_verdict == "block" else "block"
    out = rows.withColumns({own: verdict, "rule": rule, "host": host(url), "path": path(url)})
    return out.withColumn("verdict", F.coalesce(own, F.when(F.col(flag), listed_verdict).otherwise(other))).drop(key, flag, own)
