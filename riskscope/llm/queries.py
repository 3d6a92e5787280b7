"""Registered queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskscope.llm import bpe, merkle, mixing, packing, quality, rules, sharding, simhash, substring, topk, trie, urlfilter, warc
from riskscope.llm.common import cut, documents, shared_dir

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the digest of their decoding."""
    path, pattern = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    ids = bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), path, pattern, offsets=False).select("doc_id", "ids")
    return bpe.decode(ids, path, pattern).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, shards of near equal bytes."""
    return sharding.shard(documents(spark, sf_dir).select("doc_id", "text"), shards=40)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and component of every document."""
    return simhash.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), shingle=3)


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document left without repeated windows of 20."""
    out = substring.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"), window=20)
    # Without a removal the text's own words, joined by one blank.
    plain = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return out.select("doc_id", "dedup.n_words", "dedup.n_removed", F.sha2(F.coalesce("dedup.kept_text", plain), 256).alias("kept_sha256"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from rows not held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = quality.train(docs, _labels(spark, sf_dir))
    return quality.score(docs, model).select(
        "doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics and verdicts of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    forest = rules.train(docs, _labels(spark, sf_dir))
    return rules.judge(docs, forest).select("doc_id", "rules.*")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records and read back: responses by their
    payloads, revisits by their headers alone."""
    path = shared_dir(spark, "warc")
    warc.write(warc.records_of(_pages(spark, sf_dir)), path)
    same = [warc.page_id(F.col("record_id")).alias("page_id")]
    own = warc.read(spark, path).where("warc_type = 'response'").select(
        *same, F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"),
        F.col("warc_type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"),
    )
    again = warc.read(spark, path, payload=False).where("warc_type = 'revisit'").select(
        *same, F.col("payload_length").alias("payload_bytes"), F.substring_index("payload_digest", ":", -1).alias("payload_digest"),
        F.col("warc_type").alias("record_type"), warc.page_id(F.col("refers_to")).alias("refers_to"),
    )
    return own.unionByName(again)


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on page URLs.  Listed are the canonical URLs that more than
    one page has."""
    pages = _pages(spark, sf_dir).select("page_id", "url")
    often = pages.select(urlfilter.canonical(F.col("url")).alias("u")).groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u")
    return urlfilter.judge(pages, RULES, often).select("page_id", "host", "path", "rule", "verdict")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best others of every fiftieth vector."""
    vectors = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    return topk.top_k(vectors.select("vec_id", "embedding"), "vec_id % 50 = 0", k=5)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document."""
    return mixing.mix(documents(spark, sf_dir).select("doc_id", "text", "source"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle leaf, roots and proof of every document, and whether a row that
    may have been tampered with still folds to the root."""
    own = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rows = documents(spark, sf_dir).select(
        "doc_id", "source", merkle.leaf(*own, F.col("text")).alias("leaf"), F.when(hit, merkle.leaf(*own, low)).alias("tampered")
    )
    out = merkle.manifest(rows).withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return out.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and offset of every piece of all documents."""
    rows = packing.pieces(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    rows = cut(rows.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return packing.place(rows, order=["doc_id", "piece"])


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all conversations, rebuilt to share heads."""
    turns = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet")
    return trie.prefix_trie(turns, share_heads=True).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_sharding": op2_sharding,
    "op3_simhash": op3_simhash,
    "op4_quality": op4_quality,
    "op5_substring": op5_substring,
    "op6_warc": op6_warc,
    "op7_quality_rules": op7_quality_rules,
    "op8_urls": op8_urls,
    "op9_topk": op9_topk,
    "op10_mixing": op10_mixing,
    "op11_merkle": op11_merkle,
    "op12_packing": op12_packing,
    "op13_trie": op13_trie,
}


def _field_sql(column: str) -> str:
    return f"coalesce(strlen({column}::varchar) || ':' || {column}, '-')"


_HEAD_SQL = " || ".join(map(_field_sql, ("doc_id", "source", "lang", "n_chars")))
_LOW_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _crc_sql(number: str) -> str:
    """CRC-32 of a decimal number, bit by bit over its bytes."""
    return f"""xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length({number}::varchar) + 1), lambda i: ascii(({number}::varchar)[i])::bigint)),
                  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""


WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE: dict[str, str] = {
    "op5_substring": f"""
        with d as (select doc_id, {WORDS_SQL} as w from documents),
        s as (select doc_id, w, unnest(range(1, len(w) - 18)) as p from d where len(w) >= 20),
        k as (select doc_id, p, row_number() over (partition by array_to_string(w[p:p + 19], ' ') order by doc_id, p) as n from s),
        c as (select distinct doc_id, p + unnest(range(20)) as i from k where n > 1),
        g as (select doc_id, list(i) as gone from c group by doc_id)
        select d.doc_id, len(w)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed,
               sha256(array_to_string(case when gone is null then w else list_transform(list_filter(range(1, len(w) + 1), lambda i: not list_contains(gone, i)), lambda i: w[i]) end, ' ')) as kept_sha256
        from d left join g using (doc_id)""",
    "op6_warc": """
        with p as (select page_id, coalesce(html, '') as h from pages),
        q as (select page_id, strlen(h)::bigint as payload_bytes, sha256(h) as payload_digest, min(page_id) over (partition by h) as first from p)
        select page_id, payload_bytes, payload_digest,
               case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
               case when payload_bytes >= 100 and page_id <> first then first end as refers_to
        from q""",
    "op8_urls": r"""
        with a as (select page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                          regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path,
                          string_split(regexp_extract(coalesce(url, ''), '://[^?#]*\?([^#]*)', 1), '&') as params, contains(coalesce(url, ''), '://') as ok from pages),
        b as (select *, list_sort(list_filter(params, lambda x: x <> '' and not starts_with(x, 'utm_'))) as kept from a),
        c as (select *, case when ok then regexp_replace(host, '^www\.', '') || rtrim(path, '/') || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end end as canonical from b),
        d as (select *, canonical is not null and count(*) over (partition by canonical) > 1 as listed,
                     case when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
                          when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
                          when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
                          when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule from c)
        select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow' when listed then 'block' else 'allow' end as verdict
        from d""",
    "op9_topk": """
        with v as (select vec_id, list_transform(embedding, lambda x: floor(x::double * 256)::bigint) as e from embeddings
                   where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        a as (select vec_id, len(e) as n, e from v where vec_id % 50 = 0 qualify row_number() over (partition by vec_id order by len(e), e) = 1),
        q as (select vec_id, n, unnest(e) as x, generate_subscripts(e, 1) as i from a),
        c as (select vec_id, row, len(e) as n, unnest(e) as x, generate_subscripts(e, 1) as i from (select *, row_number() over () as row from v)),
        s as (select q.vec_id as query_id, c.vec_id, c.row, sum(q.x * c.x)::bigint as score
              from q join c on q.i = c.i and q.n = c.n and q.vec_id <> c.vec_id group by 1, 2, 3),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
        select query_id, rank::integer as rank, vec_id, score from r where rank <= 5""",
    "op10_mixing": f"""
        with d as (select doc_id, source, len({WORDS_SQL})::bigint as size, md5('17:' || coalesce(doc_id::varchar, '')) as k from documents),
        e as (select *, ('0x' || k[1:4])::bigint % 64 as shard from d),
        s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as place from e group by source),
        w as (select *, [5, 2, 1][((place - 1) % 3 + 1)::int] as weight, (select sum(source_size) from s) as total from s),
        o as (select *, 2 * source_size / weight as most, sum(2 * source_size) over (order by 2 * source_size / weight, place) - 2 * source_size as before,
                     sum(weight) over (order by 2 * source_size / weight, place rows between current row and unbounded following) as ahead from w),
        l as (select *, (1.5::double * total - before) / ahead as level from o),
        t as (select place, source, source_size, total, least(2.0::double * source_size, (select max(level) from l where level <= most) * weight) as target from l),
        n as (select unnest(range(0, (select greatest(1, floor(max(target))::bigint) from t))) as j),
        b as (select place, row_number() over (order by target / (2 * j + 1) desc, place, j) as r from t join n on 2 * j + 1 <= 2 * target + 1 where target > 0),
        m as (select place, count(*) as quota from b where r <= (select any_value(floor(1.5 * total)) from t) group by place),
        c as (select place, shard, sum(size) as cell_size, coalesce(any_value(quota), 0) as quota from e join t on e.source is not distinct from t.source left join m using (place) group by place, shard),
        y as (select place, shard, row_number() over (partition by place order by cell_size / (2 * j + 1) desc, shard, j) as r, quota from c join n on j < 2 * cell_size),
        f as (select c.place, shard, cell_size, coalesce(words, 0) as words from c left join (select place, shard, count(*) as words from y where r <= quota group by all) using (place, shard)),
        g as (select doc_id, size, source_size, target, cell_size, words, sum(size) over (partition by place, shard order by k, doc_id, size rows unbounded preceding) - size as start
              from e join t on e.source is not distinct from t.source join f using (place, shard))
        select doc_id, size, source_size::bigint as source_size, target,
               (case when cell_size > 0 then (words // cell_size) * size + greatest(0, least(size, words % cell_size - start)) else 0 end)::bigint as taken
        from g""",
    "op11_merkle": f"""
        with recursive d as (select doc_id, source, sha256({_HEAD_SQL} || {_field_sql("text")}) as leaf, sha256({_HEAD_SQL} || {_field_sql(_LOW_SQL)}) as low,
                                    coalesce({_crc_sql("doc_id")} % 5 = 0, false) as hit, row_number() over () as uid from documents),
        x as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by source) as n from d),
        t as (select source, 0 as lvl, place, n, leaf as h from x
              union all select source, lvl + 1, place // 16, max(n + 15) // 16, sha256(string_agg(h, '' order by place)) from t where n > 1 group by source, lvl, place // 16),
        s as (select source, h as subroot, row_number() over (order by source nulls first) - 1 as place, count(*) over () as n from t where n = 1),
        v as (select 0 as lvl, place, n, subroot as h from s
              union all select lvl + 1, place // 16, max(n + 15) // 16, sha256(string_agg(h, '' order by place)) from v where n > 1 group by lvl, place // 16),
        below as (select uid, lvl, string_agg(h, '' order by t.place) filter (t.place < x.place >> (4 * lvl)) as a, string_agg(h, '' order by t.place) filter (t.place > x.place >> (4 * lvl)) as b
                  from x join t on x.source is not distinct from t.source where t.n > 1 and t.place // 16 = x.place >> (4 * lvl + 4) group by uid, lvl),
        above as (select source, lvl, string_agg(h, '' order by v.place) filter (v.place < s.place >> (4 * lvl)) as a, string_agg(h, '' order by v.place) filter (v.place > s.place >> (4 * lvl)) as b
                  from s join v on v.n > 1 and v.place // 16 = s.place >> (4 * lvl + 4) group by source, lvl),
        path as (select uid, lvl, coalesce(a, '') as a, coalesce(b, '') as b from below
                 union all select uid, 100 + lvl, coalesce(a, ''), coalesce(b, '') from x join above on x.source is not distinct from above.source),
        step as (select *, row_number() over (partition by uid order by lvl) as k, count(*) over (partition by uid) as steps from path),
        fold as (select uid, 0 as k, case when hit then low else leaf end as h from x union all select uid, step.k, sha256(a || h || b) from fold join step using (uid) where step.k = fold.k + 1),
        proof as (select uid, sha256(string_agg(a || b, '' order by k)) as proof_sha256 from step group by uid),
        done as (select uid, max_by(h, k) as folded_root from fold group by uid)
        select doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) as proof_sha256, folded_root, folded_root = root as verified
        from x join s on x.source is not distinct from s.source join done using (uid) left join proof using (uid), (select h as root from v where n = 1)""",
    "op13_trie": f"""
        with o as (select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as k, turn from conversations where conv_id is not null),
        a as (select c, list({{'k': k, 'b': strlen(text)}} order by turn nulls first, k) as own from o group by c),
        b as (select a.c, list_concat(coalesce(base.own, [])[:h], a.own[h + 1:]) as turns from (select *, {_crc_sql("c")} % 9 as h from a) a left join a base on base.c = a.c - a.c % 5),
        r as (select c, d, len(turns) as n, sha256(array_to_string(list_transform(turns[:d], lambda x: x.k), '')) as p, case when d > 0 then turns[d].b else 0 end as bytes from (select *, unnest(range(0, len(turns) + 1)) as d from b)),
        v as (select d, p, min(c) as conv_id, count(*) as n_convs, any_value(bytes) as bytes, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (n = d), '')) as ends_sha256 from r group by d, p),
        e as (select v.d, v.p, parent.p as up, pv.conv_id as parent_conv_id from v left join r parent on parent.c = v.conv_id and parent.d = v.d - 1 left join v pv on pv.p = parent.p and pv.d = parent.d),
        k as (select up, d, count(*) as n_children from e group by up, d),
        w as (select v.*, coalesce(n_children, 0) as n_children from v left join k on k.up = v.p and k.d = v.d + 1),
        s as (select r.d, r.p, sum((w.n_convs - 1) * w.bytes) as saved_tokens, count(*) filter (w.n_children = 0) as n_leaves from w join r on r.c = w.conv_id and r.d <= w.d group by r.d, r.p)
        select conv_id, d::bigint as depth, parent_conv_id, n_convs, n_children::bigint as n_children, n_leaves, saved_tokens::bigint as saved_tokens, ends_sha256
        from w join s using (d, p) join e using (d, p)""",
}
