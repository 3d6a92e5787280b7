"""Page text, public hosts, feeds, whitelist and skewed joins on cases the test tables lack."""

import ipaddress

import duckdb
import pytest
from pyspark.sql import functions as F

import oracle_duckdb
from riskscope.functions import html as H
from riskscope.functions import urls as U
from riskscope.operators.joins import join_skew_safe
from riskscope.operators.scoring import whitelist_split
from riskscope.sources import io as IO

PAGES = {
    "<p>a</p><!-- <nav> --><p>KEEP</p><nav>x</nav><p>b</p>": "a KEEP b",
    "<header-bar>HB</header-bar><p>mid</p><header>h</header>end": "HB mid end",
    "caf&eacute; &uuml;ber &#8364; &#233; &#xE9;": "café über € é é",
    "&amp;lt; R&D; &nosuch; a & b &#0; &#x1F600;": "&lt; R&D; &nosuch; a & b � \U0001f600",
    "a&nbsp;&#160;b": "a b",
}
HOSTS = [
    "100.64.0.1", "192.0.0.9", "192.0.0.10", "192.0.0.8", "192.0.0.170", "10.1.2.3", "8.8.8.8", "172.15.0.1", "172.16.0.1", "198.18.0.1", "198.20.0.1",
    "224.0.0.1", "255.255.255.255", "169.254.1.1", "203.0.113.9", "::ffff:10.0.0.1", "64:ff9b::1", "100::1", "2001::1", "2001:1::1", "2001:1::3", "2001:3::1",
    "2001:4:112::1", "2001:20::1", "2001:db8::1", "2001:200::1", "2002::1", "2606:4700::1111", "3fff::1", "3fff:fff::1", "3fff:1000::1", "fc00::1", "fe80::1",
    "fec0::1", "ff02::1", "::1", "::", "4000::1",
]


def public(host):
    a = ipaddress.ip_address(host)
    return not (a.is_private or a.is_loopback or a.is_link_local or a.is_reserved or a.is_multicast)


def test_page_text(spark):
    df = spark.createDataFrame(list(PAGES.items()), "html string, want string")
    for r in df.select("want", H.visible_text(H.strip_boilerplate("html")).alias("got")).collect():
        assert r.got == r.want


@pytest.mark.parametrize("how", ["spark", "sql"])
def test_public_hosts_as_the_standard_library(spark, how):
    if how == "spark":
        got = {r.h: r.p for r in spark.createDataFrame([(h,) for h in HOSTS], "h string").select("h", U.is_public_host(F.col("h")).alias("p")).collect()}
    else:
        v4, v6 = oracle_duckdb.private_v4_sql("h"), oracle_duckdb.private_v6_sql("h")
        sql = f"select h, not case when contains(h, ':') then {v6} else {v4} end from (select unnest({HOSTS}) as h)"
        got = dict(duckdb.connect().execute(sql).fetchall())
    assert got == {h: public(h) for h in HOSTS}


def test_feed_rows_are_judged_one_by_one(spark, tmp_path):
    (tmp_path / "feed.csv").write_text('# note\n1,2\n3,4,http://a.example/\n5,6,"https://b.example/x,y",7,8\n9,0,ftp://c\n')
    assert [r.url for r in IO.read_feed_csv(spark, str(tmp_path / "feed.csv")).collect()] == ["http://a.example/", "https://b.example/x,y"]


def test_whitelist_keeps_null_hosts(spark):
    hit, rest = whitelist_split(spark.createDataFrame([("A.example",), (None,), ("b",)], "netloc string"), whitelist=["a.example"])
    assert (hit.count(), sorted(str(r.netloc) for r in rest.collect())) == (1, ["None", "b"])


@pytest.mark.parametrize("most", [1, 1000])
def test_skewed_join_keeps_null_and_hot_keys(spark, most):
    left = spark.range(4000).select(F.col("id").alias("i"), F.when(F.col("id") % 20 == 0, F.col("id") % 100).alias("k"))
    right = spark.range(0, 100, 20).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("left", "inner"):
        out = join_skew_safe(left, right, "k", how, hot_key_rows=10, max_hot_keys=most)
        assert sorted(map(tuple, out.select("i", "k", "v").collect())) == sorted(map(tuple, left.join(right, "k", how).select("i", "k", "v").collect()), key=lambda r: r[0])
