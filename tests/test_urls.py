from pyspark.sql import functions as F

from riskscope.functions import urls as U
from riskscope.operators.url_features import URL_FEATURES, candidate_urls, url_mutations, with_url_features

G = {
    "paypal-login-verify-account.xyz": [39, 1, 3, 2, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 0, 3, 4.3681, 31, 0.0, 0, 0, 0, 0, 0, 1],
    "https://roblox.com.bn/games/74538164085210/sword-fighting-347226": [64, 2, 2, 5, 1, 0, 0, 0, 0, 0, 0, 20, 0, 0, 3, 0, 1, 0, 0, 4.8534, 13, 0.0, 0, 0, 0, 0, 0, 1],
    "https://www.kaggle.com/": [23, 2, 0, 3, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 3.8492, 14, 0.0, 0, 0, 0, 0, 0, 0],
    "http://192.168.10.5//login.php?a=1&a=2&b=%20&=x#top": [51, 4, 0, 4, 0, 0, 0, 1, 1, 0, 1, 13, 3, 1, 1, 0, 0, 0, 1, 4.4515, 12, 1.0, 4, 0, 3, 0, 0, 0],
}


def feats(spark, urls):
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    return {r["url"]: r for r in with_url_features(df).collect()}


def test_golden_vectors(spark):
    out = feats(spark, list(G))
    for url, expected in G.items():
        assert [out[url][k] for k in URL_FEATURES] == expected, url


def test_edge_inputs(spark):
    out = feats(spark, [None, "   ", "HTTP://x.com/a", "https://u:p@H.com:80/a/b;q=1?a=1#f", "http://a_b.example.com/x",
                        "https://[::1]/x", "https://bit.ly/x", "https://x.blogspot.com/paypal", "https://www.paypal.com/",
                        "https://www.youtube.com", "https://[zz/x"])
    assert out[None]["url_length"] == 0 and out[None]["url_entropy"] == 0.0
    assert out["HTTP://x.com/a"]["hostname"] == "http"
    r = out["https://u:p@H.com:80/a/b;q=1?a=1#f"]
    assert (r["hostname"], r["path_depth"], r["num_query_params"], r["has_at_symbol"]) == ("h.com", 2, 1, 1)
    assert out["http://a_b.example.com/x"]["hostname"] == "a_b.example.com"
    assert out["https://[::1]/x"]["has_ip"] == 1
    assert out["https://bit.ly/x"]["is_shortened"] == 1
    b = out["https://x.blogspot.com/paypal"]
    assert (b["uses_free_hosting"], b["brand_on_free_hosting"], b["brand_domain_mismatch"]) == (1, 1, 1)
    assert out["https://www.paypal.com/"]["brand_domain_mismatch"] == 0
    assert out["https://www.youtube.com"]["brand_domain_mismatch"] == 1
    assert out["https://[zz/x"]["url_valid"] is False


def test_registered_domain_rules(spark):
    rules = (("com", "exact"), ("uk", "exact"), ("co.uk", "exact"), ("com.bn", "exact"), ("bn", "exact"),
             ("ck", "wildcard"), ("www.ck", "exception"))
    hosts = {"a.b.example.co.uk": "example.co.uk", "roblox.com.bn": "roblox.com.bn", "x.y.foo.ck": "y.foo.ck",
             "www.ck": "www.ck", "a.www.ck": "www.ck", "localhost": "localhost", "co.uk": "co.uk",
             "192.168.0.1": "192.168.0.1", "sub.example.com": "example.com", "": ""}
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    got = {r["h"]: r["d"] for r in df.select("h", U.registered_domain(F.col("h"), rules).alias("d")).collect()}
    assert got == hosts


def test_candidates_and_mutations(spark):
    df = spark.createDataFrame([("https://www.kaggle.com/",)], "url string")
    c = [r["candidate"] for r in candidate_urls(df).orderBy("rank").collect()]
    assert c == ["https://www.kaggle.com/", "http://www.kaggle.com/", "https://kaggle.com/"]
    m = {r["variant"]: r["mutated_url"] for r in url_mutations(df, keyword="  gift card ").collect()}
    assert m[2] == "https://www.kaggle.com/gift-card/login"
    assert m[3] == "https://secure-gift-card.www.kaggle.com/"
    assert m[4] == "https://www.kaggle.com/?gift-card=true&session=778899"


def test_public_host(spark):
    hosts = ["example.com", "", "localhost", "10.0.0.1", "8.8.8.8", "::1", "2001:4860::8888", "224.0.0.1"]
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    got = {r["h"]: r["p"] for r in df.select("h", U.is_public_host(F.col("h")).alias("p")).collect()}
    assert got == {"example.com": True, "": False, "localhost": False, "10.0.0.1": False, "8.8.8.8": True,
                   "::1": False, "2001:4860::8888": True, "224.0.0.1": False}


def test_percent_decoding_keeps_bad_escapes(spark):
    from urllib.parse import unquote_plus

    keys = ["a%zz%41", "a+b%20c", "%e4%b8%ad%", "b%", "%", "", "%4", "x%ff%zz", "%%41", "plain"]
    df = spark.createDataFrame([(k,) for k in keys], "k string").select("k", U.percent_decode(F.col("k")).alias("d"))
    assert {r.k: r.d for r in df.collect()} == {k: unquote_plus(k) for k in keys}
