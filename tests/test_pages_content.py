from pyspark.sql import functions as F

from riskscope.operators.content import CONTENT_FEATURES, with_content_features
from riskscope.operators.domains import parse_domain_date, parse_whois
from riskscope.operators import pages as P
from riskscope.operators.pages import extract_pages

PAGE = ('<html><head><title> A  B </title><meta name="Description" content=" d  e "></head><body><nav><a href="/n">n</a>'
        '</nav><p>x<b>y</b>&amp;lt;</p><!-- c --><a href="/z">z</a><a>q</a><script>s</script></body></html>')


def test_page_golden(spark):
    r = extract_pages(spark.createDataFrame([(PAGE,)], "html string")).first()
    assert (r["title"], r["meta_description"], r["text"], r["link_count"], r["low_content"]) == ("A B", "d e", "x y &lt; z q", 1, 1)


def test_page_without_body_and_og(spark):
    html = '<title>T</title><meta property="og:description" content="og text"><p>Hello</p><footer>f</footer>'
    r = extract_pages(spark.createDataFrame([(html,)], "html string")).first()
    assert r["text"] == "T Hello" and r["meta_description"] == "og text"


def test_content_golden(spark):
    rows = [("Winner!", "Act now: CLAIM YOUR prize!!! act now", "<form><IFRAME>"), (None, None, None),
            ("", "x" * 300 + " " + " ".join(f"w{i}" for i in range(40)) + "!!!!!!", "")]
    out = with_content_features(spark.createDataFrame(rows, "title string, text string, html string"), "title", "text", "html").collect()
    assert [out[0][k] for k in CONTENT_FEATURES] == [36, 7, 7, 1.0, 1, 1, 3, 0.3846, 4.857]
    assert [out[1][k] for k in CONTENT_FEATURES] == [0, 0, 0, 0.0, 0, 0, 0, 0.0, 0.0]
    assert (out[2]["text_length"], out[2]["token_count"], out[2]["exclamation_count"]) == (250, 30, 4)


def test_date_goldens(spark):
    cases = {
        "2024-01-15T10:00:00Z": ("2024-01-15 10:00:00", "2024-01-15 10:00:00"),
        "2024-01-15T10:00:00+0000": ("2024-01-15 10:00:00", "2024-01-15 10:00:00"),
        "2024-01-15 10:00:00 UTC": ("2024-01-15 10:00:00", "2024-01-15 10:00:00"),
        "15-Jan-2024 10:00:00": ("2024-01-15 10:00:00", "2024-01-15 10:00:00"),
        "03/04/2024": ("2024-04-03 00:00:00", "2024-04-03 00:00:00"),
        "15-Jan-2024": ("2024-01-15 00:00:00", None),
        "15.01.2024": ("2024-01-15 00:00:00", None),
        "2024-01-15T10:00:00.0Z": ("2024-01-15 10:00:00", None),
    }
    df = spark.createDataFrame([(k,) for k in cases], "raw string")
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    got = {r["raw"]: (r["d"], r["s"]) for r in df.select("raw", fmt(parse_domain_date(F.col("raw"))).alias("d"),
                                                            fmt(parse_domain_date(F.col("raw"), True)).alias("s")).collect()}
    assert got == cases


def test_whois_rules(spark):
    rows = [("a", "Creation Date: 2025-12-01\nRegistry Expiry Date: 2026-03-01\nRegistrar: Example Reg"),
            ("b", "Connecting to whois.x\nno data"), ("c", "   "), ("d", "Created: 2020-01-01")]
    out = {r["domain"]: r for r in parse_whois(spark.createDataFrame(rows, "domain string, raw string"), as_of="2026-01-01 00:00:00").collect()}
    assert (out["a"]["domain_age_days"], out["a"]["domain_expiry_days"], out["a"]["registrar"], out["a"]["missing_whois"]) == (31, 59, "Example Reg", 0)
    assert (out["b"]["domain_age_days"], out["b"]["missing_whois"]) == (-1, 1)
    assert out["c"]["missing_whois"] == 1
    assert out["d"]["domain_age_days"] == 2192 and out["d"]["registrar"] == ""


def test_resolved_rows_do_not_depend_on_hot_keys(spark):
    """Rows that hold one URL, one homepage, one bad URL or one URL without a
    capture many times: the same whether a key is split off as hot or not."""
    page = lambda n: "<html><head><title>t{0}</title></head><body>{1}</body></html>".format(n, "word " * n)
    caps = spark.createDataFrame(
        [(u, u, 0, True, "text/html", page(n)) for u, n in (("https://a.com/", 80), ("https://a.com/low", 2), ("https://www.b.com/x", 50), ("https://b.com/", 3), ("http://c.com/", 60))],
        "url string, final_url string, redirect_count int, ok boolean, content_type string, html string",
    )
    urls = ["https://a.com/none"] * 5 + ["https://a.com/low"] * 4 + ["https://b.com/x", "https://c.com/", "https://c.com/"] + ["", None, "https://"] * 3 + ["https://nowhere.org/p"] * 6
    rows = spark.createDataFrame(list(enumerate(urls)), "id int, url string")
    got = [sorted(map(repr, P.resolve_captures(rows, caps, hot_key_rows=h).collect())) for h in (1, 3, 10**9)]
    assert got[0] == got[1] == got[2] and len(got[0]) == len(urls)
    by = {r["id"]: (r["status"], r["final_url"], r["title"], r["error"]) for r in P.resolve_captures(rows, caps, hot_key_rows=3).collect()}
    assert by[0] == ("success", "https://a.com/", "t80", P.FALLBACK)
    assert by[5][:3] == ("success", "https://a.com/", "t80")  # the homepage has more text
    assert by[9] == ("success", "https://www.b.com/x", "t50", None)
    assert by[10][:3] == ("success", "http://c.com/", "t60")
    assert {by[i][0] for i, u in enumerate(urls) if not u} == {"failed"} and by[len(urls) - 1][:2] == ("partial", "https://nowhere.org/p")
    assert P.resolve_captures(rows.limit(0), caps).count() == 0
    assert {r["status"] for r in P.resolve_captures(rows, caps.limit(0)).collect()} == {"failed", "partial"}
