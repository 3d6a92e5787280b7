"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator of the inventory, each over the whole test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskscope.operators import url_features as UF
from riskscope.session import ensure_checkpoint_dir, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn

    return deco


def _pages(spark, sf):
    return read_table(spark, sf, "pages")


@register("url_features")
def q_url_features(spark: SparkSession, sf: str) -> DataFrame:
    """U1-U26 over every page URL."""
    df = UF.with_url_features(_pages(spark, sf).select("page_id", "url"))
    return df.select("page_id", "url", "registered_domain", *UF.URL_FEATURES)


@register("url_features_mutated")
def q_url_features_mutated(spark: SparkSession, sf: str) -> DataFrame:
    """U30 + U26: the four probe variants of every page URL (adds suspicious
    words, credentials-style queries and extra subdomains), then features."""
    m = UF.url_mutations(_pages(spark, sf).select("page_id", "url"), keyword="paypal secure login")
    df = UF.with_url_features(m, "mutated_url")
    return df.select("page_id", "variant", "label", "mutated_url", "registered_domain", *UF.URL_FEATURES)


# ------------------------------------------------------------- pages, content
from riskscope import dictionaries as D  # noqa: E402
from riskscope.operators import content as C  # noqa: E402
from riskscope.operators import pages as P  # noqa: E402
from riskscope.plans import score_pages as SP  # noqa: E402

# Replacement keyword list for non-vacuous content checks: the test texts
# contain none of the real scam phrases, so this list uses words and word
# pairs that do occur there.  Single words and phrases, same rules.
TEST_KEYWORDS = ("ouen", "ment", "the", "ing", "thnt", "of the", "en la", "is the", "und die", "and the")


@register("page_extract")
def q_page_extract(spark, sf):
    """H2-H9 over every page."""
    return P.extract_pages(_pages(spark, sf)).select(
        "page_id", "title", "meta_description", "text", "text_length", "low_content", "link_count",
        "has_form", "has_iframe",
    )


#: Bodies of probe pages; ``@`` stands for the page's id.
PAGE_PROBES = {
    "nested": "<nav><nav>a</nav>LEAK</nav>end @",
    "three deep": "<footer>1<footer>2<footer>3</footer>4</footer>5</footer>out @<aside/>side",
    "unclosed": "<p>a @</p><nav>x",
    "quoted": "<div title='a>b @'>c @</div>",
    "stray quote": "<p title=it's>hm @</p> 'q'",
    "references": "x @ &check; &amp;lt; &frac12; &#x2713; &nosuch;",
    "crossed": "<header><nav>a</header>b @</nav>c",
    "script": "<script>if(a<nav b='</x'){}</script>ok @<nav/>z<!-- <nav> -->q",
    "other names": "<header-bar>k @</header-bar>",
    "links": "<a href='u'>l @</a> <a name=x>m</a><form></form><iframe></iframe>",
    "long": "word @ and more<br>" * 60,
    "empty": "",
}


@register("page_extract_probes")
def q_page_probes(spark, sf):
    """H2-H9 over probe pages of every page's id: nested, unclosed, crossed and
    quoted markup, references, descriptions of either kind, links, short and long texts."""
    rows = F.array(*[F.struct(F.lit(k).alias("probe"), F.lit(v).alias("body")) for k, v in PAGE_PROBES.items()])
    probes = _pages(spark, sf).select("page_id", F.explode(rows).alias("r")).select("page_id", "r.*")
    meta = F.when(F.col("page_id") % 3 == 0, "<META name='Description' content='D &amp; @'>").when(F.col("page_id") % 3 == 1, '<meta property="og:description" content="og @">').otherwise("")
    html = F.concat(F.lit("<html><head><title> T  @</title>"), meta, F.lit("</head><body class='x>y'>"), "body", F.lit("</body></html>"))
    out = P.extract_pages(probes.select("page_id", "probe", F.replace(html, F.lit("@"), F.col("page_id").cast("string")).alias("html")))
    return out.select("page_id", "probe", "title", "meta_description", "text", "text_length", "low_content", "link_count", "has_form", "has_iframe")


def _docs(spark, sf):
    return read_table(spark, sf, "documents")


@register("content_features_documents")
def q_content_docs(spark, sf):
    """C1-C9 on every document text (title NULL), real dictionaries."""
    df = C.with_content_features(_docs(spark, sf).select("doc_id", "text"), None, "text", None)
    return df.select("doc_id", *C.CONTENT_FEATURES)


@register("content_features_keywords")
def q_content_keywords(spark, sf):
    """C4/C5 with a replacement keyword list (words present in the texts)."""
    df = C.with_content_features(
        _docs(spark, sf).select("doc_id", "text"), None, "text", None, keywords=TEST_KEYWORDS
    )
    return df.select("doc_id", "token_count", "scam_keyword_count", "scam_keyword_density", "avg_word_length")


@register("content_features_pages")
def q_content_pages(spark, sf):
    """H8 -> C9 with the page title weighted 3x."""
    ex = P.extract_pages(_pages(spark, sf))
    df = C.with_content_features(ex, "title", "text", has_flags=False, keywords=TEST_KEYWORDS)
    return df.select("page_id", *C.CONTENT_FEATURES)


@register("score_pages")
def q_score_pages(spark, sf):
    """Flagship: URL + page + content features -> family scores -> score ->
    band, drivers, notes, active signals for every page."""
    return SP.flagship_report(_pages(spark, sf))


# -------------------------------------------------------------------- domains
from riskscope.functions.urls import lookup_domain as _lookup_domain  # noqa: E402
from riskscope.operators import domains as DM  # noqa: E402
from riskscope.sources import fixtures as FX  # noqa: E402


@register("whois_parse")
def q_whois_parse(spark, sf):
    """D2-D4 on every WHOIS record."""
    w = DM.parse_whois(FX.whois_raw(spark, sf), as_of=FX.AS_OF)
    return w.select("domain", "ord", "domain_age_days", "domain_expiry_days", "registrar", "missing_whois")


@register("domain_features")
def q_domain_features(spark, sf):
    """D2-D6 per domain: first usable WHOIS record + certificate facts."""
    return DM.domain_table(FX.whois_raw(spark, sf), FX.certs(spark, sf), as_of=FX.AS_OF)


def _customer_urls(spark, sf):
    c = read_table(spark, sf, "customer").select("c_custkey")
    tld = F.element_at(F.array(*[F.lit(t) for t in ("com", "net", "org", "xyz", "co.uk")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    return c.select("c_custkey", F.concat(F.lit("https://www.shop"), F.col("c_custkey").cast("string"), F.lit("."), tld, F.lit("/account")).alias("url"))


@register("domain_features_urls")
def q_domain_features_urls(spark, sf):
    """D1 + D7: every customer's shop URL joined to the domain table; URLs
    whose domain has no data get the defaults."""
    dom = DM.domain_table(FX.whois_raw(spark, sf), FX.certs(spark, sf), as_of=FX.AS_OF)
    out = DM.with_domain_features(_customer_urls(spark, sf), dom)
    return out.select("c_custkey", "url", "lookup_domain", *DM.DOMAIN_FEATURES)


# -------------------------------------------------------------------- dataset
from riskscope.operators import dataset as DS  # noqa: E402

SAMPLE_ROWS = 250  # rows of the balanced sample, where a sample is the feature
SEED = 42


def reference_rows(spark, sf):
    return DS.valid_labeled_rows(FX.labeled_reference_files(spark, sf))


def deduped_reference(spark, sf):
    return DS.dedupe_reference(reference_rows(spark, sf))


@register("reference_rows")
def q_reference_rows(spark, sf):
    """S1 + F1: both reference files, validated (label 0/1, URL normalised)."""
    return reference_rows(spark, sf).select("url", "label", "source_dataset", "line", "has_reference_text")


@register("dedupe_reference")
def q_dedupe_reference(spark, sf):
    """One row per URL (text first, then source, then line)."""
    return deduped_reference(spark, sf).select("url", "label", "source_dataset", "line", "has_reference_text")


@register("balanced_sample")
def q_balanced_sample(spark, sf):
    """M1: balanced sample of the de-duplicated reference rows (text
    preferred, with-replacement draws where a pool is short)."""
    s = DS.balanced_sample(deduped_reference(spark, sf), SAMPLE_ROWS, SEED)
    return s.select("url", "label", "source_dataset", "line", "has_reference_text", "draw", "sample_order")


@register("stratified_split")
def q_stratified_split(spark, sf):
    """M2: label-proportional 80/20 split by md5(url) order."""
    return DS.stratified_split(deduped_reference(spark, sf), 0.2, SEED).select("url", "label", "is_test")


@register("stratified_folds")
def q_stratified_folds(spark, sf):
    """M3: five label-proportional folds."""
    return DS.stratified_folds(deduped_reference(spark, sf), 5, SEED).select("url", "label", "fold")


def _url_copies(spark, sf):
    p = _pages(spark, sf).select("page_id", "url")
    return (
        p.select(F.col("url"), (F.col("page_id") * 3).alias("pos"))
        .unionByName(p.select(F.upper(F.col("url")).alias("url"), (F.col("page_id") * 3 + 1).alias("pos")))
        .unionByName(p.select(F.concat(F.col("url"), F.lit("/")).alias("url"), (F.col("page_id") * 3 + 2).alias("pos")))
    )


@register("dedupe_urls")
def q_dedupe_urls(spark, sf):
    """Page URLs plus upper-case and trailing-slash copies, first per key."""
    return DS.dedupe_urls(_url_copies(spark, sf)).select("dedupe_key", "url", "pos")


@register("feed_union")
def q_feed_union(spark, sf):
    """X1 + M4: first 300 distinct URLs of the page feed, topped up from a
    document feed."""
    primary = _pages(spark, sf).select("url", F.col("page_id").alias("pos"))
    d = _docs(spark, sf)
    secondary = d.select(
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("doc_id").alias("pos"),
    )
    return DS.union_with_shortfall(primary, secondary, 300).select("url", "pos", "_prio").withColumnRenamed("_prio", "feed")


def url_probes(pages):
    """Eight URLs made of every page id, so that each URL rule both holds and
    fails somewhere."""
    i, text = F.col("page_id"), lambda c: c.cast("string")
    probes = {
        "credentials": F.concat(F.lit("https://user@h"), text(i), F.lit(".example.com/a//b#f")),
        "IPv4": F.concat(F.lit("http://"), F.concat_ws(".", text(i % 223 + 1), text(i % 256), text(i * 7 % 256), F.lit("9")), F.lit(":8080/login")),
        "IPv6": F.concat(F.lit("http://[2001:db8::"), F.lower(F.hex(i % 65536)), F.lit("]/x")),
        "suffix": F.concat(F.lit("https://secure-login"), text(i), F.lit(".xyz/verify?a%20b=1&a+b=2&c="), text(i)),
        "escapes": F.concat(F.lit("https://h"), text(i), F.lit(".example.org/?a%zz%41=1&a%zzA=2&a%ZZA=3&%e4%b8%ad=4&b%=5&b%25=6&c%4=7")),
        "short": F.concat(F.lit("https://bit.ly/"), text(i)),
        "hosted brand": F.concat(F.lit("https://paypal-"), text(i), F.lit(".weebly.com/x.com/signin")),
        "hosted": F.concat(F.lit("https://u"), text(i), F.lit(".github.io/a_b/index~"), text(i), F.lit(".html")),
        "official": F.concat(F.lit("https://www.paypal.com/"), text(i), F.lit("/caf%C3%A9")),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("probe"), v.alias("url")) for k, v in probes.items()])
    return pages.select("page_id", F.explode(rows).alias("r")).select("page_id", "r.*")


@register("url_features_probes")
def q_url_probes(spark, sf):
    """U1-U26 over probe URLs of every page: credentials, double slashes, IP
    hosts, odd suffixes, shorteners, free hosting, suffixes in paths."""
    df = UF.with_url_features(url_probes(_pages(spark, sf)))
    return df.select("page_id", "probe", "url", "registered_domain", *UF.URL_FEATURES)


def _order_rules(orders):
    """A rule per order: exact, wildcard, or a wildcard and its exception."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    tld = F.element_at(F.array(*map(F.lit, ("com", "de", "co.uk", "jp"))), (key % 4 + 1).cast("int"))
    suffix = F.concat(F.lit("z"), key.cast("string"), F.lit("."), tld)
    rows = orders.select(F.when(key % 3 == 0, "exact").otherwise("wildcard").alias("kind"), suffix.alias("suffix"), (key % 3 == 2).alias("both"), cust.alias("cust"), key.alias("key"))
    return rows, rows.select("suffix", "kind").unionByName(rows.where("both").select(F.concat(F.lit("city."), "suffix").alias("suffix"), F.lit("exception").alias("kind")))


from riskscope.functions import urls as U  # noqa: E402
from riskscope.operators import suffixes as SX  # noqa: E402


@register("public_suffix_match")
def q_public_suffix(spark, sf):
    """J1, U23, D1 over a large rule table: the built-in rules and one or two
    for every order, against the pages' hosts and hosts made of the orders."""
    rows, made = _order_rules(read_table(spark, sf, "orders"))
    table = SX.suffix_table(SX.builtin_rules(spark).unionByName(made))
    below = F.concat(F.lit("a"), F.col("cust").cast("string"), F.lit(".b."), F.when(F.col("cust") % 3 == 0, "city.").otherwise(""), F.col("suffix"))
    host = F.when(F.col("cust") % 5 == 0, F.col("suffix")).when(F.col("cust") % 7 == 0, F.concat(F.lit("x."), "suffix")).otherwise(below)
    hosts = rows.select(F.lit("order").alias("of"), F.col("key").cast("long").alias("id"), host.alias("host"))
    pages = _pages(spark, sf).select(F.lit("page").alias("of"), F.col("page_id").alias("id"), U.parse_url_parts(F.col("url"))["hostname"].alias("host"))
    out = SX.with_suffix_labels(hosts.unionByName(pages), "host", table)
    host, labels = F.col("host"), F.col("suffix_labels")
    return out.select("of", "id", "host", labels.cast("long").alias("suffix_labels"), SX.registered(host, labels).alias("registered_domain"), SX.lookup(host, labels).alias("lookup_domain"))


# ----------------------------------------------------------------- evaluation
from riskscope.operators import domains as _DM  # noqa: E402,F811
from riskscope.operators import evaluate as EV  # noqa: E402
from riskscope.operators import scoring as SC  # noqa: E402


def evaluation_table(spark, sf):
    """Scored pages with the block-list label as the expected class (the
    deterministic mean-of-families score stands in for a model)."""
    rep = SP.flagship_report(_pages(spark, sf))
    lab = FX.weak_labels(rep)
    return lab.select(
        "url",
        "expected_label",
        F.when(F.col("expected_label") == 1, "SCAM").otherwise("LEGIT").alias("expected_name"),
        F.col("url").alias("final_url"),
        F.lit("success").alias("scrape_status"),
        F.lit("").alias("scrape_error"),
        F.when(F.col("prediction") == "SCAM", 1).otherwise(0).alias("predicted_label"),
        F.col("prediction").alias("predicted_name"),
        "confidence",
        "scam_probability",
        (F.when(F.col("prediction") == "SCAM", 1).otherwise(0) == F.col("expected_label")).cast("int").alias("correct"),
    )


@register("evaluation_rows")
def q_evaluation_rows(spark, sf):
    """T11 evaluation rows (expected vs predicted per page)."""
    return evaluation_table(spark, sf)


@register("holdout_metrics")
def q_holdout_metrics(spark, sf):
    """A5: accuracy, precision, recall, F1, exact ROC AUC."""
    return EV.holdout_metrics(evaluation_table(spark, sf), "expected_label", "predicted_label", "scam_probability")


@register("confusion_matrix")
def q_confusion_matrix(spark, sf):
    """2x2 zero-filled confusion matrix."""
    return EV.confusion_matrix(evaluation_table(spark, sf))


@register("classification_report")
def q_classification_report(spark, sf):
    """Per-class and averaged precision / recall / F1 / support."""
    return EV.classification_report(evaluation_table(spark, sf))


@register("real_summary")
def q_real_summary(spark, sf):
    """Per expected class totals, correct, mean confidence, accuracy."""
    return EV.real_summary(evaluation_table(spark, sf))


@register("eval_summary")
def q_eval_summary(spark, sf):
    """A9 / S5 summary lines: total, legit and scam correct counts."""
    return EV.eval_summary(evaluation_table(spark, sf))


@register("confidence_histogram")
def q_confidence_histogram(spark, sf):
    """10 equal-width confidence bins by expected class."""
    return EV.confidence_histogram(evaluation_table(spark, sf))


@register("report_lines")
def q_report_lines(spark, sf):
    """The lines of the Markdown report, a row per line."""
    from riskscope.sources.io import report_lines

    return report_lines(evaluation_table(spark, sf)).select("section", "ord_key", "line")


@register("top_confident_examples")
def q_top_confident(spark, sf):
    """The 12 most telling examples (wrong first, then confident)."""
    return EV.top_confident_examples(evaluation_table(spark, sf))


@register("case_history")
def q_case_history(spark, sf):
    """The 12 latest scans (page URL scored, time from events)."""
    hist = FX.url_history(spark, sf).withColumn("checked_at", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    # The latest first: 12 rows, so only their pages are scored.
    last = F.broadcast(hist.orderBy(F.desc("checked_at"), "url", "page_id").limit(12).select("page_id", "checked_at"))
    pages = read_table(spark, sf, "pages", spread_rows=False).join(last.select("page_id"), "page_id", "left_semi")
    rep = SP.flagship_report(pages).join(last, "page_id")
    return EV.case_history(rep.select("url", "prediction", "confidence", "scam_probability", "risk_label", "checked_at"))


def prepared_dataset(spark, sf):
    """Dataset build (lifecycle B) over the whole de-duplicated reference:
    28 URL features, 9 content features from the reference text, 9 domain
    defaults, 8 meta columns = 54 columns."""
    s = deduped_reference(spark, sf)
    u = UF.with_url_features(s, "url")
    c = C.with_content_features(u, F.lit(""), "text_content", F.lit(""))
    d = c.withColumns(_DM.empty_domain_defaults())
    meta = [
        F.col("url"), F.col("url").alias("final_url"), F.col("label"), F.col("source_dataset"),
        F.col("has_reference_text").cast("int").alias("has_reference_text"),
        F.lit("not_scraped").alias("scrape_status"), F.lit("").alias("scrape_error"), F.lit(0).alias("redirect_count"),
    ]
    return d.select(*meta, *UF.URL_FEATURES, *[F.col(x).cast("string" if x == "registrar" else "int").alias(x) for x in _DM.DOMAIN_FEATURES], *C.CONTENT_FEATURES)


@register("prepared_dataset")
def q_prepared_dataset(spark, sf):
    """The 54-column prepared rows."""
    return prepared_dataset(spark, sf)


@register("label_counts")
def q_label_counts(spark, sf):
    """A1: label counts and shares of the prepared dataset."""
    return EV.label_counts(prepared_dataset(spark, sf))


@register("dataset_summary")
def q_dataset_summary(spark, sf):
    """Rows, columns, rows with text, URL-only rows."""
    return EV.dataset_summary(prepared_dataset(spark, sf))


@register("null_counts")
def q_null_counts(spark, sf):
    """A2: NULLs per column of documents LEFT JOIN labels (top 20)."""
    d = _docs(spark, sf).join(read_table(spark, sf, "labels"), "doc_id", "left")
    return EV.null_counts(d)


@register("constant_columns")
def q_constant_columns(spark, sf):
    """A3: constant columns of the prepared dataset."""
    return EV.constant_columns(prepared_dataset(spark, sf))


@register("feature_profile")
def q_feature_profile(spark, sf):
    """L1: numeric profile and keep/drop decision per candidate column."""
    return EV.feature_profile(prepared_dataset(spark, sf)).select(
        "column", "position", "n", "non_null", "min", "max", "kept"
    )


def clean_dataset(spark, sf):
    return EV.select_numeric_features(prepared_dataset(spark, sf))


@register("describe_features")
def q_describe(spark, sf):
    """A4: mean, sample sd, min, max of every kept feature."""
    clean, feats = clean_dataset(spark, sf)
    d = EV.describe_features(clean, feats)
    return d.select("column", *[F.bround(c, 6).alias(c) for c in ("mean", "std", "min", "max")])


@register("feature_variance_topk")
def q_variance(spark, sf):
    """A10: the 16 features with the largest sample variance."""
    clean, feats = clean_dataset(spark, sf)
    v = EV.feature_variance_topk(clean, feats, 16)
    return v.select("column", F.bround("variance", 6).alias("variance"))


@register("correlation_pairs")
def q_corr(spark, sf):
    """Pearson correlation of every pair of kept features."""
    clean, feats = clean_dataset(spark, sf)
    c = EV.correlation_pairs(clean, feats)
    return c.select("feature_a", "feature_b", F.bround("corr", 6).alias("corr"))


BOX_FEATURES = ("url_length", "num_dots", "num_hyphen", "num_digits", "url_entropy", "path_depth", "text_length", "token_count")


@register("box_stats")
def q_box(spark, sf):
    """Quartiles and whiskers of eight features by label."""
    b = EV.box_stats(prepared_dataset(spark, sf), BOX_FEATURES)
    return b.select("feature", "label", *[F.bround(c, 6).alias(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")])


@register("feature_medians")
def q_medians(spark, sf):
    """L2: exact medians of the kept features (training imputation values)."""
    clean, feats = clean_dataset(spark, sf)
    return EV.median_table(clean, feats).select(F.col("feature").alias("column"), F.bround("median", 6).alias("median"))


@register("standardized_features")
def q_standardized(spark, sf):
    """L2 + L3: median imputation, then (x - mean) / population sd, of eight
    features of every prepared row."""
    # The medians, the means and the result read these rows: prepared once.
    d = cut_lineage(prepared_dataset(spark, sf).select("url", "label", *[F.col(c).cast("double").alias(c) for c in BOX_FEATURES]))
    z = EV.standard_scale(EV.median_impute(d, EV.medians(d, BOX_FEATURES)), BOX_FEATURES)
    return z.select("url", "label", *[F.bround(c, 6).alias(c) for c in BOX_FEATURES])


@register("class_weights")
def q_class_weights(spark, sf):
    """L4: balanced class weight per label."""
    clean, _ = clean_dataset(spark, sf)
    return EV.balanced_weights(clean).groupBy("label").agg(F.bround(F.first("weight"), 6).alias("weight"), F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ captures
@register("filter_html")
def q_filter_html(spark, sf):
    """H1: captures that are OK and look like HTML (type / body sniffing)."""
    return P.filter_html(FX.captures(spark, sf)).select("url", "content_type", "redirect_count")


@register("resolve_captures")
def q_resolve_captures(spark, sf):
    """H10 + H11: URL list (page URLs, www-toggled copies, missing paths)
    resolved against the capture table with homepage fallback."""
    r = P.resolve_captures(FX.url_list(spark, sf), FX.captures(spark, sf))
    return r.select(
        "page_id", "url", "status", "final_url", "error", "redirect_count", "title", "text_length",
        "low_content", "link_count",
    )


# ------------------------------------------------------------ URL utilities

@register("url_parts")
def q_url_parts(spark, sf):
    """U1, U1b, U2, U27, U28 on every page URL (and its upper-cased copy)."""
    p = _pages(spark, sf).select("page_id", "url")
    p = p.unionByName(p.select((F.col("page_id") + 1_000_000).alias("page_id"), F.upper("url").alias("url")))
    n = p.withColumn("normalized_url", U.normalize_url(F.col("url")))
    n = n.withColumn("_p", U.parse_url_parts(F.col("normalized_url")))
    return n.select(
        "page_id", "url", "normalized_url",
        F.col("_p.scheme").alias("scheme"), F.col("_p.netloc").alias("netloc"), F.col("_p.hostname").alias("hostname"),
        F.col("_p.path").alias("path"), F.col("_p.query").alias("query"), F.col("_p.fragment").alias("fragment"),
        U.canonical_url(F.col("url")).alias("canonical_url"),
        U.dedupe_key(F.col("normalized_url")).alias("dedupe_key"),
        U.homepage_url(F.col("normalized_url")).alias("homepage_url"),
    )


@register("candidate_urls")
def q_candidate_urls(spark, sf):
    """Ranked fetch candidates of every canonical page URL."""
    p = _pages(spark, sf).select("page_id", U.canonical_url(F.col("url")).alias("url"))
    return UF.candidate_urls(p, "url").select("page_id", "url", "rank", "candidate")


@register("public_hosts")
def q_public_hosts(spark, sf):
    """Public-host check on every page host and on the IPv4 literals
    built from each event's (user_id, value) pair."""
    hosts = _pages(spark, sf).select(U.parse_url_parts(U.normalize_url(F.col("url")))["hostname"].alias("host"))
    ev = read_table(spark, sf, "events").select(
        F.concat_ws(".", *[((F.col("user_id") * k + F.floor(F.col("value"))) % m).cast("long").cast("string")
                           for k, m in ((1, 256), (7, 256), (13, 256), (31, 256))]).alias("host")
    )
    h = hosts.unionByName(ev).distinct()
    return h.select("host", U.is_public_host(F.col("host")).alias("is_public"), U.is_ip_literal(F.col("host")).cast("int").alias("is_ip"))


@register("text_corpus")
def q_text_corpus(spark, sf):
    """F3 + C11: pages with non-blank text; corpus text = title + text."""
    ex = P.extract_pages(_pages(spark, sf)).withColumnRenamed("text", "text_content")
    return DS.text_corpus(ex, "title", "text_content").select("page_id", "corpus_text")


@register("tfidf_top_terms")
def q_tfidf(spark, sf):
    """Top 10 TF-IDF terms of every document (smoothed idf, L2 norm)."""
    return C.tfidf_top_terms(_docs(spark, sf), "doc_id", "text", top_n=10)


@register("tfidf_transform")
def q_tfidf_transform(spark, sf):
    """Every conversation turn under a model fitted to the documents,
    written and read again."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tfidf-{uuid.uuid4().hex}"
    C.fit_tfidf(_docs(spark, sf), "doc_id", "text", min_df=2).write.parquet(path)
    turns = read_table(spark, sf, "conversations").withColumn("turn_id", F.concat_ws("-", "conv_id", "turn"))
    return C.transform_tfidf(turns, "turn_id", "text", spark.read.parquet(path))


# --------------------------------------------------------------------- store
from riskscope.operators import store as ST  # noqa: E402

MERGE_COLUMNS = ("title", "status", "final_url", "label", "url_length", "suspicious_word_count", "text_length")


def stored_websites(spark, sf):
    """Stored table: every page, extracted and featurised, no label yet."""
    ex = P.extract_pages(_pages(spark, sf).select("url", "html"))
    f = UF.with_url_features(ex, "url")
    return f.select(
        "url", "title", F.lit("success").alias("status"), F.col("url").alias("final_url"),
        F.lit(None).cast("int").alias("label"), "url_length", "suspicious_word_count", "text_length",
    )


def incoming_websites(spark, sf):
    """Incoming batch: the URL list resolved against the captures, URL
    features of the final URL, block-list label."""
    r = P.resolve_captures(FX.url_list(spark, sf), FX.captures(spark, sf))
    r = r.withColumn("_furl", F.when(F.col("final_url") != "", F.col("final_url")).otherwise(F.col("url")))
    f = FX.weak_labels(UF.with_url_features(r, "_furl"), "url")
    return ST.one_per_key(f.select(
        "url", "title", "status", "final_url", F.col("expected_label").alias("label"), "url_length",
        "suspicious_word_count", "text_length",
    ))


@register("not_seen_urls")
def q_not_seen(spark, sf):
    """URLs of the list that are not stored yet."""
    return ST.not_seen(FX.url_list(spark, sf), stored_websites(spark, sf)).select("page_id", "url")


@register("websites_merge")
def q_websites_merge(spark, sf):
    """J4 + J5: upsert the incoming batch into the stored table (merge mode)."""
    return ST.merge_websites(stored_websites(spark, sf), incoming_websites(spark, sf), "merge")


@register("websites_insert_ignore")
def q_websites_ignore(spark, sf):
    """J4 + J5 in insert-ignore mode: stored scrape fields kept, features
    and labels updated."""
    return ST.merge_websites(stored_websites(spark, sf), incoming_websites(spark, sf), "ignore")


@register("websites_export")
def q_websites_export(spark, sf):
    """F2 + F4: labelled rows of the merged table without text columns."""
    m = ST.merge_websites(stored_websites(spark, sf), incoming_websites(spark, sf), "merge")
    return ST.export_dataset(m, labeled_only=True, drop_text=True)


BATCH_WHITELIST = ("www.therer.example.com", "ththre.example.com", "blog.tionsh.example.net")


@register("batch_check")
def q_batch_check(spark, sf):
    """J6 + L17: whitelisted hosts are LEGITIMATE at 100 %; the rest are
    scored and checked against the block-list expectation."""
    rep = SP.flagship_report(_pages(spark, sf)).select("page_id", "url", "scam_probability")
    rep = FX.weak_labels(rep).withColumn("expected", F.when(F.col("expected_label") == 1, "Scam").otherwise("Legit"))
    rep = rep.withColumn("netloc", F.lower(U.parse_url_parts(F.col("url"))["netloc"]))
    white, rest = SC.whitelist_split(rep, "netloc", BATCH_WHITELIST)
    w = white.select(
        "page_id", "url", "expected", F.lit("LEGITIMATE").alias("predicted_verdict"),
        F.lit("100.00%").alias("confidence_text"), F.lit("Whitelisted").alias("note"),
    )
    s = SC.batch_verdict(rest, "expected").select(
        "page_id", "url", "expected", "predicted_verdict", "confidence_text", F.lit("ML Prediction").alias("note")
    )
    out = w.unionByName(s)
    ok = F.col("predicted_verdict").contains(F.upper(F.col("expected")))
    return out.withColumn("check", F.when(ok, "[PASS]").otherwise("[FAIL]"))


# ------------------------------------------------------------------------ ML
from riskscope.operators import extratrees as ET  # noqa: E402
from riskscope.operators import ml as ML  # noqa: E402
from riskscope.streaming.jobs import score_urls as _score_urls  # noqa: E402
from riskscope.session import cut_lineage  # noqa: E402

# Small forests for the registered checks; full sizes are the defaults of
# TrainConfig.
CHECK_CONFIG = ML.TrainConfig(
    n_extra_trees=40, n_random_forest=40, gbt_iter=20, max_depth=8, lr_max_iter=200, rff_dim=64, svc_max_iter=40
)


@register("url_only_scores")
def q_url_only(spark, sf):
    """URL-only scoring (zero content features) of every page URL."""
    s = _score_urls(_pages(spark, sf).select("page_id", "url"))
    return s.select("page_id", "url", *SC.FAMILY_COLUMNS, "scam_probability", "prediction", "confidence", "risk_label")


def _train_test(spark, sf):
    prep = cut_lineage(ST.one_per_key(prepared_dataset(spark, sf)))
    _, feats = EV.select_numeric_features(prep)
    keyed = prep.select("url", *[F.col(c).cast("double").alias(c) for c in feats], "label")
    # Training reads the split many times: cut the lineage once (reliable
    # checkpoint in the shared checkpoint directory).
    split = cut_lineage(DS.stratified_split(keyed, 0.2, SEED))
    # Every training row, dealt by its place in an order: bootstraps are drawn partition by partition.
    train = split.where(~F.col("is_test")).drop("is_test").orderBy(F.md5("url"), "url")
    return cut_lineage(train), split.where("is_test").drop("is_test"), feats


@register("cv_leaderboard")
def q_cv_leaderboard(spark, sf):
    """L5 + L6 + A14: 5-fold CV of the five candidates on the training part
    of the prepared dataset; ranked by F1 then AUC, display names."""
    train, _, feats = _train_test(spark, sf)
    board, _ = ML.cross_validate(train, feats, CHECK_CONFIG)
    name = F.initcap(F.replace(F.col("model"), F.lit("_"), F.lit(" ")))
    return board.select("model", name.alias("display_name"), *[c for c in board.columns if c != "model"])


TREE_FEATURES = ("url_length", "num_dots", "num_hyphen", "num_digits", "path_depth", "text_length", "token_count")


@register("extra_trees_nodes")
def q_extra_trees_nodes(spark, sf):
    """The nodes of three extremely randomised trees of depth 3, grown over
    the whole prepared dataset; each with its label counts, cut and share of
    label 1 by class weight."""
    x = F.array(*[F.col(c).cast("double") for c in TREE_FEATURES])
    rows = cut_lineage(prepared_dataset(spark, sf).select(x.alias("x"), "label"))
    model = ET.fit(rows, len(TREE_FEATURES), n_trees=3, max_depth=3, max_features=3, seed=SEED)
    inner = F.col("feature") >= 0
    name = F.element_at(F.array(*map(F.lit, TREE_FEATURES)), F.when(inner, F.col("feature") + 1).otherwise(1))
    a, b = F.col("n0") * F.lit(model.weights[0]), F.col("n1") * F.lit(model.weights[1])
    return model.table(spark).select("tree", "node", "n0", "n1", F.when(inner, name).alias("feature"),
                                     F.when(inner, F.bround("cut", 6)).alias("cut"), F.bround(b / (a + b), 6).alias("share"))


@register("holdout_model_metrics")
def q_holdout_model(spark, sf):
    """L5 + L7 + A5: calibrated random forest on the training part, exact
    holdout metrics on the 20 % test part."""
    train, test, feats = _train_test(spark, sf)
    ens = ML.calibrate_isotonic(train, feats, "random_forest", CHECK_CONFIG)
    scored = ens.transform(test)
    return EV.holdout_metrics(SC.score_batch(scored, valid_col=None), "label", "prediction_label", "scam_probability")


@register("calibrated_scores")
def q_calibrated_scores(spark, sf):
    """L8 with a model: calibrated logistic regression scores, labels and
    bands for the holdout rows."""
    train, test, feats = _train_test(spark, sf)
    ens = ML.calibrate_isotonic(train, feats, "logistic_regression", CHECK_CONFIG)
    s = SC.score_batch(ens.transform(test), valid_col=None)
    return s.select("url", "label", F.bround("scam_probability", 4).alias("scam_probability"), "prediction", "confidence", SC.risk_band(F.col("scam_probability"))["label"].alias("risk_label"))


@register("feature_importance")
def q_feature_importance(spark, sf):
    """Mean feature importance over the calibrated extra-trees folds."""
    train, _, feats = _train_test(spark, sf)
    ens = ML.calibrate_isotonic(train, feats, "extra_trees", CHECK_CONFIG)
    imp = ML.feature_importance(ens, top=20)
    return spark.createDataFrame([(i + 1, f, round(v, 6)) for i, (f, v) in enumerate(imp)], "rank int, feature string, importance double")


@register("isotonic_calibration")
def q_isotonic_calibration(spark, sf):
    """L7's isotonic map by itself: the raw score of a labelled document is
    its length in steps of 500 characters, the label ``quality``; the map at every step."""
    docs = read_table(spark, sf, "documents", spread_rows=False).where("n_chars is not null")
    labels = read_table(spark, sf, "labels", spread_rows=False).where("quality in (0, 1)")
    step = F.floor(F.col("n_chars") / 500).cast("long")
    held = docs.join(labels, "doc_id").select(step.alias("step"), step.cast("double").alias("iso_in"), F.col("quality").alias("label"))
    per = held.groupBy("step", "iso_in").agg(F.count(F.lit(1)).alias("n_rows"))
    return ML.isotonic_map(held).transform(per).select("step", "n_rows", F.bround("prediction", 6).alias("calibrated"))


# ------------------------------------------------- groups, alignment, impute
FEATURE_GROUPS = (
    ("URL structure", UF.URL_FEATURES[:25]),
    ("Hosting and brand signals", UF.URL_FEATURES[25:]),
    ("Page content", ("text_length", "token_count", "scam_keyword_count", "scam_keyword_density", "exclamation_count", "caps_ratio", "avg_word_length")),
)
MODEL_FEATURES = tuple(f for _, fs in FEATURE_GROUPS for f in fs)


@register("feature_group_counts")
def q_feature_groups(spark, sf):
    """Kept features of the cleaned dataset counted per feature group
    (other kept columns count as domain signals)."""
    prof = EV.feature_profile(prepared_dataset(spark, sf)).where("kept")
    pairs = [(f, g) for g, fs in FEATURE_GROUPS for f in fs]
    group = F.coalesce(
        F.element_at(F.create_map(*[x for f, g in pairs for x in (F.lit(f), F.lit(g))]), F.col("column")),
        F.lit("Domain signals"),
    )
    return prof.groupBy(group.alias("group")).agg(F.count(F.lit(1)).alias("feature_count"))


@register("feature_preview")
def q_feature_preview(spark, sf):
    """F5 + L10: URL features of every page aligned to the 35 model
    features (content columns absent -> NULL -> 0)."""
    f = UF.with_url_features(_pages(spark, sf).select("page_id", "url"))
    return SC.feature_preview(f, MODEL_FEATURES, keep=["page_id"])


@register("impute_domain")
def q_impute_domain(spark, sf):
    """Customer shop URLs left-joined to the domain table without
    defaults, then imputed as the batch scorer does."""
    dom = DM.domain_table(FX.whois_raw(spark, sf), FX.certs(spark, sf), as_of=FX.AS_OF)
    urls = _customer_urls(spark, sf)
    keyed = urls.withColumn("lookup_domain", U.lookup_domain(U.parse_url_parts(F.col("url"))["hostname"]))
    j = keyed.join(dom.withColumnRenamed("domain", "lookup_domain"), "lookup_domain", "left")
    out = DM.impute_domain(j.drop("missing_whois").withColumn("missing_whois", F.lit(None).cast("int")))
    return out.select("c_custkey", "domain_age_days", "domain_expiry_days", "ssl_days_remaining", "missing_whois",
                      "has_ssl", "ssl_valid", "is_new_domain", "short_expiry_domain")
