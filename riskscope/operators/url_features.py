"""URL feature operators (``DataFrame -> DataFrame``): U26 and friends.

``with_url_features`` is a map-only operator: three projections (normalise,
split once into a struct, derive features from the struct fields), no
shuffle, no Python worker.  It keeps every input column.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskscope import dictionaries as D
from riskscope.functions import urls as U
from riskscope.operators.suffixes import with_registered_domain
from riskscope.functions.memo import freeze, jvm_memo

# Output columns of U26, in the order of the stored schema.
URL_FEATURES = (
    "url_length", "num_dots", "num_hyphen", "num_slashes", "https", "subdomains",
    "has_at_symbol", "has_double_slash", "has_ip", "num_underscores", "num_percent",
    "num_digits", "num_query_params", "has_query", "path_depth", "suspicious_tld",
    "brand_in_url", "is_shortened", "suspicious_word_count", "url_entropy",
    "hostname_length", "digit_letter_ratio", "num_special_chars", "tld_in_path",
    "longest_digit_run", "uses_free_hosting", "brand_on_free_hosting", "brand_domain_mismatch",
)
DOUBLE_URL_FEATURES = ("url_entropy", "digit_letter_ratio")


def url_feature_exprs(
    u: Column,
    host: Column,
    path_l: Column,
    query: Column,
    scheme: Column,
    registered: Column,
    *,
    suspicious_tlds: Iterable[str] = D.SUSPICIOUS_TLDS,
    brands: Iterable[str] = D.BRAND_KEYWORDS,
    official: Mapping[str, Iterable[str]] = D.OFFICIAL_BRAND_DOMAINS,
    shorteners: Iterable[str] = D.SHORTENING_SERVICES,
    free_hosting: Iterable[str] = D.FREE_HOSTING_DOMAINS,
    suspicious_words: Iterable[str] = D.SUSPICIOUS_WORDS,
) -> dict[str, Column]:
    """The 28 feature expressions over already parsed parts."""
    brands = tuple(brands)
    host_path = F.concat(host, path_l)
    brand = U.brand_in(host_path, brands)
    free = U.uses_free_hosting(host, free_hosting)
    official_hit = U.official_brand_hit(host_path, registered, official)
    i = lambda c: c.cast("int")
    exprs = {
        "url_length": i(F.length(u)),
        "num_dots": i(U.count_substr(u, ".")),
        "num_hyphen": i(U.count_substr(u, "-")),
        "num_slashes": i(U.count_substr(u, "/")),
        "https": i(scheme == "https"),
        "subdomains": U.subdomain_count(host),
        "has_at_symbol": i(u.contains("@")),
        "has_double_slash": i(path_l.contains("//")),
        "has_ip": i(U.is_ip_literal(host)),
        "num_underscores": i(U.count_substr(u, "_")),
        "num_percent": i(U.count_substr(u, "%")),
        "num_digits": i(F.length(F.regexp_replace(u, r"[^\p{Nd}]", ""))),
        "num_query_params": U.num_query_params(query),
        "has_query": i(query != ""),
        "path_depth": U.path_depth(path_l),
        "suspicious_tld": i(U.tld_of(host).isin(*suspicious_tlds)),
        "brand_in_url": i(brand),
        "is_shortened": i(host.isin(*shorteners)),
        "suspicious_word_count": U.suspicious_word_count(F.lower(u), suspicious_words),
        "url_entropy": U.shannon_entropy(u),
        "hostname_length": i(F.length(host)),
        "digit_letter_ratio": U.digit_letter_ratio(host),
        "num_special_chars": i(F.length(u) - F.length(F.translate(u, "~={}|^`", ""))),
        "tld_in_path": U.tld_in_path(path_l),
        "longest_digit_run": U.longest_digit_run(host),
        "uses_free_hosting": free,
        "brand_on_free_hosting": i(brand & (free == 1)),
        "brand_domain_mismatch": i(brand & ~official_hit),
    }
    return exprs


@jvm_memo
def _split_stages(url_col: str):
    """Four projections: normalise; RFC 3986 groups; host info; host, path,
    validity.  Each regex is evaluated once per row."""
    u = U.normalize_url(F.col(url_col))
    s = F.regexp_replace(F.col("_u"), "[\t\r\n]", "")
    groups = {
        "_scheme": F.lower(F.regexp_extract(F.col("_s"), U.RFC3986, 1)),
        "_netloc": F.regexp_extract(F.col("_s"), U.RFC3986, 2),
        "_rawpath": F.regexp_extract(F.col("_s"), U.RFC3986, 3),
        "_query": F.regexp_extract(F.col("_s"), U.RFC3986, 4),
    }
    hostinfo = F.regexp_extract(F.col("_netloc"), "([^@]*)$", 1)
    hi = F.col("_hostinfo")
    net = F.col("_netloc")
    last = {
        "_host": F.lower(
            F.when(hi.contains("["), F.regexp_extract(hi, r"\[([^\]]*)", 1)).otherwise(F.regexp_extract(hi, "^([^:]*)", 1))
        ),
        "_path": F.lower(F.regexp_replace(F.col("_rawpath"), ";[^/]*$", "")),
        "url_valid": (net.contains("[") == net.contains("]"))
        & F.when(hi.contains("["), F.lower(hi).rlike(r"^\[" + U.IPV6_RE[1:-1] + r"\](?::.*)?$")).otherwise(F.lit(True)),
    }
    return u, s, groups, hostinfo, last


def with_url_parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Normalised URL ``_u`` and its parts ``_scheme, _netloc, _query,
    _host, _path`` (lower case), ``url_valid`` as staged projections."""
    u, s, groups, hostinfo, last = _split_stages(url_col)
    return (
        df.withColumn("_u", u)
        .withColumn("_s", s)
        .withColumns(groups)
        .withColumn("_hostinfo", hostinfo)
        .withColumns(last)
        .drop("_s", "_rawpath", "_hostinfo")
    )


@jvm_memo
def _feature_stage_exprs(suffix_rules, frozen_dicts):
    reg = U.registered_domain(F.col("_host"), suffix_rules)
    dicts = {k: (dict(v) if k == "official" else v) for k, v in frozen_dicts}
    exprs = url_feature_exprs(
        F.col("_u"), F.col("_host"), F.col("_path"), F.col("_query"), F.col("_scheme"), F.col("_reg"), **dicts
    )
    return reg, exprs


def with_url_features(
    df: DataFrame,
    url_col: str = "url",
    *,
    suffix_rules: Iterable[tuple[str, str]] | DataFrame = D.BUILTIN_SUFFIXES,
    keep_internal: bool = False,
    **dicts,
) -> DataFrame:
    """Add the 28 URL features plus ``normalized_url``, ``hostname``,
    ``registered_domain`` and ``url_valid`` (False where a strict splitter
    rejects the URL; such rows are scored as errors downstream).

    Three projections: normalise, split once, features from the parts; the
    expression trees are built once per JVM and reused.  ``suffix_rules`` may be
    a rule table (``suffixes.suffix_table``), such as a full public-suffix list."""
    staged = with_url_parts(df, url_col)
    if isinstance(suffix_rules, DataFrame):
        staged = with_registered_domain(staged, "_host", suffix_rules, out="_reg")
        _, exprs = _feature_stage_exprs(freeze(D.BUILTIN_SUFFIXES), freeze(dicts))
    else:
        reg, exprs = _feature_stage_exprs(freeze(suffix_rules), freeze(dicts))
        staged = staged.withColumn("_reg", reg)
    out = staged.withColumns(
        {
            **exprs,
            "normalized_url": F.col("_u"),
            "hostname": F.col("_host"),
            "registered_domain": F.col("_reg"),
        }
    )
    if not keep_internal:
        out = out.drop("_u", "_netloc", "_host", "_path", "_query", "_scheme", "_reg")
    return out


def url_features(df: DataFrame, url_col: str = "url", **kw) -> DataFrame:
    """Input key columns + the 28 features only."""
    return with_url_features(df, url_col, **kw)


def candidate_urls(df: DataFrame, url_col: str = "url") -> DataFrame:
    """One row per (url, rank, candidate): the URL with an explicit path,
    its ``http`` variant when it is https, and the ``www.`` toggled variant;
    duplicates removed, first occurrence kept."""
    s = F.regexp_replace(F.col(url_col), "[\t\r\n]", "")
    scheme = F.lower(F.regexp_extract(s, U.RFC3986, 1))
    netloc = F.regexp_extract(s, U.RFC3986, 2)
    path = F.regexp_extract(s, U.RFC3986, 3)
    query = F.regexp_extract(s, U.RFC3986, 4)
    frag = F.regexp_extract(s, U.RFC3986, 5)
    path = F.when(path == "", F.lit("/")).otherwise(path)
    tail = F.concat(
        path,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
        F.when(frag != "", F.concat(F.lit("#"), frag)).otherwise(F.lit("")),
    )

    def build(sch, net):
        return F.concat(F.when(sch != "", F.concat(sch, F.lit(":"))).otherwise(F.lit("")), F.lit("//"), net, tail)

    other_net = F.when(netloc.startswith("www."), F.substring(netloc, 5, 1 << 30)).otherwise(
        F.concat(F.lit("www."), netloc)
    )
    cands = F.array(
        build(scheme, netloc),
        F.when(scheme == "https", build(F.lit("http"), netloc)),
        build(scheme, other_net),
    )
    cands = F.array_distinct(F.filter(cands, lambda x: x.isNotNull()))
    cands = F.when(netloc == "", F.array(F.col(url_col))).otherwise(cands)
    return df.select("*", F.posexplode(cands).alias("rank", "candidate")).withColumn(
        "rank", (F.col("rank") + 1).cast("int")
    )


def url_mutations(
    df: DataFrame,
    url_col: str = "url",
    keyword: str | Column = "verify-account",
) -> DataFrame:
    """Four probe variants per URL (variant, label, mutated_url).

    1 the URL as serialised by a browser URL parser; 2 ``origin/<kw>/login``;
    3 ``scheme//secure-<kw>.<host><path>`` (userinfo, port, query dropped);
    4 ``origin<path>?<kw>=true&session=778899``.  Blank URL ->
    ``https://www.example.com/login``; blank keyword -> ``verify-account``;
    white space runs in the keyword -> ``-``; a URL not starting with
    ``http`` gets ``https://``; an unparsable one falls back to the default.
    """
    kw = F.lit(keyword) if isinstance(keyword, str) else keyword
    kw = U.py_strip(F.coalesce(kw, F.lit("")))
    kw = F.when(kw == "", F.lit("verify-account")).otherwise(kw)
    kw = F.regexp_replace(kw, U.WS_CLASS + "+", "-")
    raw = U.py_strip(F.coalesce(F.col(url_col), F.lit("")))
    raw = F.when(raw == "", F.lit("https://www.example.com/login")).otherwise(raw)
    base = F.when(raw.startswith("http"), raw).otherwise(F.concat(F.lit("https://"), raw))
    m = r"^([A-Za-z][A-Za-z0-9+.-]*:)//([^/?#@]*@)?([^/?#:@]+)(:[0-9]*)?([^?#]*)(\?[^#]*)?(#.*)?$"
    # Stage 1: keyword and base URL; stage 2: parts; stage 3: variants.  The
    # stages keep each regex evaluated once per row and the generated code small.
    staged = df.withColumns({"_kw": kw, "_base": base}).withColumn(
        "_base", F.when(F.col("_base").rlike(m), F.col("_base")).otherwise(F.lit("https://www.example.com/login"))
    )
    b = F.col("_base")
    enc = lambda c: F.replace(c, F.lit(" "), F.lit("%20"))
    staged = staged.withColumns(
        {
            "_proto": F.lower(F.regexp_extract(b, m, 1)),
            "_user": F.regexp_extract(b, m, 2),
            "_host": F.lower(F.regexp_extract(b, m, 3)),
            "_port": F.regexp_extract(b, m, 4),
            "_path": enc(F.regexp_extract(b, m, 5)),
            "_search": enc(F.regexp_extract(b, m, 6)),
            "_frag": enc(F.regexp_extract(b, m, 7)),
        }
    )
    proto, host, port = F.col("_proto"), F.col("_host"), F.col("_port")
    default_port = ((proto == "https:") & (port == ":443")) | ((proto == "http:") & (port == ":80"))
    staged = staged.withColumns(
        {
            "_port": F.when(default_port | (port == ":"), F.lit("")).otherwise(port),
            "_path": F.when(F.col("_path") == "", F.lit("/")).otherwise(F.col("_path")),
            "_search": F.when(F.col("_search") == "?", F.lit("")).otherwise(F.col("_search")),
            "_frag": F.when(F.col("_frag") == "#", F.lit("")).otherwise(F.col("_frag")),
        }
    )
    kw, user, port, path = F.col("_kw"), F.col("_user"), F.col("_port"), F.col("_path")
    origin = F.concat(proto, F.lit("//"), host, port)
    variants = F.array(
        F.struct(
            F.lit("Base URL").alias("label"),
            F.concat(proto, F.lit("//"), user, host, port, path, F.col("_search"), F.col("_frag")).alias("mutated_url"),
        ),
        F.struct(
            F.lit("Keyword in path").alias("label"),
            F.concat(origin, F.lit("/"), kw, F.lit("/login")).alias("mutated_url"),
        ),
        F.struct(
            F.lit("Extra subdomain").alias("label"),
            F.concat(proto, F.lit("//secure-"), kw, F.lit("."), host, path).alias("mutated_url"),
        ),
        F.struct(
            F.lit("Query pressure").alias("label"),
            F.concat(origin, path, F.lit("?"), kw, F.lit("=true&session=778899")).alias("mutated_url"),
        ),
    )
    return staged.select("*", F.posexplode(variants).alias("_variant", "_m")).select(
        *df.columns,
        (F.col("_variant") + 1).cast("int").alias("variant"),
        F.col("_m.label").alias("label"),
        F.col("_m.mutated_url").alias("mutated_url"),
    )


