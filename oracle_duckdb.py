"""DuckDB SQL builders for the correctness oracle.

Each builder returns SQL text over the registered test views.  The SQL is an
independent formulation of the same rules (RE2 regexes, list lambdas,
``round_even``); only the fixed dictionaries are shared with the Spark code.
"""

from __future__ import annotations

from riskscope import dictionaries as D

# Code points that Python's str.isspace accepts (fixed values).
WS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                       0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def qlist(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def sql_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def url_part_sql(url: str, part: int) -> str:
    """Part of a URL by cutting at the first '#', '?', ':' and '//':
    1 scheme, 2 authority, 3 path, 4 query, 5 fragment."""
    before_hash = f"split_part({url}, '#', 1)"
    if part == 5:
        return f"substr({url}, length({before_hash}) + 2)"
    before_query = f"split_part({before_hash}, '?', 1)"
    if part == 4:
        return f"substr({before_hash}, length({before_query}) + 2)"
    segment = f"split_part({before_query}, '/', 1)"
    scheme = f"(CASE WHEN contains({segment}, ':') THEN split_part({segment}, ':', 1) ELSE '' END)"
    if part == 1:
        return scheme
    rest = f"(CASE WHEN {scheme} = '' THEN {before_query} ELSE substr({before_query}, length({scheme}) + 2) END)"
    authority = f"(CASE WHEN starts_with({rest}, '//') THEN split_part(substr({rest}, 3), '/', 1) ELSE '' END)"
    if part == 2:
        return authority
    return f"(CASE WHEN starts_with({rest}, '//') THEN substr({rest}, 3 + length({authority})) ELSE {rest} END)"


def v4_sql(host: str) -> str:
    """Four decimal numbers up to 255 without leading zeros."""
    good = "regexp_matches(o4, '^[0-9]{1,3}$') AND (o4 = '0' OR NOT starts_with(o4, '0')) AND TRY_CAST(o4 AS INTEGER) <= 255"
    return f"(len(string_split({host}, '.')) = 4 AND list_bool_and(list_transform(string_split({host}, '.'), lambda o4: {good})))"


def v6_sql(host: str) -> str:
    """Eight groups, or fewer around one '::'; a dotted quad at the end is two."""
    groups = f"list_filter(string_split({host}, ':'), lambda g6: g6 <> '')"
    last = f"coalesce({groups}[-1], '')"
    quad = f"({v4_sql(last)} AND ends_with({host}, {last}))"
    head = f"(CASE WHEN {quad} THEN list_slice({groups}, 1, len({groups}) - 1) ELSE {groups} END)"
    n = f"(len({groups}) + CASE WHEN {quad} THEN 1 ELSE 0 END)"
    return (
        f"(contains({host}, ':') AND NOT contains({host}, ':::') AND len(string_split({host}, '::')) <= 2 "
        f"AND NOT regexp_matches({host}, '^:([^:]|$)|[^:]:$') "
        f"AND (CASE WHEN contains({host}, '::') THEN {n} <= 7 ELSE {n} = 8 END) "
        f"AND len(list_filter({head}, lambda h6: NOT regexp_matches(h6, '^[0-9a-f]{{1,4}}$'))) = 0)"
    )


def normalize_sql(col: str) -> str:
    t = f"coalesce(trim({col}, {q(WS)}), '')"
    return (
        f"(CASE WHEN {t} = '' THEN '' "
        f"WHEN starts_with({t}, 'http://') OR starts_with({t}, 'https://') THEN {t} "
        f"ELSE 'https://' || {t} END)"
    )


def suffix_len_sql(host: str, rules=D.BUILTIN_SUFFIXES) -> str:
    exact = [s for s, k in rules if k == "exact"]
    wild = [s for s, k in rules if k == "wildcard"]
    exc = [s for s, k in rules if k == "exception"]
    labels = f"string_split({host}, '.')"
    n = f"len({labels})"

    def cand(k):
        return f"array_to_string(list_slice({labels}, {k}, {n}), '.')"

    in_exact = f"{cand('k')} IN {qlist(exact)}" if exact else "false"
    in_wild = f"(k < {n} AND {cand('k + 1')} IN {qlist(wild)})" if wild else "false"
    not_exc = f"{cand('k')} NOT IN {qlist(exc)}" if exc else "true"
    normal = (
        f"list_max(list_transform(range(1, {n} + 1), lambda k: "
        f"CASE WHEN {in_exact} OR ({in_wild} AND {not_exc}) THEN {n} - k + 1 ELSE 0 END))"
    )
    if exc:
        exception = (
            f"list_max(list_transform(range(1, {n} + 1), lambda k: "
            f"CASE WHEN {cand('k')} IN {qlist(exc)} THEN {n} - k ELSE 0 END))"
        )
        normal = f"(CASE WHEN {exception} > 0 THEN {exception} ELSE {normal} END)"
    return f"(CASE WHEN {host} = '' THEN 0 ELSE coalesce({normal}, 0) END)"


def registered_sql(host: str, k: str) -> str:
    labels = f"string_split({host}, '.')"
    n = f"len({labels})"
    return (
        f"(CASE WHEN {k} > 0 AND {n} > {k} "
        f"THEN array_to_string(list_slice({labels}, {n} - {k}, {n}), '.') ELSE {host} END)"
    )


def url_parts_ctes(source: str, url_col: str = "url", keys: str = "*") -> str:
    """CTEs p0..p3 over ``source`` producing u, scheme, netloc, path_l, query,
    host, url_valid, reg (registered domain)."""
    bracketed = "lower(regexp_extract(hostinfo, '\\[([^\\]]*)', 1))"
    return f"""
p0 AS (SELECT {keys}, {normalize_sql(url_col)} AS u FROM {source}),
p1 AS (SELECT *, regexp_replace(u, '[\\t\\r\\n]', '', 'g') AS s_ FROM p0),
p2 AS (SELECT *, lower({url_part_sql('s_', 1)}) AS scheme,
              {url_part_sql('s_', 2)} AS netloc,
              regexp_replace({url_part_sql('s_', 3)}, ';[^/]*$', '') AS path_raw,
              {url_part_sql('s_', 4)} AS query FROM p1),
p3 AS (SELECT *, regexp_extract(netloc, '([^@]*)$', 1) AS hostinfo FROM p2),
p4 AS (SELECT *, lower(CASE WHEN contains(hostinfo, '[') THEN regexp_extract(hostinfo, '\\[([^\\]]*)', 1)
                           ELSE regexp_extract(hostinfo, '^([^:]*)', 1) END) AS host,
              lower(path_raw) AS path_l,
              (contains(netloc, '[') = contains(netloc, ']')) AND
              (NOT contains(hostinfo, '[') OR (regexp_matches(hostinfo, '^\\[[^\\]]*\\](:.*)?$') AND {v6_sql(bracketed)})) AS url_valid
       FROM p3),
p5 AS (SELECT *, {suffix_len_sql('host')} AS sfx_k FROM p4),
p6 AS (SELECT *, {registered_sql('host', 'sfx_k')} AS reg FROM p5)"""


def url_feature_select_sql() -> str:
    """Select list (28 features) over columns u, host, path_l, query, scheme, reg."""
    hp = "(host || path_l)"
    brand = "regexp_matches(" + hp + ", " + q("|".join(D.BRAND_KEYWORDS)) + ")"
    free = (
        "regexp_matches(regexp_replace(host, '^\\.+|\\.+$', '', 'g'), "
        + q("(^|\\.)(" + "|".join(d.replace(".", "\\.") for d in D.FREE_HOSTING_DOMAINS) + ")$")
        + ")"
    )
    official = " OR ".join(
        f"(contains({hp}, {q(b)}) AND reg IN {qlist(ds)})" for b, ds in D.OFFICIAL_BRAND_DOMAINS.items()
    )
    is_ip = f"({v4_sql('host')} OR {v6_sql('host')})"
    labels = "list_filter(string_split(host, '.'), lambda x: x <> '')"
    n = f"len({labels})"
    cnt = lambda ch: f"(length(u) - length(replace(u, {q(ch)}, '')))"
    sw = " + ".join(f"contains(lower(u), {q(w)})::INTEGER" for w in D.SUSPICIOUS_WORDS)
    digits_h = "length(regexp_replace(host, '[^\\p{Nd}]', '', 'g'))"
    letters_h = "length(regexp_replace(host, '[^\\p{L}]', '', 'g'))"
    cols = {
        "url_length": "length(u)",
        "num_dots": cnt("."),
        "num_hyphen": cnt("-"),
        "num_slashes": cnt("/"),
        "https": "(scheme = 'https')",
        "subdomains": (
            f"(CASE WHEN host = '' OR {is_ip} THEN 0 WHEN {n} <= 2 THEN 0 "
            f"WHEN length({labels}[-1]) = 2 AND {labels}[-2] IN {qlist(D.COMMON_SECOND_LEVEL)} "
            f"THEN greatest({n} - 3, 0) ELSE greatest({n} - 2, 0) END)"
        ),
        "has_at_symbol": "contains(u, '@')",
        "has_double_slash": "contains(path_l, '//')",
        "has_ip": is_ip,
        "num_underscores": cnt("_"),
        "num_percent": cnt("%"),
        "num_digits": "length(regexp_replace(u, '[^\\p{Nd}]', '', 'g'))",
        "num_query_params": (
            "len(list_distinct(list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''), "
            "lambda x: url_decode(replace(split_part(x, '=', 1), '+', ' ')))))"
        ),
        "has_query": "(query <> '')",
        "path_depth": "len(list_filter(string_split(path_l, '/'), lambda x: x <> ''))",
        "suspicious_tld": (
            f"(contains(host, '.') AND ('.' || string_split(host, '.')[-1]) IN {qlist(D.SUSPICIOUS_TLDS)})"
        ),
        "brand_in_url": brand,
        "is_shortened": f"(host IN {qlist(D.SHORTENING_SERVICES)})",
        "suspicious_word_count": f"({sw})",
        "url_entropy": "(CASE WHEN length(u) = 0 THEN 0.0 ELSE round_even(list_aggregate(string_split(u, ''), 'entropy'), 4) END)",
        "hostname_length": "length(host)",
        "digit_letter_ratio": (
            f"(CASE WHEN host = '' THEN 0.0 WHEN {letters_h} = 0 THEN (CASE WHEN {digits_h} > 0 THEN 1.0 ELSE 0.0 END) "
            f"ELSE round_even({digits_h} / {letters_h}, 4) END)"
        ),
        "num_special_chars": "(length(u) - length(translate(u, '~={}|^`', '')))",
        "tld_in_path": "regexp_matches(path_l, " + q("(?i)\\.(" + "|".join(D.PATH_TLDS) + ")(?:/|\\z)") + ")",
        "longest_digit_run": "coalesce(list_max(list_transform(regexp_extract_all(host, '\\p{Nd}+'), lambda x: length(x))), 0)",
        "uses_free_hosting": free,
        "brand_on_free_hosting": f"({brand} AND {free})",
        "brand_domain_mismatch": f"({brand} AND NOT ({official}))",
    }
    out = []
    for name, expr in cols.items():
        typ = "DOUBLE" if name in ("url_entropy", "digit_letter_ratio") else "INTEGER"
        out.append(f"CAST({expr} AS {typ}) AS {name}")
    return ",\n       ".join(out)


# --------------------------------------------------------------------------
# Oracle queries
# --------------------------------------------------------------------------

ORACLE: dict[str, str] = {}

URL_FEATURE_NAMES = (
    "url_length", "num_dots", "num_hyphen", "num_slashes", "https", "subdomains",
    "has_at_symbol", "has_double_slash", "has_ip", "num_underscores", "num_percent",
    "num_digits", "num_query_params", "has_query", "path_depth", "suspicious_tld",
    "brand_in_url", "is_shortened", "suspicious_word_count", "url_entropy",
    "hostname_length", "digit_letter_ratio", "num_special_chars", "tld_in_path",
    "longest_digit_run", "uses_free_hosting", "brand_on_free_hosting", "brand_domain_mismatch",
)


def url_features_sql(source: str, url_col: str, keys: list[str], extra: str = "") -> str:
    """Full SQL: keys + registered_domain + 28 features over ``source``."""
    keys_sql = ", ".join(keys)
    return f"""WITH {url_parts_ctes(source, url_col, keys_sql + (', ' + url_col if url_col not in keys else ''))}
SELECT {keys_sql}, reg AS registered_domain{extra},
       {url_feature_select_sql()}
FROM p6"""


ORACLE["url_features"] = url_features_sql("pages", "url", ["page_id", "url"])


ORACLE["url_features_probes"] = url_features_sql(
    """(SELECT page_id, unnest(['credentials', 'IPv4', 'IPv6', 'suffix', 'escapes', 'short', 'hosted brand', 'hosted', 'official']) AS probe,
        unnest(['https://user@h' || page_id || '.example.com/a//b#f',
                'http://' || (page_id % 223 + 1) || '.' || (page_id % 256) || '.' || (page_id * 7 % 256) || '.9:8080/login',
                'http://[2001:db8::' || lower(to_hex(page_id % 65536)) || ']/x',
                'https://secure-login' || page_id || '.xyz/verify?a%20b=1&a+b=2&c=' || page_id,
                'https://h' || page_id || '.example.org/?a%zz%41=1&a%zzA=2&a%ZZA=3&%e4%b8%ad=4&b%=5&b%25=6&c%4=7',
                'https://bit.ly/' || page_id,
                'https://paypal-' || page_id || '.weebly.com/x.com/signin',
                'https://u' || page_id || '.github.io/a_b/index~' || page_id || '.html',
                'https://www.paypal.com/' || page_id || '/caf%C3%A9']) AS url FROM pages)""",
    "url", ["page_id", "probe", "url"])


BUILTIN_RULES_SQL = ", ".join(f"({q(r)}, {q(k)})" for r, k in D.BUILTIN_SUFFIXES)


def suffix_match_sql() -> str:
    """Rule table and hosts made of the orders; every suffix of a host is
    joined to the rules, and the longest match kept."""
    labels, n = "string_split(host, '.')", "len(string_split(host, '.'))"
    nz = f"list_filter({labels}, lambda x: x <> '')"
    return f"""WITH {url_parts_ctes('pages', 'url', 'page_id, url')},
o AS (SELECT o_orderkey AS k, o_custkey AS c, 'z' || o_orderkey || '.' || ['com', 'de', 'co.uk', 'jp'][(o_orderkey % 4 + 1)::int] AS suffix FROM orders),
rules AS (SELECT DISTINCT * FROM (SELECT suffix, CASE WHEN k % 3 = 0 THEN 'exact' ELSE 'wildcard' END AS kind FROM o
          UNION ALL SELECT 'city.' || suffix, 'exception' FROM o WHERE k % 3 = 2 UNION ALL (VALUES {BUILTIN_RULES_SQL}))),
hosts AS (SELECT 'order' AS of, k::bigint AS id, CASE WHEN c % 5 = 0 THEN suffix WHEN c % 7 = 0 THEN 'x.' || suffix
                 ELSE 'a' || c || '.b.' || CASE WHEN c % 3 = 0 THEN 'city.' ELSE '' END || suffix END AS host FROM o
          UNION ALL SELECT 'page', page_id, host FROM p6),
cand AS (SELECT of, id, {n} AS n, j, array_to_string({labels}[{n} - j + 1:], '.') AS suffix FROM (SELECT *, unnest(range(1, {n} + 1)) AS j FROM hosts)),
hit AS (SELECT of, id, max(CASE WHEN kind = 'exception' THEN j - 1 END) AS e, max(CASE WHEN kind = 'exact' THEN j WHEN kind = 'wildcard' AND n > j THEN j + 1 END) AS r
        FROM cand JOIN rules USING (suffix) GROUP BY of, id),
m AS (SELECT of, id, host, CASE WHEN host = '' THEN 0 WHEN e > 0 THEN e ELSE coalesce(r, 0) END AS l FROM hosts LEFT JOIN hit USING (of, id))
SELECT of, id, host, l::bigint AS suffix_labels, CASE WHEN l > 0 AND {n} > l THEN array_to_string({labels}[{n} - l:], '.') ELSE host END AS registered_domain,
       CASE WHEN l > 0 AND {n} > l THEN array_to_string({labels}[{n} - l:], '.')
            WHEN len({nz}) >= 3 AND length({nz}[-1]) = 2 AND {nz}[-2] IN {qlist(D.COMMON_SECOND_LEVEL)} THEN array_to_string({nz}[-3:], '.')
            WHEN len({nz}) >= 2 THEN array_to_string({nz}[-2:], '.') ELSE host END AS lookup_domain
FROM m"""


ORACLE["public_suffix_match"] = suffix_match_sql()


def mutations_sql(source: str, url_col: str, keys: str, keyword: str) -> str:
    """U30 in SQL: returns ``keys, variant, label, mutated_url``."""
    strip = lambda c: f"trim({c}, {q(WS)})"
    m = r"^([A-Za-z][A-Za-z0-9+.-]*:)//([^/?#@]*@)?([^/?#:@]+)(:[0-9]*)?([^?#]*)(\?[^#]*)?(#.*)?$"
    kw0 = strip(q(keyword))
    kw = f"regexp_replace(CASE WHEN {kw0} = '' THEN 'verify-account' ELSE {kw0} END, {q('[' + WS + ']+')}, '-', 'g')"
    raw = strip(f"coalesce({url_col}, '')")
    return f"""m0 AS (SELECT {keys}, {kw} AS kw,
        CASE WHEN {raw} = '' THEN 'https://www.example.com/login' ELSE {raw} END AS raw FROM {source}),
m1 AS (SELECT *, CASE WHEN starts_with(raw, 'http') THEN raw ELSE 'https://' || raw END AS b0 FROM m0),
m2 AS (SELECT *, CASE WHEN regexp_matches(b0, {q(m)}) THEN b0 ELSE 'https://www.example.com/login' END AS b FROM m1),
m3 AS (SELECT *, lower(regexp_extract(b, {q(m)}, 1)) AS proto, regexp_extract(b, {q(m)}, 2) AS usr,
        lower(regexp_extract(b, {q(m)}, 3)) AS mhost, regexp_extract(b, {q(m)}, 4) AS port0,
        replace(regexp_extract(b, {q(m)}, 5), ' ', '%20') AS path0,
        replace(regexp_extract(b, {q(m)}, 6), ' ', '%20') AS search0,
        replace(regexp_extract(b, {q(m)}, 7), ' ', '%20') AS frag0 FROM m2),
m4 AS (SELECT *,
        CASE WHEN (proto = 'https:' AND port0 = ':443') OR (proto = 'http:' AND port0 = ':80') OR port0 = ':' THEN '' ELSE port0 END AS mport,
        CASE WHEN path0 = '' THEN '/' ELSE path0 END AS mpath,
        CASE WHEN search0 = '?' THEN '' ELSE search0 END AS msearch,
        CASE WHEN frag0 = '#' THEN '' ELSE frag0 END AS mfrag FROM m3),
m5 AS (
  SELECT {keys}, 1 AS variant, 'Base URL' AS label, proto || '//' || usr || mhost || mport || mpath || msearch || mfrag AS mutated_url FROM m4
  UNION ALL SELECT {keys}, 2, 'Keyword in path', proto || '//' || mhost || mport || '/' || kw || '/login' FROM m4
  UNION ALL SELECT {keys}, 3, 'Extra subdomain', proto || '//secure-' || kw || '.' || mhost || mpath FROM m4
  UNION ALL SELECT {keys}, 4, 'Query pressure', proto || '//' || mhost || mport || mpath || '?' || kw || '=true&session=778899' FROM m4)"""


ORACLE["url_features_mutated"] = f"""WITH {mutations_sql('pages', 'url', 'page_id', 'paypal secure login')},
{url_parts_ctes('m5', 'mutated_url', 'page_id, CAST(variant AS INTEGER) AS variant, label, mutated_url')}
SELECT page_id, variant, label, mutated_url, reg AS registered_domain,
       {url_feature_select_sql()}
FROM p6"""


# --------------------------------------------------------------- pages, text
# The references the test pages have, the ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&euro;", "€"), ("&amp;", "&"))
TAG_RE = r"<(?:/?[A-Za-z]|[!?])[^>]*>"
COMMENT_RE = r"(?s)<!--.*?-->"


def strip_ws_sql(x: str) -> str:
    return f"trim({x}, {q(WS)})"


def collapse_sql(x: str) -> str:
    return strip_ws_sql(f"regexp_replace({x}, {q('[' + WS + ']+')}, ' ', 'g')")


def decode_sql(x: str) -> str:
    out = x
    for ent, ch in ENTITIES:
        out = f"replace({out}, {q(ent)}, {q(ch)})"
    return out


def clean_html_sql(html: str) -> str:
    out = f"coalesce({html}, '')"
    for t in D.DROPPED_TAGS:
        out = f"regexp_replace({out}, {q('(?is)<' + t + '\\b(?:[^>]*?/>|[^>]*>.*?</' + t + '\\s*>)')}, ' ', 'g')"
    return f"regexp_replace({out}, {q(COMMENT_RE)}, ' ', 'g')"


def page_ctes(source: str, keys: str, html: str = "html") -> str:
    """CTEs h0..h2 -> keys, title, meta_description, text, text_length,
    low_content, link_count, has_form, has_iframe (and h2.clean)."""
    title_raw = "regexp_extract(clean, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1)"
    meta_tag = (
        "regexp_extract(clean, "
        + q("(?is)(<meta\\b[^>]*?\\sname\\s*=\\s*(?:\"description\"|'description'|description\\b)[^>]*>)")
        + ", 1)"
    )
    prop_tag = (
        "regexp_extract(clean, "
        + q("(?s)(<meta\\b[^>]*?\\s(?i:property)\\s*=\\s*(?:\"og:description\"|'og:description'|og:description\\b)[^>]*>)")
        + ", 1)"
    )
    cpat = q("(?is)\\scontent\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)'|([^\\s\"'>]+))")
    content = (
        f"regexp_extract(mtag, {cpat}, 1) || regexp_extract(mtag, {cpat}, 2) || regexp_extract(mtag, {cpat}, 3)"
    )
    body = (
        "CASE WHEN regexp_matches(clean, '(?i)<body\\b') THEN "
        "regexp_extract(clean, '(?is)<body\\b[^>]*>(.*?)(?:</body\\s*>|\\z)', 1) ELSE clean END"
    )
    return f"""h0 AS (SELECT {keys}, {html} AS raw_html, {clean_html_sql(html)} AS clean FROM {source}),
h1 AS (SELECT *, CASE WHEN {meta_tag} <> '' THEN {meta_tag} ELSE {prop_tag} END AS mtag FROM h0),
h2 AS (SELECT * EXCLUDE (mtag),
   CASE WHEN contains({title_raw}, '<') THEN '' ELSE {collapse_sql(decode_sql(title_raw))} END AS title,
   CASE WHEN mtag = '' THEN '' ELSE {collapse_sql(decode_sql(content))} END AS meta_description,
   {collapse_sql(decode_sql(f"regexp_replace({body}, {q(TAG_RE)}, ' ', 'g')"))} AS text,
   CAST(len(regexp_extract_all(clean, {q('(?i)<a\\s(?:[^>]*\\s)?href(?:\\s*=|[\\s/>])')})) AS INTEGER) AS link_count,
   CAST(regexp_matches(coalesce(raw_html, ''), '(?i)<form\\b') AS INTEGER) AS has_form,
   CAST(regexp_matches(coalesce(raw_html, ''), '(?i)<iframe\\b') AS INTEGER) AS has_iframe
   FROM h1)"""


ORACLE["page_extract"] = f"""WITH {page_ctes('pages', 'page_id')}
SELECT page_id, title, meta_description, text, CAST(length(text) AS INTEGER) AS text_length,
       CAST(length(text) < {D.LOW_CONTENT_CHARS} AS INTEGER) AS low_content, link_count, has_form, has_iframe
FROM h2"""


#: What a tolerant HTML parser leaves of the probe pages, written by hand.
PROBE_TEXTS = {
    "nested": "end @", "three deep": "out @ side", "unclosed": "a @", "quoted": "c @", "stray quote": "hm @ 'q'", "references": "x @ \u2713 &lt; \u00bd \u2713 &nosuch;",
    "crossed": "b @ c", "script": "ok @ z q", "other names": "k @", "links": "l @ m", "long": " ".join(["word @ and more"] * 60), "empty": "",
}
ORACLE["page_extract_probes"] = f"""WITH v AS (SELECT page_id, probe, replace(body, '@', page_id::varchar) AS text FROM pages, (VALUES {', '.join(f'({q(k)}, {q(v)})' for k, v in PROBE_TEXTS.items())}) t(probe, body))
SELECT page_id, probe, 'T ' || page_id AS title, CASE page_id % 3 WHEN 0 THEN 'D & ' || page_id WHEN 1 THEN 'og ' || page_id ELSE '' END AS meta_description, text,
       length(text)::int AS text_length, (length(text) < {D.LOW_CONTENT_CHARS})::int AS low_content, (probe = 'links')::int AS link_count, (probe = 'links')::int AS has_form, (probe = 'links')::int AS has_iframe
FROM v"""


def content_ctes(source: str, keys: str, title: str, text: str, keywords=D.SCAM_KEYWORDS, weight: int = D.TITLE_WEIGHT) -> str:
    """CTEs c0..c2 -> keys + the content features (except has_form/has_iframe)."""
    punct = D.ASCII_PUNCTUATION
    ttl = strip_ws_sql(f"coalesce({title}, '')")
    txt = strip_ws_sql(f"coalesce({text}, '')")
    weighted = strip_ws_sql(f"repeat({ttl} || ' ', {max(weight, 1)}) || {txt}")
    norm = collapse_sql(f"translate(lower({weighted}), {q(punct)}, {q(' ' * len(punct))})")
    singles = [k for k in dict.fromkeys(keywords) if " " not in k]
    phrases = [k for k in dict.fromkeys(keywords) if " " in k]
    hits = []
    if singles:
        hits.append(f"len(list_filter(tok, lambda x: x IN {qlist(singles)}))")
    for ph in phrases:
        pp = " " + ph.replace(" ", "  ") + " "
        hits.append(f"((length(padded) - length(replace(padded, {q(pp)}, ''))) // {len(pp)})")
    hits_sql = " + ".join(hits) if hits else "0"
    return f"""c0 AS (SELECT {keys}, {txt} AS txt, {norm} AS norm FROM {source}),
c1 AS (SELECT *, list_filter(string_split(norm, ' '), lambda x: x <> '' AND x NOT IN {qlist(D.ENGLISH_STOP_WORDS)}) AS tok,
              ' ' || replace(norm, ' ', '  ') || ' ' AS padded FROM c0),
c2 AS (SELECT *, CAST({hits_sql} AS INTEGER) AS hits, len(tok) AS ntok,
              length(regexp_replace(txt, '[^\\p{{L}}]', '', 'g')) AS letters,
              length(regexp_replace(txt, '[^\\p{{Lu}}]', '', 'g')) AS uppers FROM c1)"""


CONTENT_SELECT = f"""CAST(least(length(txt), {D.MAX_TEXT_LENGTH_FEATURE}) AS INTEGER) AS text_length,
       CAST(least(ntok, {D.MAX_TOKEN_COUNT_FEATURE}) AS INTEGER) AS token_count,
       hits AS scam_keyword_count,
       CAST(CASE WHEN ntok = 0 THEN 0.0 ELSE round_even(hits / ntok, 6) END AS DOUBLE) AS scam_keyword_density,
       CAST(least(length(txt) - length(replace(txt, '!', '')), {D.MAX_EXCLAMATION_FEATURE}) AS INTEGER) AS exclamation_count,
       CAST(CASE WHEN letters = 0 THEN 0.0 ELSE round_even(uppers / letters, 4) END AS DOUBLE) AS caps_ratio,
       CAST(CASE WHEN ntok = 0 THEN 0.0 ELSE round_even(length(array_to_string(tok, '')) / ntok, 3) END AS DOUBLE) AS avg_word_length"""

ORACLE["content_features_documents"] = f"""WITH {content_ctes('documents', 'doc_id', 'NULL', 'text')}
SELECT doc_id, {CONTENT_SELECT}, 0 AS has_form, 0 AS has_iframe FROM c2"""

TEST_KEYWORDS = ("ouen", "ment", "the", "ing", "thnt", "of the", "en la", "is the", "und die", "and the")

ORACLE["content_features_keywords"] = f"""WITH {content_ctes('documents', 'doc_id', 'NULL', 'text', TEST_KEYWORDS)}
SELECT doc_id, CAST(least(ntok, {D.MAX_TOKEN_COUNT_FEATURE}) AS INTEGER) AS token_count,
       hits AS scam_keyword_count,
       CAST(CASE WHEN ntok = 0 THEN 0.0 ELSE round_even(hits / ntok, 6) END AS DOUBLE) AS scam_keyword_density,
       CAST(CASE WHEN ntok = 0 THEN 0.0 ELSE round_even(length(array_to_string(tok, '')) / ntok, 3) END AS DOUBLE) AS avg_word_length
FROM c2"""

ORACLE["content_features_pages"] = f"""WITH {page_ctes('pages', 'page_id')},
{content_ctes('h2', 'page_id, has_form, has_iframe', 'title', 'text', TEST_KEYWORDS)}
SELECT page_id, {CONTENT_SELECT}, has_form, has_iframe FROM c2"""


# ------------------------------------------------------------ flagship score
from riskscope.operators.scoring import (  # noqa: E402
    BANDS, FAMILIES, FAMILY_COLUMNS, LOW_BAND, NOTE_BRAND, NOTE_DEFAULT, NOTE_LIMITED, NOTE_TEXT,
)


def family_sql() -> str:
    parts = []
    for (_label, _d, terms), name in zip(FAMILIES, FAMILY_COLUMNS):
        total = "0.0"
        for feat, div, w in terms:
            total = f"({total} + coalesce(CAST({feat} AS DOUBLE), 0.0) / {float(div)!r} * {w!r})"
        parts.append(f"round_even(greatest(0.0, least({total}, 1.0)), 3) AS {name}")
    return ",\n       ".join(parts)


def band_sql(p: str) -> tuple[str, str]:
    lab = "CASE " + " ".join(f"WHEN {p} >= {t} THEN {q(l)}" for t, l, _ in BANDS) + f" ELSE {q(LOW_BAND[0])} END"
    tone = "CASE " + " ".join(f"WHEN {p} >= {t} THEN {q(tn)}" for t, _, tn in BANDS) + f" ELSE {q(LOW_BAND[1])} END"
    return lab, tone


def drivers_sql() -> list[str]:
    n = len(FAMILY_COLUMNS)
    ranks = []
    for i, ci in enumerate(FAMILY_COLUMNS):
        terms = []
        for j, cj in enumerate(FAMILY_COLUMNS):
            if j == i:
                continue
            cond = f"{cj} > {ci}" if j > i else f"{cj} >= {ci}"
            terms.append(f"CAST({cond} AS INTEGER)")
        ranks.append("(" + " + ".join(terms) + ")")
    out = []
    for r in range(3):
        whens = " ".join(f"WHEN {ranks[i]} = {r} THEN {q(FAMILIES[i][0])}" for i in range(n))
        out.append(f"CASE {whens} END AS driver_{r + 1}")
    return out


def flagship_sql(source: str = "pages") -> str:
    lab, tone = band_sql("scam_probability")
    notes = (
        f"concat_ws(' | ', CASE WHEN coalesce(status, '') <> 'success' THEN {q(NOTE_LIMITED)} END, "
        f"CASE WHEN text_length > 0 THEN {q(NOTE_TEXT)} END, "
        f"CASE WHEN brand_domain_mismatch <> 0 THEN {q(NOTE_BRAND)} END)"
    )
    signals = (
        "concat_ws(', ', CASE WHEN suspicious_word_count > 0 THEN 'Suspicious words' END, "
        "CASE WHEN scam_keyword_count > 0 THEN 'Scam keywords' END, "
        "CASE WHEN suspicious_tld <> 0 THEN 'Suspicious TLD' END, "
        "CASE WHEN url_length >= 80 THEN 'URL length' END, "
        "CASE WHEN text_length > 0 THEN 'Page text' END, "
        "CASE WHEN status = 'success' THEN 'Scrape status' END)"
    )
    return f"""WITH {page_ctes(source, 'page_id, url')},
{content_ctes('h2', 'page_id, title, has_form, has_iframe', 'title', 'text')},
cf AS (SELECT page_id, title, {CONTENT_SELECT} FROM c2),
{url_parts_ctes(source, 'url', 'page_id, url')},
uf AS (SELECT page_id, url, reg AS registered_domain, url_valid, {url_feature_select_sql()} FROM p6),
j AS (SELECT uf.*, cf.* EXCLUDE (page_id), 'success' AS status FROM uf JOIN cf USING (page_id)),
f AS (SELECT *, {family_sql()} FROM j),
s AS (SELECT *, round_even(({' + '.join(FAMILY_COLUMNS)}) / {len(FAMILY_COLUMNS)}, 4) AS p FROM f),
o AS (SELECT *, CASE WHEN url_valid THEN p ELSE 0.0 END AS scam_probability FROM s)
SELECT page_id, url, registered_domain, title, {', '.join(FAMILY_COLUMNS)},
       scam_probability,
       CASE WHEN NOT url_valid THEN 'ERROR' WHEN p >= 0.5 THEN 'SCAM' ELSE 'LEGIT' END AS prediction,
       CASE WHEN NOT url_valid THEN 0.0 WHEN p >= 0.5 THEN round_even(p, 4) ELSE round_even(1.0 - p, 4) END AS confidence,
       {lab} AS risk_label, {tone} AS risk_tone,
       {', '.join(drivers_sql())},
       CASE WHEN {notes} = '' THEN {q(NOTE_DEFAULT)} ELSE {notes} END AS notes,
       {signals} AS active_signals
FROM o"""


ORACLE["score_pages"] = flagship_sql()


# -------------------------------------------------------------------- domains
from riskscope.operators.domains import CREATION_PATTERNS, EXPIRY_PATTERNS, REGISTRAR_PATTERNS  # noqa: E402

AS_OF = "2026-01-01 00:00:00"
PY_DATE_FORMATS = (
    "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y/%m/%d %H:%M:%S", "%Y/%m/%d", "%Y-%m-%d", "%d-%b-%Y",
    "%d-%b-%Y %H:%M:%S", "%d.%m.%Y", "%d/%m/%Y", "%m/%d/%Y", "%b %d %Y",
)

SHOP_TLD = "['com', 'net', 'org', 'xyz', 'co.uk'][o_orderkey % 5 + 1]"


def whois_raw_sql() -> str:
    d = "o_orderdate"
    created = (
        f"CASE WHEN o_orderkey % 4 = 0 THEN strftime({d}, '%Y-%m-%dT%H:%M:%S') || 'Z' "
        f"WHEN o_orderkey % 4 = 1 THEN strftime({d}, '%d-%b-%Y') "
        f"WHEN o_orderkey % 4 = 2 THEN strftime({d}, '%Y-%m-%d %H:%M:%S') || ' UTC' "
        f"ELSE strftime({d}, '%d.%m.%Y') END"
    )
    exp = f"strftime(CAST({d} AS DATE) + INTERVAL 12 MONTH, '%Y-%m-%d')"
    lines = (
        f"[CASE WHEN o_orderkey % 5 <> 1 THEN (CASE WHEN o_orderkey % 2 = 0 THEN 'Creation Date: ' ELSE 'Registered On: ' END) || {created} END, "
        f"CASE WHEN o_orderkey % 5 <> 2 THEN 'Registry Expiry Date: ' || {exp} END, "
        f"CASE WHEN o_orderkey % 5 <> 3 THEN 'Registrar: R' || CAST(o_custkey AS VARCHAR) END, "
        f"CASE WHEN o_orderkey % 11 = 0 THEN 'Connecting to whois.example' END]"
    )
    return (
        f"SELECT 'shop' || CAST(o_custkey AS VARCHAR) || '.' || {SHOP_TLD} AS domain, "
        f"array_to_string(list_filter({lines}, lambda x: x IS NOT NULL), chr(10)) AS raw, o_orderkey AS ord FROM orders"
    )


def certs_sql() -> str:
    return f"""SELECT domain, arg_min(struct_pack(reachable := reachable, verified := verified, not_after := not_after), ord) AS c
FROM (SELECT 'shop' || CAST(o_custkey AS VARCHAR) || '.' || {SHOP_TLD} AS domain, o_orderkey AS ord,
             o_orderkey % 3 <> 0 AS reachable, o_orderkey % 3 = 1 AS verified,
             CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate + INTERVAL 400 DAY END AS not_after FROM orders)
GROUP BY domain"""


def first_match_sql(raw: str, patterns) -> str:
    vals = [f"nullif({strip_ws_sql(f'regexp_extract({raw}, {q(p)}, 1)')}, '')" for p in patterns]
    return "coalesce(" + ", ".join(vals) + ")"


def date_sql(x: str) -> str:
    s = strip_ws_sql(x)
    s = f"regexp_replace(regexp_replace({s}, '^\"+|\"+$', '', 'g'), '^''+|''+$', '', 'g')"
    s = strip_ws_sql(f"replace(replace({s}, '(UTC)', ''), ' UTC', '')")
    t = "(\\d{1,2}:\\d{1,2}:\\d{1,2})"
    s = f"regexp_replace({s}, {q(t + '\\.\\d+')}, '\\1')"
    s = f"regexp_replace({s}, {q(t + '\\s+[A-Z]{2,5}$')}, '\\1')"
    s = f"regexp_replace({s}, {q(t + '\\s*[+-]\\d{2}:?\\d{2}$')}, '\\1')"
    s = f"regexp_replace({s}, {q(t + '\\.\\d+')}, '\\1')"
    s = strip_ws_sql(f"regexp_replace({s}, 'Z+$', '')")
    return "coalesce(" + ", ".join(f"try_strptime({s}, {q(f)})" for f in PY_DATE_FORMATS) + ")"


def days_sql(later: str, earlier: str) -> str:
    return f"CAST(floor((epoch({later}) - epoch({earlier})) / 86400) AS INTEGER)"


def whois_parsed_sql() -> str:
    usable = "(trim(raw) <> '' AND NOT (contains(raw, 'Connecting to') AND NOT contains(raw, 'Registrar:')))"
    now = f"TIMESTAMP '{AS_OF}'"
    return f"""w0 AS ({whois_raw_sql()}),
w1 AS (SELECT domain, ord,
   CASE WHEN {usable} THEN {date_sql(first_match_sql('raw', CREATION_PATTERNS))} END AS c_,
   CASE WHEN {usable} THEN {date_sql(first_match_sql('raw', EXPIRY_PATTERNS))} END AS e_,
   CASE WHEN {usable} THEN substr({first_match_sql('raw', REGISTRAR_PATTERNS)}, 1, 255) END AS r_ FROM w0),
w2 AS (SELECT domain, ord,
   CASE WHEN c_ IS NULL THEN -1 ELSE greatest({days_sql(now, 'c_')}, 0) END AS domain_age_days,
   coalesce({days_sql('e_', now)}, -1) AS domain_expiry_days,
   coalesce(r_, '') AS registrar,
   CASE WHEN c_ IS NOT NULL OR e_ IS NOT NULL OR r_ IS NOT NULL THEN 0 ELSE 1 END AS missing_whois FROM w1)"""


ORACLE["whois_parse"] = f"""WITH {whois_parsed_sql()}
SELECT domain, ord, CAST(domain_age_days AS INTEGER) AS domain_age_days,
       CAST(domain_expiry_days AS INTEGER) AS domain_expiry_days, registrar,
       CAST(missing_whois AS INTEGER) AS missing_whois FROM w2"""


def domain_table_sql() -> str:
    now = f"TIMESTAMP '{AS_OF}'"
    return f"""{whois_parsed_sql()},
w3 AS (SELECT domain, arg_min(struct_pack(a := domain_age_days, e := domain_expiry_days, r := registrar, m := missing_whois),
                              (missing_whois, ord)) AS w FROM w2 GROUP BY domain),
k0 AS ({certs_sql()}),
k1 AS (SELECT domain, CAST(c.reachable AS INTEGER) AS has_ssl, CAST(c.reachable AND c.verified AS INTEGER) AS ssl_valid,
              CASE WHEN c.reachable AND c.verified AND c.not_after IS NOT NULL THEN {days_sql('c.not_after', now)} ELSE -1 END AS ssl_days_remaining
       FROM k0),
dt AS (SELECT coalesce(w3.domain, k1.domain) AS domain,
              CAST(coalesce(w.a, -1) AS INTEGER) AS domain_age_days, CAST(coalesce(w.e, -1) AS INTEGER) AS domain_expiry_days,
              coalesce(w.r, '') AS registrar, CAST(coalesce(w.m, 1) AS INTEGER) AS missing_whois,
              CAST(coalesce(has_ssl, 0) AS INTEGER) AS has_ssl, CAST(coalesce(ssl_valid, 0) AS INTEGER) AS ssl_valid,
              CAST(coalesce(ssl_days_remaining, -1) AS INTEGER) AS ssl_days_remaining
       FROM w3 FULL OUTER JOIN k1 ON w3.domain = k1.domain),
dtf AS (SELECT *, CAST(domain_expiry_days <> -1 AND domain_expiry_days < 180 AS INTEGER) AS short_expiry_domain,
               CAST(domain_age_days <> -1 AND domain_age_days < 180 AS INTEGER) AS is_new_domain FROM dt)"""


DOMAIN_COLS = ("domain_age_days, domain_expiry_days, registrar, missing_whois, has_ssl, ssl_valid, "
               "ssl_days_remaining, short_expiry_domain, is_new_domain")

ORACLE["domain_features"] = f"WITH {domain_table_sql()}\nSELECT domain, {DOMAIN_COLS} FROM dtf"


def lookup_domain_sql(host: str) -> str:
    k = suffix_len_sql(host)
    labels_nz = f"list_filter(string_split({host}, '.'), lambda x: x <> '')"
    m = f"len({labels_nz})"
    fallback = (
        f"CASE WHEN {m} >= 3 AND length({labels_nz}[-1]) = 2 AND {labels_nz}[-2] IN {qlist(D.COMMON_SECOND_LEVEL)} "
        f"THEN array_to_string(list_slice({labels_nz}, {m} - 2, {m}), '.') "
        f"WHEN {m} >= 2 THEN array_to_string(list_slice({labels_nz}, {m} - 1, {m}), '.') ELSE {host} END"
    )
    raw = f"string_split({host}, '.')"
    n = f"len({raw})"
    return (
        f"(CASE WHEN {k} > 0 AND {n} > {k} THEN array_to_string(list_slice({raw}, {n} - {k}, {n}), '.') "
        f"ELSE {fallback} END)"
    )


ORACLE["domain_features_urls"] = f"""WITH {domain_table_sql()},
cu AS (SELECT c_custkey, 'https://www.shop' || CAST(c_custkey AS VARCHAR) || '.' ||
              ['com', 'net', 'org', 'xyz', 'co.uk'][c_custkey % 5 + 1] || '/account' AS url FROM customer),
{url_parts_ctes('cu', 'url', 'c_custkey, url')},
lk AS (SELECT c_custkey, url, {lookup_domain_sql('host')} AS lookup_domain FROM p6)
SELECT c_custkey, url, lookup_domain,
       CAST(coalesce(domain_age_days, -1) AS INTEGER) AS domain_age_days,
       CAST(coalesce(domain_expiry_days, -1) AS INTEGER) AS domain_expiry_days,
       coalesce(registrar, '') AS registrar, CAST(coalesce(missing_whois, 1) AS INTEGER) AS missing_whois,
       CAST(coalesce(has_ssl, 0) AS INTEGER) AS has_ssl, CAST(coalesce(ssl_valid, 0) AS INTEGER) AS ssl_valid,
       CAST(coalesce(ssl_days_remaining, -1) AS INTEGER) AS ssl_days_remaining,
       CAST(coalesce(short_expiry_domain, 0) AS INTEGER) AS short_expiry_domain,
       CAST(coalesce(is_new_domain, 0) AS INTEGER) AS is_new_domain
FROM lk LEFT JOIN dtf ON lk.lookup_domain = dtf.domain"""


# -------------------------------------------------------------------- dataset
def reference_files_sql() -> str:
    url = "'https://' || source || '.example.com/' || CAST(doc_id AS VARCHAR)"
    label = "CASE WHEN toxic = 1 OR quality = 0 THEN '1' ELSE '0' END"
    return f"""rf0 AS (SELECT d.doc_id, d.text, d.source, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)),
rf1 AS (SELECT {url} AS url0, {label} AS label0, CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END AS text_content,
               'ref/a.csv' AS source_dataset, doc_id AS line FROM rf0
        UNION ALL
        SELECT {url}, {label}, CASE WHEN doc_id % 3 = 1 THEN '' ELSE text END, 'ref/b.csv', doc_id FROM rf0 WHERE doc_id % 4 = 0),
rf2 AS (SELECT {normalize_sql('url0')} AS url, TRY_CAST(label0 AS DOUBLE) AS lab, coalesce(text_content, '') AS text_content,
               source_dataset, line FROM rf1),
rr AS (SELECT url, CAST(lab AS INTEGER) AS label, text_content, source_dataset, line,
              {strip_ws_sql('text_content')} <> '' AS has_reference_text FROM rf2 WHERE url <> '' AND lab IN (0.0, 1.0)),
dr AS (SELECT url, r.label AS label, r.source_dataset AS source_dataset, r.line AS line, r.has_reference_text AS has_reference_text,
              r.text_content AS text_content
       FROM (SELECT url, arg_min(struct_pack(label := label, source_dataset := source_dataset, line := line,
                                             has_reference_text := has_reference_text, text_content := text_content),
                                 (NOT has_reference_text, source_dataset, line)) AS r FROM rr GROUP BY url))"""


ORACLE["reference_rows"] = f"WITH {reference_files_sql()}\nSELECT url, label, source_dataset, line, has_reference_text FROM rr"
ORACLE["dedupe_reference"] = f"WITH {reference_files_sql()}\nSELECT url, label, source_dataset, line, has_reference_text FROM dr"


def h60(x: str) -> str:
    return f"('0x' || substr({x}, 1, 15))::BIGINT"


def balanced_sample_sql(rows: int = 250, seed: int = 42) -> str:
    return f"""WITH {balanced_ctes(rows, seed)}
SELECT url, label, source_dataset, line, has_reference_text, CAST(draw AS BIGINT) AS draw,
       md5('{seed}:' || url || ':' || draw) AS sample_order FROM s"""


def balanced_ctes(rows: int = 250, seed: int = 42) -> str:
    per, rem = rows // 2, rows % 2
    return f"""{reference_files_sql()},
b0 AS (SELECT *, md5('{seed}:' || label || ':' || url) AS h FROM dr),
cnt AS (SELECT label, count(*) FILTER (WHERE has_reference_text) AS n_text, count(*) FILTER (WHERE NOT has_reference_text) AS n_other,
               CASE WHEN label = 0 THEN {per + rem} ELSE {per} END AS need FROM b0 GROUP BY label),
pools AS (SELECT label, 't' AS tag, true AS want_text, need AS k, n_text AS size FROM cnt WHERE n_text >= need
          UNION ALL SELECT label, 't', true, n_text, n_text FROM cnt WHERE n_text < need AND n_text > 0
          UNION ALL SELECT label, 'f', false, need - n_text, n_other FROM cnt WHERE n_text < need AND n_text > 0
          UNION ALL SELECT label, 'a', NULL, need, n_text + n_other FROM cnt WHERE n_text = 0),
pr AS (SELECT b0.*, pools.tag, pools.k, pools.size,
              row_number() OVER (PARTITION BY b0.label, pools.tag ORDER BY h) - 1 AS rnk
       FROM b0 JOIN pools ON b0.label = pools.label AND (pools.want_text IS NULL OR pools.want_text = b0.has_reference_text)),
plain AS (SELECT url, label, source_dataset, line, has_reference_text, text_content, 0 AS draw FROM pr WHERE size >= k AND rnk < k),
dr0 AS (SELECT label, tag, size, unnest(range(k)) AS i FROM pools WHERE size < k AND k > 0),
drw AS (SELECT label, tag, i + 1 AS draw, {h60("md5('" + str(seed) + ":draw:' || label || ':' || tag || ':' || i)")} % size AS rnk FROM dr0),
repl AS (SELECT pr.url, pr.label, pr.source_dataset, pr.line, pr.has_reference_text, pr.text_content, drw.draw
         FROM pr JOIN drw ON pr.label = drw.label AND pr.tag = drw.tag AND pr.rnk = drw.rnk),
s AS (SELECT * FROM plain UNION ALL SELECT * FROM repl)"""


ORACLE["balanced_sample"] = balanced_sample_sql()

ORACLE["stratified_split"] = f"""WITH {reference_files_sql()},
r AS (SELECT url, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || url)) - 1 AS rnk,
             count(*) OVER (PARTITION BY label) AS n FROM dr)
SELECT url, label, rnk < round(n * 0.2) AS is_test FROM r"""

ORACLE["stratified_folds"] = f"""WITH {reference_files_sql()},
r AS (SELECT url, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:fold:' || url)) - 1 AS rnk FROM dr)
SELECT url, label, CAST(rnk % 5 AS INTEGER) AS fold FROM r"""

ORACLE["dedupe_urls"] = f"""WITH c AS (
  SELECT url, page_id * 3 AS pos FROM pages
  UNION ALL SELECT upper(url), page_id * 3 + 1 FROM pages
  UNION ALL SELECT url || '/', page_id * 3 + 2 FROM pages),
n AS (SELECT {normalize_sql('url')} AS url, pos FROM c),
k AS (SELECT lower(regexp_replace(url, '/+$', '')) AS dedupe_key, url, pos FROM n WHERE url <> '')
SELECT dedupe_key, arg_min(url, pos) AS url, min(pos) AS pos FROM k GROUP BY dedupe_key"""

ORACLE["feed_union"] = f"""WITH c AS (
  SELECT url, page_id AS pos, 0 AS feed FROM pages
  UNION ALL SELECT 'https://' || source || '.example.com/' || CAST(doc_id AS VARCHAR), doc_id, 1 FROM documents),
n AS (SELECT {normalize_sql('url')} AS url, pos, feed FROM c),
k AS (SELECT lower(regexp_replace(url, '/+$', '')) AS dedupe_key, url, pos, feed FROM n WHERE url <> ''),
d AS (SELECT dedupe_key, arg_min(struct_pack(url := url, pos := pos, feed := feed), (feed, pos)) AS r FROM k GROUP BY dedupe_key)
SELECT r.url AS url, r.pos AS pos, r.feed AS feed FROM d ORDER BY r.feed, r.pos LIMIT 300"""


# ----------------------------------------------------------------- evaluation
def eval_ctes() -> str:
    fl = flagship_sql()
    host = "lower(regexp_extract(url, '^(?:[^:/?#]+:)?//(?:[^/?#]*@)?([^/?#:]*)', 1))"
    return f"""fl AS ({fl}),
ev AS (SELECT url, CAST(regexp_matches({host}, 'cheap-pills|casino-win|free-bets') AS INTEGER) AS expected_label,
              url AS final_url, 'success' AS scrape_status, '' AS scrape_error,
              CASE WHEN prediction = 'SCAM' THEN 1 ELSE 0 END AS predicted_label, prediction AS predicted_name,
              confidence, scam_probability FROM fl),
ev2 AS (SELECT *, CASE WHEN expected_label = 1 THEN 'SCAM' ELSE 'LEGIT' END AS expected_name,
               CAST(predicted_label = expected_label AS INTEGER) AS correct FROM ev)"""


ORACLE["evaluation_rows"] = f"""WITH {eval_ctes()}
SELECT url, expected_label, expected_name, final_url, scrape_status, scrape_error, predicted_label,
       predicted_name, confidence, scam_probability, correct FROM ev2"""

ORACLE["holdout_metrics"] = f"""WITH {eval_ctes()},
b AS (SELECT expected_label AS y, predicted_label AS p, scam_probability AS s FROM ev2),
bs AS (SELECT s, count(*) AS n_s, sum(y) AS pos_s FROM b GROUP BY s),
r AS (SELECT *, coalesce(sum(n_s) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n_s + 1) / 2.0 AS midrank FROM bs),
a AS (SELECT sum(midrank * pos_s) AS rank_sum FROM r),
c AS (SELECT count(*) AS n, sum(CAST(y = 1 AND p = 1 AS BIGINT)) AS tp, sum(CAST(y = 0 AND p = 1 AS BIGINT)) AS fp,
             sum(CAST(y = 1 AND p <> 1 AS BIGINT)) AS fn, sum(CAST(y = p AS BIGINT)) AS correct, sum(y) AS n_pos FROM b),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS prec,
             CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS rec FROM c, a)
SELECT round_even(correct / n, 6) AS accuracy, round_even(prec, 6) AS precision, round_even(rec, 6) AS recall,
       round_even(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END, 6) AS f1,
       round_even(CASE WHEN n_pos > 0 AND n - n_pos > 0 THEN (rank_sum - n_pos * (n_pos + 1) / 2.0) / (n_pos * (n - n_pos)) END, 6) AS roc_auc
FROM m"""

CM_SQL = """cm AS (SELECT g.expected, g.predicted, coalesce(c.n, 0) AS n
  FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) g(expected, predicted)
  LEFT JOIN (SELECT CAST(expected_label AS INTEGER) AS expected, CAST(predicted_label AS INTEGER) AS predicted, count(*) AS n
             FROM ev2 GROUP BY ALL) c USING (expected, predicted))"""

ORACLE["confusion_matrix"] = f"WITH {eval_ctes()},\n{CM_SQL}\nSELECT CAST(expected AS INTEGER) AS expected, CAST(predicted AS INTEGER) AS predicted, n FROM cm"

ORACLE["classification_report"] = f"""WITH {eval_ctes()},
{CM_SQL},
pc AS (SELECT k, sum(CASE WHEN expected = k AND predicted = k THEN n ELSE 0 END) AS tp,
              sum(CASE WHEN predicted = k THEN n ELSE 0 END) AS pp, sum(CASE WHEN expected = k THEN n ELSE 0 END) AS sup
       FROM cm, (VALUES (0), (1)) kk(k) GROUP BY k),
pr AS (SELECT CAST(k AS VARCHAR) AS class, CASE WHEN pp > 0 THEN tp / pp ELSE 0.0 END AS precision,
              CASE WHEN sup > 0 THEN tp / sup ELSE 0.0 END AS recall, sup AS support FROM pc),
pf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM pr),
al AS (SELECT * FROM pf
       UNION ALL SELECT 'macro avg', avg(precision), avg(recall), sum(support), avg(f1) FROM pf
       UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(support),
                        sum(f1 * support) / sum(support) FROM pf)
SELECT class, round_even(precision, 6) AS precision, round_even(recall, 6) AS recall, round_even(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM al"""

ORACLE["real_summary"] = f"""WITH {eval_ctes()}
SELECT expected_name, count(*) AS total, CAST(sum(correct) AS BIGINT) AS correct,
       round_even(avg(confidence), 6) AS mean_confidence, round_even(avg(correct), 6) AS accuracy
FROM ev2 GROUP BY expected_name"""

ORACLE["eval_summary"] = f"""WITH {eval_ctes()},
r AS (SELECT expected_label, CAST(sum(correct) AS BIGINT) AS correct, count(*) AS total FROM ev2 GROUP BY ROLLUP (expected_label))
SELECT CASE WHEN expected_label IS NULL THEN 'Total' WHEN expected_label = 0 THEN 'Legit' ELSE 'Scam' END AS scope,
       correct, total,
       printf('- %s: %d/%d correct', CASE WHEN expected_label IS NULL THEN 'Total' WHEN expected_label = 0 THEN 'Legit' ELSE 'Scam' END, correct, total) AS line
FROM r"""

ORACLE["confidence_histogram"] = f"""WITH {eval_ctes()},
mm AS (SELECT min(confidence) AS lo, max(confidence) AS hi FROM ev2),
w AS (SELECT lo, CASE WHEN hi > lo THEN (hi - lo) / 10 ELSE 0.0 END AS width FROM mm),
bb AS (SELECT expected_name, CASE WHEN width = 0 THEN 0 ELSE CAST(least(floor((confidence - lo) / width), 9) AS INTEGER) END AS bin,
              lo, width FROM ev2, w),
g AS (SELECT DISTINCT expected_name, unnest(range(10)) AS bin FROM ev2)
SELECT g.expected_name, CAST(g.bin AS INTEGER) AS bin, round_even(w.lo + g.bin * w.width, 6) AS lower,
       round_even(w.lo + (g.bin + 1) * w.width, 6) AS upper,
       (SELECT count(*) FROM bb WHERE bb.expected_name = g.expected_name AND bb.bin = g.bin) AS n
FROM g, w"""

ORACLE["report_lines"] = f"""WITH {eval_ctes()},
t AS (SELECT count(*) AS n, sum(correct) AS c, count(*) FILTER (expected_label = 0) AS ln, count(*) FILTER (expected_label = 1) AS sn,
             coalesce(sum(correct) FILTER (expected_label = 0), 0) AS lc, coalesce(sum(correct) FILTER (expected_label = 1), 0) AS sc FROM ev2),
h AS (SELECT unnest(['# Real Site Prediction Results', '', '- Total: ' || c || '/' || n || ' correct', '- Legit: ' || lc || '/' || ln || ' correct',
                     '- Scam: ' || sc || '/' || sn || ' correct', '', '| Expected | Predicted | Correct | Confidence | URL |',
                     '|---|---|---:|---:|---|']) AS line, unnest(range(8)) AS i FROM t)
SELECT 0 AS section, CAST(i AS VARCHAR) AS ord_key, line FROM h
UNION ALL SELECT 1, url, '| ' || expected_name || ' | ' || predicted_name || ' | ' || CASE WHEN correct = 1 THEN 'yes' ELSE 'no' END ||
       ' | ' || printf('%.2f%%', confidence * 100) || ' | ' || url || ' |' FROM ev2"""

ORACLE["top_confident_examples"] = f"""WITH {eval_ctes()}
SELECT url, expected_name, predicted_name, correct, printf('%.2f%%', confidence * 100) AS confidence_pct
FROM ev2 ORDER BY correct ASC, confidence DESC, url ASC LIMIT 12"""

ORACLE["case_history"] = f"""WITH fl AS ({flagship_sql()}),
h AS (SELECT p.page_id, p.url, e.ts FROM pages p JOIN events e ON p.page_id = e.event_id)
SELECT h.url, fl.prediction, fl.confidence, fl.scam_probability, fl.risk_label, strftime(h.ts, '%Y-%m-%dT%H:%M:%S') AS checked_at
FROM h JOIN fl USING (page_id) ORDER BY checked_at DESC, url ASC LIMIT 12"""


# ------------------------------------------------------- prepared / cleaning
DOMAIN_FEATURE_NAMES = ("domain_age_days", "domain_expiry_days", "registrar", "missing_whois", "has_ssl", "ssl_valid",
                        "ssl_days_remaining", "short_expiry_domain", "is_new_domain")
CONTENT_FEATURE_NAMES = ("text_length", "token_count", "scam_keyword_count", "scam_keyword_density", "has_form",
                         "has_iframe", "exclamation_count", "caps_ratio", "avg_word_length")
META = ("url", "final_url", "source_dataset", "has_reference_text", "scrape_status", "scrape_error", "redirect_count", "registrar")
CANDIDATES = [c for c in URL_FEATURE_NAMES + DOMAIN_FEATURE_NAMES + CONTENT_FEATURE_NAMES if c not in META]


def prepared_ctes() -> str:
    dom = ("-1 AS domain_age_days, -1 AS domain_expiry_days, '' AS registrar, 1 AS missing_whois, 0 AS has_ssl, "
           "0 AS ssl_valid, -1 AS ssl_days_remaining, 0 AS short_expiry_domain, 0 AS is_new_domain")
    return f"""{reference_files_sql()},
s AS (SELECT *, 0 AS draw FROM dr),
{url_parts_ctes('s', 'url', 'url, draw, label, source_dataset, has_reference_text')},
uf AS (SELECT url, draw, label, source_dataset, has_reference_text, {url_feature_select_sql()} FROM p6),
{content_ctes('s', 'url, draw', "''", 'text_content')},
cf AS (SELECT url, draw, {CONTENT_SELECT}, 0 AS has_form, 0 AS has_iframe FROM c2),
prep AS (SELECT uf.url, uf.url AS final_url, uf.label, uf.source_dataset, CAST(uf.has_reference_text AS INTEGER) AS has_reference_text,
                'not_scraped' AS scrape_status, '' AS scrape_error, 0 AS redirect_count, CAST(uf.draw AS BIGINT) AS draw,
                {', '.join('uf.' + c for c in URL_FEATURE_NAMES)}, {dom},
                {', '.join('cf.' + c for c in CONTENT_FEATURE_NAMES)}
         FROM uf JOIN cf ON uf.url = cf.url AND uf.draw = cf.draw)"""


ORACLE["prepared_dataset"] = f"""WITH {prepared_ctes()}
SELECT * EXCLUDE (draw) REPLACE (CAST(domain_age_days AS INTEGER) AS domain_age_days, CAST(domain_expiry_days AS INTEGER) AS domain_expiry_days,
                  CAST(missing_whois AS INTEGER) AS missing_whois, CAST(has_ssl AS INTEGER) AS has_ssl, CAST(ssl_valid AS INTEGER) AS ssl_valid,
                  CAST(ssl_days_remaining AS INTEGER) AS ssl_days_remaining, CAST(short_expiry_domain AS INTEGER) AS short_expiry_domain,
                  CAST(is_new_domain AS INTEGER) AS is_new_domain, CAST(has_form AS INTEGER) AS has_form,
                  CAST(has_iframe AS INTEGER) AS has_iframe, CAST(redirect_count AS INTEGER) AS redirect_count)
FROM prep"""

ORACLE["label_counts"] = f"""WITH {prepared_ctes()},
c AS (SELECT label, count(*) AS n FROM prep GROUP BY label),
f AS (SELECT g.label, coalesce(c.n, 0) AS n FROM (VALUES (0), (1)) g(label) LEFT JOIN c USING (label))
SELECT CAST(label AS INTEGER) AS label, n, round_even(CASE WHEN sum(n) OVER () > 0 THEN n / sum(n) OVER () ELSE 0.0 END, 6) AS share FROM f"""

ORACLE["dataset_summary"] = f"""WITH {prepared_ctes()}
SELECT count(*) AS rows, 54 AS columns, CAST(sum(has_reference_text) AS BIGINT) AS rows_with_text,
       CAST(sum(1 - has_reference_text) AS BIGINT) AS url_only_rows FROM prep"""

ORACLE["null_counts"] = """WITH d AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic
                FROM documents d LEFT JOIN labels l USING (doc_id)),
u AS (UNPIVOT (SELECT CAST(doc_id IS NULL AS BIGINT) AS doc_id, CAST(text IS NULL AS BIGINT) AS text,
                      CAST(lang IS NULL AS BIGINT) AS lang, CAST(source IS NULL AS BIGINT) AS source,
                      CAST(n_chars IS NULL AS BIGINT) AS n_chars, CAST(quality IS NULL AS BIGINT) AS quality,
                      CAST(toxic IS NULL AS BIGINT) AS toxic FROM d)
      ON COLUMNS(*) INTO NAME "column" VALUE null_flag)
SELECT "column", sum(null_flag) AS nulls FROM u GROUP BY "column" ORDER BY nulls DESC, "column" LIMIT 20"""

ALL_PREP_COLS = ["url", "final_url", "label", "source_dataset", "has_reference_text", "scrape_status", "scrape_error",
                 "redirect_count", *URL_FEATURE_NAMES, *DOMAIN_FEATURE_NAMES, *CONTENT_FEATURE_NAMES]

ORACLE["constant_columns"] = f"""WITH {prepared_ctes()},
u AS (UNPIVOT (SELECT {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in ALL_PREP_COLS)} FROM prep)
      ON COLUMNS(*) INTO NAME "column" VALUE v)
SELECT "column" FROM u GROUP BY "column" HAVING count(v) = 0 OR min(v) = max(v)"""


def profile_ctes() -> str:
    pos = " ".join(f"WHEN {q(c)} THEN {i}" for i, c in enumerate(CANDIDATES))
    return f"""{prepared_ctes()},
num AS (SELECT url, draw, label, {', '.join(f'TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) AS {c}' for c in CANDIDATES)} FROM prep),
lng AS (UNPIVOT num ON {', '.join(CANDIDATES)} INTO NAME "column" VALUE v),
cols AS (SELECT unnest({sql_list(CANDIDATES)}) AS "column"),
agg AS (SELECT "column", count(v) AS non_null, min(v) AS min, max(v) AS max FROM lng GROUP BY "column"),
prof AS (SELECT "column", CASE "column" {pos} END AS position, (SELECT count(*) FROM prep) AS n,
                coalesce(non_null, 0) AS non_null, min, max FROM cols LEFT JOIN agg USING ("column")),
kept AS (SELECT *, non_null > 0 AND (min <> max OR non_null < n) AS kept FROM prof),
kl AS (SELECT lng.* FROM lng JOIN kept USING ("column") WHERE kept.kept)"""


ORACLE["feature_profile"] = f"""WITH {profile_ctes()}
SELECT "column", CAST(position AS INTEGER) AS position, n, non_null, min, max, kept FROM kept"""

ORACLE["describe_features"] = f"""WITH {profile_ctes()}
SELECT "column", round_even(avg(v), 6) AS mean, round_even(stddev_samp(v), 6) AS std, round_even(min(v), 6) AS min,
       round_even(max(v), 6) AS max FROM kl GROUP BY "column"
"""

ORACLE["feature_variance_topk"] = f"""WITH {profile_ctes()}
SELECT "column", round_even(var_samp(v), 6) AS variance FROM kl GROUP BY "column"
ORDER BY var_samp(v) DESC NULLS LAST, "column" LIMIT 16"""

ORACLE["correlation_pairs"] = f"""WITH {profile_ctes()},
kp AS (SELECT "column", position FROM kept WHERE kept),
pa AS (SELECT a."column" AS feature_a, b."column" AS feature_b, la.v AS va, lb.v AS vb
       FROM kp a JOIN kp b ON b.position < a.position
       JOIN kl la ON la."column" = a."column" JOIN kl lb ON lb."column" = b."column" AND lb.url = la.url AND lb.draw = la.draw)
SELECT feature_a, feature_b, round_even(corr(va, vb), 6) AS corr FROM pa GROUP BY feature_a, feature_b"""

BOX = ("url_length", "num_dots", "num_hyphen", "num_digits", "url_entropy", "path_depth", "text_length", "token_count")

ORACLE["box_stats"] = f"""WITH {prepared_ctes()},
lng AS (UNPIVOT (SELECT label, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in BOX)} FROM prep)
        ON {', '.join(BOX)} INTO NAME feature VALUE value),
qq AS (SELECT feature, label, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
              quantile_cont(value, 0.75) AS q3 FROM lng GROUP BY feature, label),
j AS (SELECT lng.*, q1, median, q3, q3 - q1 AS iqr FROM lng JOIN qq USING (feature, label))
SELECT feature, label, round_even(q1, 6) AS q1, round_even(median, 6) AS median, round_even(q3, 6) AS q3,
       round_even(min(CASE WHEN value >= q1 - 1.5 * iqr THEN value END), 6) AS whisker_low,
       round_even(max(CASE WHEN value <= q3 + 1.5 * iqr THEN value END), 6) AS whisker_high
FROM j GROUP BY feature, label, q1, median, q3"""

ORACLE["feature_medians"] = f"""WITH {profile_ctes()}
SELECT "column", round_even(quantile_cont(v, 0.5), 6) AS median FROM kl GROUP BY "column"
"""

_Z = ", ".join(
    f"round_even((CAST({c} AS DOUBLE) - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1), 6) AS {c}" for c in BOX
)
ORACLE["standardized_features"] = f"""WITH {prepared_ctes()}
SELECT url, label, {_Z} FROM prep"""

ORACLE["class_weights"] = f"""WITH {prepared_ctes()},
c AS (SELECT label, count(*) AS n FROM prep GROUP BY label)
SELECT CAST(label AS INTEGER) AS label, round_even(sum(n) OVER () / (2.0 * n), 6) AS weight, n FROM c"""


TREE_FEATURES = ("url_length", "num_dots", "num_hyphen", "num_digits", "path_depth", "text_length", "token_count")


def extra_trees_sql(trees: int = 3, depth: int = 3, k: int = 3, seed: int = 42, min_leaf: int = 2) -> str:
    """Each level in plain SQL: ``at`` says where a row stands in each tree, ``sz``
    counts a node's labels, ``cand`` draws cuts, ``win`` takes the best."""
    ctes = [prepared_ctes(), f"""tb AS MATERIALIZED (SELECT row_number() OVER (ORDER BY url) AS id, label, {', '.join(TREE_FEATURES)} FROM prep),
tw AS (SELECT count(*) / (2.0::DOUBLE * count(*) FILTER (label = 0)) AS w0, count(*) / (2.0::DOUBLE * count(*) FILTER (label = 1)) AS w1 FROM tb),
tl AS MATERIALIZED (SELECT id, label, unnest(range({len(TREE_FEATURES)})) AS f, unnest([{', '.join(f'{c}::DOUBLE' for c in TREE_FEATURES)}]) AS v FROM tb),
at0 AS (SELECT id, label, unnest(range({trees})) AS tree, 0 AS node FROM tb)"""]
    out = []
    for d in range(depth + 1):
        ctes.append(f"sz{d} AS (SELECT tree, node, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM at{d} GROUP BY tree, node)")
        if d == depth:
            out.append(f"SELECT tree, node, n0, n1, NULL AS f, NULL AS cut FROM sz{d}")
            break
        key = f"'{seed}|' || '@' || '|' || tree || '|' || node || '|' || f"
        ctes.append(f"""rg{d} AS (SELECT tree, node, f, min(v) AS lo, max(v) AS hi FROM at{d} JOIN tl USING (id) GROUP BY tree, node, f HAVING max(v) > min(v)),
cand{d} AS MATERIALIZED (SELECT tree, node, n0, n1, f, lo + ('0x' || substr(md5({key.replace('@', 'cut')}), 1, 8))::BIGINT / 4294967296.0::DOUBLE * (hi - lo) AS cut,
       row_number() OVER (PARTITION BY tree, node ORDER BY md5({key.replace('@', 'pick')}), f) AS rk
       FROM rg{d} JOIN sz{d} USING (tree, node) WHERE n0 > 0 AND n1 > 0 AND n0 + n1 >= {2 * min_leaf} QUALIFY rk <= {k}),
lf{d} AS (SELECT tree, node, c.f, rk, any_value(n0) AS n0, any_value(n1) AS n1, any_value(cut) AS cut,
       count(*) FILTER (v <= cut AND a.label = 0) AS l0, count(*) FILTER (v <= cut AND a.label = 1) AS l1
       FROM cand{d} c JOIN at{d} a USING (tree, node) JOIN tl ON tl.id = a.id AND tl.f = c.f GROUP BY tree, node, c.f, rk),
gn{d} AS (SELECT *, l0 * w0 AS a, l1 * w1 AS b, (n0 - l0) * w0 AS c, (n1 - l1) * w1 AS d FROM lf{d}, tw WHERE l0 + l1 >= {min_leaf} AND n0 + n1 - l0 - l1 >= {min_leaf}),
win{d} AS MATERIALIZED (SELECT tree, node, f, cut FROM gn{d}
       QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY (a * a + b * b) / (a + b) + (c * c + d * d) / (c + d) DESC, rk) = 1),
at{d + 1} AS MATERIALIZED (SELECT at{d}.id, at{d}.label, tree, 2 * node + CASE WHEN v <= cut THEN 1 ELSE 2 END AS node
       FROM at{d} JOIN win{d} w USING (tree, node) JOIN tl ON tl.id = at{d}.id AND tl.f = w.f)""")
        out.append(f"SELECT tree, node, n0, n1, f, cut FROM sz{d} LEFT JOIN win{d} USING (tree, node)")
    names = f"[{', '.join(map(q, TREE_FEATURES))}]"
    return f"""WITH {(',' + chr(10)).join(ctes)}
SELECT CAST(tree AS INTEGER) AS tree, CAST(node AS BIGINT) AS node, n0, n1, {names}[f + 1] AS feature, round_even(cut, 6) AS cut,
       round_even(n1 * w1 / (n0 * w0 + n1 * w1), 6) AS share
FROM ({' UNION ALL '.join(out)}), tw"""


ORACLE["extra_trees_nodes"] = extra_trees_sql()


# ------------------------------------------------------------------ captures
CONTENT_TYPES = ("text/html; charset=utf-8", "text/html", "application/xhtml+xml", "", "text/plain",
                 "application/pdf", "image/png")


def split_ctes(name: str, source: str, col: str, keys: str) -> str:
    """CTE ``name`` = keys + scheme, netloc, path, query, frag, has_q, has_f of ``col``."""
    return f"""{name}0 AS (SELECT {keys}, regexp_replace({col}, '[\\t\\r\\n]', '', 'g') AS s_ FROM {source}),
{name} AS (SELECT * EXCLUDE (s_), lower({url_part_sql('s_', 1)}) AS scheme, {url_part_sql('s_', 2)} AS netloc,
           {url_part_sql('s_', 3)} AS path, {url_part_sql('s_', 4)} AS query,
           {url_part_sql('s_', 5)} AS frag, regexp_matches(s_, '^[^#]*\\?') AS has_q, contains(s_, '#') AS has_f FROM {name}0)"""


def homepage_expr(url: str) -> str:
    s = f"regexp_replace({url}, '[\\t\\r\\n]', '', 'g')"
    sch = f"lower({url_part_sql(s, 1)})"
    net = f"{url_part_sql(s, 2)}"
    return f"(CASE WHEN {sch} = '' OR {net} = '' THEN {url} ELSE {sch} || '://' || {net} || '/' END)"


def captures_sql() -> str:
    ct = sql_list(CONTENT_TYPES)
    return f"""cap AS (
  SELECT url, page_id % 13 <> 0 AS ok, {ct}[page_id % 7 + 1] AS content_type, url AS final_url,
         CAST(page_id % 3 AS INTEGER) AS redirect_count, html FROM pages
  UNION ALL
  SELECT hurl, true, 'text/html', hurl, 0, b.html FROM (
    SELECT hurl, arg_max(struct_pack(html := html, page_id := page_id), (length(html), page_id)) AS b
    FROM (SELECT {homepage_expr('url')} AS hurl, html, page_id FROM pages) GROUP BY hurl)),
fcap AS (SELECT * FROM cap WHERE ok AND (
    (contains(lower(coalesce(content_type, '')), 'text/html') OR contains(lower(coalesce(content_type, '')), 'application/xhtml+xml')
     OR contains(lower(substr(coalesce(html, ''), 1, 1000)), '<html') OR contains(lower(substr(coalesce(html, ''), 1, 1000)), '<body')
     OR (contains(lower(coalesce(content_type, '')), 'text/plain') AND contains(lower(substr(coalesce(html, ''), 1, 1000)), '<')
         AND contains(lower(substr(coalesce(html, ''), 1, 1000)), '>'))
     OR lower(coalesce(content_type, '')) = '')
    AND NOT (contains(lower(coalesce(content_type, '')), 'image/') OR contains(lower(coalesce(content_type, '')), 'video/')
             OR contains(lower(coalesce(content_type, '')), 'application/pdf'))))"""


ORACLE["filter_html"] = f"WITH {captures_sql()}\nSELECT url, content_type, redirect_count FROM fcap"


def first_capture_ctes(name: str, keys_source: str, key: str) -> str:
    tail = ("(CASE WHEN path = '' THEN '/' ELSE path END) || (CASE WHEN query <> '' THEN '?' || query ELSE '' END) "
            "|| (CASE WHEN frag <> '' THEN '#' || frag ELSE '' END)")
    www = "(CASE WHEN starts_with(netloc, 'www.') THEN substr(netloc, 5) ELSE 'www.' || netloc END)"
    pre = "(CASE WHEN scheme <> '' THEN scheme || ':' ELSE '' END)"
    return f"""{name}k AS (SELECT DISTINCT {key} AS k FROM {keys_source} WHERE {key} IS NOT NULL),
{split_ctes(name + 's', name + 'k', 'k', 'k')},
{name}c AS (SELECT k, 1 AS rnk, CASE WHEN netloc = '' THEN k ELSE {pre} || '//' || netloc || {tail} END AS candidate FROM {name}s
   UNION ALL SELECT k, 2, 'http://' || netloc || {tail} FROM {name}s WHERE netloc <> '' AND scheme = 'https'
   UNION ALL SELECT k, 3, {pre} || '//' || {www} || {tail} FROM {name}s WHERE netloc <> ''),
{name} AS (SELECT k, arg_min(up.pg, rnk) AS pg FROM {name}c JOIN up ON up.url = {name}c.candidate GROUP BY k)"""


def resolve_sql() -> str:
    canon_src = "ul"
    return f"""WITH {captures_sql()},
{page_ctes('fcap', 'url, final_url, redirect_count')},
up AS (SELECT url, arg_min(struct_pack(final_url := final_url, redirect_count := redirect_count, title := title,
                                      text := text, text_length := CAST(length(text) AS INTEGER),
                                      low_content := CAST(length(text) < {D.LOW_CONTENT_CHARS} AS INTEGER), link_count := link_count),
                          (final_url, redirect_count, text)) AS pg FROM h2 GROUP BY url),
ul AS (SELECT page_id, url FROM pages
       UNION ALL SELECT page_id * 10 + 1, CASE WHEN starts_with({url_part_sql('url', 2)}, 'www.')
                                           THEN regexp_replace(url, '//www\\.', '//') ELSE regexp_replace(url, '//', '//www.') END
                 FROM pages WHERE page_id % 5 = 0
       UNION ALL SELECT page_id * 10 + 2, url || '/missing' FROM pages WHERE page_id % 7 = 0
       UNION ALL SELECT doc_id * 10 + 3, 'http://docs.example.net/d/' || CAST(doc_id AS VARCHAR) FROM labels),
un AS (SELECT page_id, url, {normalize_sql('url')} AS u FROM ul),
{split_ctes('us', 'un', 'u', 'page_id, url')},
base AS (SELECT page_id, url, CASE WHEN netloc = '' THEN '' ELSE scheme || '://' || lower({strip_ws_sql('netloc')}) ||
              (CASE WHEN path = '' THEN '/' ELSE path END) || (CASE WHEN has_q AND query <> '' THEN '?' || query ELSE '' END) ||
              (CASE WHEN has_f AND frag <> '' THEN '#' || frag ELSE '' END) END AS nurl FROM us),
{first_capture_ctes('fc', 'base', 'nurl')},
r1 AS (SELECT base.*, fc.pg FROM base LEFT JOIN fc ON fc.k = base.nurl),
r2 AS (SELECT *, CASE WHEN nurl = '' THEN NULL WHEN pg IS NULL THEN {homepage_expr('nurl')}
                      WHEN pg.low_content = 1 THEN {homepage_expr('pg.final_url')} END AS hkey,
              CASE WHEN pg IS NULL THEN nurl ELSE pg.final_url END AS origin FROM r1),
{first_capture_ctes('hc', 'r2', 'hkey')},
r3 AS (SELECT r2.*, hc.pg AS hp FROM r2 LEFT JOIN hc ON hc.k = r2.hkey),
r4 AS (SELECT *, coalesce(hp IS NOT NULL AND hkey <> origin AND (pg IS NULL OR hp.text_length > pg.text_length), false) AS fb FROM r3),
r5 AS (SELECT *, CASE WHEN fb THEN hp ELSE pg END AS fpg FROM r4)
SELECT page_id, url,
       CASE WHEN nurl = '' THEN 'failed' WHEN fpg IS NOT NULL THEN 'success' ELSE 'partial' END AS status,
       CASE WHEN nurl = '' THEN '' WHEN fpg IS NOT NULL THEN fpg.final_url ELSE nurl END AS final_url,
       CASE WHEN nurl = '' THEN 'Invalid URL' WHEN fb THEN 'Homepage fallback used'
            WHEN fpg IS NULL THEN 'Scraping blocked, non-HTML content, or request failed' END AS error,
       CAST(CASE WHEN fpg IS NOT NULL AND nurl <> '' THEN fpg.redirect_count ELSE 0 END AS INTEGER) AS redirect_count,
       CASE WHEN fpg IS NOT NULL AND nurl <> '' THEN fpg.title ELSE '' END AS title,
       CAST(CASE WHEN fpg IS NOT NULL AND nurl <> '' THEN fpg.text_length ELSE 0 END AS INTEGER) AS text_length,
       CAST(CASE WHEN fpg IS NOT NULL AND nurl <> '' THEN fpg.low_content ELSE 0 END AS INTEGER) AS low_content,
       CAST(CASE WHEN fpg IS NOT NULL AND nurl <> '' THEN fpg.link_count ELSE 0 END AS INTEGER) AS link_count
FROM r5"""


ORACLE["resolve_captures"] = resolve_sql()


# ------------------------------------------------------------ URL utilities
#: First and last address of each IPv4 range that isn't public.
V4_RANGES = (
    ("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"), ("127.0.0.0", "127.255.255.255"), ("169.254.0.0", "169.254.255.255"),
    ("172.16.0.0", "172.31.255.255"), ("192.0.0.0", "192.0.0.8"), ("192.0.0.11", "192.0.0.255"), ("192.0.2.0", "192.0.2.255"),
    ("192.168.0.0", "192.168.255.255"), ("198.18.0.0", "198.19.255.255"), ("198.51.100.0", "198.51.100.255"),
    ("203.0.113.0", "203.0.113.255"), ("224.0.0.0", "255.255.255.255"),
)


def _v4(address: str) -> int:
    value = 0
    for part in address.split("."):
        value = value * 256 + int(part)
    return value


def private_v4_sql(host: str) -> str:
    """Is the dotted quad in one of the ranges, compared as a number?"""
    number = f"list_reduce(list_transform(string_split({host}, '.'), lambda x: TRY_CAST(x AS BIGINT)), lambda a, x: a * 256 + x)"
    return "(" + " OR ".join(f"{number} BETWEEN {_v4(a)} AND {_v4(b)}" for a, b in V4_RANGES) + ")"


def private_v6_sql(host: str) -> str:
    """By the first two groups: public are 2000::/3 without its special
    blocks, and fec0::/10."""
    first = f"regexp_extract({host}, '^([0-9a-f]*):', 1)"
    second = f"coalesce(TRY_CAST('0x' || nullif(regexp_extract({host}, '^[0-9a-f]+:([0-9a-f]+)', 1), '') AS BIGINT), 0)"
    head = f"coalesce(TRY_CAST('0x' || nullif({first}, '') AS BIGINT), 0)"
    special = f"""({head} = 8193 AND ({second} = 3512 OR ({second} < 512 AND NOT ({second} = 3 OR {second} BETWEEN 32 AND 63
        OR regexp_matches({host}, '^2001:0*1::[12]$') OR regexp_matches({host}, '^2001:0*4:0*112:')))))"""
    return f"NOT ({head} BETWEEN 65216 AND 65279 OR ({head} BETWEEN 8192 AND 16383 AND NOT ({special} OR {head} = 8194)))"




def canonical_ctes(source: str, col: str, keys: str, name: str = "cn") -> str:
    return f"""{name}a AS (SELECT {keys}, {normalize_sql(col)} AS cu FROM {source}),
{split_ctes(name + 'b', name + 'a', 'cu', keys + ', cu')},
{name} AS (SELECT {keys}, cu, CASE WHEN netloc = '' THEN '' ELSE scheme || '://' || lower({strip_ws_sql('netloc')}) ||
              (CASE WHEN path = '' THEN '/' ELSE path END) || (CASE WHEN has_q AND query <> '' THEN '?' || query ELSE '' END) ||
              (CASE WHEN has_f AND frag <> '' THEN '#' || frag ELSE '' END) END AS canonical_url FROM {name}b)"""


ORACLE["url_parts"] = f"""WITH src AS (SELECT page_id, url FROM pages UNION ALL SELECT page_id + 1000000, upper(url) FROM pages),
{canonical_ctes('src', 'url', 'page_id, url')},
{url_parts_ctes('src', 'url', 'page_id, url')}
SELECT p6.page_id, p6.url, u AS normalized_url, scheme, netloc, host AS hostname, path_raw AS path, query,
       {url_part_sql('s_', 5)} AS fragment, cn.canonical_url,
       lower(regexp_replace(u, '/+$', '')) AS dedupe_key, {homepage_expr('u')} AS homepage_url
FROM p6 JOIN cn USING (page_id)"""

ORACLE["candidate_urls"] = f"""WITH {canonical_ctes('pages', 'url', 'page_id')},
{split_ctes('cs', 'cn', 'canonical_url', 'page_id, canonical_url')},
t AS (SELECT *, (CASE WHEN path = '' THEN '/' ELSE path END) || (CASE WHEN query <> '' THEN '?' || query ELSE '' END)
                || (CASE WHEN frag <> '' THEN '#' || frag ELSE '' END) AS tail,
             (CASE WHEN scheme <> '' THEN scheme || ':' ELSE '' END) AS pre FROM cs),
c AS (SELECT page_id, canonical_url, CASE WHEN netloc = '' THEN [canonical_url] ELSE list_distinct_ordered END AS cands
      FROM (SELECT *, list_filter([pre || '//' || netloc || tail,
                                   CASE WHEN scheme = 'https' THEN 'http://' || netloc || tail END,
                                   pre || '//' || (CASE WHEN starts_with(netloc, 'www.') THEN substr(netloc, 5) ELSE 'www.' || netloc END) || tail],
                                  lambda x: x IS NOT NULL) AS list_distinct_ordered FROM t))
SELECT page_id, canonical_url AS url, CAST(i AS INTEGER) AS rank, cands[i] AS candidate
FROM c, range(1, len(cands) + 1) r(i)"""

ORACLE["public_hosts"] = f"""WITH {url_parts_ctes('pages', 'url', 'page_id')},
ev AS (SELECT concat_ws('.', {', '.join(f'CAST((user_id * {k} + CAST(floor(value) AS BIGINT)) % 256 AS VARCHAR)' for k in (1, 7, 13, 31))}) AS host FROM events),
h AS (SELECT DISTINCT host FROM (SELECT host FROM p6 UNION ALL SELECT host FROM ev))
SELECT host,
       host <> '' AND lower(host) NOT IN ('localhost', 'localhost.localdomain')
       AND NOT ({v4_sql('lower(host)')} AND {private_v4_sql('lower(host)')})
       AND NOT ({v6_sql('lower(host)')} AND {private_v6_sql('lower(host)')}) AS is_public,
       CAST({v4_sql('host')} OR {v6_sql('host')} AS INTEGER) AS is_ip
FROM h"""

ORACLE["text_corpus"] = f"""WITH {page_ctes('pages', 'page_id')}
SELECT page_id, {strip_ws_sql(f"concat_ws(' ', nullif({strip_ws_sql('title')}, ''), nullif({strip_ws_sql('text')}, ''))")} AS corpus_text
FROM h2 WHERE trim(text) <> ''"""


def tfidf_sql(top_n: int = 10) -> str:
    punct = D.ASCII_PUNCTUATION
    norm = collapse_sql(f"translate(lower(coalesce(text, '')), {q(punct)}, {q(' ' * len(punct))})")
    return f"""WITH t0 AS (SELECT doc_id, unnest(list_filter(string_split({norm}, ' '), lambda x: x <> '' AND x NOT IN {qlist(D.ENGLISH_STOP_WORDS)})) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t0 GROUP BY doc_id, term),
nd AS (SELECT count(*) AS n FROM documents),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT tf.doc_id, tf.term, tf.tf * (ln((1.0 + nd.n) / (1 + df.df)) + 1) AS raw FROM tf JOIN df USING (term), nd WHERE nd.n >= 2),
nw AS (SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term ASC) AS rnk FROM nw)
SELECT doc_id, CAST(rnk AS INTEGER) AS rank, term, round_even(weight, 6) AS weight FROM r WHERE rnk <= {top_n}"""


ORACLE["tfidf_top_terms"] = tfidf_sql()


def tfidf_transform_sql(min_df: int = 2) -> str:
    """Terms of the turns, weighted by their document frequency in the documents."""
    norm = collapse_sql(f"translate(lower(coalesce(text, '')), {q(D.ASCII_PUNCTUATION)}, {q(' ' * len(D.ASCII_PUNCTUATION))})")
    terms = f"unnest(list_filter(string_split({norm}, ' '), lambda x: x <> '' AND x NOT IN {qlist(D.ENGLISH_STOP_WORDS)})) AS term"
    return f"""WITH seen AS (SELECT DISTINCT doc_id, {terms} FROM documents),
m AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM seen GROUP BY term HAVING count(*) >= {min_df}),
u AS (SELECT conv_id || '-' || turn AS turn_id, {terms} FROM conversations),
f AS (SELECT turn_id, term, count(*) AS tf FROM u GROUP BY ALL),
w AS (SELECT turn_id, term, tf, tf * idf AS raw FROM f JOIN m USING (term))
SELECT turn_id, term, tf, round_even(raw / sqrt(sum(raw * raw) OVER (PARTITION BY turn_id)), 6) AS weight FROM w"""


ORACLE["tfidf_transform"] = tfidf_transform_sql()


# --------------------------------------------------------------------- store
def stored_sql() -> str:
    return f"""(WITH {page_ctes('pages', 'page_id, url')},
{url_parts_ctes('h2', 'url', 'page_id, url, title, text')},
uf AS (SELECT url, title, text, {url_feature_select_sql()} FROM p6)
SELECT url, title, 'success' AS status, url AS final_url, CAST(NULL AS INTEGER) AS label, url_length,
       suspicious_word_count, CAST(length(text) AS INTEGER) AS text_length FROM uf)"""


def incoming_sql() -> str:
    host = "lower(regexp_extract(url, '^(?:[^:/?#]+:)?//(?:[^/?#]*@)?([^/?#:]*)', 1))"
    return f"""(WITH rs AS ({resolve_sql()}),
rs2 AS (SELECT *, CASE WHEN final_url <> '' THEN final_url ELSE url END AS furl FROM rs),
{url_parts_ctes('rs2', 'furl', 'url, title, status, final_url, text_length')},
uf AS (SELECT url, title, status, final_url, text_length, {url_feature_select_sql()} FROM p6)
SELECT url, title, status, final_url, CAST(regexp_matches({host}, 'cheap-pills|casino-win|free-bets') AS INTEGER) AS label,
       url_length, suspicious_word_count, text_length FROM uf)"""


def merge_sql(mode: str) -> str:
    cols = ("title", "status", "final_url", "label", "url_length", "suspicious_word_count", "text_length")
    scrape = ("title", "status", "final_url")
    sel = []
    for c in cols:
        if c == "label":
            sel.append(f"coalesce(i.label, s.label) AS label")
        elif mode == "ignore" and c in scrape:
            sel.append(f"CASE WHEN s.url IS NOT NULL THEN s.{c} ELSE i.{c} END AS {c}")
        else:
            sel.append(f"CASE WHEN i.url IS NOT NULL THEN i.{c} ELSE s.{c} END AS {c}")
    return f"""SELECT coalesce(s.url, i.url) AS url, {', '.join(sel)}
FROM {stored_sql()} s FULL OUTER JOIN (SELECT * FROM {incoming_sql()} x QUALIFY row_number() OVER (PARTITION BY url ORDER BY url) = 1) i
ON s.url = i.url"""


ORACLE["websites_merge"] = merge_sql("merge")
ORACLE["websites_insert_ignore"] = merge_sql("ignore")
ORACLE["websites_export"] = f"""SELECT url, status, final_url, label, url_length, suspicious_word_count, text_length
FROM ({merge_sql('merge')}) m WHERE label IS NOT NULL"""

ORACLE["not_seen_urls"] = f"""WITH rs AS ({resolve_sql()})
SELECT page_id, url FROM rs WHERE url NOT IN (SELECT url FROM {stored_sql()} st)"""

BATCH_WHITELIST = ("www.therer.example.com", "ththre.example.com", "blog.tionsh.example.net")

ORACLE["batch_check"] = f"""WITH fl AS ({flagship_sql()}),
b AS (SELECT page_id, url, scam_probability,
             CASE WHEN regexp_matches(lower(regexp_extract(url, '^(?:[^:/?#]+:)?//(?:[^/?#]*@)?([^/?#:]*)', 1)),
                                      'cheap-pills|casino-win|free-bets') THEN 'Scam' ELSE 'Legit' END AS expected,
             lower({url_part_sql("regexp_replace(url, '[\\t\\r\\n]', '', 'g')", 2)}) AS netloc FROM fl),
v AS (SELECT page_id, url, expected, 'LEGITIMATE' AS predicted_verdict, '100.00%' AS confidence_text, 'Whitelisted' AS note
      FROM b WHERE netloc IN {qlist(BATCH_WHITELIST)}
      UNION ALL
      SELECT page_id, url, expected, CASE WHEN scam_probability >= 0.5 THEN 'SCAM' ELSE 'LEGITIMATE' END,
             printf('%.2f%%', greatest(scam_probability, 1 - scam_probability) * 100), 'ML Prediction'
      FROM b WHERE netloc NOT IN {qlist(BATCH_WHITELIST)})
SELECT *, CASE WHEN contains(predicted_verdict, upper(expected)) THEN '[PASS]' ELSE '[FAIL]' END AS "check" FROM v"""


# ------------------------------------------------------------ URL-only score
def url_only_sql() -> str:
    lab, _tone = band_sql("p")
    zeros = ", ".join(f"0 AS {c}" for c in ("text_length", "token_count", "scam_keyword_count", "has_form", "has_iframe", "exclamation_count")) + \
        ", 0.0 AS scam_keyword_density, 0.0 AS caps_ratio, 0.0 AS avg_word_length"
    return f"""WITH {url_parts_ctes('pages', 'url', 'page_id, url')},
uf AS (SELECT page_id, url, url_valid, {url_feature_select_sql()}, {zeros} FROM p6),
f AS (SELECT *, {family_sql()} FROM uf),
s AS (SELECT *, round_even(({' + '.join(FAMILY_COLUMNS)}) / {len(FAMILY_COLUMNS)}, 4) AS p0 FROM f),
o AS (SELECT *, CASE WHEN url_valid THEN p0 ELSE 0.0 END AS p FROM s)
SELECT page_id, url, {', '.join(FAMILY_COLUMNS)}, p AS scam_probability,
       CASE WHEN NOT url_valid THEN 'ERROR' WHEN p0 >= 0.5 THEN 'SCAM' ELSE 'LEGIT' END AS prediction,
       CASE WHEN NOT url_valid THEN 0.0 WHEN p0 >= 0.5 THEN round_even(p0, 4) ELSE round_even(1.0 - p0, 4) END AS confidence,
       {lab} AS risk_label
FROM o"""


ORACLE["url_only_scores"] = url_only_sql()


# ------------------------------------------------- groups, alignment, impute
GROUPS = (("URL structure", URL_FEATURE_NAMES[:25]), ("Hosting and brand signals", URL_FEATURE_NAMES[25:]),
          ("Page content", ("text_length", "token_count", "scam_keyword_count", "scam_keyword_density",
                            "exclamation_count", "caps_ratio", "avg_word_length")))
MODEL_FEATURES = tuple(f for _, fs in GROUPS for f in fs)

ORACLE["feature_group_counts"] = f"""WITH {profile_ctes()},
g AS (SELECT * FROM (VALUES {', '.join(f'({q(f)}, {q(g)})' for g, fs in GROUPS for f in fs)}) t(feature, grp))
SELECT coalesce(g.grp, 'Domain signals') AS "group", count(*) AS feature_count
FROM kept LEFT JOIN g ON g.feature = kept."column" WHERE kept.kept GROUP BY ALL"""

ORACLE["feature_preview"] = f"""WITH {url_parts_ctes('pages', 'url', 'page_id')},
uf AS (SELECT page_id, {url_feature_select_sql()} FROM p6)
SELECT page_id, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' if c in URL_FEATURE_NAMES else f'0.0 AS {c}' for c in MODEL_FEATURES)}
FROM uf"""

ORACLE["impute_domain"] = f"""WITH {domain_table_sql()},
cu AS (SELECT c_custkey, 'https://www.shop' || CAST(c_custkey AS VARCHAR) || '.' ||
              ['com', 'net', 'org', 'xyz', 'co.uk'][c_custkey % 5 + 1] || '/account' AS url FROM customer),
{url_parts_ctes('cu', 'url', 'c_custkey, url')},
lk AS (SELECT c_custkey, {lookup_domain_sql('host')} AS lookup_domain FROM p6),
j AS (SELECT lk.c_custkey, dtf.* FROM lk LEFT JOIN dtf ON lk.lookup_domain = dtf.domain)
SELECT c_custkey, coalesce(CAST(domain_age_days AS DOUBLE), -1.0) AS domain_age_days,
       coalesce(CAST(domain_expiry_days AS DOUBLE), -1.0) AS domain_expiry_days,
       coalesce(CAST(ssl_days_remaining AS DOUBLE), -1.0) AS ssl_days_remaining,
       CAST(coalesce(CAST(domain_age_days AS DOUBLE), -1.0) = -1 AS INTEGER) AS missing_whois,
       coalesce(CAST(has_ssl AS DOUBLE), -1.0) AS has_ssl, coalesce(CAST(ssl_valid AS DOUBLE), -1.0) AS ssl_valid,
       coalesce(CAST(is_new_domain AS DOUBLE), -1.0) AS is_new_domain,
       coalesce(CAST(short_expiry_domain AS DOUBLE), -1.0) AS short_expiry_domain
FROM j"""

# Max-min formula: the largest, over all starts up to a step, of the smallest mean over all ends from it.
ORACLE["isotonic_calibration"] = """WITH s AS (SELECT CAST(n_chars // 500 AS BIGINT) AS step, count(*) AS n, sum(quality) AS q
  FROM documents JOIN labels USING (doc_id) WHERE quality IN (0, 1) AND n_chars IS NOT NULL GROUP BY 1),
c AS (SELECT *, sum(q) OVER (ORDER BY step) AS cq, sum(n) OVER (ORDER BY step) AS cn FROM s),
g AS (SELECT a.step AS lo, b.step AS hi, (b.cq - a.cq + a.q) / (b.cn - a.cn + a.n) AS mean FROM c a JOIN c b ON a.step <= b.step),
m AS (SELECT c.step, c.n, g.lo, min(g.mean) AS low FROM c JOIN g ON g.lo <= c.step AND g.hi >= c.step GROUP BY ALL)
SELECT step, n AS n_rows, round_even(max(low), 6) AS calibrated FROM m GROUP BY step, n"""
