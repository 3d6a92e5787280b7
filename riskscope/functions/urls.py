"""URL column functions (``Column -> Column``).

Everything is a built-in Spark SQL expression: regexes, ``length``/``replace``
counts and a few higher-order functions over short arrays (host labels,
query keys, distinct URL characters).  No Python worker is involved.

Parsing follows RFC 3986 appendix B with the rules of a common URL splitter:
tab/CR/LF are dropped before splitting, the host is the part of the netloc
after the last ``@`` and before the port, lower-cased, and ``;params`` of the
last path segment are cut from the path.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskscope import dictionaries as D

# Characters that Python-style ``str.strip()`` / ``str.split()`` treat as white
# space: tab..CR, the four separators 0x1c-0x1f, NEL and the Unicode space
# separators (category Z), spelled out as code points.  Written so that Java
# regex and RE2 read it the same way.
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
WS_CLASS = (
    r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

RFC3986 = r"(?s)^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_RE = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
_H = r"[0-9a-f]{1,4}"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
IPV6_RE = (
    "^(?:"
    rf"(?:{_H}:){{7}}{_H}"
    rf"|(?:{_H}:){{1,7}}:"
    rf"|(?:{_H}:){{1,6}}:{_H}"
    rf"|(?:{_H}:){{1,5}}(?::{_H}){{1,2}}"
    rf"|(?:{_H}:){{1,4}}(?::{_H}){{1,3}}"
    rf"|(?:{_H}:){{1,3}}(?::{_H}){{1,4}}"
    rf"|(?:{_H}:){{1,2}}(?::{_H}){{1,5}}"
    rf"|{_H}:(?::{_H}){{1,6}}"
    rf"|:(?:(?::{_H}){{1,7}}|:)"
    rf"|(?:{_H}:){{6}}{_V4}"
    rf"|(?:{_H}:){{1,5}}:{_V4}"
    rf"|::(?:{_H}:){{0,5}}{_V4}"
    ")(?:%.+)?$"
)


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col: Column | str) -> Column:
    """``str.strip()``: remove leading/trailing white space (Unicode aware)."""
    return F.regexp_replace(_c(col), rf"^{WS_CLASS}+|{WS_CLASS}+$", "")


def collapse_ws(col: Column | str) -> Column:
    """``' '.join(s.split())``: runs of white space to one space, trimmed.
    One ``translate`` pass maps every white-space character to a space, then
    only runs of plain spaces are rewritten."""
    spaced = F.translate(_c(col), WS_CHARS, " " * len(WS_CHARS))
    return F.trim(F.regexp_replace(spaced, " {2,}", " "))


def count_substr(col: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal substring."""
    return F.length(col) - F.length(F.replace(col, F.lit(needle), F.lit("")))


# --------------------------------------------------------------------- U1, U2


def normalize_url(col: Column | str) -> Column:
    """Trim; NULL/blank -> ''; prefix ``https://`` unless the URL starts
    (case-sensitively) with ``http://`` or ``https://``."""
    t = F.coalesce(py_strip(_c(col)), F.lit(""))
    return (
        F.when(t == "", F.lit(""))
        .when(t.startswith("http://") | t.startswith("https://"), t)
        .otherwise(F.concat(F.lit("https://"), t))
    )


def parse_url_parts(url: Column | str) -> Column:
    """Split a (normalised) URL into a struct.

    Fields: scheme, netloc, path (``;params`` cut), query, fragment,
    hostname (lower case, no userinfo/port/brackets), valid (False when the
    splitter would reject the URL: unbalanced or malformed IPv6 brackets).
    """
    s = F.regexp_replace(_c(url), "[\t\r\n]", "")
    scheme = F.lower(F.regexp_extract(s, RFC3986, 1))
    netloc = F.regexp_extract(s, RFC3986, 2)
    raw_path = F.regexp_extract(s, RFC3986, 3)
    query = F.regexp_extract(s, RFC3986, 4)
    fragment = F.regexp_extract(s, RFC3986, 5)
    path = F.regexp_replace(raw_path, ";[^/]*$", "")
    hostinfo = F.regexp_extract(netloc, "([^@]*)$", 1)
    hostname = F.lower(
        F.when(hostinfo.contains("["), F.regexp_extract(hostinfo, r"\[([^\]]*)", 1)).otherwise(
            F.regexp_extract(hostinfo, "^([^:]*)", 1)
        )
    )
    open_br = netloc.contains("[")
    close_br = netloc.contains("]")
    bracket_ok = F.when(
        hostinfo.contains("["),
        F.lower(hostinfo).rlike(r"^\[" + IPV6_RE[1:-1] + r"\](?::.*)?$"),
    ).otherwise(F.lit(True))
    valid = (open_br == close_br) & bracket_ok
    return F.struct(
        scheme.alias("scheme"),
        netloc.alias("netloc"),
        path.alias("path"),
        query.alias("query"),
        fragment.alias("fragment"),
        hostname.alias("hostname"),
        valid.alias("valid"),
    )


# ------------------------------------------------------------ host predicates


def is_ip_literal(host: Column) -> Column:
    """Host is an IPv4 (strict dotted quad) or IPv6 literal."""
    return host.rlike(IPV4_RE) | host.rlike(IPV6_RE)


def host_labels(host: Column) -> Column:
    return F.filter(F.split(host, r"\."), lambda x: x != "")


def subdomain_count(host: Column, second_level: Iterable[str] = D.COMMON_SECOND_LEVEL) -> Column:
    """Labels beyond the registered part (approximation without a suffix
    list).  Non-empty labels are counted and picked with code-generated
    regex functions (no lambda)."""
    n = F.size(F.regexp_extract_all(host, F.lit(r"([^.]+)"), 1))
    last = F.regexp_extract(host, r"([^.]+)\.*$", 1)
    second = F.regexp_extract(host, r"([^.]+)\.+[^.]+\.*$", 1)
    return (
        F.when((host == "") | is_ip_literal(host), F.lit(0))
        .when(n <= 2, F.lit(0))
        .when((F.length(last) == 2) & second.isin(*second_level), F.greatest(n - 3, F.lit(0)))
        .otherwise(F.greatest(n - 2, F.lit(0)))
    ).cast("int")


def tld_of(host: Column) -> Column:
    """'.' + last label, or '' when the host has no dot."""
    return F.when(host.contains("."), F.concat(F.lit("."), F.substring_index(host, ".", -1))).otherwise(
        F.lit("")
    )


def uses_free_hosting(host: Column, domains: Iterable[str] = D.FREE_HOSTING_DOMAINS) -> Column:
    """Host equals, or is a subdomain of, a free-hosting domain."""
    h = F.regexp_replace(host, r"^\.+|\.+$", "")
    alt = "|".join(d.replace(".", r"\.") for d in domains)
    return h.rlike(rf"(^|\.)({alt})$").cast("int")


# Non-public address ranges (fixed values of the IANA special-purpose
# registries): private, loopback, link-local, documentation, reserved,
# multicast and the 240/4 block.  Shared space 100.64/10 and 192.0.0.9-10
# count as public; outside 2000::/3, of IPv6 only fec0::/10 does.
PRIVATE_V4_RE = (
    r"^(?:10\.|127\.|0\.|169\.254\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|"
    r"192\.0\.0\.(?:[0-8]|1[1-9]|[2-9][0-9]|[12][0-9][0-9])$|192\.0\.2\.|198\.1[89]\.|"
    r"198\.51\.100\.|203\.0\.113\.|22[4-9]\.|23[0-9]\.|24[0-9]\.|25[0-5]\.)"
)
PRIVATE_V6_RE = (
    r"^(?:[0-9a-f]{0,3}:|[014-9a-e][0-9a-f]{3}:|f[0-9a-df][0-9a-f]{2}:|fe[0-9ab][0-9a-f]:|"
    r"2001::|2001:0{0,2}1?[0-9a-f]{1,2}:|2001:0?db8:|2002:)"
)
# Global exceptions inside 2001::/23.
GLOBAL_V6_RE = r"^(?:2001:0{0,3}1::[12]$|2001:0{0,3}3:|2001:0{0,3}4:0?112:|2001:0{0,2}[23][0-9a-f]:)"


def is_public_host(host: Column) -> Column:
    """Reject empty, localhost and private/loopback/link-local/reserved/
    multicast IPv4 literals and the matching IPv6 ranges."""
    h = F.lower(host)
    v4 = h.rlike(IPV4_RE)
    v6 = h.rlike(IPV6_RE)
    return (
        (h != "")
        & ~h.isin("localhost", "localhost.localdomain")
        & ~(v4 & h.rlike(PRIVATE_V4_RE))
        & ~(v6 & h.rlike(PRIVATE_V6_RE) & ~h.rlike(GLOBAL_V6_RE))
    )


# --------------------------------------------------------------- entropy etc.


def shannon_entropy(u: Column) -> Column:
    """U16: Shannon entropy (bits per character), rounded half-even to 4 dp."""
    n = F.length(u)
    chars = F.array_distinct(F.split(u, ""))

    def step(acc, ch):
        p = (n - F.length(F.replace(u, ch, F.lit("")))) / n
        return acc - p * F.log2(p)

    ent = F.aggregate(chars, F.lit(0.0).cast("double"), step)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.bround(ent, 4))


def digit_letter_ratio(host: Column) -> Column:
    """Digits / letters of the host (4 dp); no letters -> 1.0 if digits."""
    digits = F.length(F.regexp_replace(host, r"[^\p{Nd}]", ""))
    letters = F.length(F.regexp_replace(host, r"[^\p{L}]", ""))
    return (
        F.when(host == "", F.lit(0.0))
        .when(letters == 0, F.when(digits > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
        .otherwise(F.bround(digits / letters, 4))
    )


def longest_digit_run(host: Column) -> Column:
    """Longest run of digits in the host."""
    runs = F.split(host, r"[^\p{Nd}]+")
    return F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r))), F.lit(0)).cast("int")


def percent_decode(raw: Column) -> Column:
    """Percent-decoding that keeps escapes without two hex digits and decodes
    the others; ``+`` is a space, invalid UTF-8 becomes U+FFFD.  Built byte by
    byte, as hex, only where the plain decoder gives up."""
    pieces = F.split(F.replace(raw, F.lit("+"), F.lit(" ")), "%")
    hexed = lambda text: F.hex(F.encode(text, "UTF-8"))

    def piece(p: Column) -> Column:
        good = p.rlike("^[0-9A-Fa-f]{2}")
        return F.when(good, F.concat(F.substring(p, 1, 2), hexed(F.substr(p, F.lit(3))))).otherwise(F.concat(F.lit("25"), hexed(p)))

    rest = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), piece)
    whole = F.unhex(F.concat(hexed(pieces[0]), F.array_join(rest, "")))
    return F.coalesce(F.try_url_decode(raw), F.make_valid_utf8(whole.cast("string")))


def num_query_params(query: Column) -> Column:
    """Number of distinct percent-decoded keys; blank values kept,
    empty segments skipped, ``+`` is a space."""
    segs = F.filter(F.split(query, "&"), lambda x: x != "")

    def key(seg):
        return percent_decode(F.substring_index(seg, "=", 1))

    return F.size(F.array_distinct(F.transform(segs, key))).cast("int")


def path_depth(path_l: Column) -> Column:
    """Non-empty path segments."""
    return F.size(F.regexp_extract_all(path_l, F.lit("([^/]+)"), 1)).cast("int")


def tld_in_path(path_l: Column, tlds: Iterable[str] = D.PATH_TLDS) -> Column:
    """``.com/`` (or ``.com`` at the end) style TLD inside the path."""
    return path_l.rlike(r"(?i)\.(" + "|".join(tlds) + r")(?:/|\z)").cast("int")


def brand_in(text: Column, brands: Iterable[str] = D.BRAND_KEYWORDS) -> Column:
    """Any brand is a substring of ``text`` (host || path, lower case)."""
    out = F.lit(False)
    for b in brands:
        out = out | text.contains(b)
    return out


def brand_hits(text: Column, brands: Iterable[str] = D.BRAND_KEYWORDS) -> Column:
    """Array of brands found in ``text`` (dictionary order)."""
    return F.filter(F.array(*[F.lit(b) for b in brands]), lambda b: F.locate(b, text) > 0)


def official_brand_hit(
    text: Column,
    registered: Column,
    official: Mapping[str, Iterable[str]] = D.OFFICIAL_BRAND_DOMAINS,
) -> Column:
    """True when some brand found in ``text`` owns ``registered``."""
    out = F.lit(False)
    for brand, domains in official.items():
        out = out | (text.contains(brand) & registered.isin(*domains))
    return out


def suspicious_word_count(url_lower: Column, words: Iterable[str] = D.SUSPICIOUS_WORDS) -> Column:
    """How many dictionary words occur (each counted once)."""
    total = F.lit(0)
    for w in words:
        total = total + url_lower.contains(w).cast("int")
    return total.cast("int")


# ---------------------------------------------------- U23 registered domain


def suffix_sets(rules: Iterable[tuple[str, str]]) -> tuple[list[str], list[str], list[str]]:
    exact, wild, exc = [], [], []
    for suffix, kind in rules:
        {"exact": exact, "wildcard": wild, "exception": exc}[kind].append(suffix.lower())
    return exact, wild, exc


def public_suffix_labels(host: Column, rules: Iterable[tuple[str, str]] = D.BUILTIN_SUFFIXES) -> Column:
    """Number of labels of the longest matching public-suffix rule (0 = none).

    Exact rule ``c``; wildcard ``*.p`` matches any ``x.p`` that is not an
    exception; exception ``!e`` makes ``parent(e)`` the suffix and wins.
    Candidates are the last ``j`` labels (``substring_index(host, '.', -j)``)
    for ``j`` up to the deepest rule, tested against literal hash sets: a
    code-generated projection, no lambda, no join, no shuffle, however
    skewed the hosts are."""
    exact, wild, exc = suffix_sets(rules)
    depth = max(
        [len(r.split(".")) for r in exact]
        + [len(r.split(".")) + 1 for r in wild]
        + [len(r.split(".")) for r in exc]
        + [1]
    )
    n = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1

    def in_set(c, values):
        return c.isin(*values) if values else F.lit(False)

    cand = {j: F.substring_index(host, ".", -j) for j in range(1, depth + 1)}
    normal = F.lit(0)
    for j in range(1, depth + 1):
        hit = in_set(cand[j], exact)
        if j >= 2 and wild:
            hit = hit | (in_set(cand[j - 1], wild) & ~in_set(cand[j], exc))
        normal = F.when((n >= j) & hit, F.lit(j)).otherwise(normal)
    if exc:
        exception = F.lit(0)
        for j in range(1, depth + 1):
            exception = F.when((n >= j) & in_set(cand[j], exc), F.lit(j - 1)).otherwise(exception)
        normal = F.when(exception > 0, exception).otherwise(normal)
    return F.when(host == "", F.lit(0)).otherwise(normal)


def registered_domain(host: Column, rules: Iterable[tuple[str, str]] = D.BUILTIN_SUFFIXES) -> Column:
    """eTLD+1 of the host; the host itself when no suffix or no label
    before it (IP literals, unknown TLDs, bare suffixes)."""
    rules = tuple(rules)
    k = public_suffix_labels(host, rules)
    n = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    depth = max([len(r.split(".")) + 1 for r, _ in rules] + [1])
    out = host
    for j in range(depth, 0, -1):
        out = F.when((k == j) & (n > j), F.substring_index(host, ".", -(j + 1))).otherwise(out)
    return out


def lookup_domain(host: Column, rules: Iterable[tuple[str, str]] = D.BUILTIN_SUFFIXES) -> Column:
    """Registered domain for WHOIS/TLS lookups.  Without a known suffix:
    last three labels for ``x.co.uk`` shapes, else the last two."""
    rules = tuple(rules)
    k = public_suffix_labels(host, rules)
    labels = host_labels(host)
    raw = F.split(host, r"\.")
    n = F.size(raw)
    m = F.size(labels)
    fallback = (
        F.when(
            (m >= 3)
            & (F.length(F.element_at(labels, -1)) == 2)
            & F.element_at(labels, -2).isin(*D.COMMON_SECOND_LEVEL),
            F.array_join(F.slice(labels, -3, 3), "."),
        )
        .when(m >= 2, F.array_join(F.slice(labels, -2, 2), "."))
        .otherwise(host)
    )
    return F.when((k > 0) & (n > k), F.array_join(F.slice(raw, n - k, k + 1), ".")).otherwise(fallback)


# ------------------------------------------------------------ U27, U28, U1b


def dedupe_key(url_norm: Column) -> Column:
    """``rstrip('/')`` then lower case."""
    return F.lower(F.regexp_replace(url_norm, "/+$", ""))


def homepage_url(url: Column) -> Column:
    """Scheme://netloc/ (the URL itself when scheme or netloc is empty)."""
    s = F.regexp_replace(url, "[\t\r\n]", "")
    scheme = F.lower(F.regexp_extract(s, RFC3986, 1))
    netloc = F.regexp_extract(s, RFC3986, 2)
    return F.when((scheme == "") | (netloc == ""), url).otherwise(
        F.concat(scheme, F.lit("://"), netloc, F.lit("/"))
    )


def canonical_url(url: Column) -> Column:
    """U1, then '' when there is no netloc; netloc trimmed and lower
    case; empty path becomes '/'."""
    u = normalize_url(url)
    s = F.regexp_replace(u, "[\t\r\n]", "")
    scheme = F.lower(F.regexp_extract(s, RFC3986, 1))
    netloc = F.regexp_extract(s, RFC3986, 2)
    path = F.regexp_extract(s, RFC3986, 3)
    query = F.regexp_extract(s, RFC3986, 4)
    frag = F.regexp_extract(s, RFC3986, 5)
    has_q = s.rlike(r"^[^#]*\?")
    has_f = s.contains("#")
    rebuilt = F.concat(
        scheme,
        F.lit("://"),
        F.lower(py_strip(netloc)),
        F.when(path == "", F.lit("/")).otherwise(path),
        F.when(has_q & (query != ""), F.concat(F.lit("?"), query)).otherwise(F.lit("")),
        F.when(has_f & (frag != ""), F.concat(F.lit("#"), frag)).otherwise(F.lit("")),
    )
    return F.when(netloc == "", F.lit("")).otherwise(rebuilt)
