"""Domain operators over WHOIS text and certificate tables.

Live WHOIS/TLS probes become two tables: ``whois_raw(domain, raw[, ord])``
and ``certs(domain, reachable, verified, not_after)``.  Features are computed
once per distinct domain (partial aggregation, so a hot domain does not
skew) and joined back with :func:`join_skew_safe`.  ``as_of`` replaces "now"
so results repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskscope.functions.urls import lookup_domain, parse_url_parts, py_strip
from riskscope.operators.joins import join_skew_safe

# ---------------------------------------------------------------------------
# FIXED VALUES — WHOIS field patterns (tried in order) and date formats.
# ---------------------------------------------------------------------------
CREATION_PATTERNS = (
    r"(?i)(?:Creation Date|Created On|Domain Registration Date|Registered On):\s*(.+)",
    r"(?i)(?:Created|Registered):\s*(.+)",
)
EXPIRY_PATTERNS = (
    r"(?i)(?:Expir(?:y|ation) Date|Registrar Registration Expiration Date|Registry Expiry Date|Paid-till):\s*(.+)",
    r"(?i)(?:Expires On|Expiry):\s*(.+)",
)
REGISTRAR_PATTERNS = (
    r"(?i)Registrar:\s*(.+)",
    r"(?i)Registrar Name:\s*(.+)",
    r"(?i)Sponsoring Registrar:\s*(.+)",
)
# strptime formats in order, written as Spark datetime patterns (one letter
# for day/month/hour/minute/second so single digits parse as well).
DATE_FORMATS = (
    "yyyy-M-d'T'H:m:s", "yyyy-M-d H:m:s", "yyyy/M/d H:m:s", "yyyy/M/d", "yyyy-M-d", "d-MMM-yyyy",
    "d-MMM-yyyy H:m:s", "d.M.yyyy", "d/M/yyyy", "M/d/yyyy", "MMM d yyyy",
)
# Shape of each format: a format is only tried on text of its shape, so a
# failed parse (an exception inside the parser) is never the common case.
_D, _T = r"[0-9]{1,2}", r"[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}"
DATE_SHAPES = (
    rf"^[0-9]{{4}}-{_D}-{_D}T{_T}$", rf"^[0-9]{{4}}-{_D}-{_D} {_T}$", rf"^[0-9]{{4}}/{_D}/{_D} {_T}$",
    rf"^[0-9]{{4}}/{_D}/{_D}$", rf"^[0-9]{{4}}-{_D}-{_D}$", rf"^{_D}-[A-Za-z]{{3}}-[0-9]{{4}}$",
    rf"^{_D}-[A-Za-z]{{3}}-[0-9]{{4}} {_T}$", rf"^{_D}\.{_D}\.[0-9]{{4}}$", rf"^{_D}/{_D}/[0-9]{{4}}$",
    rf"^{_D}/{_D}/[0-9]{{4}}$", rf"^[A-Za-z]{{3}} {_D} [0-9]{{4}}$",
)
SHORT_DAYS = 180
REGISTRAR_MAX = 255
# ---------------------------------------------------------------------------

DOMAIN_FEATURES = (
    "domain_age_days", "domain_expiry_days", "registrar", "missing_whois", "has_ssl", "ssl_valid",
    "ssl_days_remaining", "short_expiry_domain", "is_new_domain",
)


def first_match(raw: Column, patterns) -> Column:
    """First pattern whose first match has a non-blank group 1 (stripped)."""
    vals = [F.nullif(py_strip(F.regexp_extract(raw, p, 1)), F.lit("")) for p in patterns]
    return F.coalesce(*vals)


def clean_date_text(raw: Column, strict: bool = False) -> Column:
    """Clean-up before format matching.

    ``strict=True`` reproduces the original steps exactly (which also cut
    ``15.01.2024`` to ``15.01`` and ``15-Jan-2024`` to ``15-Jan``).  The
    default applies the fraction / zone / offset cuts only after a time of
    day, so date-only values survive."""
    s = py_strip(raw)
    s = F.regexp_replace(F.regexp_replace(s, '^"+|"+$', ""), "^'+|'+$", "")
    s = py_strip(F.replace(F.replace(s, F.lit("(UTC)"), F.lit("")), F.lit(" UTC"), F.lit("")))
    if strict:
        s = F.regexp_replace(s, r"\.\d+$", "")
        s = F.regexp_replace(s, r"\s+[A-Z]{2,5}$", "")
        s = py_strip(F.regexp_replace(s, r"([+-]\d{2}):?(\d{2})$", ""))
        return py_strip(F.regexp_replace(s, "Z+$", ""))
    t = r"(\d{1,2}:\d{1,2}:\d{1,2})"
    s = F.regexp_replace(s, t + r"\.\d+", "$1")
    s = F.regexp_replace(s, t + r"\s+[A-Z]{2,5}$", "$1")
    s = F.regexp_replace(s, t + r"\s*[+-]\d{2}:?\d{2}$", "$1")
    s = F.regexp_replace(s, t + r"\.\d+", "$1")
    return py_strip(F.regexp_replace(s, "Z+$", ""))


def parse_domain_date(raw: Column, strict: bool = False) -> Column:
    """D3: timestamp (UTC) of the first format that parses, else NULL."""
    return parse_clean_date(clean_date_text(raw, strict))


def parse_clean_date(s: Column) -> Column:
    """D3 on already cleaned text (stage the cleaning in its own projection)."""
    return F.coalesce(
        *[F.when(s.rlike(shape), F.try_to_timestamp(s, F.lit(f))) for f, shape in zip(DATE_FORMATS, DATE_SHAPES)]
    )


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days, floored (as a timedelta's ``days``)."""
    return F.floor((F.unix_seconds(later) - F.unix_seconds(earlier)) / F.lit(86400)).cast("int")


def parse_whois(df: DataFrame, raw_col: str = "raw", *, as_of: str, strict_dates: bool = False) -> DataFrame:
    """D2 + D4 per WHOIS record: domain_age_days, domain_expiry_days,
    registrar, missing_whois.  Blank text, or "Connecting to" without a
    ``Registrar:`` line, counts as no answer."""
    raw = F.coalesce(F.col(raw_col), F.lit(""))
    usable = (py_strip(raw) != "") & ~(raw.contains("Connecting to") & ~raw.contains("Registrar:"))
    now = F.to_timestamp(F.lit(as_of))
    # Staged so each cleaned date string is computed once: inside when /
    # coalesce branches Spark does not share common subexpressions.
    staged = (
        df.withColumn("_ok", usable)
        .withColumns(
            {
                "_cr": F.when(F.col("_ok"), first_match(raw, CREATION_PATTERNS)),
                "_er": F.when(F.col("_ok"), first_match(raw, EXPIRY_PATTERNS)),
                "_r": F.when(F.col("_ok"), F.substring(first_match(raw, REGISTRAR_PATTERNS), 1, REGISTRAR_MAX)),
            }
        )
        .withColumns({"_cs": clean_date_text(F.col("_cr"), strict_dates), "_es": clean_date_text(F.col("_er"), strict_dates)})
        .withColumns({"_c": parse_clean_date(F.col("_cs")), "_e": parse_clean_date(F.col("_es"))})
        .drop("_ok", "_cr", "_er", "_cs", "_es")
    )
    return staged.withColumns(
        {
            # greatest() skips NULLs, so the unknown case is handled first
            "domain_age_days": F.when(F.col("_c").isNull(), F.lit(-1)).otherwise(
                F.greatest(days_between(now, F.col("_c")), F.lit(0))
            ),
            "domain_expiry_days": F.coalesce(days_between(F.col("_e"), now), F.lit(-1)),
            "registrar": F.coalesce(F.col("_r"), F.lit("")),
            "missing_whois": F.when(
                F.col("_c").isNotNull() | F.col("_e").isNotNull() | F.col("_r").isNotNull(), 0
            ).otherwise(1),
        }
    ).drop("_c", "_e", "_r")


def whois_features(whois_raw: DataFrame, *, as_of: str, strict_dates: bool = False) -> DataFrame:
    """One row per domain: the first record (by ``ord``) that is not
    missing, else the first record.  ``groupBy`` with ``min_by`` combines
    map-side, so a domain with millions of records stays cheap."""
    parsed = parse_whois(whois_raw, as_of=as_of, strict_dates=strict_dates)
    order = F.struct(F.col("missing_whois"), F.col("ord") if "ord" in whois_raw.columns else F.lit(0))
    best = F.min_by(F.struct("domain_age_days", "domain_expiry_days", "registrar", "missing_whois"), order)
    return parsed.groupBy("domain").agg(best.alias("w")).select("domain", "w.*")


def ssl_features(certs: DataFrame, *, as_of: str) -> DataFrame:
    """has_ssl, ssl_valid, ssl_days_remaining per domain."""
    now = F.to_timestamp(F.lit(as_of))
    valid = F.col("reachable") & F.col("verified")
    return certs.select(
        "domain",
        F.col("reachable").cast("int").alias("has_ssl"),
        valid.cast("int").alias("ssl_valid"),
        F.when(valid & F.col("not_after").isNotNull(), days_between(F.col("not_after").cast("timestamp"), now))
        .otherwise(F.lit(-1))
        .alias("ssl_days_remaining"),
    )


def with_flags(df: DataFrame) -> DataFrame:
    """short_expiry_domain, is_new_domain."""
    e, a = F.col("domain_expiry_days"), F.col("domain_age_days")
    return df.withColumns(
        {
            "short_expiry_domain": ((e != -1) & (e < SHORT_DAYS)).cast("int"),
            "is_new_domain": ((a != -1) & (a < SHORT_DAYS)).cast("int"),
        }
    )


def empty_domain_defaults() -> dict[str, Column]:
    """Values for domains without any data."""
    return {
        "domain_age_days": F.lit(-1),
        "domain_expiry_days": F.lit(-1),
        "registrar": F.lit(""),
        "missing_whois": F.lit(1),
        "has_ssl": F.lit(0),
        "ssl_valid": F.lit(0),
        "ssl_days_remaining": F.lit(-1),
        "short_expiry_domain": F.lit(0),
        "is_new_domain": F.lit(0),
    }


def domain_table(whois_raw: DataFrame, certs: DataFrame, *, as_of: str, strict_dates: bool = False) -> DataFrame:
    """D2-D6 per domain (full outer join of the two sources, defaults for
    the missing side)."""
    w = whois_features(whois_raw, as_of=as_of, strict_dates=strict_dates)
    s = ssl_features(certs, as_of=as_of)
    j = w.join(s, "domain", "full")
    d = empty_domain_defaults()
    j = j.select("domain", *[F.coalesce(F.col(c), d[c]).alias(c) for c in DOMAIN_FEATURES if c not in ("short_expiry_domain", "is_new_domain")])
    return with_flags(j).select("domain", *[F.col(c).cast("string" if c == "registrar" else "int").alias(c) for c in DOMAIN_FEATURES])


def with_domain_features(
    df: DataFrame, domains: DataFrame, url_col: str = "url", *, hot_key_rows: int = 100_000
) -> DataFrame:
    """D1 + D7: registered lookup domain of each URL, joined to the domain
    table; URLs without data get the defaults.  A few registrable domains
    can hold most URLs, so the join splits hot keys off and broadcasts
    their (few) domain rows."""
    host = parse_url_parts(F.col(url_col))["hostname"]
    keyed = df.withColumn("lookup_domain", lookup_domain(host))
    right = domains.withColumnRenamed("domain", "lookup_domain")
    j = join_skew_safe(keyed, right, "lookup_domain", hot_key_rows=hot_key_rows)
    d = empty_domain_defaults()
    return j.withColumns({c: F.coalesce(F.col(c), d[c]) for c in DOMAIN_FEATURES})


def impute_domain(df: DataFrame) -> DataFrame:
    """Cast and fill as a batch scorer does: day counts and the six
    flags NULL -> -1, ``missing_whois := age == -1``, counts -> 0, ratios ->
    0.0; only columns that exist are touched."""
    cols = set(df.columns)
    exprs = {}
    for c in ("domain_age_days", "domain_expiry_days", "ssl_days_remaining"):
        if c in cols:
            exprs[c] = F.coalesce(F.col(c).try_cast("double"), F.lit(-1.0))
    staged = df.withColumns(exprs) if exprs else df
    exprs = {}
    if "domain_age_days" in cols:
        exprs["missing_whois"] = (F.col("domain_age_days") == -1).cast("int")
    for c in ("has_ssl", "ssl_valid", "is_new_domain", "short_expiry_domain", "has_form", "has_iframe"):
        if c in cols:
            exprs[c] = F.coalesce(F.col(c).try_cast("double"), F.lit(-1.0))
    for c in ("text_length", "token_count", "scam_keyword_count", "exclamation_count"):
        if c in cols:
            exprs[c] = F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    for c in ("scam_keyword_density", "caps_ratio", "avg_word_length"):
        if c in cols:
            exprs[c] = F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    return staged.withColumns(exprs) if exprs else staged
