"""HTML column functions: boilerplate removal, title, meta description,
visible text and link count, all with Spark regex expressions.

The rules follow a tolerant HTML parser: 11 boilerplate tags are removed with
their content, comments are dropped, text is taken from ``<body>`` (or the
whole document when there is none), text pieces are joined by one space and
white space is collapsed.  Brackets in quoted attribute values are stepped
over, an element left open drops the rest of the page, and pages with nested
boilerplate of one name are scanned tag by tag with a running depth.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskscope import dictionaries as D
from riskscope.functions.urls import collapse_ws

# Named character references of HTML 4 by the standard library's table, and
# the apostrophe.  A no-break space counts as a blank.
NAMED = {name: " " if code == 160 else chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}
# HTML 5's further names, by the standard library's table.
NAMED_5 = {name[:-1]: chars for name, chars in html5.items() if name.endswith(";") and name[:-1] not in NAMED}
REFERENCE_RE = r"^(#[xX][0-9A-Fa-f]{1,8}|#[0-9]{1,9}|[A-Za-z][A-Za-z0-9]*);"

# The rest of a start tag up to its bracket: a quote counts after ``=`` only.
# The bound on the pieces keeps the matcher's stack small.
ATTRS = r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["']){0,2000}+"""
TAG_RE = rf"<(?:[A-Za-z]{ATTRS}|/[A-Za-z][^>]*|![^>]*|\?[^>]*)>"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _code_point(code: Column) -> Column:
    """The character of a code point; U+FFFD where there is none."""
    good = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(F.when(good, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")
    return F.when(code == 160, F.lit(" ")).otherwise(char)


def decode_entities(col: Column) -> Column:
    """Character references decoded once each (``&amp;lt;`` gives ``&lt;``):
    the text is cut at ``&``, and a piece that begins with a reference gets
    its character.  Texts without ``&`` stay as they are."""
    named, more = (F.from_json(F.lit(json.dumps(table)), "map<string,string>") for table in (NAMED, NAMED_5))

    def piece(p: Column) -> Column:
        ref = F.regexp_extract(p, REFERENCE_RE, 1)
        code = F.when(ref.rlike("^#[xX]"), F.conv(F.substr(ref, F.lit(3)), 16, 10)).otherwise(F.substr(ref, F.lit(2))).try_cast("long")
        char = F.when(ref.startswith("#"), _code_point(code)).when(ref != "", F.coalesce(F.try_element_at(named, ref), F.try_element_at(more, ref)))
        return F.coalesce(F.concat(char, F.substr(p, F.length(ref) + 2)), F.concat(F.lit("&"), p))

    pieces = F.split(col, "&")
    rest = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), piece)
    return F.when(col.contains("&"), F.concat(pieces[0], F.array_join(rest, ""))).otherwise(col)


def boilerplate_re(tags: Iterable[str] = D.DROPPED_TAGS) -> str:
    """Comments and whole boilerplate elements, leftmost first, so that a tag
    inside a comment opens nothing.  A name ends at a blank, slash or bracket
    (``<header-bar>`` is no header).  An element left open goes on to the end."""
    alt = "|".join(tags)
    return rf"(?is)<!--.*?-->|<({alt})(?=[\s/>]){ATTRS}(?:(?<=/)>|>.*?(?:</\1\s*>|\z))"


def _boilerplate_token_re(tags: Iterable[str]) -> str:
    """Single boilerplate tags; comments, scripts and styles whole."""
    alt = "|".join(tags)
    return rf"(?is)<!--.*?-->|<(script|style)(?=[\s/>]){ATTRS}(?:(?<=/)>|>.*?(?:</\1\s*>|\z))|</?(?:{alt})(?=[\s/>]){ATTRS}>"


def _strip_nested(html: Column, tags: Iterable[str]) -> Column:
    """The text outside boilerplate, by a running depth: inside an element only
    tags of its own name count."""
    token = F.lit(_boilerplate_token_re(tags))
    pieces, found = F.split(html, token), F.regexp_extract_all(html, token, F.lit(0))

    def step(state: Column, at: Column) -> Column:
        tag, depth = at["tag"], state["depth"]
        name = F.lower(F.regexp_extract(tag, "^</?([A-Za-z]+)", 1))
        whole = (name == "") | name.isin("script", "style") | tag.endswith("/>")
        change = F.when(whole, 0).when(tag.startswith("</"), F.when((depth > 0) & (name == state["name"]), -1).otherwise(0))
        change = change.otherwise(F.when((depth == 0) | (name == state["name"]), 1).otherwise(0))
        return F.struct(
            F.when(depth == 0, F.concat(state["out"], at["text"], F.lit(" "))).otherwise(state["out"]).alias("out"),
            F.when((depth == 0) & (change > 0), name).otherwise(state["name"]).alias("name"),
            (depth + change).cast("int").alias("depth"),
        )

    start = F.struct(F.lit("").alias("out"), F.lit("").alias("name"), F.lit(0).alias("depth"))
    steps = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda text, tag: F.struct(text.alias("text"), tag.alias("tag")))
    end = lambda state: F.when(state["depth"] == 0, F.concat(state["out"], F.element_at(pieces, -1))).otherwise(state["out"])
    return F.aggregate(steps, start, step, end)


def strip_boilerplate(html: Column | str, tags: Iterable[str] = D.DROPPED_TAGS) -> Column:
    """H2: remove comments and the boilerplate tags with their content in one
    pass, leftmost first.  Each removed piece becomes a space.  Nested elements
    of one name leave a closing tag over; only such pages are scanned again."""
    tags = tuple(tags)
    page = F.coalesce(_c(html), F.lit(""))
    over = rf"(?i)</(?:{'|'.join(tags)})(?=[\s/>])"
    once = F.regexp_replace(page, boilerplate_re(tags), " ")
    # As an element of an array, so that it is computed once.
    return F.transform(F.array(once), lambda x: F.when(x.rlike(over), _strip_nested(page, tags)).otherwise(x))[0]


def title(clean_html: Column) -> Column:
    """H3: text of the first ``<title>``; '' when empty or when it holds
    markup (then it has no single string)."""
    raw = F.regexp_extract(clean_html, rf"(?is)<title\b{ATTRS}>(.*?)</title\s*>", 1)
    return F.when(raw.contains("<"), F.lit("")).otherwise(collapse_ws(decode_entities(raw)))


def _attr(tag: Column, name: str) -> Column:
    pat = rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    return F.concat(F.regexp_extract(tag, pat, 1), F.regexp_extract(tag, pat, 2), F.regexp_extract(tag, pat, 3))


def meta_description(clean_html: Column) -> Column:
    """H4: ``content`` of the first ``<meta name=description>`` (value
    compared ignoring case), else of ``<meta property="og:description">``."""
    by_name = F.regexp_extract(
        clean_html,
        r"""(?is)(<meta\b[^>]*?\sname\s*=\s*(?:"description"|'description'|description(?=[\s/>]))[^>]*>)""",
        1,
    )
    by_prop = F.regexp_extract(
        clean_html,
        r"""(?s)(<meta\b[^>]*?\s(?i:property)\s*=\s*(?:"og:description"|'og:description'|og:description(?=[\s/>]))[^>]*>)""",
        1,
    )
    tag = F.when(by_name != "", by_name).otherwise(by_prop)
    return F.when(tag == "", F.lit("")).otherwise(collapse_ws(decode_entities(_attr(tag, "content"))))


def body_html(clean_html: Column) -> Column:
    """Inner HTML of the first ``<body>`` (to ``</body>`` or the end), or the
    whole document when there is no body."""
    has_body = clean_html.rlike(r"(?i)<body\b")
    inner = F.regexp_extract(clean_html, rf"(?is)<body\b{ATTRS}>(.*?)(?:</body\s*>|$)", 1)
    return F.when(has_body, inner).otherwise(clean_html)


def visible_text(clean_html: Column) -> Column:
    """H5: body text pieces joined by one space, entities decoded, white
    space collapsed."""
    no_tags = F.regexp_replace(body_html(clean_html), TAG_RE, " ")
    return collapse_ws(decode_entities(no_tags))


def link_count(clean_html: Column) -> Column:
    """H6: ``<a>`` tags with an ``href`` attribute left after H2."""
    return F.regexp_count(clean_html, F.lit(r"(?i)<a\s(?:[^>]*\s)?href(?:\s*=|[\s/>])")).cast("int")


def has_tag(raw_html: Column, tag: str) -> Column:
    """H9: the raw page contains ``<tag`` (ignoring case)."""
    return F.coalesce(raw_html, F.lit("")).rlike(rf"(?i)<{tag}\b").cast("int")


def looks_like_html(content_type: Column, body: Column) -> Column:
    """H1 content check: html/xhtml type, ``<html``/``<body`` in the first
    1000 characters, text/plain with ``<`` and ``>``, or no type; never
    image/video/pdf."""
    ct = F.lower(F.coalesce(content_type, F.lit("")))
    start = F.lower(F.substring(F.coalesce(body, F.lit("")), 1, 1000))
    probably = (
        ct.contains("text/html")
        | ct.contains("application/xhtml+xml")
        | start.contains("<html")
        | start.contains("<body")
        | (ct.contains("text/plain") & start.contains("<") & start.contains(">"))
        | (ct == "")
    )
    blocked = ct.contains("image/") | ct.contains("video/") | ct.contains("application/pdf")
    return probably & ~blocked
