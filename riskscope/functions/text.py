"""Text column functions for the content features."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskscope import dictionaries as D
from riskscope.functions.urls import WS_CHARS, collapse_ws, count_substr, py_strip


def weighted_text(title: Column, text: Column, weight: int = D.TITLE_WEIGHT) -> Column:
    """``((title + ' ') * w + text).strip()`` with w >= 1."""
    w = max(int(weight), 1)
    t = py_strip(F.coalesce(title, F.lit("")))
    x = py_strip(F.coalesce(text, F.lit("")))
    return py_strip(F.concat(F.repeat(F.concat(t, F.lit(" ")), w), x))


def normalize_text(col: Column) -> Column:
    """Lower case, ASCII punctuation and white space to single spaces
    (one ``translate`` pass for both), runs collapsed, trimmed."""
    chars = D.ASCII_PUNCTUATION + WS_CHARS
    return F.trim(F.regexp_replace(F.translate(F.lower(col), chars, " " * len(chars)), " {2,}", " "))


def clean_tokens(normalized: Column, stop_words: Iterable[str] = D.ENGLISH_STOP_WORDS) -> Column:
    """Tokens of the normalised text without stop words."""
    stops = tuple(stop_words)
    return F.filter(F.split(normalized, " "), lambda x: (x != "") & ~x.isin(*stops))


def split_keywords(keywords: Iterable[str]) -> tuple[list[str], list[str]]:
    kws = list(dict.fromkeys(keywords))
    return [k for k in kws if " " not in k], [k for k in kws if " " in k]


def keyword_hits(tokens: Column, normalized: Column, keywords: Iterable[str] = D.SCAM_KEYWORDS) -> Column:
    """C4: single words counted on the stop-word-free tokens; phrases counted
    as whole-word, non-overlapping matches in the normalised text (stop words
    kept).  Repeats count.  A cheap ``contains`` guards each phrase regex."""
    singles, phrases = split_keywords(keywords)
    total = F.lit(0)
    if singles:
        total = total + F.size(F.filter(tokens, lambda x: x.isin(*singles)))
    for ph in phrases:
        pat = r"(?U)(?<!\w)" + re.escape(ph).replace(r"\ ", " ") + r"(?!\w)"
        total = total + F.when(normalized.contains(ph), F.regexp_count(normalized, F.lit(pat))).otherwise(F.lit(0))
    return total.cast("int")


def caps_ratio(text: Column) -> Column:
    """Upper-case letters / letters (4 dp), 0.0 without letters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    upper = F.length(F.regexp_replace(text, r"[^\p{Lu}]", ""))
    return F.when(letters == 0, F.lit(0.0)).otherwise(F.bround(upper / letters, 4))


def avg_word_length(tokens: Column) -> Column:
    """Mean token length (3 dp), 0.0 without tokens."""
    n = F.size(tokens)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.bround(F.length(F.array_join(tokens, "")) / n, 3))


def exclamations(text: Column) -> Column:
    return count_substr(text, "!")


def combined_text(title: Column, text: Column) -> Column:
    """C11: title and text joined by a space, blanks skipped."""
    t = py_strip(F.coalesce(title, F.lit("")))
    x = py_strip(F.coalesce(text, F.lit("")))
    return py_strip(F.concat_ws(" ", F.when(t != "", t), F.when(x != "", x)))
