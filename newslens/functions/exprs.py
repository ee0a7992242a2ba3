"""Column expressions.

Every function here takes and returns `Column`s built from native Spark SQL
functions, so they stay inside whole-stage code generation and are pushed
through Catalyst like any hand-written expression.  Patterns are written in the
subset shared by Java regex and RE2; the DuckDB twins in `newslens.plans.oracle`
write theirs out anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from newslens import schema as S

# Python's `str.strip()` whitespace set, as a character class.
PY_WS = r"[\t\n\x{0b}\x{0c}\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TRIM_PATTERN = rf"^{PY_WS}+|{PY_WS}+$"
# A term: a maximal run of letters and digits.
WORD_PATTERN = r"[\p{L}\p{N}]+"
NON_WORD_PATTERN = r"[^\p{L}\p{N}]+"
# One blank character as Java's `\s` defines it (RE2's `\s` lacks \x0b).
BLANK = r"[ \t\n\x{0b}\x{0c}\r]"
# What Python's int() accepts: blanks, sign, decimal digits, single underscores.
INT_PATTERN = rf"^{PY_WS}*[+-]?\p{{Nd}}+(_\p{{Nd}}+)*{PY_WS}*$"
# Host part of an absolute URL.
HOST_PATTERN = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)"
# Fixed value: the URL pattern the fetcher uses to rebuild its seen set.
URL_IN_TEXT_PATTERN = r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\(\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


# P1 -------------------------------------------------------------------------
def content_text(content: str | Column, sep: str = "") -> Column:
    """Join paragraphs: no separator for analysis, a blank for token files."""
    return F.concat_ws(sep, col_(content))


# P3 / P4 --------------------------------------------------------------------
def parse_pub_time(text: str | Column, fmt: str = S.TIME_FORMAT) -> Column:
    """Publish time as TIMESTAMP_NTZ; the sentinel or bad text gives null."""
    return F.try_to_timestamp(col_(text), F.lit(fmt)).cast("timestamp_ntz")


def age_minutes(ts: str | Column, now: str | Column) -> Column:
    """Whole minutes from `ts` to `now`, truncated toward zero."""
    now_c = F.lit(now).cast("timestamp_ntz") if isinstance(now, str) else now
    return F.timestamp_diff("MINUTE", col_(ts), now_c)


# URL helpers (P5-P7, P11) ---------------------------------------------------
def url_host(url: str | Column) -> Column:
    return F.lower(F.regexp_extract(col_(url), HOST_PATTERN, 1))


def url_section(url: str | Column) -> Column:
    """Second host label if it is `news`, else the first label."""
    labels = F.split(url_host(url), r"\.")
    return F.when(F.get(labels, 1) == F.lit(S.NEWS_SECTION), F.lit(S.NEWS_SECTION)) \
        .otherwise(F.get(labels, 0))


def canonical_url(url: str | Column) -> Column:
    """Cut the query string and the fragment."""
    return F.regexp_replace(col_(url), r"[?#].*$", "")


def url_province(url: str | Column) -> Column:
    """`nation` unless the URL carries `.news`, else the first host label."""
    u = col_(url)
    return F.when(~u.contains(".news"), F.lit("nation")) \
        .otherwise(F.get(F.split(url_host(u), r"\."), 0))


def url_allowed(url: str | Column, domains: Iterable[str], pattern: str) -> Column:
    """Host ends with one of `domains` (or equals it) and the URL matches `pattern`."""
    host = url_host(url)
    ok = F.lit(False)
    for d in domains:
        d = d.lower().lstrip(".")
        ok = ok | (host == F.lit(d)) | host.endswith("." + d)
    return ok & col_(url).rlike(pattern)


# Text cleaning (P8, P9, P13) -------------------------------------------------
def py_strip(text: str | Column) -> Column:
    """Python `str.strip()`: also removes U+3000, NBSP and the other Unicode blanks."""
    return F.regexp_replace(col_(text), TRIM_PATTERN, "")


def clean_time(text: str | Column) -> Column:
    """Strip, then right-strip every character of the time trailer (a set)."""
    trailer = "".join(sorted(set(S.TIME_TRAILER)))
    klass = "[" + trailer.replace("\\", "\\\\").replace("]", "\\]") + "]+$"
    return F.regexp_replace(py_strip(text), klass, "")


def trim_all(arr: str | Column) -> Column:
    """Strip every paragraph of an array."""
    return F.transform(col_(arr), lambda x: py_strip(x))


def with_default(value: str | Column) -> Column:
    """Missing or blank → the sentinel `#`."""
    return F.coalesce(F.nullif(py_strip(value), F.lit("")), F.lit(S.MISSING))


# P10 ------------------------------------------------------------------------
def is_int_token(tok: str | Column) -> Column:
    """True when Python's `int()` would accept the token."""
    return col_(tok).rlike(INT_PATTERN)


# P16 ------------------------------------------------------------------------
def urls_in_text(text: str | Column) -> Column:
    """Array of every URL in a text blob."""
    return F.regexp_extract_all(col_(text), F.lit(URL_IN_TEXT_PATTERN), 0)


# P17-P19 --------------------------------------------------------------------
def month_day(ts: str | Column) -> Column:
    return F.date_format(col_(ts), "MM-dd")


def hour_of(ts: str | Column) -> Column:
    return F.hour(col_(ts))


def hour_label(h: str | Column) -> Column:
    hc = col_(h)
    return F.format_string("%d:00-%d:00", hc, hc + 1)


def minute_key(ts: str | Column, fmt: str = S.MINUTE_KEY_FORMAT) -> Column:
    return F.date_format(col_(ts), fmt)


# T1 -------------------------------------------------------------------------
def segment(text: str | Column, mode: str = "words") -> Column:
    """Array of lower-cased terms.

    words       maximal runs of letters/digits (default; language neutral)
    space       blank-separated tokens, empty ones dropped
    cjk_bigram  like `words`, but runs of Han characters become overlapping
                character bigrams (a dictionary-free stand-in for word
                segmentation of Chinese)
    """
    low = F.lower(col_(text))
    if mode == "words":
        # Cutting at runs of non-word characters yields the maximal word runs
        # (plus empty ends, dropped); ~3x cheaper than extracting every match.
        return F.filter(F.split(low, NON_WORD_PATTERN), lambda x: F.length(x) > 0)
    if mode == "space":
        return F.filter(F.split(low, r"\s+"), lambda x: F.length(x) > 0)
    if mode == "cjk_bigram":
        runs = F.regexp_extract_all(low, F.lit(r"\p{IsHan}+|[\p{L}\p{N}&&[^\p{IsHan}]]+"), 0)

        def expand(t: Column) -> Column:
            n = F.length(t)
            bigrams = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(t, i, 2))
            return F.when(t.rlike(r"^\p{IsHan}") & (n > 1), bigrams).otherwise(F.array(t))

        return F.flatten(F.transform(runs, expand))
    raise ValueError(f"unknown segmentation mode {mode!r}")


def drop_stopwords_array(arr: str | Column, stopwords: Iterable[str]) -> Column:
    """T2 on an array column: order and duplicates kept, blanks dropped.

    `isin` over many literals is a hash-set look-up, whatever the list's length.
    """
    words = sorted(set(stopwords))
    return F.filter(col_(arr), lambda x: (F.length(x) > 0) & (~x.isin(words) if words else F.lit(True)))
