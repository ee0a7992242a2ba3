"""Fetched pages → article records, links and crawl depth (P14, P15, J4, J7, S9 dedup).

Extraction is a projection of native regex functions over the `html` column:
no per-row Python, no HTML library behind a UDF.  Rules are patterns, so a
site with another layout passes its own `ExtractRules`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslens import schema as S
from newslens.functions import exprs as X
from newslens.session import reuse


@dataclass(frozen=True)
class ExtractRules:
    """Where the fields of an article sit in a page (Java/RE2 regex, group 1).

    `paragraph` is the opening tag of a paragraph; its text runs to the closing
    tag, or to the next paragraph where there is none.
    """
    main: str = r"(?s)<article[^>]*>(.*?)</article>"
    title: str = r"(?s)<h1[^>]*>(.*?)</h1>"
    # Fixed value: the class name of the block that holds time and source.
    time: str = r"(?s)class=\"post_time_source\"[^>]*>([^<]*)"
    source: str = r"(?s)class=\"post_time_source\".*?<a[^>]*>([^<]*)</a>"
    paragraph: str = r"<p(?:[ \t\r\n][^>]*)?>"


DEFAULT_RULES = ExtractRules()

# The named character references decoded in extracted text (`&amp;` last).
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"),
            ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&middot;", "·"),
            ("&amp;", "&"))


def decode_entities(c: Column) -> Column:
    """Named references of the list, and numeric ones (`&#39;`, `&#x4e2d;`)."""
    def char(code: Column) -> Column:
        valid = (code > 0) & (code <= 0x10FFFF) & ((code < 0xD800) | (code > 0xDFFF))
        return F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(F.lit(0xFFFD))), 8, "0")), "UTF-32")

    def numeric(text: Column, pattern: str, base: int) -> Column:
        def put(acc: Column, ref: Column) -> Column:  # ref: the whole reference
            digits = F.regexp_extract(ref, r"([0-9a-fA-F]+);$", 1)
            return F.replace(acc, ref, X.let(F.conv(digits, base, 10).cast("bigint"), char))

        return X.let(text, lambda t: F.aggregate(F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), 0)), t, put))

    c = numeric(c, r"&#[0-9]{1,9};", 10)
    c = numeric(c, r"&#[xX][0-9a-fA-F]{1,6};", 16)
    for ent, ch in ENTITIES:
        c = F.replace(c, F.lit(ent), F.lit(ch))
    return c


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]*>", "")


def paragraphs(block: Column, rules: ExtractRules = DEFAULT_RULES) -> Column:
    """Texts of the paragraphs of a block: every text node, also inside and behind inline
    tags; trimmed, references decoded, empty ones dropped (P9, Q10)."""
    parts = F.split(block, rules.paragraph)
    behind = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    inner = F.transform(behind, lambda x: decode_entities(strip_tags(F.regexp_extract(x, r"(?s)^(.*?)(?:</p[ \t\r\n]*>.*)?$", 1))))
    return F.filter(X.trim_all(inner), lambda x: F.length(x) > 0)


def extract_articles(pages: DataFrame, rules: ExtractRules = DEFAULT_RULES) -> DataFrame:
    """P14 (+P5, P6, P8, P9, P13, Q10): (page_id, url, title, section, time, source, content).

    All main blocks of a page count.  Pages without any paragraph text are
    dropped, as they would never be stored.
    """
    main = F.array_join(F.regexp_extract_all("html", F.lit(rules.main), 1), "\n")
    block = F.when(F.length(main) > 0, main).otherwise(F.col("html"))
    title = X.with_default(decode_entities(strip_tags(F.regexp_extract(block, rules.title, 1))))
    time_raw = F.regexp_extract("html", rules.time, 1)
    source = X.py_strip(decode_entities(F.regexp_extract("html", rules.source, 1)))
    url = X.canonical_url("url")
    return (pages.select(
                "page_id",
                url.alias("url"),
                title.alias("title"),
                X.url_section(url).alias("section"),
                X.with_default(X.clean_time(time_raw)).alias("time"),
                F.nullif(source, F.lit("")).alias("source"),
                paragraphs(block, rules).alias("content"))
            .where(F.size("content") > 0))


# What a link follower reads: the href of an anchor, in any quoting.
ANCHOR = r"(?is)<(?:a|area)[ \t\r\n][^>]*>"
HREF = r"(?is)[ \t\r\n\"'/]href[ \t\r\n]*=[ \t\r\n]*(\"[^\"]*\"|'[^']*'|[^ \t\r\n\"'>]+)"


def drop_dot_segments(path: Column) -> Column:
    """`/a/./b/../c` → `/a/c`; a path never climbs above its root."""
    def step(acc: Column, s: Column) -> Column:
        up = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))
        return F.when(s == ".", acc).when(s == "..", up).otherwise(F.concat(acc, F.array(s)))

    def tidy(segments: Column) -> Column:
        rest = F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 1, F.lit(0)))
        kept = F.aggregate(rest, F.slice(segments, 1, 1), step)
        open_end = F.element_at(segments, -1).isin(".", "..")
        return F.concat(F.array_join(kept, "/"), F.when(open_end, F.lit("/")).otherwise(F.lit("")))

    return X.let(F.split(path, "/"), tidy)


def resolve_link(base: Column, href: Column) -> Column:
    """Absolute canonical URL of `href` found on page `base`, as a follower resolves it.

    Empty, query-only and fragment-only links are the page itself; dot segments
    are removed; anything but http and https is null.
    """
    site = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"

    def behind(url: Column, origin: Column) -> Column:
        return F.substring(url, F.length(origin) + 1, F.length(url))

    def absolute(page: Column, h: Column) -> Column:
        scheme, origin = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1), F.regexp_extract(page, site, 1)
        folder = F.coalesce(F.nullif(F.regexp_extract(behind(page, origin), r"^(.*/)", 1), F.lit("")), F.lit("/"))
        return (F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h)
                 .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
                 .when(h.startswith("/"), F.concat(origin, h))
                 .when(F.length(h) == 0, page)
                 .otherwise(F.concat(origin, folder, h)))

    def tidy(url: Column) -> Column:
        origin = F.regexp_extract(url, site, 1)
        plain = F.when(behind(url, origin).contains("/."), F.concat(origin, drop_dot_segments(behind(url, origin)))).otherwise(url)
        return F.when(F.lower(url).rlike(r"^https?://[^/]"), plain)

    whole = X.let(X.canonical_url(base), lambda page: X.let(X.canonical_url(href), lambda h: absolute(page, h)))
    return X.let(whole, tidy)


def extract_links(pages: DataFrame, domains: tuple[str, ...] | None = None,
                  pattern: str | None = None) -> DataFrame:
    """(page_id, src, dst) — followable links, canonical, optionally allow-listed."""
    anchors = F.regexp_extract_all("html", F.lit(ANCHOR), 0)
    written = F.transform(anchors, lambda t: F.regexp_extract(t, HREF, 1))
    rows = pages.select("page_id", X.canonical_url("url").alias("src"), F.col("url").alias("_base"),
                        F.explode(F.filter(written, lambda h: F.length(h) > 0)).alias("_raw"))
    href = X.py_strip(decode_entities(F.regexp_replace("_raw", "^[\"']|[\"']$", "")))
    links = rows.select("page_id", "src", resolve_link(F.col("_base"), href).alias("dst")).where(F.col("dst").isNotNull())
    if domains is not None or pattern is not None:
        links = links.where(X.url_allowed("dst", domains or (), pattern or ".*"))
    return links


def urls_in_pages(pages: DataFrame, col: str = "html") -> DataFrame:
    """The distinct URLs written anywhere in a text column."""
    return pages.select(F.explode(X.urls_in_text(col)).alias("url")).distinct()


def unseen(new: DataFrame, seen: DataFrame, col: str = "url") -> DataFrame:
    """Rows of `new` whose URL is not in `seen` (anti-join; planner sizes it)."""
    return new.join(seen.select(F.col(col).alias("_seen")).distinct(),
                    F.col(col) == F.col("_seen"), "left_anti")


def first_per_url(df: DataFrame, order_col: str, col: str = "url") -> DataFrame:
    """S9 in-batch dedup: keep the earliest row of each URL.

    `min_by` is an aggregate with a partial phase, so a URL repeated in a third
    of all rows is reduced in every map task before the shuffle.
    """
    others = [c for c in df.columns if c != col]
    best = F.min_by(F.struct(*others), F.col(order_col))
    return df.groupBy(col).agg(best.alias("_r")).select(col, "_r.*").select(*df.columns)


def link_depth(edges: DataFrame, seeds: DataFrame, max_depth: int = S.MAX_DEPTH) -> DataFrame:
    """(url, depth) — fewest hops from a seed, at most `max_depth`.

    The edges are read off the pages once and kept.  Each of the (few) levels is
    a join and an anti-join against the levels before; all is one lazy plan in
    which Spark shares the repeated parts.
    """
    e = reuse(edges.select("src", "dst").distinct())
    visited = seeds.select(F.col("url")).distinct().withColumn("depth", F.lit(0))
    frontier = visited
    for d in range(1, max_depth + 1):
        nxt = frontier.select("url").join(e, F.col("url") == F.col("src")).select(F.col("dst").alias("url")).distinct()
        nxt = reuse(nxt.join(visited.select("url"), "url", "left_anti").withColumn("depth", F.lit(d)))
        visited = visited.unionByName(nxt)
        frontier = nxt
    return visited
