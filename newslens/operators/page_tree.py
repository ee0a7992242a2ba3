"""P14 with an element tree: text nodes of a page with their paths, and selectors over the paths.

A page is cut into tags and text by one pattern, and a fold over the pieces keeps the
stack of open elements, so every text node knows the elements it stands in, however
blocks of one name are nested.  The rules for pages as they are:

* comments, declarations, and the insides of `script` and `style` are no text;
* void elements (`br`, `img`, ...) open nothing;
* a closing tag closes the innermost open element of its name and all inside it; one
  that closes nothing is ignored;
* a tag may imply the end of an open element: blocks end a `p`; `li`, `dt`/`dd`, `tr`,
  `td`/`th` and `option` end their like, up to the list, table or select they stand in;
* what is open at the page's end ends there; a `<` that begins no tag is text.

A path has a step per open element, `/name.class.class`, in lower-case names and classes as written
(only those of letters, digits, `_` and `-`).  All is one expression of built-in
functions over the `html` column: no Python, no shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslens.functions import exprs as X
from newslens.operators import pages as PG

PIECES = (
    r"(?is)<!--.*?(?:-->|\z)"
    r"|<script(?=[\s/>])[^>]*>.*?(?:</script[^>]*>|\z)|<style(?=[\s/>])[^>]*>.*?(?:</style[^>]*>|\z)"
    r"|<[!?][^>]*(?:>|\z)"
    r"|</?[a-z][^>'\"]*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>'\"]*+)*+>|</?[a-z][^>]*>"
    r"|[^<]+|<"
)
CLASS = r"(?is)[\s\"'/]class\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
# Elements without content, and blocks that end a paragraph.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
BLOCKS = ("address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
          "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul")
# (tags, the open elements whose end they imply, the elements beyond which they imply nothing)
IMPLIED = (
    (BLOCKS, ("p",), ("button", "caption", "object", "table", "td", "th")),
    (("li",), ("li",), ("ol", "ul")),
    (("dt", "dd"), ("dt", "dd"), ("dl",)),
    (("tr",), ("tr", "td", "th"), ("table",)),
    (("td", "th"), ("td", "th"), ("table", "tr")),
    (("option",), ("option",), ("select",)),
)
# Nodes are gathered in lists of so many, so that adding one copies a short list.
GATHER = 64

NODE = "struct<path: string, ids: array<int>, text: string>"
STATE = f"struct<open: array<struct<name: string, step: string, id: int>>, n: int, recent: array<{NODE}>, done: array<array<{NODE}>>>"


def _piece(raw: Column) -> Column:
    """kind (`text`, `open`, `close` or null), name, step and text of a piece."""
    name = F.lower(F.regexp_extract(raw, r"^</?([A-Za-z][^\s/>]*)", 1))
    script = F.lower(raw).rlike(r"^<(script|style)[\s/>]")
    classes = F.split(F.regexp_replace(F.regexp_extract(raw, CLASS, 1), "[\"']", ""), r"\s+")
    step = F.concat_ws(".", F.concat(F.array(name), F.filter(classes, lambda c: c.rlike(r"^[A-Za-z0-9_-]+$"))))
    kind = (F.when(~raw.startswith("<") | (raw == "<"), F.lit("text"))
             .when(script | raw.rlike(r"^<[!?]"), F.lit(None).cast("string"))
             .when(raw.startswith("</"), F.lit("close"))
             .otherwise(F.lit("open")))
    return F.struct(kind.alias("kind"), name.alias("name"), F.when(kind == "open", step).alias("step"), F.when(kind == "text", raw).alias("text"))


def _last(stack: Column, names) -> Column:
    """Place of the innermost open element of these names, 0 if there is none."""
    hit = (lambda x: x["name"].isin(*names)) if isinstance(names, tuple) else (lambda x: x["name"] == names)
    return F.coalesce(F.array_max(F.transform(stack, lambda x, i: F.when(hit(x), i + 1).otherwise(0))), F.lit(0))


def _close_to(stack: Column, place: Column) -> Column:
    return F.slice(stack, F.lit(1), place - 1)


def _implied(stack: Column, name: Column) -> Column:
    """The stack behind the ends that an opening tag implies."""
    def behind(ends: tuple[str, ...], borders: tuple[str, ...]) -> Column:
        """The outermost element to end inside of the border, and all in it, are closed."""
        border = _last(stack, borders)
        places = F.transform(stack, lambda x, i: F.when(x["name"].isin(*ends) & (i + 1 > border), i + 1))
        return F.coalesce(_close_to(stack, F.array_min(places)), stack)

    out = stack
    for tags, ends, borders in IMPLIED:
        out = F.when(name.isin(*tags), behind(ends, borders)).otherwise(out)
    return out


def _step(s: Column, x: Column) -> Column:
    def state(**new: Column) -> Column:
        return F.struct(*[(new.get(f, s[f])).alias(f) for f in ("open", "n", "recent", "done")])

    def opened(stack: Column) -> Column:
        new = F.struct(x["name"].alias("name"), x["step"].alias("step"), s["n"].alias("id"))
        return F.when(x["name"].isin(*VOID), stack).otherwise(F.concat(stack, F.array(new)))

    place = _last(s["open"], x["name"])
    node = F.struct(F.concat(F.lit("/"), F.array_join(F.transform(s["open"], lambda e: e["step"]), "/")).alias("path"),
                    F.transform(s["open"], lambda e: e["id"]).alias("ids"), x["text"].alias("text"))
    full = F.size(s["recent"]) >= GATHER
    return (F.when(x["kind"] == "open", state(open=X.let(_implied(s["open"], x["name"]), opened), n=s["n"] + 1))
             .when(x["kind"] == "close", state(open=F.when(place > 0, _close_to(s["open"], place)).otherwise(s["open"])))
             .when((x["kind"] == "text") & full, state(recent=F.array(node), done=F.concat(s["done"], F.array(s["recent"]))))
             .when(x["kind"] == "text", state(recent=F.concat(s["recent"], F.array(node))))
             .otherwise(s).cast(STATE))


def text_nodes(html: str | Column) -> Column:
    """array<struct<path, ids, text>>: the text nodes in order; `ids` numbers the elements of the path within the page."""
    start = F.struct(F.array().alias("open"), F.lit(0).alias("n"), F.array().alias("recent"), F.array().alias("done")).cast(STATE)
    pieces = F.transform(F.regexp_extract_all(X.col_(html), F.lit(PIECES), 0), _piece)
    return F.aggregate(F.filter(pieces, lambda x: x["kind"].isNotNull()), start, _step, lambda s: F.concat(F.flatten(s["done"]), s["recent"]))


def page_nodes(pages: DataFrame, id_col: str = "page_id", col: str = "html") -> DataFrame:
    """(page_id, no, depth, path, text): one row per text node."""
    nodes = pages.select(id_col, F.posexplode(text_nodes(col)).alias("no", "x"))
    return nodes.select(id_col, "no", F.size("x.ids").alias("depth"), F.col("x.path").alias("path"), F.col("x.text").alias("text"))


# Selectors ------------------------------------------------------------------------
def path_pattern(selector: str) -> str:
    """A pattern for the path up to the innermost element that a selector meets.

    Steps as in `div.post_text p`: a name, classes, or both; each stands somewhere inside the one before.
    """
    out = "^"
    for step in selector.split():
        name, *classes = step.split(".")
        if not re.fullmatch(r"[A-Za-z0-9-]*", name) or not all(re.fullmatch(r"[A-Za-z0-9_-]+", c) for c in classes):
            raise ValueError(f"no selector of names and classes: {selector!r}")
        wanted = "".join(rf"(?=[^/]*\.{c}(?:[./]|$))" for c in classes)
        out += rf"(?:/[^/]*)*/{wanted}{name.lower() if name else '[^/.]+'}(?:\.[^/]*)?"
    return out + r"(?=/|$)"


def selected(nodes: Column, selector: str) -> Column:
    """array<string>: the whole text of each element that the selector meets, in order of its first text.

    Text belongs to the innermost such element around it.
    """
    pattern = path_pattern(selector)

    def owner(x: Column) -> Column:
        prefix = F.regexp_extract(x["path"], pattern, 0)
        depth = F.length(prefix) - F.length(F.replace(prefix, F.lit("/")))
        return F.struct(F.when(depth > 0, F.element_at(x["ids"], F.greatest(depth, F.lit(1)))).alias("id"), x["text"].alias("text"))

    def add(s: Column, x: Column) -> Column:
        same = F.size(s) > 0
        last = F.element_at(s, -1)
        joined = F.concat(F.slice(s, F.lit(1), F.size(s) - 1), F.array(F.struct(x["id"].alias("id"), F.concat(last["text"], x["text"]).alias("text"))))
        return F.when(same, F.when(last["id"] == x["id"], joined).otherwise(F.concat(s, F.array(x)))).otherwise(F.array(x))

    own = F.filter(F.transform(F.filter(nodes, lambda x: F.size(x["ids"]) > 0), owner), lambda x: x["id"].isNotNull())
    return F.aggregate(own, F.array().cast("array<struct<id: int, text: string>>"), add, lambda s: F.transform(s, lambda x: x["text"]))


@dataclass(frozen=True)
class TreeRules:
    """Selectors of an article's fields.  The class name is a fixed value of the original's pages."""
    title: str = "article h1"
    paragraph: str = "article p"
    time: str = "div.post_time_source"
    source: str = "div.post_time_source a"


def extract_articles(pages: DataFrame, rules: TreeRules = TreeRules()) -> DataFrame:
    """As `pages.extract_articles`, read off the element tree: (page_id, url, title, section, time, source, content).

    The time is the block's first text, the source its first link's.  Pages without any paragraph text are dropped.
    """
    read = pages.select("page_id", X.canonical_url("url").alias("url"), text_nodes("html").alias("_nodes"))
    first = lambda selector: PG.decode_entities(F.get(selected(F.col("_nodes"), selector), F.lit(0)))
    time = F.get(F.filter("_nodes", lambda x: x["path"].rlike(path_pattern(rules.time).replace("(?=/|$)", "$"))), F.lit(0))["text"]
    content = F.transform(selected(F.col("_nodes"), rules.paragraph), PG.decode_entities)
    return (read.select("page_id", "url", X.with_default(first(rules.title)).alias("title"), X.url_section("url").alias("section"),
                        X.with_default(X.clean_time(time)).alias("time"), F.nullif(X.py_strip(first(rules.source)), F.lit("")).alias("source"),
                        F.filter(X.trim_all(content), lambda x: F.length(x) > 0).alias("content"))
                .where(F.size("content") > 0))
