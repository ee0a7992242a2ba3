"""P14 with an element tree, against a parser that walks over the characters."""

import random

import pytest

from newslens.operators import page_tree as PT

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


def tag_end(html, i):
    """Behind the `>` of a tag: quotes hide it, unless they are never closed."""
    quote, k = "", i
    while k < len(html):
        c = html[k]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == ">":
            return k + 1
        k += 1
    plain = html.find(">", i)
    return plain + 1 if plain >= 0 else -1


def classes_of(tag):
    k, low = 0, tag.lower()
    while (k := low.find("class", k + 1)) >= 0:
        rest = tag[k + 5:].lstrip(" \t\n")
        if tag[k - 1] in " \t\n\"'/" and rest.startswith("="):
            rest = rest[1:].lstrip(" \t\n")
            if rest[:1] in ("'", '"') and rest.find(rest[0], 1) > 0:
                value = rest[1:rest.find(rest[0], 1)]
            else:
                value = ""
                for c in rest:
                    if c in " \t\n\"'>":
                        break
                    value += c
                if not value:
                    continue
            return [c for c in value.split() if all(x.isascii() and (x.isalnum() or x in "_-") for x in c)]
    return []


def walk(html):
    """(path, text) of the text nodes."""
    out, stack, i = [], [], 0
    low = html.lower()

    def end(names, borders=()):
        border = max((k + 1 for k, e in enumerate(stack) if e[0] in borders), default=0)
        at = [k for k in range(border, len(stack)) if stack[k][0] in names]
        if at:
            del stack[at[0]:]

    while i < len(html):
        if html[i] != "<":
            k = html.find("<", i)
            k = len(html) if k < 0 else k
            out.append(("/" + "/".join(e[1] for e in stack), html[i:k]))
            i = k
            continue
        if html.startswith("<!--", i):
            k = html.find("-->", i + 4)
            i = len(html) if k < 0 else k + 3
            continue
        raw = next((n for n in ("script", "style") if low.startswith("<" + n, i) and low[i + 1 + len(n):i + 2 + len(n)] in tuple(" \t\n/>")), None)
        if raw and html.find(">", i) >= 0:
            k = low.find("</" + raw, html.find(">", i))
            k = html.find(">", k) + 1 if k >= 0 else 0
            i = k if k > 0 else len(html)
            continue
        if html[i + 1:i + 2] in ("!", "?"):
            k = html.find(">", i)
            i = len(html) if k < 0 else k + 1
            continue
        closing = html.startswith("</", i)
        first = html[i + 1 + closing:i + 2 + closing]
        k = tag_end(html, i) if first.isascii() and first.isalpha() else -1
        if k < 0:
            out.append(("/" + "/".join(e[1] for e in stack), "<"))
            i += 1
            continue
        tag, i = html[i:k], k
        name = ""
        for c in tag[1 + closing:]:
            if c in " \t\n/>":
                break
            name += c
        name = name.lower()
        if raw:  # never ended
            continue
        if closing:
            at = [n for n, e in enumerate(stack) if e[0] == name]
            if at:
                del stack[at[-1]:]
            continue
        if name in BLOCKS:
            end({"p"}, {"button", "caption", "object", "table", "td", "th"})
        elif name == "li":
            end({"li"}, {"ol", "ul"})
        elif name in ("dt", "dd"):
            end({"dt", "dd"}, {"dl"})
        elif name == "tr":
            end({"tr", "td", "th"}, {"table"})
        elif name in ("td", "th"):
            end({"td", "th"}, {"table", "tr"})
        elif name == "option":
            end({"option"}, {"select"})
        if name not in VOID:
            stack.append((name, ".".join([name, *classes_of(tag)])))
    return out


PARTS = ["<div class='a b'>", '<div class="post_text">', "</div>", "<p>", "</p>", "<P CLASS=x>", "<b>", "</b>", "<br/>", "<img alt='a>b'>", "text ", "a < b ", "<ul>", "<li>", "</ul>",
         "<table>", "<tr>", "<td>", "</table>", "</td>", "<!-- <p> -->", "<script>var t='</p>';</script>", "<script>", "<style>p{}</style>", "<!DOCTYPE html>", "<article>", "</article>", "<h1>",
         "</h1>", "<a href='x'>", "</a>", "&amp;", "<dl>", "<dt>", "<dd>", "<select>", "<option>", "<", ">", "\n", '<i title="', "'", "<p class='q\n r'>", "</section >", "<?php ?>", "<1>"]


def pages_of(r, n, size):
    return ["".join(r.choices(PARTS, k=r.randint(0, size))) for _ in range(n)]


def test_nested_and_broken_pages_equal_a_character_walk(spark):
    r = random.Random(11)
    html = pages_of(r, 500, 40) + ["", "<", "x", "<p", "</", "<!--", "<div" + " class='k'" * 3 + ">y", "<p>" * 300 + "deep", "<div>" * 300 + "deep" + "</div>" * 400 + "out"]
    df = spark.createDataFrame(list(enumerate(html)) + [(-1, None)], "page_id long, html string").repartition(8)
    got = {}
    for x in PT.page_nodes(df).collect():
        got.setdefault(x.page_id, []).append((x.no, x.path, x.text, x.depth))
    assert -1 not in got
    for i, h in enumerate(html):
        want = walk(h)
        assert [(p, t) for _, p, t, _ in sorted(got.get(i, []))] == want, h
        assert all(d == (p.count("/") if p != "/" else 0) for _, p, _, d in got.get(i, []))


def test_a_long_page(spark):
    html = "<html><body>" + "".join(f"<p class='c{i % 7}'>t{i}<b>b</b></p>" for i in range(6000)) + "</body></html>"
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    got = PT.page_nodes(df).collect()
    assert [(x.path, x.text) for x in got] == walk(html)


def test_selectors_meet_the_innermost_element(spark):
    html = ("<div class='post_text big'><p>one <b>two</b><p>three</div><div class='post_text2'><p>no</p></div>"
            "<article><p>out</p><article class=post_text><h1>T <i>t</i></h1><p>in</p></article><p>late</p></article>")
    df = spark.createDataFrame([(html,)], "html string")
    ask = lambda s: df.select(PT.selected(PT.text_nodes("html"), s).alias("x")).first().x
    assert ask(".post_text p") == ["one two", "three", "in"]
    assert ask("div.post_text p") == ["one two", "three"]
    assert ask("article article p") == ["in"]
    assert ask("article p") == ["out", "in", "late"]
    assert ask("h1") == ["T t"]
    assert ask(".big.post_text b") == ["two"]
    assert ask("nav") == []
    with pytest.raises(ValueError):
        PT.path_pattern("p > a")


def test_articles_from_nested_blocks(spark):
    html = ("<html><div class='top post_time_source'> 2020-11-28 10:00:00　来源: <a href='/s'>Agency &amp; Co</a></div>"
            "<article><section><article><p>inner</p></article></section><h1>Big <i>news</i></h1><p>behind &lt;b&gt;</p></article><script>'<article><p>no</p>'</script></html>")
    pages = spark.createDataFrame([(1, "https://sx.news.example.com/a.html?x=1", html), (2, "https://x.example/b", "<p>no article</p>"), (3, "https://x.example/c", None)], "page_id long, url string, html string")
    got = PT.extract_articles(pages).collect()
    assert [(x.page_id, x.title, x.section, x.time, x.source, x.content) for x in got] == [(1, "Big news", "news", "2020-11-28 10:00:00", "Agency & Co", ["inner", "behind <b>"])]
