"""Edge cases of FIXTURES.md §2 and the readers / writers."""

import json
import os

from pyspark.sql import functions as F

from golden import ROWS, articles
from newslens.functions import exprs as X
from newslens.operators import pages as PG
from newslens.operators import text as TX
from newslens.sources import articles as SA
from newslens.sources import sinks as SK


def _one(spark, expr, value, typ="string"):
    return spark.createDataFrame([(value,)], f"v {typ}").select(expr(F.col("v")).alias("r")).first().r


def test_p8_clean_time(spark):
    assert _one(spark, X.clean_time, "  2020-11-28 10:00:00　来源: ") == "2020-11-28 10:00:00"


def test_p9_trim_python_whitespace(spark):
    assert _one(spark, X.py_strip, "\t 　a b　\n") == "a b"


def test_p10_int_tokens(spark):
    ints = ["5", "-3", "+4", " 12 ", "1_000", "３２"]
    not_ints = ["3.14", "1__0", "1_", "²", "- 5", "abc", ""]
    for v in ints:
        assert _one(spark, X.is_int_token, v) is True, v
    for v in not_ints:
        assert _one(spark, X.is_int_token, v) is False, v


def test_p5_p6_p7_urls(spark):
    urls = ["https://sx.news.example.com/a", "https://news.example.com/a", "https://sports.example.com/a"]
    assert [_one(spark, X.url_section, u) for u in urls] == ["news", "news", "sports"]
    assert _one(spark, X.canonical_url, "https://b.example.com/x.html?f=1") == "https://b.example.com/x.html"
    assert _one(spark, X.url_province, urls[0]) == "sx"
    assert _one(spark, X.url_province, urls[2]) == "nation"


def test_p11_allow_list(spark):
    ok = X.url_allowed(F.col("v"), ["example.com"], r"/[0-9]+$")
    df = spark.createDataFrame([("https://a.example.com/12",), ("https://a.example.org/12",),
                                ("https://a.example.com/x",)], "v string")
    assert [r[0] for r in df.select(ok).collect()] == [True, False, False]


def test_t2_keeps_duplicates_and_order(spark):
    df = spark.createDataFrame([(0, "a a b")], "doc_id long, text string")
    s = TX.token_sentence(df, ["b"], "space").first()
    assert s.words == ["a", "a"] and s.sentence == "a a"
    toks = TX.tokens(df, "space", spark.createDataFrame([("b",)], "term string"))
    assert sorted(r.term for r in toks.collect()) == ["a", "a"]


def test_p2_empty_content_dropped_and_missing_time(spark):
    rows = ROWS + [(6, "Empty", "news", "S1", "2020-11-28 10:00:00", 1, ["", ""]),
                   (7, "No time", "news", "S1", "#", 1, ["power station"])]
    arts = articles(spark, rows)
    ids = {r.doc_id: r.pub_ts for r in arts.collect()}
    assert 6 not in ids and 7 in ids and ids[7] is None
    # kept for keywords, absent from hotness
    kw = TX.article_keywords(arts, ["the"], 20, "space")
    assert kw.where("doc_id = 7").count() == 2
    from newslens.plans import reports as RP
    hot = RP.hotness_scores(arts, RP.similarity_pairs(arts, ["the"], 20, "2020-11-29 00:00:00", "space"),
                            "2020-11-29 00:00:00")
    assert hot.where("doc_id = 7").count() == 0


def test_r2_equal_scores_scale_to_zero(spark):
    from newslens.operators.ranking import min_max_scale
    df = spark.createDataFrame([(1, 0.5), (2, 0.5)], "id int, raw double")
    assert [r.s for r in min_max_scale(df, "raw", "s").collect()] == [0.0, 0.0]


def test_s1_concatenated_json(spark, scratch):
    p = os.path.join(scratch, "news.json")
    a = {"url": "u", "depth": 1, "title": "t", "section": "news", "time": "2020-11-28 10:00:00",
         "content": ["abc x"]}
    b = {"url": "w", "depth": 2, "title": "t2", "section": "news", "time": "#", "content": ["y"]}
    with open(p, "w", encoding="utf-8") as f:
        f.write(json.dumps(a, ensure_ascii=False) + json.dumps(b, ensure_ascii=False) + '{"url":"v","con')
    recs = SA.read_concat_json(spark, p)
    got = sorted((r.url, r.content[0], r.ingest_pos) for r in recs.collect())
    assert got == [("u", "abc x", 0), ("w", "y", 1)]
    arts = SA.articles_from_records(recs).collect()
    assert {r.url: r.pub_ts is None for r in arts} == {"u": False, "w": True}


def test_s1_order_across_splits(spark, scratch):
    p = os.path.join(scratch, "many.json")
    with open(p, "w", encoding="utf-8") as f:
        for i in range(3000):
            f.write(json.dumps({"url": f"u{i}", "depth": 1, "content": ["x" * 50]}))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        recs = SA.read_concat_json(spark, p)
        got = {r.url: r.ingest_pos for r in recs.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {f"u{i}": i for i in range(3000)}


def test_s3_stopwords_and_s13_suffix(spark, scratch):
    with open(os.path.join(scratch, "stop.txt"), "w", encoding="utf-8") as f:
        f.write(" the \nof\n\nthe\n")
    with open(os.path.join(scratch, "skip.json"), "w", encoding="utf-8") as f:
        f.write("{}\n")
    stop = SA.read_stopwords(spark, os.path.join(scratch, "stop.txt"))
    assert sorted(r.term for r in stop.collect()) == ["of", "the"]
    assert SA.read_text(spark, scratch, ".txt").count() == 4


def test_s9_append_skips_stored_urls(spark, scratch):
    store = os.path.join(scratch, "store")
    batch = spark.createDataFrame([(1, "https://a/x", "first"), (2, "https://a/x", "second"),
                                   (3, "https://a/y", "y")], "page_id long, url string, title string")
    first = SK.append_new_articles(batch, store)
    assert sorted((r.url, r.title) for r in first.collect()) == [("https://a/x", "first"), ("https://a/y", "y")]
    again = spark.createDataFrame([(4, "https://a/y", "y2"), (5, "https://a/z", "z")],
                                  "page_id long, url string, title string")
    second = SK.append_new_articles(again, store)
    assert [r.url for r in second.collect()] == ["https://a/z"]
    assert spark.read.parquet(store).count() == 3


def test_s11_legacy_counts(spark, scratch):
    p = os.path.join(scratch, "part-00000")
    with open(p, "w", encoding="utf-8") as f:
        f.write("('中国', 99)\n(\"it's\", 3)\n('', 2)\n")
    got = {r.word: r.n for r in SK.read_counts(spark, p, legacy=True).collect()}
    assert got == {"中国": 99, "it's": 3, "": 2}
    empty = os.path.join(scratch, "empty")
    open(empty, "w").close()
    assert SK.read_counts(spark, empty, legacy=True).count() == 0


def test_s12_history_keys_both_forms(spark, scratch):
    p = os.path.join(scratch, "hist.json")
    doc = {"2020-11-29 22-30": [{"关键词": "a", "数量": 5}, {"关键词": "b", "数量": 9}],
           "2020-11-29 22:00": [{"关键词": "c", "数量": 1}]}
    with open(p, "w", encoding="utf-8") as f:
        json.dump(doc, f, ensure_ascii=False)
    hist = SK.read_history(spark, p)
    got = sorted((r.batch_minute, r.rank, r.keyword, r.n) for r in hist.collect())
    assert got == [("2020-11-29 22:00", 1, "c", 1), ("2020-11-29 22:30", 1, "a", 5),
                   ("2020-11-29 22:30", 2, "b", 9)]
    frames = [(r.batch_minute, r.pos, r.keyword) for r in SK.history_frames(hist).orderBy("batch_minute", "pos").collect()]
    assert frames == [("2020-11-29 22:00", 1, "c"), ("2020-11-29 22:30", 1, "a"), ("2020-11-29 22:30", 2, "b")]


def test_p14_extract_page(spark):
    html = ('<html><head><script>var t="</p>";</script></head><body><nav><a href="/n">n</a></nav>'
            '<div class="post_time_source"> 2020-11-28 10:00:00　来源: <a href="/s">Agency</a></div>'
            '<article><h1>Big &amp; news</h1><p> first para </p><p class="x">second &lt;b&gt;</p></article>'
            '</body></html>')
    pages = spark.createDataFrame([(1, "https://sx.news.example.com/a.html?x=1", html),
                                   (2, "https://sports.example.com/b", "<html><article><h1>x</h1></article>")],
                                  "page_id long, url string, html string")
    got = PG.extract_articles(pages).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.url, r.title, r.section, r.time, r.source) == (
        "https://sx.news.example.com/a.html", "Big & news", "news", "2020-11-28 10:00:00", "Agency")
    assert r.content == ["first para", "second <b>"]
    links = sorted(x.dst for x in PG.extract_links(pages).collect())
    assert links == ["https://sx.news.example.com/n", "https://sx.news.example.com/s"]


def test_j7_link_depth(spark):
    edges = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "D"), ("D", "E"), ("B", "A")],
                                  "src string, dst string")
    seeds = spark.createDataFrame([("A",)], "url string")
    got = {r.url: r.depth for r in PG.link_depth(edges, seeds).collect()}
    assert got == {"A": 0, "B": 1, "C": 2, "D": 3}


def test_s10_token_files_round_trip(spark, scratch):
    from newslens.operators import counts as C
    path = os.path.join(scratch, "tokens")
    arts = articles(spark)
    SK.write_token_files(arts, path, ["the"], mode="space")
    back = spark.read.text(path)
    assert sorted(str(r.minute) for r in back.select("minute").distinct().collect()) == [
        "202011250915", "202011281000", "202011281200", "202011282030", "202011282300"]
    got = {r.word: r.n for r in C.word_count(back).collect()}
    toks = TX.tokens(arts, "space", ["the"]).groupBy("term").count().collect()
    assert got == {r.term: r["count"] for r in toks}


def test_s6_report_json(spark, scratch):
    path = os.path.join(scratch, "report")
    df = spark.createDataFrame([("标题", 1.5, ["a"], ["b"])], "title string, attention double, keyword array<string>, samenews array<string>")
    SK.write_report(df, path)
    text = "".join(open(os.path.join(path, f), encoding="utf-8").read()
                   for f in os.listdir(path) if f.endswith(".json"))
    assert json.loads(text) == {"title": "标题", "attention": 1.5, "keyword": ["a"], "samenews": ["b"]}
    assert "标题" in text


def test_crawl_batch_counts_repeats_but_stores_once(spark, scratch):
    from newslens.plans import reports as RP
    page = lambda i, body: (i, f"https://news.example.com/a{i % 2}", f"<article><h1>T{i}</h1><p>{body}</p></article>")
    pages = spark.createDataFrame([page(0, "alpha beta"), page(1, "gamma")], "page_id long, url string, html string")
    store, toks = os.path.join(scratch, "store"), os.path.join(scratch, "tokens")
    RP.crawl_batch(pages, store, toks, "2020-11-28 10:00:00", ["the"])
    again = spark.createDataFrame([page(2, "alpha delta")], "page_id long, url string, html string")
    new = RP.crawl_batch(again, store, toks, "2020-11-28 10:05:00", ["the"])
    assert new.count() == 0 and spark.read.parquet(store).count() == 2
    words = sorted(w for r in spark.read.text(toks).collect() for w in r.value.split(" "))
    assert words == ["alpha", "alpha", "beta", "delta", "gamma"]
    RP.crawl_batch(again, store, os.path.join(scratch, "t2"), "2020-11-28 10:06:00", ["the"], count_repeats=False)
    assert not os.path.exists(os.path.join(scratch, "t2")) or spark.read.text(os.path.join(scratch, "t2")).count() == 0


def test_publish_reports(spark, scratch):
    from newslens.plans import reports as RP
    RP.publish_reports(articles(spark), scratch, "2020-11-29 00:00:00", ["the"], "2020-11-29 00:00:00", 2, "space")
    hot = spark.read.json(os.path.join(scratch, "hot_news"))
    assert hot.count() == 6 and set(hot.columns) == {"title", "attention", "keyword", "samenews"}
    wk = spark.read.json(os.path.join(scratch, "window_keywords")).first()
    assert wk.time == "2020-11-29 00:00:00" and wk.timekeyword[:2] == ["old", "recap"]


def test_s1_order_across_files(spark, scratch):
    folder = os.path.join(scratch, "store")
    os.makedirs(folder)
    for name, urls in (("a.json", ["a0", "a1", "a2"]), ("b.json", ["b0", "b1"])):
        with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
            for u in urls:
                f.write(json.dumps({"url": u, "content": ["x"]}))
    got = sorted((r.ingest_pos, r.url) for r in SA.read_concat_json(spark, folder).collect())
    assert [u for _, u in got] == ["a0", "a1", "a2", "b0", "b1"]
    assert [p for p, _ in got][:3] == [0, 1, 2] and got[3][0] == 1 << 40


def test_t1_cjk_bigrams(spark):
    got = _one(spark, lambda c: X.segment(c, "cjk_bigram"), "中国人民 ABC 好, x2")
    assert got == ["中国", "国人", "人民", "abc", "好", "x2"]
    assert _one(spark, lambda c: X.segment(c, "space"), "  A  b\tc ") == ["a", "b", "c"]


# Verdict cases -----------------------------------------------------------------
def test_paragraphs_keep_every_text_node(spark):
    html = ("<article><p>one <b>two</b> three</p><p> </p><p class='x'>open &#39;&#x4e2d;&amp;lt;<p>last&nbsp;</article>"
            "<article><p>second block</p></article>")
    pages = spark.createDataFrame([(1, "http://h/1", html), (2, "http://h/2", "<article><p> <i></i></p></article>")], "page_id long, url string, html string")
    got = PG.extract_articles(pages).collect()
    assert [(r.page_id, r.content) for r in got] == [(1, ["one two three", "open '中&lt;", "last", "second block"])]


def test_links_as_a_follower_reads_them(spark):
    html = ("<a href='#top'><a href=\"?p=2\"><a href=../q.html><A HREF = './a/../b'><a href='mailto:a@b'><a href='//o.x/y/..'>"
            "<a href='/r?a=1&amp;b#c'><link href='no'><a data-href='no'>")
    for base, folder in (("http://h.x/en/1/p?z#f", "http://h.x/en/"), ("http://h.x", "http://h.x/")):
        pages = spark.createDataFrame([(1, base, html)], "page_id long, url string, html string")
        page = base.split("?")[0]
        want = [page, page, folder + "q.html", ("http://h.x/en/1/" if "en" in base else folder) + "b", "http://o.x/", "http://h.x/r"]
        assert [r.dst for r in PG.extract_links(pages).collect()] == want


def test_s1_keeps_records_that_end_in_a_nested_object(spark, scratch):
    from pyspark.sql import types as T
    p = os.path.join(scratch, "nested.json")
    with open(p, "w", encoding="utf-8") as f:
        f.write('{"a": 1, "b": {"c": "x"}}{"a": 2, "b": {"c": "y"}}{"a": 3, "b": {"c": "z"}}{"a": ')
    schema = T.StructType.fromDDL("a int, b struct<c: string>")
    got = SK_articles().read_concat_json(spark, p, schema, keep_rejects=True).orderBy("ingest_pos").collect()
    assert [(r.a, r.b and r.b.c) for r in got] == [(1, "x"), (2, "y"), (3, "z"), (None, None)]
    assert [r.rejected is not None for r in got] == [False, False, False, True]


def SK_articles():
    from newslens.sources import articles
    return articles


def test_s9_and_crawl_batch_return_what_they_store(spark, scratch):
    from newslens.plans import reports as RP
    page = lambda i: (i, f"http://h/{i}", f"<article><p>words {i}</p></article>")
    make = lambda ids: spark.createDataFrame([page(i) for i in ids], "page_id long, url string, html string")
    store, tokens = os.path.join(scratch, "store"), os.path.join(scratch, "tokens")
    for at, ids, new in (("2024-01-01 00:00:00", (1, 2), [1, 2]), ("2024-01-01 00:01:00", (2, 3, 4), [3, 4]), ("2024-01-01 00:01:00", (2, 3, 4), [3, 4])):
        got = RP.crawl_batch(make(ids), store, tokens, at, stopwords=(), count_repeats=False)
        assert sorted(r.page_id for r in got.collect()) == new
    # the third call was the second one again: nothing is stored or counted twice
    assert spark.read.parquet(store).count() == 4
    assert sorted(r.value for r in spark.read.text(tokens).collect()) == [f"words {i}" for i in (1, 2, 3, 4)]


def test_long_stop_lists_in_the_array_path(spark):
    words = [f"w{i}" for i in range(2340)]
    arts = spark.createDataFrame([(1, "w5 keep w2339 Keep w7"), (2, "w1 w2"), (3, "")], "doc_id long, text string")
    table = spark.createDataFrame([(w,) for w in words], "term string")
    for stop in (words, table):
        got = {r.doc_id: r.words for r in TX.token_sentence(arts, stop).collect()}
        assert got == {1: ["keep", "keep"], 2: [], 3: []}
    assert TX.token_sentence(arts, None).where("doc_id = 2").first().sentence == "w1 w2"


def test_similarity_slices_both_sides_and_buckets_time(spark):
    from newslens.operators import similarity as SIM
    rows = [(i, f"t{i}", "news", f"common w{i % 3} x{i}", 10 * i) for i in range(40)]
    arts = spark.createDataFrame(rows, "doc_id long, title string, section string, text string, age long")
    tk = SIM.term_table(arts, (), 20, attrs=("section", "age"))
    plain = {(r.lo, r.hi): round(r.sim, 9) for r in SIM.pair_similarity(tk).collect()}
    split = {(r.lo, r.hi): round(r.sim, 9) for r in SIM.pair_similarity(tk, salt_rows=4).collect()}
    assert split == plain and len(plain) == 780
    near = {(r.lo, r.hi): round(r.sim, 9) for r in SIM.pair_similarity(tk, block=("section",), near=("age", 70), salt_rows=4).collect()}
    assert near == {p: s for p, s in plain.items() if abs(p[0] - p[1]) <= 7}
    plan = SIM.pair_similarity(tk, block=("section",), near=("age", 70))._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_nothing_runs_while_a_report_is_planned_and_kept_frames_stay_apart(spark):
    from newslens.session import kept, reuse
    outer = reuse(spark.range(5))
    with kept():
        inner = reuse(spark.range(6))
    assert outer.storageLevel.useMemory and not inner.storageLevel.useMemory
    outer.unpersist()


def murmur3(data: bytes, seed: int = 42) -> int:
    """MurmurHash3 (x86, 32 bits) as a signed number, by its published definition."""
    m, h = 0xFFFFFFFF, seed
    rot = lambda x, r: (x << r | x >> (32 - r)) & m
    mix = lambda k: rot(k * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
    whole = len(data) // 4 * 4
    for i in range(0, whole, 4):
        h = (rot(h ^ mix(int.from_bytes(data[i:i + 4], "little")), 13) * 5 + 0xE6546B64) & m
    if whole < len(data):
        h ^= mix(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    for shift, times in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> shift) * times & m
    return h - (1 << 32) if h >> 31 else h


def test_t4h_buckets_are_those_of_the_published_hash(spark):
    from collections import Counter

    rows = [(1, "one two two three ünï 中文 a ab abc abcd abcde"), (2, ""), (3, "x " * 500)]
    arts = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (16, 1 << 18):
        got = {r.doc_id: {int(i): v for i, v in zip(r.raw_features.indices, r.raw_features.values)} for r in TX.hashed_tf(arts, num_features=n).collect()}
        assert got == {i: dict(Counter(murmur3(w.encode()) % n for w in t.split())) for i, t in rows}
