"""Registered queries over the test tables: `name -> f(spark, sf_dir) -> DataFrame`.

Keys carry the operator IDs of SURVEY §2.  Floating results are rounded to 6
digits (ranking uses 9) so engines agree; arrays are rendered as joined text
for the value comparison (the report itself keeps arrays, see `reports`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newslens import schema as S
from newslens.functions import exprs as X
from newslens.operators import counts as C
from newslens.operators import page_tree as PT
from newslens.operators import pages as PG
from newslens.operators import ranking as R
from newslens.operators import segmentation as SG
from newslens.operators import similarity as SIM
from newslens.operators import text as TX
from newslens.plans import reports as RP
from newslens.plans import stored_queries as SQ
from newslens.session import ensure_parallel, reuse, spread_texts, table_path
from newslens.sources import articles as AR
from newslens.sources import sinks as SK
from newslens.streaming import word_history as WH

QueryFn = Callable[[SparkSession, str], DataFrame]

# Allow-list used by the URL queries (P11): hosts and article path shape.
ALLOWED_DOMAINS = ("example.com", "example.net")
ARTICLE_PATH = r"^https?://[^/]+/[a-z]{2}/[0-9]+(\.html|/)?([?#].*)?$"
HOT_BOARD_N = 50
SEP = " | "


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AR.articles_from_tables(spark, sf_dir)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensure_parallel(spark.read.parquet(table_path(sf_dir, "pages")), "page_id")


def _texts(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ensure_parallel(spark.read.parquet(table_path(sf_dir, table)).select("text"))


def _r6(c: str) -> F.Column:
    return F.round(c, 6).alias(c)


# Text → weights ----------------------------------------------------------------
def y1_article_keywords(spark, sf_dir):
    kw = TX.article_keywords(_articles(spark, sf_dir))
    return kw.select("doc_id", "rank", "term", "tf", _r6("tfidf"))


def t5_doc_freq(spark, sf_dir):
    arts = _articles(spark, sf_dir)
    tf = TX.term_freq(TX.tokens(arts, stopwords=S.DEFAULT_STOPWORDS))
    m = TX.article_count(arts)
    return TX.doc_freq(tf).select("term", "df", F.round(TX.idf_expr(m, F.col("df")), 6).alias("idf"))


def t6_tfidf(spark, sf_dir):
    arts = _articles(spark, sf_dir)
    tf = reuse(TX.term_freq(TX.tokens(arts, stopwords=S.DEFAULT_STOPWORDS)))
    return TX.tfidf(tf, TX.article_count(arts)).select("doc_id", "term", "tf", _r6("tfidf"))


def y2_block_keywords(spark, sf_dir):
    return TX.block_keywords(_articles(spark, sf_dir)).select(
        F.col("rank").cast("int").alias("rank"), "term", "tf", _r6("tfidf"))


# Similarity, votes, hotness, related ------------------------------------------
def j1_pair_similarity(spark, sf_dir):
    pairs = RP.similarity_pairs(_articles(spark, sf_dir))
    return pairs.select("lo", "hi", "dot", "norm_lo", "norm_hi", _r6("sim"))


def j3_votes(spark, sf_dir):
    return RP.article_votes(_articles(spark, sf_dir))


def y4_hotness(spark, sf_dir):
    arts = _articles(spark, sf_dir)
    hot = R.hotness(arts, RP.article_votes(arts))
    return hot.select("doc_id", "votes", "age", F.round("raw", 9).alias("raw"), _r6("hotness"))


def r4_hot_board(spark, sf_dir):
    arts = _articles(spark, sf_dir)
    hot = R.hotness(arts, RP.article_votes(arts))
    top = R.hot_board(hot, HOT_BOARD_N)
    return R.top_k_per_group(top.withColumn("_g", F.lit(0)), "_g",
                             [F.col("hotness").desc(), F.col("doc_id").asc()], HOT_BOARD_N) \
            .select(F.col("rank").cast("int").alias("rank"), "doc_id", _r6("hotness"))


def y3_related_articles(spark, sf_dir):
    arts = _articles(spark, sf_dir)
    rel = RP.related_titles(arts)
    return rel.select("doc_id", F.col("rank").cast("int").alias("rank"), "title", _r6("sim"))


def y5_hot_news_report(spark, sf_dir):
    rep = RP.hot_news_report(_articles(spark, sf_dir))
    return rep.select("doc_id", "title", _r6("attention"),
                      F.array_join("keyword", " ").alias("keyword"),
                      F.array_join("samenews", SEP).alias("samenews"))


# Counts -------------------------------------------------------------------------
def a1_word_count(spark, sf_dir):
    return C.word_count(C.text_lines(_texts(spark, sf_dir, "documents")))


def a1_conversation_word_count(spark, sf_dir):
    return C.word_count(C.text_lines(_texts(spark, sf_dir, "conversations")))


def a2_top_words(spark, sf_dir):
    top = C.top_words(C.word_count(C.text_lines(_texts(spark, sf_dir, "documents"))))
    return top.select(F.col("rank").cast("int").alias("rank"), "word", "n")


def a3_source_counts(spark, sf_dir):
    return C.count_by_source(_articles(spark, sf_dir))


def a4_hour_grid(spark, sf_dir):
    return C.hour_grid(_articles(spark, sf_dir))


def a5_distinct_urls(spark, sf_dir):
    return C.distinct_urls(_pages(spark, sf_dir).select(X.canonical_url("url").alias("url")))


# Streams, batch twins ---------------------------------------------------------
def w1_window_word_count(spark, sf_dir):
    counts = RP.window_word_count(SQ.dated_lines(spark, sf_dir), "pub_ts")
    return counts.select(F.date_format("window_start", S.BATCH_KEY_FORMAT).alias("window_start"), "word", "n")


def w3_word_history(spark, sf_dir):
    return RP.word_history(SQ.dated_lines(spark, sf_dir), "pub_ts")


def w2_word_history_20s(spark, sf_dir):
    return RP.word_history(SQ.dated_lines(spark, sf_dir), "pub_ts", "20 seconds")


def w2_word_history_90s(spark, sf_dir):
    return RP.word_history(SQ.dated_lines(spark, sf_dir), "pub_ts", "90 seconds")


def w1_event_counts(spark, sf_dir):
    ev = spark.read.parquet(table_path(sf_dir, "events")).select("ts", "event_type")
    return (ev.groupBy(F.window("ts", S.STREAM_INTERVAL).alias("w"), "event_type")
              .agg(F.count(F.lit(1)).alias("n"))
              .select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                      "event_type", "n"))


def w3_batches_by_arrival(spark, sf_dir):
    """The stream's batch functions over stored lines: a conversation's number says in which batch it arrived."""
    talk = spark.read.parquet(table_path(sf_dir, "conversations"))
    at = F.format_string("2024-01-01 00:00:%02d.000", F.col("conv_id") % 60)
    words = C.words_of_lines(C.text_lines(talk.select(at.alias("batch_time"), "text"), keep=("batch_time",)), "value", keep=("batch_time",))
    counts = words.groupBy("batch_time", "word").agg(F.count(F.lit(1)).alias("n"))
    return WH.batch_history(counts)


def r5_history_frames(spark, sf_dir):
    hist = RP.word_history(SQ.dated_lines(spark, sf_dir), "pub_ts")
    return SK.history_frames(hist).select("batch_time", F.col("pos").cast("int").alias("pos"), "keyword", "n")


# Formats: parsers and renderers over strings made from the tables -------------------
def s3_stopword_list(spark, sf_dir):
    return AR.stopwords_of_lines(_stop_lines(spark, sf_dir))


def _stop_lines(spark, sf_dir):
    """A long stop list, one word per line with blanks around: the words of the benchmark texts."""
    b = spark.read.parquet(table_path(sf_dir, "benchmark"))
    word = F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))
    return b.select(word.alias("w")).select(F.concat(F.lit(" \u3000"), "w", F.lit("\t ")).alias("value"))


def j5_stopword_antijoin(spark, sf_dir):
    toks = TX.tokens(_articles(spark, sf_dir), stopwords=s3_stopword_list(spark, sf_dir))
    return toks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("term").alias("n_terms"))


def t2_table_sentences(spark, sf_dir):
    sent = TX.token_sentence(_articles(spark, sf_dir), s3_stopword_list(spark, sf_dir))
    return sent.select("doc_id", F.size("words").alias("n_words"), "sentence")


def s10_token_lines(spark, sf_dir):
    return SK.token_lines(_articles(spark, sf_dir))


def s11_legacy_counts(spark, sf_dir):
    """Counts as lines of tuples, with quotes and backslashes in the words, and lines that are none."""
    words = C.word_count(C.text_lines(_texts(spark, sf_dir, "documents"))).withColumn("word", F.concat("word", F.when(F.length("word") % 5 == 0, F.lit("'\\x")).otherwise(F.lit(""))))
    inner = F.replace("word", F.lit("\\"), F.lit("\\\\"))
    # as the tuples were printed: double quotes where they spare an escape
    double = F.col("word").contains("'") & ~F.col("word").contains('"')
    quoted = F.when(double, F.concat(F.lit('"'), inner, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(inner, F.lit("'"), F.lit("\\'")), F.lit("'")))
    line = F.concat(F.lit("("), quoted, F.lit(", "), F.col("n").cast("string"), F.lit(")"))
    return SK.parse_counts(words.select(F.explode(F.array(line, F.concat(F.lit("# "), line))).alias("value")))


def s12_history_json(spark, sf_dir):
    hist = RP.word_history(SQ.dated_lines(spark, sf_dir), "pub_ts")
    return SK.parse_history(SK.history_objects(hist), "batch_time")


# Pages -----------------------------------------------------------------------------
def y8_ingest_pages(spark, sf_dir):
    pages = SQ.recrawled(spark, sf_dir)
    # already stored: the URLs of the even pages
    seen = _pages(spark, sf_dir).where("page_id % 2 = 0").select(X.canonical_url("url").alias("url"))
    arts = RP.ingest_pages(pages, seen)
    return arts.select("page_id", "url", "title", "section", "time",
                       F.coalesce("source", F.lit(S.MISSING)).alias("source"),
                       F.size("content").alias("n_paragraphs"),
                       X.content_text("content", " ").alias("content_text"))


def _marked(spark, sf_dir):
    """Pages with a time block, inline tags, references, an unclosed and an empty paragraph."""
    pages = _pages(spark, sf_dir)
    time = F.when(F.col("page_id") % 5 == 0, F.lit("")).otherwise(F.format_string("2024-01-02 03:04:%02d　来源: ", F.col("page_id") % 60))
    block = F.concat(F.lit('<div class="post_time_source"> '), time, F.when(F.col("page_id") % 3 == 0, F.lit('<a href="/s">Desk &amp; Co</a>')).otherwise(F.lit("")), F.lit("</div>"))
    body = F.concat(F.lit("<article><p>one <b>two</b> three &#39;&#x4e2d;</p><p> </p><p class='x'>open "), F.col("page_id").cast("string"), F.lit("<p>\u3000last&nbsp;</p></article>"))
    return pages.select("page_id", "url", F.concat("html", block, body).alias("html"))


def p14_marked_pages(spark, sf_dir):
    return PG.extract_articles(_marked(spark, sf_dir)).select(
        "page_id", "title", "time", F.coalesce("source", F.lit(S.MISSING)).alias("source"), F.size("content").alias("n_paragraphs"), X.content_text("content", "|").alias("content_text"))


NESTED = ("<div class='post_text wide'><p>outer <i>a</i><article class=\"in\"><div><div>x<br>y</div></div><p>open <b>bold<li>item<ul><li>one<li>two</ul></article>"
          "<table><tr><td>1<td>2<tr><th>h</table></b> a < b <!-- <p>no</p> --><style>p{}</style><p>tail</div></div>end")


def p14_element_tree(spark, sf_dir):
    """Text nodes with their paths: each page's own html, and nested and broken blocks behind it."""
    return PT.page_nodes(_pages(spark, sf_dir).select("page_id", F.concat("html", F.lit(NESTED)).alias("html")))


def p14_tree_articles(spark, sf_dir):
    """Article fields of the marked pages, read off the element tree."""
    return PT.extract_articles(_marked(spark, sf_dir)).select(
        "page_id", "title", "time", F.coalesce("source", F.lit(S.MISSING)).alias("source"), F.size("content").alias("n_paragraphs"), X.content_text("content", "|").alias("content_text"))


def p5_url_fields(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    # every third page on a host of the news section
    url = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", r"://([^./]+)\.", "://$1.news.")).otherwise(F.col("url"))
    pages = pages.withColumn("url", url)
    return pages.select(
        "page_id",
        X.canonical_url("url").alias("canonical"),
        X.url_host("url").alias("host"),
        X.url_section("url").alias("section"),
        X.url_province("url").alias("province"),
        X.url_allowed("url", ALLOWED_DOMAINS, ARTICLE_PATH).alias("allowed"))


def p15_links(spark, sf_dir):
    return PG.extract_links(_pages(spark, sf_dir))


def p15_link_forms(spark, sf_dir):
    """Every form of link behind each page's own html: quotings, dot segments, query and fragment only, other schemes, references."""
    forms = ["<a href='#top'>", '<a href="?p=2">', '<a class="c" href=../q.html>', "<A HREF = './a/../b/./c'>", '<a href="mailto:a@b.c">',
             '<a href="//h.example/x/..">', '<a href="/p?a=1&amp;b=2#f">', '<a href="">', '<a data-href="no">', '<link href="style.css">', "<area href='/%20map'>", '<a href="HTTPS://H.example/k">', '<a href="&#47;dec">']
    return PG.extract_links(_pages(spark, sf_dir).select("page_id", "url", F.concat("html", F.lit("".join(forms))).alias("html")))


def p16_urls_in_text(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    text = F.concat(F.lit("see "), F.col("url"), F.lit(" or (http://x.org/%41?q=ü) \""), F.col("url"), F.lit('/more" https:/no '), F.col("html"), F.format_string(" behind: http://h%d.example/p", "page_id"))
    return pages.select("page_id", F.explode(F.array_distinct(X.urls_in_text(text))).alias("url"))


def j4_unseen_urls(spark, sf_dir):
    """Links not yet stored: all but those of the even pages."""
    links = PG.extract_links(_pages(spark, sf_dir))
    seen = links.where("page_id % 2 = 0").select(F.col("dst").alias("url"))
    return PG.unseen(links.select(F.col("dst").alias("url")).distinct(), seen)


def j7_link_depth(spark, sf_dir):
    """From the first page: pages lead to two further ones each, and to the links they hold."""
    pages = _pages(spark, sf_dir)
    own = X.canonical_url("url")
    child = pages.where("page_id > 0").select(F.expr("(page_id - 1) div 2").alias("parent"), own.alias("dst"))
    tree = child.join(pages.select(F.col("page_id").alias("parent"), own.alias("src")), "parent").select("src", "dst")
    edges = PG.extract_links(pages).select("src", "dst").unionByName(tree)
    seeds = pages.where("page_id = 0").select(own.alias("url"))
    return PG.link_depth(edges, seeds)


# Scalar and text helpers ------------------------------------------------------
def p10_int_words(spark, sf_dir):
    words = C.word_count(C.text_lines(_texts(spark, sf_dir, "documents")))
    return words.where(X.is_int_token("word"))


def p1_content_text(spark, sf_dir):
    """Paragraphs trimmed and joined without and with a blank (P1, P9); some texts made empty are dropped."""
    d = ensure_parallel(spark.read.parquet(table_path(sf_dir, "documents")).select("doc_id", "text"), "doc_id")
    pad = F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("\u3000 "), x, F.lit("\t\u00a0")))
    content = X.trim_all(F.when(F.col("doc_id") % 10 == 3, F.array(F.lit(" \u3000"))).otherwise(pad))
    rows = d.select("doc_id", X.content_text(content).alias("text"), X.content_text(content, " ").alias("spaced"))
    return AR.non_empty(rows).select("doc_id", F.md5("text").alias("text_md5"), F.md5("spaced").alias("spaced_md5"))


def p3_publish_times(spark, sf_dir):
    """Time texts as pages hold them: padded, trailed by the source label, missing or bad."""
    e = spark.read.parquet(table_path(sf_dir, "events")).select("event_id", "ts")
    shown = F.concat(F.lit(" \u3000\n"), F.date_format("ts", S.TIME_FORMAT), F.lit("\u3000来源: "))
    raw = F.when(F.col("event_id") % 11 == 0, F.lit(" ")).when(F.col("event_id") % 13 == 0, F.lit("2024-13-01 00:00:00")).otherwise(shown)
    return e.select("event_id", X.with_default(X.clean_time(raw)).alias("time"), X.parse_pub_time(X.clean_time(raw)).alias("pub_ts"))


def p12_depth_cap(spark, sf_dir):
    arts = _articles(spark, sf_dir).withColumn("depth", (1 + F.col("doc_id") % 6).cast("int")).where(F.col("depth") <= S.MAX_DEPTH)
    return arts.groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


def p17_day_hour(spark, sf_dir):
    arts = _articles(spark, sf_dir).where(F.col("pub_ts").isNotNull())
    return arts.select("doc_id", X.month_day("pub_ts").alias("day"),
                       X.hour_of("pub_ts").alias("hour"),
                       X.hour_label(X.hour_of("pub_ts")).alias("hour_label"),
                       X.minute_key("pub_ts").alias("minute_key"),
                       X.minute_key("pub_ts", S.FILE_MINUTE_FORMAT).alias("file_minute"))


def t2_token_sentences(spark, sf_dir):
    sent = TX.token_sentence(_articles(spark, sf_dir), S.DEFAULT_STOPWORDS)
    return sent.select("doc_id", F.size("words").alias("n_words"), "sentence")


def t1_cjk_bigrams(spark, sf_dir):
    """Texts with ten letters written as Han characters: bigrams of Han runs, other runs whole."""
    d = ensure_parallel(spark.read.parquet(table_path(sf_dir, "documents")).select("doc_id", "text"), "doc_id")
    han = F.translate(F.lower("text"), "aeiourstnh", "中文汉字测试数据分析")
    toks = TX.tokens(d.select("doc_id", han.alias("text")), mode="cjk_bigram")
    return toks.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def _in_han(c="text"):
    """Ten letters written as Han characters."""
    return F.translate(F.lower(c), "aeiourstnh", "中文汉字测试数据分析").alias("text")


def t1_dictionary_words(spark, sf_dir):
    """Texts in Han characters cut by a dictionary: the runs of up to four characters that the conversations repeat."""
    talk = spread_texts(spark.read.parquet(table_path(sf_dir, "conversations")).select("text")).select(_in_han())
    known = SG.count_dictionary(SG.han_ngrams(talk, longest=4), least=5)
    d = spread_texts(spark.read.parquet(table_path(sf_dir, "documents")).select("doc_id", "text"), "doc_id")
    toks = TX.tokens(d.select("doc_id", _in_han()), mode="dictionary", dictionary=known)
    return toks.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def t4h_hashed_tf(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    hashed = TX.hashed_tf(_articles(spark, sf_dir), stopwords=S.DEFAULT_STOPWORDS, num_features=1 << 10)
    return hashed.select("doc_id", F.aggregate(vector_to_array("raw_features"), F.lit(0.0), lambda a, x: a + x).cast("bigint").alias("n_tokens"))


def t3_space_tokens(spark, sf_dir):
    docs = ensure_parallel(spark.read.parquet(table_path(sf_dir, "documents")).select("doc_id", "text"))
    return docs.select("doc_id", F.size(TX.tokenize_space("text")).alias("n_tokens"))


def r7_last_n(spark, sf_dir):
    latest = R.last_n(_articles(spark, sf_dir), S.BLOCK_LAST_N)
    return latest.select("doc_id", "title")


QUERIES: dict[str, QueryFn] = {
    "y1_article_keywords": y1_article_keywords,
    "t5_doc_freq": t5_doc_freq,
    "t6_tfidf": t6_tfidf,
    "y2_block_keywords": y2_block_keywords,
    "j1_pair_similarity": j1_pair_similarity,
    "j3_votes": j3_votes,
    "y4_hotness": y4_hotness,
    "r4_hot_board": r4_hot_board,
    "y3_related_articles": y3_related_articles,
    "y5_hot_news_report": y5_hot_news_report,
    "a1_word_count": a1_word_count,
    "a1_conversation_word_count": a1_conversation_word_count,
    "a2_top_words": a2_top_words,
    "a3_source_counts": a3_source_counts,
    "a4_hour_grid": a4_hour_grid,
    "a5_distinct_urls": a5_distinct_urls,
    "w1_window_word_count": w1_window_word_count,
    "w1_event_counts": w1_event_counts,
    "w3_word_history": w3_word_history,
    "w2_word_history_20s": w2_word_history_20s,
    "w2_word_history_90s": w2_word_history_90s,
    "w3_batches_by_arrival": w3_batches_by_arrival,
    "s3_stopword_list": s3_stopword_list,
    "j5_stopword_antijoin": j5_stopword_antijoin,
    "t2_table_sentences": t2_table_sentences,
    "s10_token_lines": s10_token_lines,
    "s11_legacy_counts": s11_legacy_counts,
    "s12_history_json": s12_history_json,
    "p14_marked_pages": p14_marked_pages,
    "p14_element_tree": p14_element_tree,
    "p14_tree_articles": p14_tree_articles,
    "p15_link_forms": p15_link_forms,
    "p16_urls_in_text": p16_urls_in_text,
    "j4_unseen_urls": j4_unseen_urls,
    "p1_content_text": p1_content_text,
    "p3_publish_times": p3_publish_times,
    "t1_cjk_bigrams": t1_cjk_bigrams,
    "t1_dictionary_words": t1_dictionary_words,
    "t4h_hashed_tf": t4h_hashed_tf,
    "r5_history_frames": r5_history_frames,
    "y8_ingest_pages": y8_ingest_pages,
    "p5_url_fields": p5_url_fields,
    "p15_links": p15_links,
    "j7_link_depth": j7_link_depth,
    "p10_int_words": p10_int_words,
    "p12_depth_cap": p12_depth_cap,
    "p17_day_hour": p17_day_hour,
    "t2_token_sentences": t2_token_sentences,
    "t3_space_tokens": t3_space_tokens,
    "r7_last_n": r7_last_n,
} | SQ.QUERIES
