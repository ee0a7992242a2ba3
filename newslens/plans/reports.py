"""Composite queries a user calls.

Each takes DataFrames and returns a lazy DataFrame; only the similarity counts its
documents while its plan is built.  Intermediates that several branches read are kept by `session.reuse`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslens import schema as S
from newslens.operators import counts as C
from newslens.operators import pages as PG
from newslens.operators import ranking as R
from newslens.operators import similarity as SIM
from newslens.operators import text as TX
from newslens.session import SHUFFLES_GO, kept, reuse, settings

PAIR_ATTRS = ("section", "age")


def similarity_pairs(articles: DataFrame, stopwords: TX.StopWords = S.DEFAULT_STOPWORDS,
                     k: int = S.TOP_KEYWORDS, now: str | None = None, mode: str = "words",
                     salt_rows: int = SIM.SALT_ROWS, min_sim: float | None = None) -> DataFrame:
    """J1 over a corpus.  With `now`, pairs carry section and age for the
    related-titles step; without, they carry nothing that votes don't need."""
    if now is None:
        tk = SIM.term_table(articles, stopwords, k, mode)
        return SIM.pair_similarity(tk, salt_rows=salt_rows, min_sim=min_sim)
    tk = SIM.term_table(R.with_age(articles, now), stopwords, k, mode, attrs=PAIR_ATTRS)
    return SIM.pair_similarity(tk, same=("section",), carry=("age",), salt_rows=salt_rows, min_sim=min_sim)


def article_votes(articles: DataFrame, stopwords: TX.StopWords = S.DEFAULT_STOPWORDS,
                  k: int = S.TOP_KEYWORDS, mode: str = "words", threshold: float = S.VOTE_THRESHOLD) -> DataFrame:
    """J3 over a corpus: (doc_id, votes).  Worked out when called; what it kept is given back."""
    with kept(), settings(articles.sparkSession, SHUFFLES_GO):
        tk = SIM.term_table(articles, stopwords, k, mode, part_docs=SIM.PART_DOCS,
                            columns=("doc_id", "term", "tf", "df", "is_kw", "kw_norm"))
        blocks = SIM.blocks_of(tk)
    return SIM.votes_of_blocks(blocks, threshold).select(F.col("doc_id").cast(articles.schema["doc_id"].dataType).alias("doc_id"), "votes")


def related_pairs(articles: DataFrame, stopwords: TX.StopWords = S.DEFAULT_STOPWORDS,
                  k: int = S.TOP_KEYWORDS, now: str = S.QUERY_NOW, mode: str = "words",
                  max_gap: int = S.RELATED_MAX_GAP_MIN, salt_rows: int = SIM.SALT_ROWS) -> DataFrame:
    """J1 restricted to what related titles can use: section and a time bucket are
    join keys, so articles of other sections or days never meet."""
    tk = SIM.term_table(R.with_age(articles, now), stopwords, k, mode, attrs=PAIR_ATTRS)
    return SIM.pair_similarity(tk, same=("section",), carry=("age",), salt_rows=salt_rows,
                               block=("section",), near=("age", max_gap))


def hotness_scores(articles: DataFrame, pairs: DataFrame, now: str = S.QUERY_NOW,
                   threshold: float = S.VOTE_THRESHOLD, g: float = S.GRAVITY) -> DataFrame:
    """Votes (J3) → raw score (R1) → 0..100 (R2)."""
    return R.hotness(articles, SIM.votes(pairs, threshold), now, g)


def related_articles(articles: DataFrame, pairs: DataFrame, k: int = S.TOP_RELATED,
                     max_gap: int = S.RELATED_MAX_GAP_MIN) -> DataFrame:
    """(doc_id, rank, title, sim) among dated articles of the same section."""
    dated = articles.where(F.col("pub_ts").isNotNull()).select("doc_id", "title")
    live = pairs.where(F.col("age_lo").isNotNull() & F.col("age_hi").isNotNull())
    return SIM.related(live, dated, k, max_gap)


def related_titles(articles: DataFrame, stopwords: TX.StopWords = S.DEFAULT_STOPWORDS, k: int = S.TOP_KEYWORDS,
                   related_k: int = S.TOP_RELATED, now: str = S.QUERY_NOW, mode: str = "words") -> DataFrame:
    """Y3 without listed pairs: as `related_articles(articles, related_pairs(articles))`.  Its partners are worked out when called."""
    dated = articles.where(F.col("pub_ts").isNotNull()).select("doc_id", "title")
    with kept(), settings(articles.sparkSession, SHUFFLES_GO):
        tk = SIM.term_table(R.with_age(articles, now), stopwords, k, mode, attrs=PAIR_ATTRS, part_docs=SIM.PART_DOCS)
        return SIM.related_in_cells(tk, dated, related_k)


def collect_ranked(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """(key, ARRAY of value in rank order); groups hold at most k rows."""
    arr = F.array_sort(F.collect_list(F.struct(F.col("rank"), F.col(value).alias("v"))))
    return df.groupBy(key).agg(F.transform(arr, lambda s: s["v"]).alias(out))


def hot_news_report(articles: DataFrame, stopwords: TX.StopWords = S.DEFAULT_STOPWORDS,
                    k: int = S.TOP_KEYWORDS, related_k: int = S.TOP_RELATED,
                    now: str = S.QUERY_NOW, mode: str = "words") -> DataFrame:
    """(doc_id, title, attention, keyword[], samenews[]) — one row per article.

    Parts are attached by equi-joins on doc_id (J6), never by position.
    """
    dated = R.with_age(articles, now)
    tk = SIM.term_table(dated, stopwords, k, mode, attrs=PAIR_ATTRS, part_docs=SIM.PART_DOCS)
    # Votes need every pair but nothing besides its similarity; related titles need
    # attributes, but only of pairs of one section and near in time.
    voting = SIM.count_votes(tk)
    # Keywords are the flagged rows of the same term table: one tokenizer pass.
    kw = tk.where("is_kw").select("doc_id", "rank", "term", "tf", "tfidf")
    hot = R.hotness(articles, voting, now)
    rel = SIM.related_in_cells(tk, articles.where(F.col("pub_ts").isNotNull()).select("doc_id", "title"), related_k)
    return (articles.select("doc_id", "title")
            .join(hot.select("doc_id", F.col("hotness").alias("attention")), "doc_id", "left")
            .join(collect_ranked(kw, "doc_id", "term", "keyword"), "doc_id", "left")
            .join(collect_ranked(rel, "doc_id", "title", "samenews"), "doc_id", "left")
            .select("doc_id", "title", "attention",
                    F.coalesce("keyword", F.array().cast("array<string>")).alias("keyword"),
                    F.coalesce("samenews", F.array().cast("array<string>")).alias("samenews")))


def word_history(token_lines: DataFrame, ts_col: str, interval: str = S.STREAM_INTERVAL,
                 k: int = S.HISTORY_TOP) -> DataFrame:
    """Y6 batch form: (batch_time, rank, keyword, n) — top-k words per interval.

    `token_lines` holds (ts, value) lines of blank-separated tokens; windows are
    tumbling `interval` windows on `ts`, keyed by their end to the second, so
    windows shorter than a minute have keys of their own (W2).
    """
    counts = window_word_count(token_lines, ts_col, interval) \
        .withColumn("batch_time", F.date_format("window_end", S.BATCH_KEY_FORMAT))
    top = C.top_words(counts, k, group="batch_time")
    return top.select("batch_time", F.col("rank").cast("int").alias("rank"),
                      F.col("word").alias("keyword"), "n")


def window_word_count(token_lines: DataFrame, ts_col: str, interval: str = S.STREAM_INTERVAL) -> DataFrame:
    """W1 / W2 over stored lines: (window_start, window_end, word, n), not cumulative."""
    words = C.words_of_lines(token_lines, "value", keep=(ts_col,))
    return (words.groupBy(F.window(ts_col, interval).alias("w"), "word")
                 .agg(F.count(F.lit(1)).alias("n"))
                 .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "word", "n"))


def ingest_pages(pages: DataFrame, existing_urls: DataFrame | None = None,
                 rules: PG.ExtractRules = PG.DEFAULT_RULES) -> DataFrame:
    """Extract articles, keep each canonical URL once, skip URLs already stored."""
    arts = PG.first_per_url(PG.extract_articles(pages, rules), "page_id")
    if existing_urls is not None:
        arts = PG.unseen(arts, existing_urls)
    return arts


def publish_reports(articles: DataFrame, out_dir: str, at: str,
                    stopwords: TX.StopWords = S.DEFAULT_STOPWORDS, now: str = S.QUERY_NOW,
                    last_n: int = S.BLOCK_LAST_N, mode: str = "words") -> None:
    """S6 + Y5 + Y2: write `<out>/hot_news` (one JSON object per article) and
    `<out>/window_keywords` (one object: time, timekeyword[])."""
    from newslens.sources import sinks as SK

    with kept():
        report = hot_news_report(articles, stopwords, now=now, mode=mode)
        SK.write_report(report.select("title", "attention", "keyword", "samenews"), f"{out_dir}/hot_news")
        block = TX.block_keywords(articles, stopwords, last_n, mode=mode)
        SK.write_report(SK.window_keyword_report(block, at), f"{out_dir}/window_keywords")


def publish_snapshot(articles: DataFrame, path: str, at: str,
                     stopwords: TX.StopWords = S.DEFAULT_STOPWORDS, now: str = S.QUERY_NOW,
                     last_n: int = S.BLOCK_LAST_N, mode: str = "words") -> int:
    """S6 + Y5 + Y2 as one version of `sources.snapshots`: the parts `hot_news` and
    `window_keywords` become readable together, or, if one fails, not at all."""
    from newslens.sources import sinks as SK
    from newslens.sources import snapshots as SN

    with kept():
        report = hot_news_report(articles, stopwords, now=now, mode=mode)
        block = TX.block_keywords(articles, stopwords, last_n, mode=mode)
        return SN.publish(articles.sparkSession, path, at, {
            "hot_news": report.select("title", "attention", "keyword", "samenews"),
            "window_keywords": SK.window_keyword_report(block, at)})


def crawl_batch(pages: DataFrame, store_path: str, tokens_path: str, fetched_at: str,
                stopwords: TX.StopWords = S.DEFAULT_STOPWORDS, count_repeats: bool = True,
                rules: PG.ExtractRules = PG.DEFAULT_RULES, mode: str = "words",
                batch_id: str | None = None, seen_path: str | None = None) -> DataFrame:
    """Y8 with its two sinks: token lines for the word-count stream (S10) and the
    article store (S9).  With `count_repeats` (the original behaviour, Q11) every
    fetched article feeds the token files, also when its URL is already stored;
    otherwise only newly stored ones do.  Both sinks are keyed by `batch_id` (by
    default the fetch time), so a batch that is run again replaces its own rows.
    `seen_path` names a bucketed store of seen URLs (`sources.seen`).
    Returns the newly stored articles.
    """
    from newslens.sources import sinks as SK

    batch_id = batch_id or "".join(c for c in fetched_at if c.isdigit())
    extracted = PG.first_per_url(PG.extract_articles(pages, rules), "page_id")
    stored = SK.append_new_articles(extracted, store_path, batch_id=batch_id, seen_path=seen_path)
    counted = extracted if count_repeats else stored
    lines = counted.select(F.col("page_id").alias("doc_id"),
                           F.concat_ws(" ", "content").alias("text"),
                           F.lit(fetched_at).cast("timestamp_ntz").alias("pub_ts"))
    SK.write_token_files(lines, tokens_path, stopwords, mode=mode, batch_id=batch_id)
    return stored
