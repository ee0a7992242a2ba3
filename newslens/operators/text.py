"""Text → terms → weights.

Plan shape (per corpus): tokens are exploded once; term frequency is a
(doc_id, term) aggregate with map-side partial counting; document frequency a
(term) aggregate over that; TF-IDF one equi-join on term; top-k keywords a
`row_number` filter that Catalyst turns into a partial+final `WindowGroupLimit`
(each map task keeps at most k rows per document before the shuffle).
The corpus size `m` is a scalar subquery, never a join or an unpartitioned
window.  Exact counts, no hashing trick (the hashed variant is `hashed_tf`).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newslens import schema as S
from newslens.functions import exprs as X
from newslens.operators import segmentation as SG
from newslens.session import reuse

# Largest stop-word table shipped to every task as a broadcast hash set.
STOPWORD_BROADCAST_MAX = 1_000_000
# Hot terms (see `attach_doc_freq`): most terms in the broadcast table, and the
# fewest documents that make a term hot.
HOT_TERMS_MAX = 1_000_000
HOT_ROWS_MIN = 100_000

StopWords = Iterable[str] | DataFrame | None


# T1 -------------------------------------------------------------------------
def tokens(articles: DataFrame, mode: str = "words", stopwords: StopWords = None,
           text_col: str = "text", id_col: str = "doc_id", dictionary: DataFrame | None = None) -> DataFrame:
    """Long form (doc_id, term): one row per token occurrence, stop words removed.

    Mode `dictionary` cuts runs of Han characters with a table of counted words
    (term, n), see `newslens.operators.segmentation`.
    """
    if mode == "dictionary":
        if dictionary is None:
            raise ValueError("mode 'dictionary' needs a dictionary of (term, n)")
        toks = SG.dictionary_tokens(articles, dictionary, text_col, id_col).select("doc_id", "term")
    else:
        toks = articles.select(F.col(id_col).alias("doc_id"),
                               F.explode(X.segment(text_col, mode)).alias("term"))
    toks = toks.where(F.length("term") > 0)
    return remove_stopwords(toks, stopwords)


# T2 / J5 --------------------------------------------------------------------
def remove_stopwords(toks: DataFrame, stopwords: StopWords, term_col: str = "term") -> DataFrame:
    """Drop stop words (case-sensitive, duplicates and order of the rest kept).

    A literal list becomes an `InSet` predicate inside the scan's codegen
    stage.  A stop-word table is anti-joined; it is broadcast only after its
    size has been checked, otherwise the join is left to the planner.
    """
    if stopwords is None:
        return toks
    if isinstance(stopwords, DataFrame):
        stop = stopwords.select(F.col(stopwords.columns[0]).alias("_stop")).distinct()
        n = stop.limit(STOPWORD_BROADCAST_MAX + 1).count()
        if n <= STOPWORD_BROADCAST_MAX:
            stop = F.broadcast(stop)
        return toks.join(stop, F.col(term_col) == F.col("_stop"), "left_anti")
    words = sorted(set(stopwords))
    if not words:
        return toks
    return toks.where(~F.col(term_col).isin(words))


def token_sentence(articles: DataFrame, stopwords: StopWords = (), mode: str = "words",
                   text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """T2 in array form: (doc_id, *keep, words ARRAY, sentence), order and duplicates kept.

    A list is filtered inside the array; a table is anti-joined over positions
    and the arrays are put together again (an article may lose all its words).
    """
    words = X.segment(text_col, mode)
    if isinstance(stopwords, DataFrame):
        rows = articles.select("doc_id", F.posexplode(words).alias("pos", "term"))
        left = remove_stopwords(rows.where(F.length("term") > 0), stopwords)
        arr = F.array_sort(F.collect_list(F.struct("pos", "term")))
        kept = left.groupBy("doc_id").agg(F.transform(arr, lambda s: s["term"]).alias("words"))
        out = articles.select("doc_id", *keep).join(kept, "doc_id", "left") \
                      .withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    else:
        out = articles.select("doc_id", *keep, X.drop_stopwords_array(words, stopwords or ()).alias("words"))
    return out.withColumn("sentence", F.concat_ws(" ", "words"))


def tokenize_space(sentence: str | Column) -> Column:
    """Lower-case and split on single blanks; empty tokens are dropped (Q24)."""
    return F.filter(F.split(F.lower(X.col_(sentence)), X.BLANK), lambda x: F.length(x) > 0)


# T4 / T4h ---------------------------------------------------------------------
def term_freq(toks: DataFrame) -> DataFrame:
    """(doc_id, term, tf): exact counts, partial aggregation before the shuffle."""
    return toks.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def hashed_tf(articles: DataFrame, num_features: int = 1 << 18, mode: str = "words",
              stopwords: Iterable[str] = ()) -> DataFrame:
    """T4h: the ML hashing-trick variant (collisions possible by design)."""
    from pyspark.ml.feature import HashingTF

    words = token_sentence(articles, stopwords, mode).select("doc_id", "words")
    return HashingTF(inputCol="words", outputCol="raw_features",
                     numFeatures=num_features).transform(words)


# T5 / T6 ----------------------------------------------------------------------
def article_count(articles: DataFrame) -> Column:
    """m: number of kept articles, as a scalar subquery (one tiny job, no join)."""
    return articles.select(F.count(F.lit(1))).scalar()


def idf_expr(m: Column, df: Column) -> Column:
    return F.ln((m + F.lit(1)).cast("double") / (df + F.lit(1)).cast("double"))


def doc_freq(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def attach_doc_freq(tf: DataFrame, hot_terms_max: int = HOT_TERMS_MAX,
                    hot_rows_min: int = HOT_ROWS_MIN) -> DataFrame:
    """tf rows with their term's document frequency, safe for Zipf-skewed terms.

    A term held by at least `floor = max(hot_rows_min, rows / hot_terms_max)`
    documents is hot.  Since the df of all terms sum to the row count, at most
    `hot_terms_max` terms can be hot: that table has a proven size bound and is
    broadcast, so hot-term rows are matched where they are, never shuffled.
    All other terms meet in an ordinary shuffle join on term in which no key
    holds more than `floor` rows.  The counts are kept, as three branches read them.
    """
    df = reuse(doc_freq(tf))
    rows = tf.select(F.count(F.lit(1))).scalar()
    floor = F.greatest(F.lit(hot_rows_min), F.ceil(rows / F.lit(hot_terms_max)))
    hot = F.broadcast(df.where(F.col("df") >= floor))
    # One row per cold term: hash it per partition instead of sorting every tf row by term.
    cold = df.where(F.col("df") < floor).hint("shuffle_hash")
    hot_part = tf.join(hot, "term")
    cold_part = tf.join(hot.select("term"), "term", "left_anti").join(cold, "term")
    return hot_part.unionByName(cold_part)


def tfidf(tf: DataFrame, m: Column) -> DataFrame:
    """(doc_id, term, tf, df, idf, tfidf) with idf = ln((m+1)/(df+1)), raw tf."""
    return with_tfidf(attach_doc_freq(tf), m)


def with_tfidf(counted: DataFrame, m: Column) -> DataFrame:
    """`idf` and `tfidf` of rows that have `tf` and `df`."""
    return (counted.withColumn("idf", idf_expr(m, F.col("df")))
                   .withColumn("tfidf", F.col("tf") * F.col("idf")))


# T7 / R6 ----------------------------------------------------------------------
def with_rank_key(weights: DataFrame) -> DataFrame:
    """Weight rounded to 9 digits as a column: engines agree on ties, and the
    sort compares a plain double instead of re-rounding on every comparison."""
    return weights.withColumn("w9", F.round("tfidf", 9))


def rank_window(k_col: str = "doc_id") -> Window:
    return Window.partitionBy(k_col).orderBy(F.col("w9").desc(), F.col("term").asc())


def keywords(weights: DataFrame, k: int = S.TOP_KEYWORDS, key: str = "doc_id") -> DataFrame:
    """Top-k distinct terms per document by TF-IDF (ties: term ascending)."""
    return (with_rank_key(weights).withColumn("rank", F.row_number().over(rank_window(key)))
                   .where(F.col("rank") <= k)
                   .select(key, "rank", "term", "tf", "tfidf"))


def flag_keywords(weights: DataFrame, k: int = S.TOP_KEYWORDS) -> DataFrame:
    """Every (doc, term) row with `is_kw` and the document's keyword norm.

    kw_norm = Σ tf² over the document's keywords (n(i) of the similarity).
    Both come from one window partitioned by doc_id, so no extra shuffle.
    """
    by_doc = Window.partitionBy("doc_id")
    flagged = with_rank_key(weights).withColumn("rank", F.row_number().over(rank_window()))
    flagged = flagged.withColumn("is_kw", F.col("rank") <= k)
    sq = F.when(F.col("is_kw"), F.col("tf") * F.col("tf")).otherwise(F.lit(0))
    return flagged.withColumn("kw_norm", F.sum(sq).over(by_doc))


def article_keywords(articles: DataFrame, stopwords: StopWords = S.DEFAULT_STOPWORDS,
                     k: int = S.TOP_KEYWORDS, mode: str = "words",
                     dictionary: DataFrame | None = None) -> DataFrame:
    """(doc_id, rank, term, tf, tfidf)."""
    tf = reuse(term_freq(tokens(articles, mode, stopwords, dictionary=dictionary)))
    return keywords(tfidf(tf, article_count(articles)), k)


# T8 / T9 / R7 -----------------------------------------------------------------
def block_threshold(articles: DataFrame, last_n: int = S.BLOCK_LAST_N) -> Column:
    """Smallest doc_id among the latest `last_n` articles (scalar subquery).

    A top-n per partition then a final top-n (TakeOrdered): no global sort.
    """
    latest = articles.select("doc_id").orderBy(F.col("doc_id").desc()).limit(last_n)
    return latest.select(F.min("doc_id")).scalar()


def block_tfidf(articles: DataFrame, stopwords: StopWords = S.DEFAULT_STOPWORDS,
                last_n: int = S.BLOCK_LAST_N, mode: str = "words") -> DataFrame:
    """The latest `last_n` articles merged into one document.

    Earlier articles stay separate; idf is over (earlier articles + 1).  The
    merge is a relabelling of doc_id, so the plan is the plain TF-IDF plan;
    the merged document is one hot key only for the final (doc, term) counts,
    which are partially aggregated per term.  Output label `doc_id` is -1 for
    the block.
    """
    start = block_threshold(articles, last_n)
    m_block = articles.select(F.count_if(F.col("doc_id") < start) + F.lit(1)).scalar()
    toks = tokens(articles, mode, stopwords)
    toks = toks.withColumn("doc_id", F.when(F.col("doc_id") >= start, F.lit(-1))
                           .otherwise(F.col("doc_id")))
    return tfidf(reuse(term_freq(toks)), m_block)


def block_keywords(articles: DataFrame, stopwords: StopWords = S.DEFAULT_STOPWORDS,
                   last_n: int = S.BLOCK_LAST_N, k: int = S.TOP_KEYWORDS,
                   mode: str = "words") -> DataFrame:
    """(rank, term, tfidf) of the merged block; a top-k, not a sort."""
    blk = block_tfidf(articles, stopwords, last_n, mode).where(F.col("doc_id") == -1)
    order = [F.col("w9").desc(), F.col("term").asc()]
    top = with_rank_key(blk).orderBy(*order).limit(k)
    w = Window.orderBy(*order)
    # `top` holds at most k rows, so this window is over k rows only.
    return top.select(F.row_number().over(w).alias("rank"), "term", "tf", "tfidf")
