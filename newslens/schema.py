"""Schemas and fixed values (S2 and the report / history layouts)."""

from __future__ import annotations

from pyspark.sql import types as T

# One fetched article.  `time` stays text as written by the fetcher
# ("yyyy-MM-dd HH:mm:ss" or the sentinel "#"); `source` may be absent.
ARTICLE_SCHEMA = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("title", T.StringType()),
    T.StructField("section", T.StringType()),
    T.StructField("time", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("content", T.ArrayType(T.StringType())),
])

# Hot-news report row.
REPORT_SCHEMA = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("attention", T.DoubleType()),
    T.StructField("keyword", T.ArrayType(T.StringType())),
    T.StructField("samenews", T.ArrayType(T.StringType())),
])

# Word-count history, long form.
HISTORY_SCHEMA = T.StructType([
    T.StructField("batch_time", T.StringType()),
    T.StructField("rank", T.IntegerType()),
    T.StructField("keyword", T.StringType()),
    T.StructField("n", T.LongType()),
])

# ---------------------------------------------------------------------------
# Fixed values.  These must equal the original tool's for equal results.
# ---------------------------------------------------------------------------
# Sentinel written for a missing title or publish time.
MISSING = "#"
# Bucket name for articles without a source in the source chart.
UNDEFINED_SOURCE = "undefined"
# Section that triples the hotness score.
NEWS_SECTION = "news"
# Time text layout, minute keys of the word-count history (current and older
# form) and token-file names.
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
MINUTE_KEY_FORMAT = "yyyy-MM-dd HH:mm"
OLD_MINUTE_KEY_FORMAT = "yyyy-MM-dd HH-mm"
FILE_MINUTE_FORMAT = "yyyyMMddHHmm"
# Own history keys: to the second, as batches may be shorter than a minute.
BATCH_KEY_FORMAT = "yyyy-MM-dd HH:mm:ss"
# Characters stripped from the right of the time text (a trim *set*).
TIME_TRAILER = "　来源: "
# Field names of one history entry ("keyword", "count").
HISTORY_KEYWORD_FIELD = "关键词"
HISTORY_COUNT_FIELD = "数量"
# Hotness constants: gravity factor, age offset, depth ceiling, news factor,
# vote threshold, maximal gap in minutes for related titles.
GRAVITY = 9.8
AGE_OFFSET = 2
DEPTH_CEILING = 10
NEWS_FACTOR = 3
VOTE_THRESHOLD = 0.3
RELATED_MAX_GAP_MIN = 24 * 60
# Sizes: keywords per article and per block, related titles, block length,
# batch interval of the word-count stream, history entries per frame, depth cap.
TOP_KEYWORDS = 20
TOP_RELATED = 10
BLOCK_LAST_N = 100
STREAM_INTERVAL = "61 seconds"
HISTORY_TOP = 20
MAX_DEPTH = 3

# Short stop-word list used by the registered queries over the test tables
# (en/fr/de/es prose).  Users pass their own list through `read_stopwords`.
DEFAULT_STOPWORDS = ("the", "of", "and", "to", "in", "de", "la", "le", "et",
                     "und", "der", "que")

# Fixed "now" of the registered queries, so ages are reproducible.
QUERY_NOW = "2024-02-01 00:00:00"
