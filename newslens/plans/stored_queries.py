"""Registered queries that go through files: written to the cluster's shared folder by a sink or
as a source's input, and read back.  Paths come from `work_folder`, so driver and executors see them."""

from __future__ import annotations

import contextlib
import time

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newslens import schema as S
from newslens.functions import exprs as X
from newslens.operators import counts as C
from newslens.operators import pages as PG
from newslens.operators import text as TX
from newslens.operators.rolling_block import RollingBlock
from newslens.plans import reports as RP
from newslens.session import SHUFFLES_GO, cores, ensure_parallel, reuse, settings, table_path, work_folder
from newslens.sources import articles as AR
from newslens.sources import seen as SEEN
from newslens.sources import sinks as SK
from newslens.sources import snapshots as SN
from newslens.streaming import event_time as ET
from newslens.streaming import word_history as WH

# What every fifth text of the glued files ends with: cuts inside strings, quotes and backslashes.
BRACES = '\nsay "}{" \\}{ {"x":"}{"'


def _documents(spark, sf_dir):
    return ensure_parallel(spark.read.parquet(table_path(sf_dir, "documents")), "doc_id")


def _glued(df, path: str) -> str:
    """Objects (column `j`) as files of `{...}{...}`: the writer's line separator is the cut."""
    df.select(F.expr("substring(j, 2, length(j) - 2)").alias("value")).write.option("lineSep", "}{").text(path)
    return path


def _glued_documents(spark, sf_dir):
    """Documents as glued objects; every seventh is torn inside a string, every fifth holds `}{` in its strings."""
    d = _documents(spark, sf_dir)
    text = F.concat("text", F.when(F.col("doc_id") % 5 == 2, F.lit(BRACES)).otherwise(F.lit("")))
    whole = F.to_json(F.struct(F.col("doc_id"), F.col("source"), F.split(text, "\n").alias("content"), F.struct("lang").alias("site")))
    torn = F.concat(F.substring(whole, 1, 10), F.lit('"to\n}'))
    return _glued(d.select(F.when(F.col("doc_id") % 7 == 3, torn).otherwise(whole).alias("j")), work_folder(spark, "glued"))


def _read_glued(spark, sf_dir, quoted: bool):
    schema = T.StructType.fromDDL("doc_id long, source string, content array<string>, site struct<lang: string>")
    rec = AR.read_concat_json(spark, _glued_documents(spark, sf_dir), schema, keep_order=False, keep_rejects=True, quoted=quoted)
    return rec.select("doc_id", "source", F.col("site.lang").alias("lang"), X.content_text("content", "\n").alias("text"), F.col("rejected").isNotNull().alias("torn"))


def s1_concat_json(spark, sf_dir):
    """Glued files cut at `}{` outside of strings: every whole record comes back, the torn ones as rejects."""
    return _read_glued(spark, sf_dir, quoted=True)


def s1_cut_everywhere(spark, sf_dir):
    """The same files cut at every `}{`: a record with k of them in its strings is k + 1 rejects."""
    return _read_glued(spark, sf_dir, quoted=False)


def s2_article_records(spark, sf_dir):
    """Article records in the store's schema, through a glued file, as canonical articles."""
    d = _documents(spark, sf_dir)
    time = F.when(F.col("doc_id") % 11 == 0, F.lit(S.MISSING)).otherwise(F.format_string(" 2024-01-02 03:%02d:%02d　来源: ", F.col("doc_id") % 60, F.col("doc_id") % 59))
    record = F.struct(
        F.format_string("https://news.example.com/%d.html", "doc_id").alias("url"), (1 + F.col("doc_id") % 3).cast("int").alias("depth"),
        F.substring_index("text", "\n", 1).alias("title"), F.col("lang").alias("section"), time.alias("time"), F.col("source"), F.split("text", "\n").alias("content"))
    path = _glued(d.select(F.to_json(record).alias("j")), work_folder(spark, "records"))
    arts = AR.articles_from_records(AR.read_concat_json(spark, path, quoted=True))
    return arts.select("url", "title", "section", "source", F.date_format("pub_ts", S.TIME_FORMAT).alias("pub_time"), "depth", F.md5("text").alias("text_md5"))


def _text_files(spark, sf_dir):
    """Texts as `.txt` files, several lines each, beside files of another suffix."""
    path = work_folder(spark, "texts")
    d = _documents(spark, sf_dir).select(F.col("text").alias("value"))
    d.write.text(path)
    d.write.mode("append").json(path)
    return path


def s5_text_files(spark, sf_dir):
    lines = AR.read_text(spark, _text_files(spark, sf_dir), ".txt")
    return lines.groupBy(F.md5("value").alias("line_md5")).agg(F.count(F.lit(1)).alias("n"))


def _streamed(spark, sf_dir, **options):
    """Run the word-count stream over the text files until all are read: paths of its history and its counts."""
    root = work_folder(spark, "stream")
    query = WH.start_word_history(spark, _text_files(spark, sf_dir), f"{root}/history", f"{root}/checkpoint", f"{root}/counts", available_now=True, **options)
    query.awaitTermination()
    return f"{root}/history", f"{root}/counts"


def s7_stream_counts(spark, sf_dir):
    """The counts that several micro-batches have stored."""
    _, counts = _streamed(spark, sf_dir, max_files_per_trigger=3)
    return spark.read.parquet(counts).groupBy("word").agg(F.sum("n").alias("n"))


def s8_stream_history(spark, sf_dir):
    """The history entry of one micro-batch over all files."""
    history, _ = _streamed(spark, sf_dir)
    return WH.read_history_table(spark, history).select("rank", "keyword", "n")


def dated_lines(spark, sf_dir):
    """What the fetcher writes to token files: one stop-filtered line per article."""
    arts = AR.articles_from_tables(spark, sf_dir).where(F.col("pub_ts").isNotNull())
    sent = TX.token_sentence(arts, S.DEFAULT_STOPWORDS, keep=("pub_ts",))
    return sent.select("doc_id", "pub_ts", F.col("sentence").alias("value"))


# Event time: bytes of text a core that one micro-batch takes, and so what the state store holds of it.
SLICE_BYTES = 8 << 20


def _time_slices(spark, lines, path: str, n: int):
    """`lines` as one file for each of about 2 `n` slices of time, oldest first, and how many of them are the first half of the time."""
    bounds = lines.agg(F.percentile_approx("ts", [k / (2 * n) for k in range(1, 2 * n)])).first()[0] or []
    half = bounds[n - 1] if bounds else None
    bounds = sorted(set(bounds))
    # how many bounds lie before the line's time
    number = F.size(F.filter(F.lit(bounds).cast("array<timestamp>"), lambda b: b < F.col("ts"))) if bounds else F.lit(0)
    dealt = lines.withColumn("slice", number).repartition(2 * n, "slice")
    with settings(spark, SHUFFLES_GO):
        dealt.write.option("compression", "zstd").option("parquet.block.size", str(SLICE_BYTES // 4)).partitionBy("slice").parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path
    files = folder(path).getFileSystem(spark._jsc.hadoopConfiguration())
    found = {int(s.getPath().getName().split("=")[1]): s.getPath() for s in files.listStatus(folder(path)) if "=" in s.getPath().getName()}
    parts = [[f.getPath() for f in files.listStatus(found[k]) if f.getPath().getName().startswith("part-")] for k in sorted(found)]
    return files, parts, sum(k <= bounds.index(half) for k in found) if bounds else 0


def _by_event_time(spark, sf_dir):
    """Dated lines as a stream by their own times: the first half of the time, a restart with the second one and a
    line far ahead that closes all windows, and another with lines of every fiftieth article again, by then too late.

    A half comes as files of one slice of time each, one a micro-batch and oldest first, so the state store holds the windows of
    two slices, not of a half.  The stream takes files by their modification times, which are set; a store that does not keep
    them gets all files of a half in one batch.
    """
    root = work_folder(spark, "event-time")
    lines = dated_lines(spark, sf_dir).select("doc_id", F.col("pub_ts").cast("timestamp").alias("ts"), "value")
    text_bytes = spark.read.parquet(table_path(sf_dir, "documents")).select(F.sum(F.octet_length("text"))).first()[0] or 0
    files, parts, first = _time_slices(spark, lines, f"{root}/lines", -(-text_bytes // (2 * SLICE_BYTES * cores(spark))) or 1)
    folder, to = spark._jvm.org.apache.hadoop.fs.Path, f"{root}/in"
    at = int(time.time()) * 1000 - 1000 * (len(parts) + 1)
    lines.select("ts", "value").limit(0).write.parquet(to)

    def add(slices, number) -> bool:
        """Whether the files' times are in the slices' order."""
        kept = True
        for k, group in enumerate(slices, number):
            for f in group:
                moved = folder(f"{to}/slice-{k:05d}-{f.getName()}")
                files.rename(f, moved)
                with contextlib.suppress(Exception):  # a store without such times
                    files.setTimes(moved, at + 1000 * k, -1)
                kept &= files.getFileStatus(moved).getModificationTime() == at + 1000 * k
        return kept and all(len(group) == 1 for group in slices)

    def run(ordered: bool):
        stream = ET.stream_lines(spark, to, max_files_per_trigger=1 if ordered else None)
        # few state files for the slices' size, those of passed batches go, and a slice is read by all cores
        own = {"spark.sql.shuffle.partitions": str(2 * cores(spark)), "spark.sql.streaming.minBatchesToRetain": "2",
               "spark.sql.streaming.maxBatchesToRetainInMemory": "1", "spark.sql.files.openCostInBytes": str(1 << 20),
               "spark.sql.streaming.stateStore.maintenanceInterval": "15s"}
        if files.getScheme() == "file":  # the other manager starts a process for every link that it looks up in a local folder
            own["spark.sql.streaming.checkpointFileManagerClass"] = "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager"
        with settings(spark, own | SHUFFLES_GO):
            ET.start_window_counts(stream, f"{root}/out", f"{root}/checkpoint", available_now=True).awaitTermination()

    run(add(parts[:first], 0))
    ordered = add(parts[first:], first)
    ahead = spark.range(1).select(F.lit("2100-01-01 00:00:00").cast("timestamp").alias("ts"), F.lit("").alias("value"))
    ahead.write.mode("append").parquet(to)
    run(ordered)
    stored = spark.read.schema(lines.schema).parquet(to)
    stored.where("doc_id % 50 = 0").select("ts", "value").write.mode("append").parquet(to)
    run(False)
    return root


def w1_event_time_counts(spark, sf_dir):
    """The windows that the stream has appended; late lines are in none of them."""
    counts = ET.read_window_counts(spark, f"{_by_event_time(spark, sf_dir)}/out")
    return counts.select(F.date_format("window_start", S.BATCH_KEY_FORMAT).alias("window_start"), "word", "n")


def w1_late_lines(spark, sf_dir):
    root = _by_event_time(spark, sf_dir)
    return ET.line_account(spark, spark.read.schema(ET.LINE_SCHEMA).parquet(f"{root}/in"), f"{root}/out", f"{root}/checkpoint")


def w4_quiet_batches(spark, sf_dir):
    """Three batches through the history sink, the last one twice; the second has no countable word and leaves no entry."""
    talk = spark.read.parquet(table_path(sf_dir, "conversations"))
    path = work_folder(spark, "quiet")
    sink = WH.history_sink(path)
    batches = [C.text_lines(talk.where(F.col("conv_id") % 3 == k).select("text")) for k in range(3)]
    batches[1] = talk.where("conv_id % 3 = 1").select(F.col("conv_id").cast("string").alias("value"))
    for k in (0, 1, 2, 2):
        sink(batches[k], k)
    frames = WH.read_history_table(spark, path)
    # one row a frame
    order = frames.select("batch_time").distinct().select("batch_time", F.row_number().over(Window.orderBy("batch_time")).cast("int").alias("frame"))
    return frames.join(order, "batch_time").select("frame", "rank", "keyword", "n")


def s6_report_rows(spark, sf_dir):
    """Keywords through the report writer, as the lines it has written."""
    arts = AR.articles_from_tables(spark, sf_dir)
    kw = RP.collect_ranked(TX.article_keywords(arts), "doc_id", "term", "keyword")
    path = work_folder(spark, "report")
    SK.write_report(kw.select("doc_id", "keyword"), path)
    return AR.read_text(spark, path).select(F.get_json_object("value", "$.doc_id").cast("bigint").alias("doc_id"), "value")


def _article_store(spark, sf_dir, seen_path=None):
    """Two batches of fetched pages, the second one run twice: each URL is stored once, by the first batch that has it."""
    pages = recrawled(spark, sf_dir)
    path = work_folder(spark, "articles")
    for batch, own in (("1", pages.where("page_id % 2 = 0")), ("2", pages), ("2", pages)):
        SK.append_new_articles(PG.extract_articles(own), path, batch_id=batch, seen_path=seen_path)
    stored = spark.read.parquet(path)
    return stored.select("page_id", "url", "title", F.col("batch_id").cast("int").alias("batch"))


def s6_snapshot(spark, sf_dir):
    """Keywords and window keywords as one published version; an earlier one holds other rows, and a later one fails halfway."""
    arts = AR.articles_from_tables(spark, sf_dir)
    path = work_folder(spark, "snapshots")
    # every publication reads them: twenty words an article, worked out once
    kw = reuse(RP.collect_ranked(TX.article_keywords(arts), "doc_id", "term", "keyword"))
    window = reuse(SK.window_keyword_report(TX.block_keywords(arts), S.QUERY_NOW))
    SN.publish(spark, path, "before", {"keywords": kw.where("doc_id % 2 = 0"), "window": window})
    SN.publish(spark, path, S.QUERY_NOW, {"keywords": kw, "window": window})
    try:
        SN.publish(spark, path, "never", {"keywords": kw.where("doc_id < 0"), "window": window.select(F.raise_error(F.lit("no window")).cast("string").alias("time"))})
    except Exception as e:  # noqa: BLE001 - the failure that is asked for, and no other
        if "no window" not in str(e):
            raise
    words = SN.read_part(spark, path, "keywords", "doc_id long, keyword array<string>").select(F.col("doc_id").cast("string").alias("key"), F.array_join("keyword", " ").alias("words"))
    at = SN.read_part(spark, path, "window", "time string, timekeyword array<string>").select(F.col("time").alias("key"), F.array_join("timekeyword", " ").alias("words"))
    return words.unionByName(at)


def s12_split_history(spark, sf_dir):
    """A history as files of many frames each, cut between them while it is read; every fifth keyword holds the cut."""
    hist = RP.word_history(dated_lines(spark, sf_dir), "pub_ts")
    word = F.concat("keyword", F.when(F.col("rank") % 5 == 0, F.lit('],"k": [')).otherwise(F.when(F.col("rank") % 5 == 1, F.lit("],")).otherwise(F.lit(""))))
    objects = SK.history_objects(hist.withColumn("keyword", word))
    path = work_folder(spark, "history")
    # a frame without the object's ends; the line separator closes it
    frames = objects.select(F.expr("substring(value, 2, length(value) - 3)").alias("value"))
    frames.write.option("lineSep", SK.FRAME_CUT).text(path)
    return SK.read_history(spark, path, split=True).select("batch_minute", "rank", "keyword", "n")


def a5_daily_sketches(spark, sf_dir):
    """Distinct URLs up to each of seven days, from the stored sketches of the days: the exact number, and whether
    the estimate is within three standard errors of it."""
    links = PG.extract_links(ensure_parallel(spark.read.parquet(table_path(sf_dir, "pages")), "page_id"))
    urls = links.select((F.col("page_id") % 7).cast("int").alias("day"), F.col("dst").alias("url"))
    path = work_folder(spark, "sketches")
    C.url_sketches(urls, "day").write.partitionBy("day").parquet(path)
    upto = spark.range(7).select(F.col("id").cast("int").alias("upto"))
    stored = spark.read.parquet(path)
    merged = C.merged_distinct(stored.select(F.explode(F.sequence(F.col("day"), F.lit(6))).alias("upto"), "sketch"), "upto")
    exact = urls.select(F.explode(F.sequence(F.col("day"), F.lit(6))).alias("upto"), "url").groupBy("upto").agg(F.countDistinct("url").alias("n_urls"))
    near = F.abs(F.col("estimate") - F.col("n_urls")) <= 3 * 1.04 / 2 ** (C.SKETCH_LOG / 2) * F.col("n_urls") + 1
    return upto.join(exact, "upto").join(merged.withColumnRenamed("n_urls", "estimate"), "upto").select("upto", "n_urls", near.alias("near"))


def s9_article_store(spark, sf_dir):
    return _article_store(spark, sf_dir)


def s9_bucketed_store(spark, sf_dir):
    """The same with the bucketed store of seen URLs."""
    return _article_store(spark, sf_dir, work_folder(spark, "seen"))


def j4_seen_store(spark, sf_dir):
    """Links that a store of seen URLs lacks: those of the even pages are in it, from two batches, folded into one."""
    links = PG.extract_links(ensure_parallel(spark.read.parquet(table_path(sf_dir, "pages")), "page_id"))
    path = work_folder(spark, "seen")
    for k in (0, 1):
        SEEN.mark_seen(links.where(f"page_id % 4 = {2 * k}").select(F.col("dst").alias("url")), path, str(k), buckets=16)
    SEEN.compact(spark, path)
    return SEEN.unseen_in_store(links.select(F.col("dst").alias("url")).distinct(), path, "next", buckets=16)


def recrawled(spark, sf_dir):
    """The pages, some fetched again later under another query string."""
    pages = ensure_parallel(spark.read.parquet(table_path(sf_dir, "pages")), "page_id")
    again = pages.where("page_id % 10 = 1").select((F.col("page_id") + 1_000_000_000).alias("page_id"), F.concat(X.canonical_url("url"), F.lit("?again=1")).alias("url"), "html")
    return pages.unionByName(again)


def s10_token_files(spark, sf_dir):
    path = work_folder(spark, "tokens")
    SK.write_token_files(AR.articles_from_tables(spark, sf_dir), path)
    return spark.read.text(path).select(F.col("minute").cast("string").alias("minute"), "value")


def t9_rolling_block(spark, sf_dir):
    """Block keywords after four batches of articles, kept by what leaves the block; the second batch comes twice."""
    arts = AR.articles_from_tables(spark, sf_dir).select("doc_id", "text")
    block = RollingBlock(spark, work_folder(spark, "block"), fold_every=3)
    bounds = arts.agg(F.percentile_approx("doc_id", [0.3, 0.6, 0.95])).first()[0]
    edges = [None, *bounds, None]
    for k in (0, 1, 1, 2, 3):
        low, high = edges[k], edges[k + 1]
        own = arts if low is None else arts.where(F.col("doc_id") > F.lit(low))
        block.add(own if high is None else own.where(F.col("doc_id") <= F.lit(high)), str(k))
    return block.keywords().select(F.col("rank").cast("int").alias("rank"), "term", "tf", F.round("tfidf", 6).alias("tfidf"))


def c2_seen_urls(spark, sf_dir):
    """The seen set of a store, rebuilt from its text."""
    pages = ensure_parallel(spark.read.parquet(table_path(sf_dir, "pages")), "page_id")
    path = work_folder(spark, "store-text")
    pages.select(F.concat(F.lit('{"url": "'), F.col("url"), F.lit('", "from": "https://x.org/%41?q=ü"} '), F.regexp_replace("html", r"[\r\n]", " ")).alias("value")).write.text(path)
    return SK.seen_urls_from_text(spark, path)


QUERIES = {
    "s1_concat_json": s1_concat_json,
    "s1_cut_everywhere": s1_cut_everywhere,
    "s2_article_records": s2_article_records,
    "s5_text_files": s5_text_files,
    "s7_stream_counts": s7_stream_counts,
    "s8_stream_history": s8_stream_history,
    "w1_event_time_counts": w1_event_time_counts,
    "w1_late_lines": w1_late_lines,
    "w4_quiet_batches": w4_quiet_batches,
    "s6_report_rows": s6_report_rows,
    "s6_snapshot": s6_snapshot,
    "s12_split_history": s12_split_history,
    "a5_daily_sketches": a5_daily_sketches,
    "s9_article_store": s9_article_store,
    "s9_bucketed_store": s9_bucketed_store,
    "j4_seen_store": j4_seen_store,
    "s10_token_files": s10_token_files,
    "t9_rolling_block": t9_rolling_block,
    "c2_seen_urls": c2_seen_urls,
}
