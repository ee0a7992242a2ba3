"""Keyword-union cosine similarity and what is built on it.

For a pair (a, b) the vocabulary is K(a) ∪ K(b) (their top-k keywords); the
vectors are raw term counts on it; sim = dot / (‖a‖·‖b‖).  With c_i(w) the
count of w in i and n(i) = Σ_{w∈K(i)} c_i(w)² this is

    dot    = Σ_{w ∈ K(a) ∪ K(b)} c_a(w)·c_b(w)
    ‖a‖²   = n(a) + Σ_{w ∈ K(b) \\ K(a)} c_a(w)²

so only documents that share a term of K(a) ∪ K(b) have anything to add, and no
pair is looked at besides those.

Pairs grow with the square of the corpus, so they are never shuffled.  Documents
fall into blocks of about `salt_rows`; two blocks (or one with itself) are a cell.  A
term's holders in a block are packed into one row of arrays, which goes to the cells
of those blocks that hold the term too, if either side has it as a keyword.  A cell
is whole in one task: it meets the packed holders term by term and adds up its own
pairs there, at most `salt_rows`² of them, whatever the term.  What moves is the
postings, once per block they meet, and what a task holds is bounded by the cell.

Votes ask for a number per document only, so there not even postings move: documents
are packed into blocks, written once, and each two blocks meet in one task
(`count_votes`, `operators.cells`).  Disk then grows with the corpus; the work is that of all pairs still.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newslens import schema as S
from newslens.operators import cells as CL
from newslens.operators import text as TX
from newslens.session import SHUFFLES_GO, cores, reuse, settings, work_folder

# Documents in a block: a cell holds the square of it in pairs at most.
SALT_ROWS = 2_000
# Most partitions that cells are dealt over; beyond that, a task has several cells.
CELL_PARTITIONS_MAX = 20_000
# Votes: documents in a partition, and documents and term rows in a block.
PART_DOCS = 4_000
GROUP_DOCS = 2_000
GROUP_TERMS = 1_000_000
# Rows of two blocks are some MB each.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1"}
# Votes: most terms whose document frequency is broadcast, so that only rows of rarer ones are shuffled by term.
HOT_TERMS = 200_000


def term_table(articles: DataFrame, stopwords: TX.StopWords = S.DEFAULT_STOPWORDS,
               k: int = S.TOP_KEYWORDS, mode: str = "words",
               attrs: Sequence[str] = (), part_docs: int | None = None,
               columns: Sequence[str] = ("doc_id", "term", "tf", "df", "tfidf", "rank", "is_kw", "kw_norm")) -> DataFrame:
    """tk(*columns, *attrs), by default (doc_id, term, tf, df, tfidf, rank, is_kw, kw_norm, *attrs).

    `attrs` are per-article columns (e.g. section, age) carried on every row so
    later steps need no join back to the articles; they are attached by an
    equi-join on doc_id that shares its shuffle with the keyword window.

    With `part_docs`, the documents are counted when the plan is built and dealt over
    partitions of about that many, a document whole in one (`count_votes`).
    """
    tf = reuse(TX.term_freq(TX.tokens(articles, mode, stopwords)))
    if part_docs:
        docs = tf.select("doc_id").distinct().count()
        counted = TX.attach_doc_freq(tf, HOT_TERMS, 1).repartition(max(-(-docs // part_docs), 2 * _cores(tf)), "doc_id")
    else:
        counted = TX.attach_doc_freq(tf)
    w = TX.with_tfidf(counted, TX.article_count(articles))
    if attrs:
        # Hash the per-article side: the keyword window re-sorts anyway, so a
        # sort-merge join's sort by doc_id alone would be wasted work.
        w = w.join(articles.select("doc_id", *attrs).hint("shuffle_hash"), "doc_id")
    # Both sides of the similarity join read this table: keep only what they use.
    flagged = TX.flag_keywords(w, k)
    return reuse(flagged.select(*columns, *attrs))


def _cores(df: DataFrame) -> int:
    try:
        return df.sparkSession.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001 - Connect sessions have no context
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def pair_similarity(tk: DataFrame, same: Sequence[str] = (), carry: Sequence[str] = (),
                    salt_rows: int = SALT_ROWS, block: Sequence[str] = (),
                    near: tuple[str, int] | None = None, min_sim: float | None = None) -> DataFrame:
    """(lo, hi, dot, norm_lo, norm_hi, sim, [<s>_eq], [<c>_lo, <c>_hi]) for lo < hi.

    Only pairs sharing at least one term of K(lo) ∪ K(hi) appear; all others
    have similarity 0.  All sums are integers, so the result does not depend on
    evaluation order; the one division is done last in double precision.

    `same` columns give a boolean `<s>_eq` (equal on both sides) and `carry`
    columns (numeric) their two values; both are decided per meeting of two rows, so
    the pair aggregate keeps fixed-width buffers only (codegen'd hash
    aggregation, no string state).

    `block` columns must be equal: documents of other values are never in one cell.
    `near` (column, gap) keeps pairs at most `gap` apart: blocks are within one bucket
    of that width, and meet those of their own and both neighbouring buckets only.
    Both depend on per-article attributes.  `min_sim`
    drops less similar pairs right after the aggregate.

    The documents are counted when the plan is built (`_cells`): their number says
    how many blocks there are.
    """
    attrs = list(dict.fromkeys((*same, *carry, *([near[0]] if near else []))))
    bucket = F.floor(F.col(near[0]) / F.lit(near[1])) if near else F.lit(0).cast("bigint")
    tk = tk.where("doc_id is not null").withColumn("bucket", bucket)
    for c in (*block, "bucket"):
        tk = tk.where(F.col(c).isNotNull())
    tk, partitions, torn = _cells(tk, salt_rows, block, near is not None)
    posting = F.struct(F.col("doc_id").alias("d"), (F.col("tf") * 2 + F.col("is_kw").cast("int")).alias("c"),
                       F.col("kw_norm").alias("n"), *attrs)
    fields = ["d", "c", "n", *attrs]
    # A term's holders in a block as one row of arrays, and the blocks that hold it too.
    lists = (tk.repartition("term", *block).groupBy("term", *block, "bucket", "slice")
               .agg(F.collect_list(posting).alias("p"), F.max("is_kw").alias("has_kw")))
    lists = lists.withColumn("p", F.struct(*[F.col(f"p.{c}").alias(c) for c in fields]))
    met = Window.partitionBy("term", *block)
    if near:
        met = met.orderBy("bucket").rangeBetween(-1, 1)
    lists = lists.withColumn("met", F.collect_list(F.struct("bucket", "slice", "has_kw")).over(met))
    lists = lists.withColumn("other", F.explode(F.filter("met", lambda o: F.col("has_kw") | o["has_kw"])))
    mine, other = F.struct("bucket", "slice"), F.struct("other.bucket", "other.slice")
    lists = lists.select("term", *block, F.least(mine, other).alias("one"), F.greatest(mine, other).alias("two"),
                         F.when(mine <= other, F.col("p")).alias("l"), F.when(mine >= other, F.col("p")).alias("r"))
    where = [*block, "one", "two"]
    cells = lists.withColumn("cell", F.xxhash64(*where)).repartition(partitions, "cell")
    # All grouping from here on is within a cell, so nothing is shuffled again.
    terms = cells.groupBy("cell", *where, "term").agg(F.first("l", ignorenulls=True).alias("l"), F.first("r", ignorenulls=True).alias("r"))
    zipped = lambda side: F.arrays_zip(*[F.col(f"{side}.{c}") for c in fields]).alias(side)
    terms = terms.where("l is not null and r is not null").select("cell", (F.col("one") == F.col("two")).alias("own"), zipped("l"), zipped("r"))
    terms = terms.withColumn("r_kw", F.filter("r", lambda h: h["c"] % 2 == 1))
    x = terms.select("cell", "own", "r", "r_kw", F.explode("l").alias("a"))
    a_kw = F.col("a.c") % 2 == 1
    x = x.select("cell", "own", "a", F.explode(F.when(a_kw, F.col("r")).otherwise(F.col("r_kw"))).alias("b"))
    x = x.where(F.when(F.col("own"), F.col("a.d") < F.col("b.d")).otherwise(F.col("a.d") != F.col("b.d")))
    if near:
        x = x.where(F.abs(F.col(f"a.{near[0]}") - F.col(f"b.{near[0]}")) <= F.lit(near[1]))
    # Each meeting becomes its fixed-width contribution to one pair.
    b_kw = F.col("b.c") % 2 == 1
    a_c, b_c = F.shiftright(F.col("a.c"), 1), F.shiftright(F.col("b.c"), 1)
    nothing = F.lit(0).cast("bigint")
    p = x.groupBy("cell", F.col("a.d").alias("a"), F.col("b.d").alias("b")).agg(
        F.sum(a_c * b_c).alias("dot"),
        F.sum(F.when(a_kw, nothing).otherwise(a_c * a_c)).alias("e_a"),
        F.sum(F.when(b_kw, nothing).otherwise(b_c * b_c)).alias("e_b"),
        F.max("a.n").alias("n_a"), F.max("b.n").alias("n_b"),
        *[F.max(F.coalesce(F.col(f"a.{s}") == F.col(f"b.{s}"), F.lit(False))).alias(f"{s}_eq") for s in same],
        *[F.max(f"{m}.{c}").alias(f"{c}_{m}") for c in carry for m in "ab"])
    a_is_lo = F.col("a") < F.col("b")
    ends = [(F.when(a_is_lo, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")).alias(f"{c}_lo"),
             F.when(a_is_lo, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a")).alias(f"{c}_hi")) for c in ("e", "n", *carry)]
    p = p.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "dot",
                 *[c for pair in ends for c in pair], *[f"{s}_eq" for s in same])
    extra = [f"{s}_eq" for s in same] + [c for a in carry for c in (f"{a}_lo", f"{a}_hi")]
    if torn:
        # A repeated id with several places has parts of its pairs in several cells.
        p = p.groupBy("lo", "hi").agg(*[F.sum(c).alias(c) for c in ("dot", "e_lo", "e_hi")],
                                      *[F.max(c).alias(c) for c in ("n_lo", "n_hi", *extra)])
    norm_lo = F.col("n_lo") + F.col("e_lo")
    norm_hi = F.col("n_hi") + F.col("e_hi")
    sim = F.try_divide(F.col("dot").cast("double"),
                       F.sqrt(norm_lo.cast("double") * norm_hi.cast("double")))
    out = p.select("lo", "hi", "dot", norm_lo.alias("norm_lo"), norm_hi.alias("norm_hi"),
                   sim.alias("sim"), *extra)
    return out if min_sim is None else out.where(F.col("sim") >= F.lit(min_sim))


def _cells(tk: DataFrame, salt_rows: int, block: Sequence[str], near: bool) -> tuple[DataFrame, int, bool]:
    """tk with each document's `slice` of its place (block columns and bucket), the partitions that the
    cells need, and whether a document stands in several places (repeated ids with other attributes)."""
    place = [*block, "bucket"]
    docs = tk.select("doc_id", F.struct(*place).alias("place")).groupBy("doc_id").agg(F.min("place").alias("place"), F.max("place").alias("last"))
    sizes = docs.groupBy("place").agg(F.count(F.lit(1)).alias("docs"), F.max(F.col("place") != F.col("last")).alias("torn"))
    blocks = F.col("docs") / F.lit(SALT_ROWS)
    most, cells, torn = sizes.select(F.max("docs"), F.ceil(F.sum(blocks * (blocks + 1))), F.max("torn")).first()
    partitions = max(int(tk.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(cells or 0) * (3 if near else 1))
    slices = F.lit(1).cast("bigint")
    if (most or 0) > salt_rows:
        large = sizes.where(F.col("docs") > F.lit(salt_rows)).select("place.*", F.ceil(F.col("docs") / F.lit(salt_rows)).alias("slices"))
        tk = tk.join(large, place, "left")
        slices = F.coalesce("slices", slices)
    return tk.withColumn("slice", F.pmod(F.xxhash64("doc_id"), slices)), min(partitions, CELL_PARTITIONS_MAX), bool(torn)


def both_directions(pairs: DataFrame) -> DataFrame:
    """(doc_id, other, sim) — each unordered pair twice."""
    def side(me: str, other: str):
        return F.struct(F.col(me).alias("doc_id"), F.col(other).alias("other"), F.col("sim"))

    return pairs.select(F.explode(F.array(side("lo", "hi"), side("hi", "lo"))).alias("p")) \
                .select("p.*")


# J3 ---------------------------------------------------------------------------
def votes(pairs: DataFrame, threshold: float = S.VOTE_THRESHOLD) -> DataFrame:
    """(doc_id, votes): how many other articles reach `threshold` similarity."""
    hits = pairs.where(F.col("sim") >= F.lit(threshold))
    return (hits.select(F.explode(F.array("lo", "hi")).alias("doc_id"))
                .groupBy("doc_id").agg(F.count(F.lit(1)).alias("votes")))


def count_votes(tk: DataFrame, threshold: float = S.VOTE_THRESHOLD, group_docs: int = GROUP_DOCS,
                group_terms: int = GROUP_TERMS) -> DataFrame:
    """J3 without listed pairs: (doc_id, votes) as `votes(pair_similarity(tk))`, for tk with `df`.

    Documents are packed into blocks of `group_docs` documents and about `group_terms`
    term rows at most, and every two blocks meet in one task that adds their pairs up in matrices (`operators.cells`).
    What is shuffled is a number per document and cell.  This runs when the plan is
    built; blocks and votes go to the folder that all executors share.
    """
    return votes_of_blocks(blocks_of(tk, group_docs, group_terms), threshold).select(F.col("doc_id").cast(tk.schema["doc_id"].dataType).alias("doc_id"), "votes")


def votes_of_blocks(blocks: DataFrame, threshold: float = S.VOTE_THRESHOLD) -> DataFrame:
    """`count_votes` for documents already packed; nothing else need be kept meanwhile."""
    spark = blocks.sparkSession
    path = work_folder(spark, "votes")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, two in CL.pairs_of_blocks(batches):
            for docs, n in CL.votes(one, two, threshold, one is two):
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "votes"])

    with settings(spark, SMALL_BATCHES | SHUFFLES_GO):
        found = _meet(blocks).mapInArrow(count, "doc_id long, votes long").groupBy("doc_id").agg(F.sum("votes").alias("votes"))
        found.write.parquet(path)
    return spark.read.schema("doc_id long, votes long").parquet(path)


def blocks_of(tk: DataFrame, block_docs: int = GROUP_DOCS, block_terms: int = GROUP_TERMS,
              place: tuple[Column, Column, Column] | None = None) -> DataFrame:
    """tk's documents as blocks (`cells.BLOCK_SCHEMA`) in a stored table, one or more from each of its partitions.
    `place`: group, age and title of a document; a block has one group and neighbouring ages.

    Terms stand in blocks by a 64-bit hash, whose seed is chosen so that no two terms share one.
    """
    spark = tk.sparkSession
    path = work_folder(spark, "blocks")
    tk = tk.where("doc_id is not null")
    terms = tk.where("df > 1").select("term").distinct()
    seed = next(i for i in range(100) if not _shared(terms, i))
    zero = F.lit(0).cast("bigint")
    group, age, title = place or (zero, zero, zero)
    rows = tk.select(group.cast("bigint").alias("group"), age.cast("bigint").alias("age"), title.cast("bigint").alias("title"), F.col("doc_id").cast("bigint").alias("doc_id"), _term_hash(seed).alias("h"), F.col("tf").cast("bigint").alias("tf"), "is_kw",
                     F.col("kw_norm").cast("bigint").alias("kw_norm"), F.col("df").cast("bigint").alias("df"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 24
        yield from CL.blocks(batches, first, block_docs, block_terms)

    rows.sortWithinPartitions(*(["group", "age"] if place else []), "doc_id").mapInArrow(pack, CL.BLOCK_SCHEMA).write.parquet(path)
    return spark.read.schema(CL.BLOCK_SCHEMA).parquet(path)


def _term_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "term")


def _shared(terms: DataFrame, seed: int) -> bool:
    """Whether two terms have one hash."""
    return bool(terms.groupBy(_term_hash(seed).alias("h")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count())


def _sides(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    one, two = (blocks.select(*[F.col(c).alias(f"{side}_{c}") for c in blocks.columns]) for side in ("one", "two"))
    return one, two


def _meet(blocks: DataFrame) -> DataFrame:
    """Each two blocks once (a block with itself too) as a row (one_*, two_*): partitions are read against each other, nothing is shuffled."""
    one, two = _sides(blocks)
    # either order for half of the pairs each, so that all tasks have some
    own = F.when((F.shiftright("one_block", 24) + F.shiftright("two_block", 24)) % 2 == 0, F.col("one_block") <= F.col("two_block")) \
           .otherwise(F.col("one_block") >= F.col("two_block"))
    return one.join(two.hint("shuffle_replicate_nl"), own)


# J2 ---------------------------------------------------------------------------
def related(pairs: DataFrame, titles: DataFrame, k: int = S.TOP_RELATED,
            max_gap: int = S.RELATED_MAX_GAP_MIN) -> DataFrame:
    """Top-k distinct related titles per article.

    `pairs` must carry `section_eq` and `age_lo/age_hi` (see `pair_similarity`);
    candidates share the section and are at most `max_gap` minutes apart in
    age; each partner title counts once with its best similarity; ranking is
    similarity descending, then title.  Output (doc_id, rank, title, sim).
    """
    cand = pairs.where((F.col("sim") > 0) & F.col("section_eq") &
                       (F.abs(F.col("age_lo") - F.col("age_hi")) <= F.lit(max_gap)))
    return best_titles(both_directions(cand), titles, k)


def related_in_cells(tk: DataFrame, titles: DataFrame, k: int = S.TOP_RELATED, max_gap: int = S.RELATED_MAX_GAP_MIN,
                     block_docs: int = GROUP_DOCS, block_terms: int = GROUP_TERMS) -> DataFrame:
    """`related` without listed pairs, for tk with `df`, `section` and `age`, dealt by document.

    Blocks of one section and of neighbouring ages meet where they may have pairs (`operators.cells`), and a task keeps the partners that
    may be among a document's `k` best titles.  An id with several sections, ages or titles has no one block: with such
    ids, pairs are listed.  Blocks and partners are worked out when the plan is built.
    """
    spark = tk.sparkSession
    placed = tk.where("doc_id is not null and section is not null and age is not null")
    several = lambda df, what: bool(df.groupBy("doc_id").agg(F.min(what).alias("a"), F.max(what).alias("b")).where("a <> b").limit(1).count())
    if several(placed, F.struct("section", "age")) or several(titles.where("doc_id is not null"), F.col("title")):
        pairs = pair_similarity(tk, same=("section",), carry=("age",), block=("section",), near=("age", max_gap))
        return related(pairs, titles, k, max_gap)
    ids = _title_ids(titles).groupBy("doc_id").agg(F.min("tid").cast("bigint").alias("title"))
    sections = placed.select(F.col("section").alias("term")).distinct()
    seed = next(i for i in range(100) if not _shared(sections, i))
    # titles join where the documents' rows stand
    placed = placed.join(ids.withColumnsRenamed({"doc_id": "_id"}).hint("shuffle_hash"), F.col("doc_id") == F.col("_id"), "left")
    known = F.coalesce("title", F.lit(None).cast("bigint"))
    # ids may be negative: a title's id is its place among them
    place = (F.xxhash64(F.lit(seed), "section"), F.col("age"), F.when(known.isNull(), F.lit(-1)).otherwise(F.expr("title & 9223372036854775807")))
    blocks = blocks_of(placed, block_docs, block_terms, place)
    path = work_folder(spark, "partners")
    one, two = _sides(blocks)
    # few partitions on one side, so that a task meets many blocks and keeps few partners of each document
    parts = max(1, -(-4 * cores(spark) // max(1, one.rdd.getNumPartitions())))
    near = (F.col("one_group") == F.col("two_group")) & (F.col("one_low") - F.col("two_high") <= max_gap) & (F.col("two_low") - F.col("one_high") <= max_gap)
    met = one.join(two.coalesce(parts).hint("shuffle_replicate_nl"), near)
    with settings(spark, SMALL_BATCHES | SHUFFLES_GO):
        met.mapInArrow(lambda b: CL.best_partners(b, k, max_gap), "doc_id long, other long, sim double").write.parquet(path)
    kind = tk.schema["doc_id"].dataType
    both = spark.read.schema("doc_id long, other long, sim double").parquet(path)
    return best_titles(both.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("other").cast(kind).alias("other"), "sim"), titles, k)


def _title_ids(titles: DataFrame) -> DataFrame:
    """(doc_id, tid): the smallest doc_id with that title."""
    marked = titles.select("doc_id", F.unhex(F.sha2("title", 256)).alias("_t"))
    ids = marked.where(F.col("_t").isNotNull()).groupBy("_t").agg(F.min("doc_id").alias("tid"))
    return marked.join(ids, "_t").select("doc_id", "tid")


def best_titles(both: DataFrame, titles: DataFrame, k: int = S.TOP_RELATED) -> DataFrame:
    """(doc_id, rank, title, sim) from partners (doc_id, other, sim)."""
    # Partners are deduplicated on a numeric title id (the smallest doc_id with
    # that title: one id per title).  Titles are told apart by their SHA-256, so
    # no step but the last one, over the few rows left, moves title texts.
    doc_tid = _title_ids(titles).withColumnRenamed("doc_id", "other")
    best = (both.join(doc_tid, "other")
                .groupBy("doc_id", "tid").agg(F.max("sim").alias("sim"))
                .withColumn("s9", F.round("sim", 9)))
    # The final top-k by (similarity, title) lies within rank-by-similarity <= k
    # (rank keeps every tie at the boundary), so only those rows get titles.
    by_sim = Window.partitionBy("doc_id").orderBy(F.col("s9").desc())
    short = best.withColumn("r", F.rank().over(by_sim)).where(F.col("r") <= k)
    named = short.join(titles.select(F.col("doc_id").alias("tid"), "title"), "tid")
    ranked = Window.partitionBy("doc_id").orderBy(F.col("s9").desc(), F.col("title").asc())
    return (named.withColumn("rank", F.row_number().over(ranked))
                .where(F.col("rank") <= k)
                .select("doc_id", "rank", "title", "sim"))
