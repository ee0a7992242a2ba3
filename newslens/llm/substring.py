"""Substring dedup across documents by paragraph MinHash (operator 8).

Paragraphs are the lines of `size` words or more.

1. Each has MinHash values over its 5-word shingles, in bands of two; the number of
   bands is the least that finds a pair of the asked similarity with the asked
   probability (`bands_for`).
2. Paragraphs that collide in a band form a list; equal paragraphs are one entry, put
   together in the tasks first, so a paragraph of a third of all documents is one entry.
   Each entry is paired with the 4 before it; exact Jaccard verifies; components are
   formed; and entries of longer lists that lie outside their group's largest component
   are compared with the whole group, in blocks (`rest.rest_links`).
3. A passage may also stand inside other text of its line.  So every text is cut once more
   at places that its own words choose: a piece of `size` words begins at every word whose
   two-word hash is least among its 4 neighbours on either side (and, where one word is
   said over and over, every `size` words).  A repeated passage yields the same pieces in
   every document that holds it; equal pieces (Jaccard 1) need no banding.
4. Paragraphs of a component, and equal pieces, are kept in the smallest document id that
   holds one, and are removals in all others; overlapping removals of a document are one
   span of words.

Repeats inside one document alone are not removed.  Texts of fewer than `size` words,
nulls and empty texts have no paragraphs.  Rows without an id take no part.  Rows that
share an id are one document: what they repeat among each other stays.  Spans count the
words of one text, told by its hash `body` beside the id, so each of those rows loses its own.  Texts of any
length are read whole.  An empty table gives no rows.  Other columns pass through
`remove_passages` and are otherwise not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newslens.llm.common import FOLD, SPACES, STEP, Scratch, in_arrow, light, mix, powers, rule, run_hashes, signed, small, spans, text_bytes, text_slices
from newslens.llm.graph import components
from newslens.llm.rest import rest_links

SIZE = 25
SHINGLE = 5
AROUND = 4
ROWS = 2
BEFORE = 4
TORN_MOST = 1_000_000  # most ids with several texts that are broadcast
KEEPER_MOST = 1_000_000  # most repeated paragraphs that are broadcast
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bands_for(similarity: float, recall: float, rows: int = ROWS) -> int:
    """The least number of bands that finds a pair of this similarity with this probability."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on (the last n - 1 places wrap and are not used)."""
    out = words * STEP[0]
    for j in range(1, n):
        out = out + np.roll(words, -j) * STEP[j]
    return mix(out + np.uint64(n))


class Units:
    """Of some texts: pieces and paragraphs with row, first word, number of words and hash."""

    def __init__(self, column: pa.Array, size: int):
        data, offsets = text_bytes(column)
        data = FOLD[data]
        starts, ends, rows = spans(SPACES[data], offsets)
        words = run_hashes(data, starts, ends)
        n = len(words)
        of = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        here = np.arange(n)
        place, left = here - rows[of], rows[of + 1] - here
        # paragraphs: the words of a line
        line = np.cumsum(np.append(0, data == 10))[starts]
        first = np.flatnonzero(np.append(True, (line[1:] != line[:-1]) | (of[1:] != of[:-1]))) if n else here
        length = np.diff(np.append(first, n))
        self.first, self.length = first[length >= size], length[length >= size]
        self.shingles = _grams(words, SHINGLE) if n else words
        up, down = powers(n + 1)
        sums = np.append(np.uint64(0), np.cumsum(words * up[:n], dtype=np.uint64))
        whole = lambda at, size, kind: mix((sums[at + size] - sums[at]) * down[at] + np.uint64(kind) + np.asarray(size, np.uint64) * STEP[1])
        self.line_hash, self.line_row = whole(self.first, self.length, 1), of[self.first]
        # pieces
        chosen = left >= size
        if n:
            two = _grams(words, 2)
            two[left == 1] = np.uint64(2**64 - 1)
            for k in range(1, AROUND + 1):
                chosen &= (place < k) | (two < np.roll(two, k))
                chosen &= (left <= k) | (two <= np.roll(two, -k))
            # a word said over and over has no least place: cut its run every `size` words
            run = here - np.maximum.accumulate(np.where((place > 0) & (two == np.roll(two, 1)), 0, here))
            chosen |= (left >= size) & (two == np.roll(two, -1)) & (run % size == 0)
        at = np.flatnonzero(chosen)
        self.row = np.concatenate([self.line_row, of[at]])
        self.at = np.concatenate([place[self.first], place[at]])
        self.size = np.concatenate([self.length, np.full(len(at), size)])
        self.hash = np.concatenate([self.line_hash, whole(at, size, 0)])

    def line_shingles(self, k: int) -> np.ndarray:
        return self.shingles[self.first[k] : self.first[k] + self.length[k] - SHINGLE + 1]


def occurrences(docs: DataFrame, size: int) -> DataFrame:
    """para (hash), doc, body, at (first word), words of every paragraph and piece."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                x = Units(part.column("text"), size)
                yield pa.RecordBatch.from_pydict({
                    "para": signed(x.hash), "doc": part.column("doc").take(pa.array(x.row)), "body": part.column("body").take(pa.array(x.row)), "at": pa.array(x.at.astype(np.int32)), "words": pa.array(x.size.astype(np.int32)),
                })

    return in_arrow(docs, emit, "para long, doc long, body long, at int, words int")


def band_rows(docs: DataFrame, size: int, bands: int) -> DataFrame:
    """key, para: a row per band of each paragraph, equal paragraphs of a slice of texts once."""
    factor = rule(bands * ROWS, 131)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", most=4 << 20):
                x = Units(part.column("text"), size)
                own, first = np.unique(x.line_hash, return_index=True)
                keys = np.zeros((len(own), bands), np.uint64)
                for k, f in enumerate(first.tolist()):
                    low = (x.line_shingles(f)[:, None] * factor).min(axis=0).reshape(bands, ROWS)
                    keys[k] = (low * STEP[:ROWS]).sum(axis=1, dtype=np.uint64)
                keys = mix(keys + np.arange(bands, dtype=np.uint64))
                yield pa.RecordBatch.from_pydict({"key": signed(keys.T.ravel()), "para": signed(np.tile(own, bands))})

    return in_arrow(docs, emit, "key long, para long")


def among(held: DataFrame, asked: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of `held` whose `para` may be in `asked`, for the join that follows: rows that can't meet it are not shuffled.

    The first 26 bits of the asked hashes are marked in at most 2 ** 20 rows of 64 bits, which are
    broadcast whatever the number of hashes; the more there are, the fewer rows they keep out.
    """
    word = F.shiftrightunsigned("para", 44)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("para", 38).bitwiseAND(F.lit(63)).cast("int"))
    marks = scratch.table(asked.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")), "marks")
    marked = held.withColumn("word", word).withColumn("bit", bit).join(F.broadcast(marks), "word")
    return marked.where(F.col("bits").bitwiseAND(F.col("bit")) != 0).select(*held.columns)


def _shingles(docs: DataFrame, size: int) -> DataFrame:
    """para, shingles (sorted distinct) of the paragraphs in `wanted`."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                x = Units(part.column("text"), size)
                wanted = [set(w) for w in part.column("wanted").to_pylist()]
                found = {h: k for k, (r, h) in enumerate(zip(x.line_row.tolist(), x.line_hash.view(np.int64).tolist(), strict=True)) if h in wanted[r]}
                yield pa.RecordBatch.from_pydict({"para": pa.array(list(found), pa.int64()), "shingles": pa.array([np.unique(x.line_shingles(k)).tobytes() for k in found.values()], pa.binary())})

    return in_arrow(docs, emit, "para long, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                both = len(set(memoryview(x).cast("Q")) & set(memoryview(y).cast("Q")))
                keep.append(both >= similarity * ((len(x) + len(y)) // 8 - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda end, name: sets.select(F.col("para").alias(end), F.col("shingles").alias(name))
    return in_arrow(pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y"), verify, "a long, b long")


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def repeated_passages(docs: DataFrame, size: int = SIZE, similarity: float = 0.8, recall: float = 0.98, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, body (hash of the row's text), start, end (words, exclusive), kept_in (the id that keeps the passage): one row per removal span."""
    scratch = Scratch(docs.sparkSession, "substring")
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("body"), F.col(text_col).alias("text"))
    by = Window.partitionBy("key")
    # one shuffle by key serves the distinct, the count and the order
    lists = band_rows(rows, size, bands_for(similarity, recall)).repartition("key").groupBy("key", "para").agg(F.lit(1).alias("one"))
    lists = scratch.table(lists.select("key", "para", F.count("*").over(by).alias("length")).where("length > 1"), "lists")
    member = by.orderBy("para")
    before = lists.withColumn("before", F.array_compact(F.array(*(F.lag("para", i).over(member) for i in range(1, BEFORE + 1)))))
    pairs = scratch.table(before.select("para", F.explode("before").alias("o")).select(*_pair(F.col("para"), F.col("o"))).distinct(), "pairs")
    asked = lists.select("para").distinct().withColumn("asked", F.lit(True))
    # of equal paragraphs: the first document, and whether they stand in several documents
    first = occurrences(rows, size).groupBy("para").agg(F.min("doc").alias("doc"), F.max("doc").alias("last"))
    first = first.join(asked, "para", "left").where("asked or last > doc").select("para", "doc", (F.col("last") > F.col("doc")).alias("several"), F.coalesce("asked", F.lit(False)).alias("asked"))
    first = scratch.table(first, "first")
    wanted = scratch.table(first.where("asked").groupBy("doc").agg(F.collect_list("para").alias("wanted")), "wanted")
    sets = scratch.table(_shingles(rows.join(light(wanted, "wanted"), "doc"), size), "sets")
    links = scratch.table(_verified(pairs, sets, similarity), "links")
    found = components(links, scratch)
    # the rest of longer lists
    rest = scratch.table(lists.where(F.col("length") > BEFORE + 1).select("key", F.col("para").alias("node")), "rest")
    if not rest.isEmpty():
        values = sets.select(F.col("para").alias("node"), F.col("shingles").alias("values"))
        links = scratch.table(links.unionByName(rest_links(rest, found, values, Fraction(similarity).limit_denominator(1000), scratch)), "links")
        found = components(links, scratch)
    # the smallest document of each component keeps the passage
    marked = first.join(found.select(F.col("node").alias("para"), "component"), "para", "left").where("several or component is not null").withColumn("component", F.coalesce("component", "para"))
    keeper = marked.groupBy("component").agg(F.min("doc").alias("kept_in"))
    keeper = scratch.table(marked.join(keeper, "component").select("para", "kept_in"), "keeper")
    # only documents with several texts need `body` on the way, as it is as wide as all the rest
    bodies = scratch.table(rows.groupBy("doc").agg(F.min("body").alias("body"), F.max("body").alias("other")), "bodies")
    torn = bodies.where("body <> other").select("doc")
    n = torn.count()
    told = rows
    if n <= TORN_MOST:
        own = F.when(F.col("torn"), F.col("body")) if n else F.lit(None).cast("long")
        told = rows.join(F.broadcast(torn.withColumn("torn", F.lit(True))), "doc", "left") if n else rows
        told = told.select("doc", own.alias("body"), "text")
    n = keeper.count()
    held = occurrences(told, size)
    if n > KEEPER_MOST:
        held = among(held, keeper, scratch)
    gone = held.join(small(keeper, n, KEEPER_MOST), "para").where("doc <> kept_in")
    gone = gone.groupBy("doc", "body", "at").agg((F.col("at") + F.max("words")).alias("end"), F.min("kept_in").alias("kept_in"))
    along = Window.partitionBy("doc", "body").orderBy("at")
    gone = gone.withColumn("new", (F.col("at") > F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))).cast("int"))
    gone = gone.withColumn("span", F.sum(F.coalesce("new", F.lit(0))).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    cuts = gone.groupBy("doc", "body", "span").agg(F.min("at").alias("start"), F.max("end").alias("end"), F.min("kept_in").alias("kept_in"))
    cuts = cuts.join(bodies.select("doc", F.col("body").alias("only")), "doc").withColumn("body", F.coalesce("body", "only"))
    return cuts.select(F.col("doc").alias(id_col), "body", "start", "end", "kept_in")


def remove_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with the passages' words taken out of their texts."""
    cuts = passages.groupBy(F.col(id_col).alias("__id"), F.col("body").alias("__body")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__cuts"))

    @F.pandas_udf("string")
    def cut(texts, cuts):
        out = []
        for text, spans in zip(texts, cuts, strict=True):
            if text is not None and spans is not None and len(spans):
                words = [m.span() for m in WORD.finditer(text)]
                at, left = 0, []
                for s in spans:
                    if s["start"] < len(words):
                        left.append(text[at : words[s["start"]][0]])
                        at = words[min(s["end"], len(words)) - 1][1]
                text = "".join(left) + text[at:]
            out.append(text)
        return type(texts)(out)

    joined = docs.join(cuts, (F.col(id_col) == F.col("__id")) & (F.xxhash64(text_col) == F.col("__body")), "left")
    return joined.withColumn(text_col, cut(text_col, "__cuts")).select(*docs.columns)
