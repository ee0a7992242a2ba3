"""Line dedup over all documents within an edit bound (operator 6).

A line's words are its runs without white space, A-Z lower-cased.  A line is removed if
an earlier line (by document id, then line number) has the same words, or, for lines of
`near_words` words or more, differs from it by one edit: a word put in, left out or
replaced.  The earliest line stays; lines without words always stay.

Deletion-neighbourhood join: every distinct line emits, as hashed keys, itself and its
variants with one word deleted.  Two lines are within one edit exactly if they share a
variant made by deleting the same place, or one is a variant of the other; so the
earliest neighbour is an aggregate per key, and no pairs are listed within a key.  The
found pairs are then verified on their texts.

A pair within one edit shares its first or its last half of words, so lines that share
neither with another distinct line are set aside before variants are made, and the
others emit only the variants of the half that may differ.  This drops no pair.

Equal lines are one row before anything else is joined, so a line that fills a third of
the corpus is one row in the neighbourhood join.

Nulls and empty texts have no lines and stay as they are.  A null id counts as the
largest.  Rows that repeat id and text are one document, given back as often as they
occur.  Texts of any length are split whole.  An empty table gives no rows.  Other
columns pass through; columns named like the added ones are replaced.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newslens.llm.common import FOLD, SPACES, Scratch, in_arrow, light, mix, powers, run_hashes, signed, small, spans, text_bytes, text_slices

NEAR_WORDS = 8
VARIANT_ROWS = 10_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
ORDER = ("doc", "body", "line_no")
ORDERED = "doc long, body long, line_no int"


class Lines:
    """The lines with words of some texts: word hashes W, prefix sums S of W * B**place, and each line's words [first, last)."""

    def __init__(self, column: pa.Array):
        data, offsets = text_bytes(column)
        data = FOLD[data]
        starts, ends, rows = spans(SPACES[data], offsets)
        breaks = np.cumsum(np.append(0, data == 10))
        doc = np.repeat(np.arange(len(column)), np.diff(rows))
        line = breaks[starts] - breaks[offsets[:-1]][doc]
        new = np.append(True, (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])) if len(starts) else np.zeros(0, bool)
        self.first = np.flatnonzero(new)
        self.last = np.append(self.first[1:], len(starts)).astype(np.int64) if len(starts) else self.first
        self.doc, self.line_no = doc[self.first], line[self.first]
        self.size = self.last - self.first
        self.up, self.down = powers(len(starts) + 2)
        self.sums = np.append(np.uint64(0), np.cumsum(run_hashes(data, starts, ends) * self.up[: len(starts)], dtype=np.uint64))

    def run(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the words [a, b), before mixing."""
        return (self.sums[b] - self.sums[a]) * self.down[a]

    def whole(self) -> np.ndarray:
        return mix(self.run(self.first, self.last) + self.size.astype(np.uint64))

    def half(self, words: np.ndarray, tail: bool) -> np.ndarray:
        a, b = (self.last - words, self.last) if tail else (self.first, self.first + words)
        return mix(self.run(a, b) + (words * 2 + tail + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def within_one_edit(a: list[str], b: list[str]) -> bool:
    """Whether two word sequences differ by one word put in, left out or replaced, at most."""
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, x in enumerate(a) if x != b[i]), len(a))
    return a[i:] == b[i + 1 :] or a[i + 1 :] == b[i + 1 :]


def folded_words(line: str) -> list[str]:
    return WORD.findall(line.translate(LOWER))


def find_lines(docs: DataFrame, near_words: int) -> DataFrame:
    """One row per line with words: order key, line (hash), and its half keys."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                x = Lines(part.column("text"))
                big = x.size >= near_words
                keys = np.stack([x.half(m, tail) for m in (x.size // 2, (x.size - 1) // 2) for tail in (False, True)], axis=1)
                keep = np.stack([big, big, big & (x.size % 2 == 0), big & (x.size % 2 == 0)], axis=1)
                ends = np.cumsum(np.append(0, keep.sum(axis=1))).astype(np.int32)
                at = pa.array(x.doc)
                yield pa.RecordBatch.from_pydict({
                    "doc": part.column("doc").take(at), "body": part.column("body").take(at), "line_no": pa.array(x.line_no.astype(np.int32)),
                    "line": signed(x.whole()), "halves": pa.ListArray.from_arrays(pa.array(ends), signed(keys[keep])),
                    "tails": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.tile([False, True, False, True], (len(keep), 1))[keep])),
                })

    return in_arrow(docs, lines, f"{ORDERED}, line long, halves array<long>, tails array<boolean>")


def variants(docs: DataFrame) -> DataFrame:
    """Keys of the lines that `wanted` names: deletions (place >= 0) and the line itself (place -1)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                wanted = {(i, w["line_no"]): w for i, ws in enumerate(part.column("wanted").to_pylist()) for w in ws}
                x = Lines(part.column("text"))
                picked = [(k, w) for k, at in enumerate(zip(x.doc.tolist(), x.line_no.tolist(), strict=True)) if (w := wanted.get(at))]
                if not picked:
                    continue
                k = np.array([p[0] for p in picked])
                size, first, last = x.size[k], x.first[k], x.last[k]
                half = (size - 1) // 2
                lo = np.where([p[1]["tail"] for p in picked], 0, half)  # only the first half is shared: the edit is behind it
                hi = np.where([p[1]["head"] for p in picked], size, size - half)
                n = hi - lo
                of = np.repeat(np.arange(len(k)), n)
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[of]
                cut = first[of] + place
                left = (x.sums[cut] - x.sums[first[of]]) * x.down[first[of]]
                right = (x.sums[last[of]] - x.sums[cut + 1]) * x.down[first[of] + 1]
                short = mix(left + right + (size[of] - 1).astype(np.uint64))
                own = x.whole()[k]
                owner = np.concatenate([of, np.arange(len(k))])
                yield pa.RecordBatch.from_pydict({
                    "variant": signed(np.concatenate([short, own])), "place": pa.array(np.concatenate([place, np.full(len(k), -1)]).astype(np.int32)),
                    "doc": part.column("doc").take(pa.array(x.doc[k][owner])), "body": part.column("body").take(pa.array(x.doc[k][owner])), "line_no": pa.array(x.line_no[k][owner].astype(np.int32)),
                    "line": signed(own[owner]),
                })

    return in_arrow(docs, emit, f"variant long, place int, {ORDERED}, line long")


def _verify(pairs: DataFrame) -> DataFrame:
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [within_one_edit(folded_words(a), folded_words(b)) for a, b in zip(batch.column("text").to_pylist(), batch.column("other").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("line").filter(pa.array(keep, pa.bool_()))], names=["line"])

    return in_arrow(pairs.select("line", "text", "other"), check, "line long")


def removed_lines(docs: DataFrame, near_words: int = NEAR_WORDS, scratch: Scratch | None = None) -> DataFrame:
    """doc, body, lines (array<int>): the numbers of the lines to remove, for documents that lose any.  docs: doc long, body long, text."""
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    found = scratch.table(find_lines(docs, near_words), "lines")
    order = F.struct(*ORDER)
    firsts = scratch.table(found.groupBy("line").agg(F.min(order).alias("first"), F.first("halves").alias("halves"), F.first("tails").alias("tails")), "firsts")
    # lines that share a half with another distinct line
    halves = firsts.select("line", "first", F.explode(F.arrays_zip("halves", "tails")).alias("h")).select("line", "first", F.col("h.halves").alias("key"), F.col("h.tails").alias("tail"))
    shared = halves.groupBy("key").agg(F.min("line").alias("a"), F.max("line").alias("b")).where("a <> b").select("key")
    wanted = halves.join(shared, "key").groupBy("line").agg(F.first("first").alias("first"), F.max(~F.col("tail")).alias("head"), F.max("tail").alias("tail"))
    wanted = wanted.groupBy("first.doc", "first.body").agg(F.collect_list(F.struct("first.line_no", "head", "tail")).alias("wanted"))
    wanted = scratch.table(wanted, "wanted")
    texts = docs.join(light(wanted, "wanted"), ["doc", "body"])
    # each line's earliest partner: of the same variant at the same place, or whole against shortened
    earlier = F.when(F.col("place") < 0, F.col("longer")).otherwise(F.least("same", "self"))
    own = lambda cond, value: F.min(F.when(cond, value))
    held = variants(texts).groupBy("variant").agg(F.count("*").alias("n")).where(F.col("n") > VARIANT_ROWS).select("variant")
    hot = scratch.table(held, "hot")
    n_hot = hot.count()
    is_hot = small(hot, n_hot)
    cold = variants(texts).join(is_hot, "variant", "left_anti") if n_hot else variants(texts)
    cold = cold.repartition("variant")
    by, at = Window.partitionBy("variant"), Window.partitionBy("variant", "place")
    keys = cold.withColumns({"same": F.min(order).over(at), "self": own(F.col("place") < 0, order).over(by), "longer": own(F.col("place") >= 0, order).over(by)})
    keys = keys.select("variant", "place", *ORDER, "line", earlier.alias("other"))
    if n_hot:
        # a variant of very many lines (a template that differs in one word): its minima are combined in the
        # map tasks, and its rows meet them where they are, or in a join that Spark splits
        much = variants(texts).join(is_hot, "variant", "left_semi")
        places = much.groupBy("variant", "place").agg(F.min(order).alias("same"))
        least = places.groupBy("variant").agg(own(F.col("place") < 0, F.col("same")).alias("self"), own(F.col("place") >= 0, F.col("same")).alias("longer"), F.map_from_entries(F.collect_list(F.struct("place", "same"))).alias("sames"))
        least = scratch.table(least, "least")
        told = much.join(small(least, least.count(), 10_000), "variant").withColumn("same", F.col("sames")[F.col("place")])
        keys = keys.unionByName(told.select("variant", "place", *ORDER, "line", earlier.alias("other")))
    near = keys.where(F.col("other") < order).groupBy("line").agg(F.min("other").alias("other"), F.min(order).alias("first"))
    near = scratch.table(near, "near")
    # the two texts of each found pair
    ends = near.select("line", F.explode(F.array(F.struct("first", F.lit(False).alias("is_other")), F.struct(F.col("other").alias("first"), F.lit(True).alias("is_other")))).alias("e"))
    ends = ends.groupBy("e.first.doc", "e.first.body").agg(F.collect_list(F.struct("line", "e.first.line_no", "e.is_other")).alias("ends"))
    ends = scratch.table(ends, "ends")
    cut = docs.join(light(ends, "ends"), ["doc", "body"]).withColumn("cut", F.split("text", "\n")).select("cut", F.explode("ends").alias("e"))
    cut = cut.select("e.line", "e.is_other", F.get("cut", F.col("e.line_no")).alias("text"))
    pairs = cut.groupBy("line").agg(F.max(F.when(~F.col("is_other"), F.col("text"))).alias("text"), F.max(F.when(F.col("is_other"), F.col("text"))).alias("other"))
    dropped = scratch.table(_verify(pairs), "dropped")
    keep = firsts.join(dropped.withColumn("near", F.lit(True)), "line", "left").select("line", "first", F.coalesce("near", F.lit(False)).alias("near"))
    gone = found.select(*ORDER, "line").join(keep, "line").where(F.col("near") | (F.col("first") != order))
    return scratch.table(gone.groupBy("doc", "body").agg(F.sort_array(F.collect_set("line_no")).alias("lines")), "removed")


def dedup_lines(docs: DataFrame, near_words: int = NEAR_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with their text cleaned, and n_lines (with words) and n_removed beside their columns."""
    docs = docs.drop("n_lines", "n_removed")
    marked = {"__doc": F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)), "__body": F.xxhash64(text_col)}
    narrow = docs.select(marked["__doc"].alias("doc"), marked["__body"].alias("body"), F.col(text_col).alias("text"))
    gone = removed_lines(narrow, near_words)
    gone = gone.select(F.col("doc").alias("__doc"), F.col("body").alias("__body"), F.col("lines").alias("__lines"))
    rows = docs.withColumns(marked).join(light(gone, "__lines"), ["__doc", "__body"], "left")
    split = F.split(text_col, "\n")
    kept = F.filter(split, lambda x, i: ~F.array_contains("__lines", i))
    n_lines = F.size(F.filter(split, lambda x: x.rlike(r"[^ \t\n\x0B\f\r]")))
    out = rows.withColumns({
        "n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(n_lines),
        "n_removed": F.coalesce(F.size("__lines"), F.lit(0)),
        text_col: F.when(F.col("__lines").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")),
    })
    return out.select(*docs.columns, "n_lines", "n_removed")
