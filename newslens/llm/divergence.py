"""Source divergence audit by in-mapper stripes (operator 11).

A task folds whole documents into stripes in memory: (lang, term) -> (document frequency,
count in each source), terms by hash, counts in arrays.  When the stripes pass `SPILL_CELLS`
counts they are spilled into the shuffle as rows and a new fold begins.  Stripes of one key then meet sorted and are
merged as they stream by, one stripe in memory at a time; a key comes in at most once per
spill, so no term, however frequent, brings a task more than one row per spill of the fold.
The stripe of the empty term, which no text holds, counts the documents of each source,
so sources without terms are known too.

Merged stripes of the kept terms (in `least_docs` documents of the language or more) emit
the divergences directly: they are dealt into blocks of `BLOCK_TERMS` terms, each meets the totals
of its language's sources, and a task adds |p - q| over the block's terms for every pair
of sources and keeps the block's best terms of every source.  Sources are cut into tiles
of `TILE`, and a block meets one pair of tiles at a time, so memory stays bounded however
many sources a language has.

All arithmetic is in integers: p = 1 + floor(10**9 (count + 5) / (N + 5 V)) by long
division in base 1000, exact while N + 5 V stays below 9 * 10**15.

Nulls: a null text, lang or source is ''.  A text without terms leaves its source with
zero counts; a language none of whose terms is kept has V = 0, pairs of value 0 and no
term rows.  A language with one source has no pairs.  Repeated rows count each.  Ties
rank by the item's UTF-8 bytes.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newslens.llm.common import FOLD, Scratch, distinct_words, in_arrow, small, spans, text_bytes, text_slices

LEAST_DOCS = 30
TOP_TERMS = 50
SCALE = 1_000_000_000
SMOOTH = 5
SPILL_CELLS = 1_000_000
ROWS = 4096
SLICE_BYTES = 4 << 20
BLOCK_TERMS = 512
TILE = 128

#: Bytes of a term: letters, and all of a character beyond ASCII.
IN_TERM = np.zeros(256, bool)
IN_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

STRIPE = "lang string, term string, df long, sources array<string>, counts array<long>"


def stripe_rows(langs: pa.Array, terms: pa.Array, df: np.ndarray, ends: np.ndarray, sources: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    """Stripes as rows; `ends`: where each one's sources and counts end."""
    offsets = pa.array(np.append(0, ends), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, sources.cast(pa.string())), pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64()))]
    return pa.RecordBatch.from_arrays([langs.cast(pa.string()), terms.cast(pa.string()), pa.array(df, pa.int64()), *lists], names=["lang", "term", "df", "sources", "counts"])


# --- the fold in a task ------------------------------------------------------------------
class Stripes:
    """Hash stripes of whole documents: terms and (lang, source) groups by number, and per cell (term, group) the documents and the occurrences."""

    def __init__(self):
        self.term: dict[str, int] = {"": 0}
        self.group: dict[tuple[str, str], int] = {}
        self.cells: list[np.ndarray] = []
        self.size = 0

    def _add(self, term: np.ndarray, group: np.ndarray, docs: np.ndarray, counts: np.ndarray) -> None:
        self.cells.append(np.stack([term, group, docs, counts]))
        self.size += len(term)

    def fold(self, texts: pa.Array, langs: list[str], sources: list[str]) -> None:
        """Add whole documents."""
        data, offsets = text_bytes(texts)
        data = FOLD[data]
        starts, ends, rows = spans(~IN_TERM[data], offsets)
        codes, terms = distinct_words(data, starts, ends)
        group = self.group
        group_of = np.array([group.setdefault(g, len(group)) for g in zip(langs, sources, strict=True)], np.int64)
        here, n = np.unique(group_of, return_counts=True)
        self._add(np.zeros(len(here), np.int64), here, n, n)
        if not len(codes):
            return
        width = len(terms)
        row = np.repeat(np.arange(len(texts)), np.diff(rows))
        held, n = np.unique(row * width + codes, return_counts=True)  # (document, term) and its occurrences
        cell = group_of[held // width] * width + held % width
        order = np.argsort(cell, kind="stable")
        first = np.flatnonzero(np.diff(cell[order], prepend=-1))
        number = self.term
        own = np.fromiter((number.setdefault(t, len(number)) for t in terms.to_numpy(zero_copy_only=False).tolist()), np.int64, width)
        cell = cell[order][first]
        self._add(own[cell % width], cell // width, np.diff(np.append(first, len(held))), np.add.reduceat(n[order], first))

    def spill(self) -> Iterator[pa.RecordBatch]:
        """The stripes as rows, and none are left."""
        if self.size:
            term, group, docs, counts = np.concatenate(self.cells, axis=1)
            groups = sorted(self.group)
            place = np.empty(len(groups), np.int64)  # of each group, by lang and source
            place[[self.group[g] for g in groups]] = np.arange(len(groups))
            langs = pa.array([g[0] for g in groups], pa.string())
            lang_of = np.cumsum([i > 0 and groups[i][0] != groups[i - 1][0] for i in range(len(groups))])
            cell = term * len(groups) + place[group]
            order = np.argsort(cell, kind="stable")
            first = np.flatnonzero(np.diff(cell[order], prepend=-1))
            docs, counts, cell = np.add.reduceat(docs[order], first), np.add.reduceat(counts[order], first), cell[order][first]
            term, at = cell // len(groups), cell % len(groups)
            stripe = np.flatnonzero(np.diff(term * len(groups) + lang_of[at], prepend=-1))
            batch = stripe_rows(
                langs.take(pa.array(at[stripe])), pa.array(list(self.term), pa.large_string()).take(pa.array(term[stripe])), np.add.reduceat(docs, stripe),
                np.append(stripe[1:], len(cell)), pa.array([g[1] for g in groups], pa.string()).take(pa.array(at)), counts,
            )
            yield from (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS))
        self.__init__()


def folded(docs: DataFrame, spill_cells: int = SPILL_CELLS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Partial stripes: what each task's folds have spilled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripes = Stripes()
        for batch in batches:
            for part in text_slices(batch, "text", most=SLICE_BYTES):
                stripes.fold(part.column("text"), part.column("lang").to_pylist(), part.column("source").to_pylist())
                if stripes.size >= spill_cells:
                    yield from stripes.spill()
        yield from stripes.spill()

    empty = lambda c, name: F.coalesce(F.col(c), F.lit("")).alias(name)
    return in_arrow(docs.select(empty(text_col, "text"), empty(lang_col, "lang"), empty(source_col, "source")), run, STRIPE)


def merge(rows: pa.RecordBatch, least_docs: int) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """Merged stripes of rows sorted by key: those of the kept keys, and the last key's, which may go on."""
    lang, term = rows.column("lang"), rows.column("term")
    n = rows.num_rows
    new = np.ones(n, bool)
    new[1:] = np.asarray(pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1])))
    first = np.flatnonzero(new)
    df = np.add.reduceat(rows.column("df").to_numpy(), first)
    wanted = (df >= least_docs) | np.asarray(pc.equal(term.take(pa.array(first)), ""))
    wanted[-1] = True
    key = np.cumsum(new) - 1
    rows = rows.filter(pa.array(wanted[key]))
    key = (np.cumsum(wanted) - 1)[key[wanted[key]]]
    sources, counts = rows.column("sources"), rows.column("counts")
    named = sources.flatten().dictionary_encode()
    names = len(named.dictionary)
    cell = np.repeat(key, pc.list_value_length(sources).to_numpy()) * names + named.indices.to_numpy()
    order = np.argsort(cell, kind="stable")
    at = np.flatnonzero(np.diff(cell[order], prepend=-1))
    total, cell = np.add.reduceat(counts.flatten().to_numpy()[order], at), cell[order][at]
    heads = pa.array(first[wanted])
    whole = stripe_rows(lang.take(heads), term.take(heads), df[wanted], np.searchsorted(cell // names, np.arange(len(heads)), side="right"), named.dictionary.take(pa.array(cell % names)), total)
    return whole.slice(0, len(heads) - 1), whole.slice(len(heads) - 1)


def merged(partial: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """One stripe per kept (lang, term), and the empty term's stripe of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if batch.num_rows:
                rows = pa.concat_batches([last, batch.cast(last.schema)]) if last is not None else batch
                done, last = merge(rows, least_docs)
                yield done
        if last is not None and (last.column("df")[0].as_py() >= least_docs or last.column("term")[0].as_py() == ""):
            yield last

    return in_arrow(partial.repartition("lang", "term").sortWithinPartitions("lang", "term"), run, STRIPE)


# --- divergences -------------------------------------------------------------------------
def smoothed(counts: np.ndarray, n: np.ndarray | int, v: int) -> np.ndarray:
    """1 + floor(SCALE (count + SMOOTH) / (n + SMOOTH v)), exact: three digits of base 1000 by long division."""
    below = np.asarray(n, np.int64) + SMOOTH * v
    whole, rest = np.divmod(np.asarray(counts, np.int64) + SMOOTH, below)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, below)
        whole = whole * 1000 + digit
    return whole + 1


def block_rows(sources: list[str], n: np.ndarray, tiles: np.ndarray, own: tuple[int, int], v: int, lang_n: int, terms: list[str], totals: np.ndarray, cells: tuple[np.ndarray, np.ndarray, np.ndarray], top: int) -> Iterator[tuple[str, str, str, int]]:
    """(source, part, item, value) of a block of terms: sums over its terms for pairs, its best terms for each source.

    `cells`: term number, source number and count; `own`: the two tiles that meet here.
    """
    counts = np.zeros((len(sources), len(terms)), np.int64)
    counts[cells[1], cells[0]] = cells[2]
    p = smoothed(counts, n[:, None], v) if terms else np.zeros((len(sources), 0), np.int64)
    left, right = (np.flatnonzero(tiles == t) for t in own)
    for i in left.tolist():
        apart = np.abs(p[right] - p[i]).sum(axis=1).tolist()
        for j, value in zip(right.tolist(), apart, strict=True):
            if own[0] != own[1]:
                yield sources[i], "pair", sources[j], value
                yield sources[j], "pair", sources[i], value
            elif i != j:
                yield sources[i], "pair", sources[j], value
    if own[0] == own[1] and terms:
        excess = np.where(counts > 0, p - smoothed(totals, lang_n, v), 0)
        for i in left.tolist():
            at = np.flatnonzero(excess[i] > 0).tolist()
            for value, term in sorted(((-int(excess[i, t]), terms[t]) for t in at), key=lambda x: (x[0], x[1].encode()))[:top]:
                yield sources[i], "term", term, -value


def divergences(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, block_terms: int = BLOCK_TERMS, tile: int = TILE, spill_cells: int = SPILL_CELLS, **columns: str) -> DataFrame:
    """lang, source, part, item, value, rank."""
    scratch = Scratch(docs.sparkSession, "divergence")
    stripes = scratch.table(merged(folded(docs, spill_cells, **columns), least_docs), "stripes")
    kept = stripes.where("term <> ''")
    # totals of every (lang, source): N, V, and the source's tile
    known = stripes.where("term = ''").select("lang", F.explode("sources").alias("source"))
    counted = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    sums = counted.groupBy("lang").agg(F.sum("n").alias("lang_n"))
    groups = known.groupBy("lang").agg(F.count("*").alias("n_sources"))
    langs = groups.join(sizes, "lang", "left").join(sums, "lang", "left").select(
        "lang", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_n", F.lit(0)).alias("lang_n"),
        F.greatest(F.ceil(F.coalesce("v", F.lit(0)) / block_terms), F.lit(1)).cast("int").alias("blocks"),
        F.ceil(F.col("n_sources") / tile).cast("int").alias("tiles"))
    langs = scratch.table(langs, "langs")
    langs = small(langs, langs.count())
    meet = F.explode(F.expr("flatten(transform(sequence(0, tiles - 1), i -> transform(sequence(i, tiles - 1), j -> struct(i, j))))")).alias("own")
    totals = known.join(counted, ["lang", "source"], "left").join(langs, "lang").select(
        "lang", "source", F.coalesce("n", F.lit(0)).alias("n"), "v", "lang_n", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int").alias("tile"), "blocks", "tiles")
    totals = scratch.table(totals, "totals")
    right = totals.select("lang", "source", "n", "v", "lang_n", "tile", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), "tiles")
    right = right.select("lang", "source", "n", "v", "lang_n", "tile", "block", meet).where("tile = own.i or tile = own.j").select("*", F.col("own.i").alias("i"), F.col("own.j").alias("j")).drop("own")
    left = kept.join(langs, "lang").select(
        "lang", "term", "sources", "counts", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"),
        F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), meet).select("*", F.col("own.i").alias("i"), F.col("own.j").alias("j")).drop("own")
    schema = "lang string, source string, part string, item string, value long"

    def emit(key: tuple, block: pa.Table, known: pa.Table) -> pa.Table:
        sources = known.column("source").to_pylist()
        number = {s: k for k, s in enumerate(sources)}
        names = block.column("sources").combine_chunks()
        lengths = pc.list_value_length(names).to_numpy(zero_copy_only=False) if len(names) else np.zeros(0, np.int64)
        at = np.array([number.get(s, -1) for s in names.flatten().to_pylist()], np.int64)
        term = np.repeat(np.arange(len(names)), lengths)
        count = block.column("counts").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        here = at >= 0
        rows = list(
            block_rows(
                sources, known.column("n").to_numpy(), known.column("tile").to_numpy(), (key[2].as_py(), key[3].as_py()), known.column("v")[0].as_py(), known.column("lang_n")[0].as_py(),
                block.column("term").to_pylist(), block.column("total").to_numpy(), (term[here], at[here], count[here]), top,
            )
        ) if sources else []
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
        return pa.table([pa.array([key[0].as_py()] * len(rows), pa.string()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["lang", "source", "part", "item", "value"])

    keys = ["lang", "block", "i", "j"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(emit, schema)
    found = scratch.table(found, "found")
    # a pair's blocks are added up; a source's best terms are among the best of its blocks
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
