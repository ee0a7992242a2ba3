"""Filter interaction audit by decision diagrams (operator 12).

Every document gets a failure mask, one bit per filter.  Masks are counted per part
(source), beside the documents of good quality and the toxic ones among them: at most
2 ** filters rows a part.  From a part's counts a decision diagram is built whose
terminals are those counts and whose nodes weigh what reaches them.  The diagram starts
in one variable order and visits all others, each by one swap of two neighbouring
levels.  In every order the path on which all filters pass gives the steps: a node's
fail child weighs what the step removes, its pass child what it keeps.

The filters of `failures`: A too few words, B too few distinct words, C too many
capitals, D a forbidden character, E a repeated text.  E compares whole texts by their
SHA-256: a text's cells (equal in all that is counted) are folded before the shuffle,
so thousands of copies of one text are a few rows, and what passes E is counted at the
text's smallest id.

Nulls: a null text is empty; a null source is the part ''.  A row without an id is not
a copy of anything and has no labels; it hides no other row either.  Rows repeated with
one id and text are no copies of each other (neither id is smaller).  A document
with several label rows is good (toxic) if any of them says so; null labels say nothing.
Empty texts fail A only (and E, where an earlier text is empty).  An empty table gives no
rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslens.llm.common import Scratch

FILTERS = "ABCDE"
COUNTED = ("n", "good", "toxic")
NULL_SALTS = 4096


# --- decision diagrams -------------------------------------------------------------------
class Diagram:
    """A shared decision diagram over failure masks; every node weighs the (n, good, toxic) below it.

    Node 0 is the terminal without documents; a node that leads only there is node 0
    itself.  `order[k]` is the filter asked at level k.
    """

    def __init__(self, filters: str, counts: dict[int, tuple[int, ...]]):
        """`counts`: what each mask (bit i: fails filters[i]) holds."""
        self.order = list(filters)
        self.weight: list[tuple[int, ...]] = [(0,) * len(COUNTED)]
        self.kids: list[tuple[int, int]] = [(0, 0)]
        self._nodes: dict[tuple[int, int, int], int] = {}
        self._leaves: dict[tuple[int, ...], int] = {self.weight[0]: 0}
        self.root = self._build(counts, 0, 0)

    def _leaf(self, counts: tuple[int, ...]) -> int:
        if counts not in self._leaves:
            self._leaves[counts] = self._new(counts, (0, 0))
        return self._leaves[counts]

    def _new(self, weight: tuple[int, ...], kids: tuple[int, int]) -> int:
        self.weight.append(weight)
        self.kids.append(kids)
        return len(self.weight) - 1

    def _node(self, level: int, passed: int, failed: int) -> int:
        if not passed and not failed:
            return 0
        key = (level, passed, failed)
        if key not in self._nodes:
            self._nodes[key] = self._new(tuple(a + b for a, b in zip(self.weight[passed], self.weight[failed], strict=True)), (passed, failed))
        return self._nodes[key]

    def _build(self, counts: dict[int, tuple[int, ...]], level: int, mask: int) -> int:
        if level == len(self.order):
            return self._leaf(counts.get(mask, self.weight[0]))
        return self._node(level, self._build(counts, level + 1, mask), self._build(counts, level + 1, mask | 1 << level))

    def swap(self, level: int) -> None:
        """Exchange the filters of `level` and `level + 1`; nodes above are led to the new ones, all below stay."""
        done: dict[int, int] = {}

        def turned(node: int, at: int) -> int:
            if not node:
                return 0
            if node not in done:
                p, f = self.kids[node]
                if at == level:
                    (pp, pf), (fp, ff) = self.kids[p], self.kids[f]
                    done[node] = self._node(level, self._node(level + 1, pp, fp), self._node(level + 1, pf, ff))
                else:
                    done[node] = self._node(at, turned(p, at + 1), turned(f, at + 1))
            return done[node]

        self.root = turned(self.root, 0)
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> Iterator[tuple[str, tuple[int, ...], tuple[int, ...]]]:
        """Along the path on which all filters pass: filter, weight kept, weight removed."""
        node = self.root
        for name in self.order:
            node, failed = self.kids[node]
            yield name, self.weight[node], self.weight[failed]


def adjacent_swaps(n: int) -> Iterator[int]:
    """Levels to swap with the next one, so that all orders of n come up once (plain changes)."""
    if n < 2:
        return
    inner = adjacent_swaps(n - 1)
    down = True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        step = next(inner, None)
        if step is None:
            return
        yield step + down  # the last filter stands in front of the others, or behind them
        down = not down


def audit_part(counts: dict[int, tuple[int, ...]], filters: str = FILTERS) -> Iterator[dict]:
    """The rows of one part, from what each failure mask holds."""
    diagram = Diagram(filters, counts)
    alone = {f: counts.get(1 << i, (0,))[0] for i, f in enumerate(filters)}
    rows, shapley, failing = [], dict.fromkeys(filters, 0), {}

    def visit() -> None:
        order = "".join(diagram.order)
        for k, (name, kept, removed) in enumerate(diagram.steps(), 1):
            if k == 1:
                failing[name] = removed[0]
            shapley[name] += removed[0]
            rows.append((order, k, name, kept[0], removed))

    visit()
    for level in adjacent_swaps(len(filters)):
        diagram.swap(level)
        visit()
    for order, k, name, kept, (removed, good, toxic) in rows:
        yield {
            "filter_order": order, "step": k, "kept": kept, "removed": removed, "redundant": failing[name] - removed,
            "unique_fails": alone[name], "good_lost": good, "toxic_lost": toxic, "shapley": shapley[name],
        }


# --- failure masks -----------------------------------------------------------------------
def failures(text: Column) -> list[Column]:
    """Whether a text fails A, B, C and D."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return [F.size(words) < 50, 100 * F.size(F.array_distinct(words)).cast("long") < 65 * F.size(words).cast("long"), 100 * capitals.cast("long") > 5 * F.length(text).cast("long"), text.rlike(r"[#$%&*|]")]


def failure_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, mask (bit i: fails filter i), n, good, toxic: the documents of each part and mask."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    mask = sum((F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)) for i, fails in enumerate(failures(text))), F.lit(0))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), mask.alias("mask"))
    # the whole texts are read once; repeated rows fold here, before the join with the labels
    rows = rows.groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    said = labels.select(F.col("doc_id").cast("long").alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).where("id is not null")
    said = said.groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")).withColumn("salt", F.lit(0))
    # rows without an id meet no label: a salt spreads them
    salted = rows.withColumn("salt", F.when(F.col("id").isNull(), 1 + F.pmod(F.xxhash64("digest"), F.lit(NULL_SALTS))).otherwise(0).cast("int"))
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    known = salted.join(said, ["id", "salt"], "left").select("id", "part", "digest", "mask", "n", flag("good"), flag("toxic"))
    # a cell: rows of one text that are equal in all that is counted
    cells = known.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("id").alias("first"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), F.min_by("n", "id").alias("n_first"))
    cells = Scratch(docs.sparkSession, "audit").table(cells, "cells")
    first = cells.groupBy("digest").agg(F.min("first").alias("least"), F.count("*").alias("cells"))
    several = first.where("cells > 1").select("digest", "least")
    told = cells.join(several, "digest", "left").withColumn("least", F.coalesce("least", "first"))
    passes = F.col("nameless") + F.when(F.col("first") == F.col("least"), F.col("n_first")).otherwise(0)
    bit = 1 << FILTERS.index("E")
    both = told.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("mask"), passes.alias("n")), F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - passes).alias("n")))).alias("x"))
    n = F.col("x.n")
    counted = both.groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"))
    return counted.where("n > 0")


def audit_filters(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row per part, order and step."""
    longs = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

    def rows(part: pd.DataFrame) -> pd.DataFrame:
        counts = {int(m): (int(n), int(g), int(t)) for m, n, g, t in zip(part["mask"], part["n"], part["good"], part["toxic"], strict=True)}
        return pd.DataFrame(audit_part(counts)).assign(part=part["part"].iloc[0])[["part", "filter_order", "step", *longs]]

    counted = failure_counts(docs, labels, **columns)
    return counted.groupBy("part").applyInPandas(rows, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in longs))
