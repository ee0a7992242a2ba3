"""Operator 8 where rows share an id; scratch tables that go; lists cut into slices."""

import os

import numpy as np
from test_texts import docs_of

from newslens.llm import near_dedup, rest, sharding, substring
from newslens.llm.common import Scratch, temporary


def words(seed, n):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(list("abcdefghij"), 6)) for _ in range(n))


def test_each_row_of_an_id_loses_its_own_passages(spark):
    shared, other = words(1, 80), words(2, 120)
    rows = [(1, f"{words(3, 30)} {shared} {words(4, 30)}"), (2, f"{words(5, 10)} {shared} {words(6, 30)}"), (2, other), (2, other), (3, other + " end"), (4, None)]
    docs = docs_of(spark, rows)
    spans = substring.repeated_passages(docs)
    assert spans.columns == ["doc_id", "body", "start", "end", "kept_in"]
    cut = [(x.doc_id, x.text) for x in substring.remove_passages(docs, spans).collect()]
    assert sorted(t for i, t in cut if i == 1) == [rows[0][1]]
    assert sorted(t for i, t in cut if i == 2 and t.startswith(other[:20])) == [other, other]  # doc 2 keeps it, twice as given
    rest_of = next(t for i, t in cut if i == 2 and not t.startswith(other[:20]))
    left = set(rest_of.split()) & set(shared.split())
    assert len(left) < 40 and set(words(5, 10).split()) <= set(rest_of.split()) and set(words(6, 30).split()) <= set(rest_of.split())
    assert len(next(t for i, t in cut if i == 3).split()) < 50
    assert len(cut) == len(rows)


def test_long_lists_cut_into_slices_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(rest, "LIST_ROWS", 6)
    monkeypatch.setattr(rest.sliced, "__defaults__", (6,))
    monkeypatch.setattr(rest, "BLOCK_BYTES", 2000)
    core = words(7, 60).split()
    rows = [(i, " ".join([*core[:i % 5], f"x{i}", *core[i % 5:], f"y{i}"])) for i in range(40)] + [(100 + i, words(50 + i, 60)) for i in range(20)]
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(docs_of(spark, rows)).collect()}
    assert all(got[i] == 0 for i in range(40)) and all(got[100 + i] == 100 + i for i in range(20))
    line = words(8, 40)
    spans = substring.repeated_passages(docs_of(spark, [(i, f"{line} z{i}") for i in range(60)]))
    assert {x.doc_id for x in spans.collect()} == set(range(1, 60)) and {x.kept_in for x in spans.collect()} == {0}


def test_scratch_tables_go_with_their_block(spark):
    with temporary(spark):
        outer = Scratch(spark, "outer")
        outer.table(spark.range(3), "a")
        with temporary(spark):
            sharding.shard_rows(docs_of(spark, [(1, "a"), (2, "b")])).collect()
            inner = Scratch(spark, "inner")
            inner.table(spark.range(3), "b")
        here = lambda s: s.root.removeprefix("file:").replace("//", "/")
        assert os.path.exists(here(outer)) and not os.path.exists(here(inner))
    assert not os.path.exists(here(outer))


def test_shard_buckets_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKETS", 2)
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 10)
    docs = docs_of(spark, [(i, f"t{i}") for i in range(95)])
    got = sharding.shard_rows(docs, shards=4).collect()
    assert sorted(r.row_number for r in got) == list(range(95)) and sorted(r.place for r in got) == list(range(95))


def test_templated_lines_of_one_variant(spark, monkeypatch):
    """Lines that differ in one word share a variant: beyond VARIANT_ROWS its minima are combined and joined."""
    import brute

    from newslens.llm import line_dedup

    monkeypatch.setattr(line_dedup, "VARIANT_ROWS", 6)
    start = "this is the page with the number".split()
    lines = [" ".join([*start, f"n{i}", "of", "many"]) for i in range(30)] + [" ".join([*start, "of", "many"])] + [words(20 + i, 12) for i in range(10)]
    rows = [(i, "\n".join([lines[i % len(lines)], words(90 + i, 9), lines[(7 * i) % len(lines)]])) for i in range(45)]
    want = brute.clean_lines(dict(rows), line_dedup.NEAR_WORDS)
    got = {x.doc_id: (x.text, x.n_lines, x.n_removed) for x in line_dedup.dedup_lines(docs_of(spark, rows)).collect()}
    assert got == want and sum(n for *_, n in got.values()) > 40
