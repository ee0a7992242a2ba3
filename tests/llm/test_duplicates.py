"""Operators 2, 6 and 8 against brute force, and their edge cases."""

import random
from fractions import Fraction

import brute
import pytest

from newslens.llm import graph, line_dedup, near_dedup, substring
from newslens.llm.common import Scratch


def prose(r, n, vocabulary=3000):
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def edited(r, text, share):
    return [x if r.random() > share else f"e{r.randrange(10**6)}" for x in text]


def docs_of(spark, rows, extra="id long, n int, one string, key string"):
    return spark.createDataFrame([(i, t, 1, 2, "x", "y") for i, t in rows], f"doc_id long, text string, {extra}")


@pytest.fixture(scope="module")
def corpus():
    """Groups of copies from two to eighty, a passage shared by many, short texts, empties."""
    r = random.Random(3)
    rows, i = [], 0
    for size, share in ((80, 0.02), (40, 0.05), (12, 0.03), (2, 0.01), (2, 0.03), (3, 0.04)):
        base = prose(r, r.randrange(30, 200))
        for _ in range(size):
            rows.append((i := i + 1, " ".join(edited(r, base, share * r.random() * 2))))
    passage = prose(r, 60)
    rows += [(i := i + 1, " ".join(prose(r, 40) + passage + prose(r, 30))) for _ in range(40)]
    rows += [(i := i + 1, " ".join(passage + prose(r, 1 + k % 9))) for k in range(40)]  # the passage is most of the text
    rows += [(i := i + 1, t) for t in ("", " \n ", "one", "One", "one two", "one  TWO", "one two three", None, "one two three four")]
    rows += [rows[0], (i := i + 1, rows[0][1].upper())]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("shingle", "similarity"), [(3, Fraction(85, 100)), (5, Fraction(4, 5))])
def test_near_duplicates_equal_brute_force(spark, corpus, shingle, similarity):
    got = near_dedup.near_duplicates(docs_of(spark, corpus), shingle, similarity).collect()
    label = brute.near(dict(corpus), shingle, similarity.numerator, similarity.denominator)
    assert len(got) == len(corpus)
    assert {(x.doc_id, x.n_shingles, x.component_id, x.kept) for x in got} == {(d, len(brute.shingles(t, shingle)), label[d], label[d] == d) for d, t in corpus}


def test_near_duplicates_edges(spark):
    long = " ".join(f"v{k}" for k in range(120_000))
    rows = [(None, "a b c d e f"), (None, None), (1, "a b c d e f"), (2, "A b c d e f"), (3, long), (4, long + " end"), (5, "")]
    got = {(x.doc_id, x.component_id, x.kept) for x in near_dedup.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == {(None, None, True), (1, 1, True), (2, 1, False), (3, 3, True), (4, 3, False), (5, 5, True)}
    assert near_dedup.near_duplicates(docs_of(spark, [])).count() == 0


def test_components_of_paths_stars_and_rings(spark, scratch):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 - i) for i in range(1, 60)] + [(900 + i, 900 + (i + 1) % 9) for i in range(9)] + [(7, 7), (8, 6), (6, 8)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in graph.components(df, Scratch(spark, "test")).collect()}
    linked = {frozenset(e) for e in edges}
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert got == brute.groups(nodes, lambda a, b: frozenset((a, b)) in linked)
    assert graph.components(df.where("a < 0"), Scratch(spark, "test")).count() == 0


def test_line_dedup_equals_brute_force(spark):
    r = random.Random(5)
    lines = [" ".join(prose(r, r.choice((1, 2, 7, 8, 9, 14, 30)), 400)) for _ in range(60)]
    rows = []
    for d in range(1, 41):
        own = []
        for _ in range(r.randrange(0, 8)):
            w = r.choice(lines).split(" ")
            edit = r.randrange(6)
            at = r.randrange(len(w))
            w = [*w[:at], *([] if edit == 1 else [f"x{r.randrange(9)}"] if edit == 2 else [w[at], f"y{r.randrange(9)}"] if edit == 3 else [w[at]]), *w[at + 1 :]]
            own.append(r.choice(("", "  ", "")) + r.choice((" ", "  ", "\t")).join(w).replace("w1", "W1") if edit != 4 else "")
        rows.append((d, "\n".join(own)))
    rows += [(50, None), (51, ""), (52, "\n\n"), (53, "a\r\na\n b"), (54, " ".join(f"q{k}" for k in range(70_000)))]
    got = line_dedup.dedup_lines(docs_of(spark, rows, "n_lines long, n_removed int, line string, first string"), near_words=8).collect()
    want = brute.clean_lines(dict(rows), 8)
    assert {x.doc_id: (x.text, x.n_lines, x.n_removed) for x in got} == want
    assert sum(x.n_removed for x in got) > 30 and got[0].line == "x"


def test_line_dedup_edges(spark):
    assert line_dedup.dedup_lines(docs_of(spark, [])).count() == 0
    rows = [(3, "same line"), (3, "same line"), (None, "same line\nother"), (None, "same line\nother"), (4, "SAME  line\n\nmore")]
    got = sorted((x.doc_id or 99, x.text) for x in line_dedup.dedup_lines(docs_of(spark, rows)).collect())
    assert got == [(3, "same line"), (3, "same line"), (4, "\nmore"), (99, "other"), (99, "other")]


def test_within_one_edit_equals_the_full_table():
    r = random.Random(9)
    for _ in range(3000):
        a, b = ([r.choice("abc") for _ in range(r.randrange(6))] for _ in range(2))
        assert line_dedup.within_one_edit(a, b) == brute.one_edit(a, b)


def test_passages_are_found_inside_other_text(spark):
    r = random.Random(8)
    passages = [prose(r, n, 10**6) for n in (60, 75, 90, 130, 200)]
    rows, holders = [], {}
    for d in range(60):
        text = prose(r, 120, 10**6)
        for p in r.sample(range(5), d % 3):
            at = r.randrange(len(text))
            text[at:at] = passages[p]
            holders.setdefault(d, set()).add(p)
        rows.append((d, " ".join(text[:50]) + "\n" + " ".join(text[50:])))
    rows += [(100, " ".join((w := prose(r, 40, 10**6)) + w)), (101, None), (102, ""), (None, rows[1][1]), (103, " ".join(["so"] * 200)), (104, " ".join(["so"] * 120))]
    docs = docs_of(spark, rows, "doc long, at int, para string, start string")
    spans = substring.repeated_passages(docs)
    got = {}
    for x in spans.collect():
        got.setdefault(x.doc_id, []).append((x.start, x.end, x.kept_in))
    firsts = {p: min(d for d, ps in holders.items() if p in ps) for p in range(5)}
    repeated = {d for d, ps in holders.items() if any(firsts[p] != d for p in ps)}
    assert set(got) == repeated | {104}
    text = dict(rows[:60])
    for d in repeated:  # what is removed does stand in the document that keeps it
        for a, b, kept in got[d]:
            assert any(tuple(brute.words(text[d])[k : k + substring.SIZE]) in brute.shingles(text[kept], substring.SIZE) for k in range(a, b - substring.SIZE + 1))
    cut = {x.doc_id: x.text for x in substring.remove_passages(docs.where("doc_id is not null"), spans).collect()}
    assert all((cut[d] == text[d]) == (d not in got) for d in text) and cut[101] is None
    assert all(len(brute.words(cut[d])) == len(brute.words(text[d])) - sum(b - a for a, b, _ in got[d]) for d in repeated)


def test_near_passages_are_linked(spark):
    r = random.Random(2)
    base = prose(r, 400, 10**6)
    rows = [(k, " ".join(edited(r, base, 0.01))) for k in range(12)]
    assert {x.doc_id for x in substring.repeated_passages(docs_of(spark, rows)).collect()} == set(range(1, 12))
    assert substring.repeated_passages(docs_of(spark, [])).count() == 0


def test_bands_reach_the_recall():
    for similarity in (0.6, 0.8, 0.9):
        b = substring.bands_for(similarity, 0.98)
        assert 1 - (1 - similarity**substring.ROWS) ** b >= 0.98 > 1 - (1 - similarity**substring.ROWS) ** (b - 1)
