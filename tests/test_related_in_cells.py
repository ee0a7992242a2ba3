"""Y3 in cells: no pair is listed, and each document has the titles that listed pairs give."""

import numpy as np

from newslens.operators import similarity as SIM
from newslens.plans import reports as RP
from newslens.plans.queries import QUERIES


def articles(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, title string, section string, age long, text string")


def both_ways(spark, rows, **sizes):
    arts = articles(spark, rows)
    tk = SIM.term_table(arts, (), 3, attrs=("section", "age"), part_docs=20)
    titles = arts.select("doc_id", "title")
    pairs = SIM.pair_similarity(tk, same=("section",), carry=("age",), block=("section",), near=("age", 50))
    want = {tuple(r) for r in SIM.related(pairs, titles, 4, 50).collect()}
    return want, {tuple(r) for r in SIM.related_in_cells(tk, titles, 4, 50, **sizes).collect()}


def test_best_titles_over_blocks_with_copies_and_ties(spark):
    rng = np.random.default_rng(5)
    rows = [(i - 40, f"t{i % 23}" if i % 19 else None, "ab"[i % 5 // 4], int(rng.integers(0, 200)), " ".join(f"w{x}" for x in rng.zipf(1.4, 12) % 40)) for i in range(120)]
    rows += [(300 + i, f"copy{i % 7}", "a", 60 + i, "same words here") for i in range(20)] + [(500, "no section", None, 5, "w1 w2"), (501, "no age", "a", None, "w1 w2")]
    for sizes in ({}, {"block_docs": 7}, {"block_terms": 30}):
        want, got = both_ways(spark, rows, **sizes)
        assert want and got == want


def test_an_id_with_two_places_or_titles_is_listed(spark):
    rows = [(1, "a", "s", 5, "grid power"), (1, "a", "s", 95, "grid power"), (2, "b", "s", 10, "grid plan"), (3, "c", "s", 99, "grid plan power")]
    want, got = both_ways(spark, rows)
    assert want and got == want
    want, got = both_ways(spark, [rows[0], (1, "z", "s", 5, "grid power"), *rows[2:]])
    assert want and got == want


def test_related_queries_list_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(SIM, "pair_similarity", None)
    for name in ("y3_related_articles", "y5_hot_news_report"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert RP.related_titles
