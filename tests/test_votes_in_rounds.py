"""Votes are counted where documents stand: neither pairs nor postings are shuffled, and no pair is lost or counted twice."""

from newslens.operators import similarity as SIM
from newslens.plans import reports as RP
from newslens.plans.queries import QUERIES


def test_rounds_give_the_votes_of_listed_pairs(spark):
    rows = [(i, f"common a{i % 4} a{i % 4} b{i % 7} own{i} " + "many " * (i % 3)) for i in range(50)]
    rows += [(None, "common a1"), (60, None), (61, ""), (7, "common twice")]
    arts = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r.doc_id: r.votes for r in SIM.votes(RP.similarity_pairs(arts, (), 3)).collect()}
    assert want
    for group_docs, group_terms in ((2000, 500_000), (15, 500_000), (2000, 120)):
        tk = SIM.term_table(arts, (), 3, part_docs=9)
        assert {r.doc_id: r.votes for r in SIM.count_votes(tk, group_docs=group_docs, group_terms=group_terms).collect()} == want
    assert {r.doc_id: r.votes for r in RP.article_votes(arts, (), 3).collect()} == want
    assert RP.article_votes(arts.where("doc_id < 0"), (), 3).count() == 0


def test_rounds_take_repeated_ids_as_listed_pairs_do(spark):
    rows = [(1, "news", "grid power", 5), (1, "news", "grid power", 15), (2, "news", "grid plan", 10), (3, "news", "grid", 95)]
    arts = spark.createDataFrame(rows, "doc_id long, section string, text string, age long")
    tk = SIM.term_table(arts, (), 20, attrs=("section", "age"), part_docs=2)
    want = {r.doc_id: r.votes for r in SIM.votes(SIM.pair_similarity(tk)).collect()}
    assert want and {r.doc_id: r.votes for r in SIM.count_votes(tk, group_docs=2).collect()} == want


def test_vote_queries_make_no_cells(spark, monkeypatch):
    """Shuffled postings grew with the square of the corpus."""
    monkeypatch.setattr(SIM, "pair_similarity", None)
    for name in ("j3_votes", "r4_hot_board"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
