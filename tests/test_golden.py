"""Expected values of the golden mini corpus (FIXTURES.md §2)."""

import pytest
from pyspark.sql import functions as F

from golden import NOW, STOP, articles
from newslens.operators import counts as C
from newslens.operators import similarity as SIM
from newslens.operators import text as TX
from newslens.plans import reports as RP


def _tf(spark):
    arts = articles(spark)
    return arts, TX.term_freq(TX.tokens(arts, "space", STOP))


def test_t5_document_frequencies(spark):
    arts, tf = _tf(spark)
    got = {r.term: r.df for r in TX.doc_freq(tf).collect()}
    assert got == {"power": 4, "grid": 4, "upgrade": 2, "cup": 2, "goal": 2, "plan": 1,
                   "final": 1, "bill": 1, "old": 1, "recap": 1}
    assert arts.count() == 6


T7 = {
    0: [("upgrade", 0.847298), ("power", 0.672944), ("grid", 0.336472)],
    1: [("plan", 2.505526), ("grid", 0.336472), ("power", 0.336472)],
    2: [("goal", 2.541894), ("final", 1.252763), ("cup", 0.847298)],
    3: [("bill", 1.252763), ("grid", 0.336472), ("power", 0.336472)],
    4: [("old", 1.252763), ("upgrade", 0.847298), ("grid", 0.336472), ("power", 0.336472)],
    5: [("recap", 1.252763), ("cup", 0.847298), ("goal", 0.847298)],
}


def test_t7_keywords(spark):
    kw = TX.article_keywords(articles(spark), STOP, 20, "space")
    got = {}
    for r in kw.orderBy("doc_id", "rank").collect():
        got.setdefault(r.doc_id, []).append((r.term, round(r.tfidf, 6)))
    assert got == T7


def test_t9_block_keywords(spark):
    bk = TX.block_keywords(articles(spark), STOP, last_n=2, mode="space")
    got = [(r.term, round(r.tfidf, 6)) for r in bk.orderBy("rank").collect()]
    assert got == [("old", 1.098612), ("recap", 1.098612), ("cup", 0.693147), ("goal", 0.693147),
                   ("upgrade", 0.693147), ("grid", 0.182322), ("power", 0.182322)]


def test_t9_block_covering_everything_gives_zero_weights(spark):
    bk = TX.block_keywords(articles(spark), STOP, last_n=6, mode="space").collect()
    assert bk and all(r.tfidf == 0.0 for r in bk)
    assert [r.term for r in bk] == sorted(r.term for r in bk)


J1 = {
    20: {(0, 1): 0.5, (0, 3): 0.707107, (0, 4): 0.816497, (1, 3): 0.471405, (1, 4): 0.408248,
         (2, 5): 0.696311, (3, 4): 0.57735},
    2: {(0, 1): 0.5, (0, 3): 0.707107, (0, 4): 0.774597, (1, 3): 0.316228, (1, 4): 0.258199,
        (2, 5): 0.696311, (3, 4): 0.408248},
    1: {(0, 4): 0.707107, (2, 5): 0.707107},
}


@pytest.mark.parametrize("k", [20, 2, 1])
@pytest.mark.parametrize("salt_rows", [SIM.SALT_ROWS, 1])
def test_j1_similarity(spark, k, salt_rows):
    tk = SIM.term_table(articles(spark), STOP, k, "space")
    pairs = SIM.pair_similarity(tk, salt_rows=salt_rows)
    got = {(r.lo, r.hi): round(r.sim, 6) for r in pairs.collect()}
    assert got == J1[k]


def test_j3_r1_r2_hotness(spark):
    arts = articles(spark)
    pairs = RP.similarity_pairs(arts, STOP, 20, NOW, "space")
    hot = RP.hotness_scores(arts, pairs, NOW)
    got = {r.doc_id: (r.age, r.votes, round(r.raw, 9), round(r.hotness, 6)) for r in hot.collect()}
    assert got == {
        0: (840, 3, 0.058897668, 100.0),
        1: (720, 3, 0.054271016, 92.144591),
        2: (210, 1, 0.0, 0.0),
        3: (720, 3, 0.013850416, 23.516068),
        4: (5205, 3, 0.007525192, 12.776723),
        5: (60, 1, 0.0, 0.0),
    }


def test_j2_related_titles(spark):
    arts = articles(spark)
    pairs = RP.similarity_pairs(arts, STOP, 20, NOW, "space")
    rel = RP.related_articles(arts, pairs)
    got = {}
    for r in rel.orderBy("doc_id", "rank").collect():
        got.setdefault(r.doc_id, []).append(r.title)
    assert got == {0: ["Grid upgrade plan"], 1: ["Grid upgrade"], 2: ["Cup recap"], 5: ["Cup final"]}


def test_y5_report_rows(spark):
    rep = RP.hot_news_report(articles(spark), STOP, 20, 10, NOW, "space")
    rows = {r.doc_id: r for r in rep.collect()}
    assert len(rows) == 6
    assert rows[0].keyword == ["upgrade", "power", "grid"]
    assert rows[0].samenews == ["Grid upgrade plan"]
    assert rows[3].samenews == [] and rows[4].samenews == []
    assert rows[0].attention == 100.0 and rows[5].attention == 0.0


def test_a3_sources(spark):
    got = [(r.source, r.n) for r in C.count_by_source(articles(spark)).collect()]
    assert got == [("S2", 1), ("S3", 1), ("undefined", 1), ("S1", 3)]


def test_a4_hour_grid(spark):
    grid = C.hour_grid(articles(spark), ["2020-11-25", "2020-11-28"]).collect()
    assert len(grid) == 48
    nonzero = {(r.day[5:], r.hour): r.n for r in grid if r.n}
    assert nonzero == {("11-25", 9): 1, ("11-28", 10): 1, ("11-28", 12): 2,
                       ("11-28", 20): 1, ("11-28", 23): 1}
    labels = {r.hour: r.hour_label for r in grid}
    assert labels[0] == "0:00-1:00" and labels[23] == "23:00-24:00"


def test_word_counts_sum_to_tokens(spark):
    lines = spark.createDataFrame([("x y x",), ("x  7",)], "value string")
    wc = {r.word: r.n for r in C.word_count(lines).collect()}
    assert wc == {"x": 3, "y": 1, "": 1, "7": 1}
    top = [(r.word, r.n) for r in C.top_words(C.word_count(lines)).orderBy("rank").collect()]
    assert top == [("x", 3), ("y", 1)]
    total = lines.select(F.size(F.split("value", " ", -1)).alias("k")).agg(F.sum("k")).first()[0]
    assert sum(wc.values()) == total


def test_j2_blocked_pairs_give_same_titles(spark):
    arts = articles(spark)
    full = RP.related_articles(arts, RP.similarity_pairs(arts, STOP, 20, NOW, "space"))
    blocked = RP.related_articles(arts, RP.related_pairs(arts, STOP, 20, NOW, "space"))
    key = lambda df: sorted((r.doc_id, r.rank, r.title, round(r.sim, 9)) for r in df.collect())
    assert key(full) == key(blocked)
