"""J3 by blocks: the sums of float32 decide no pair that integers would decide otherwise, and no round over all documents is left."""

import numpy as np

from newslens.operators import similarity as SIM
from newslens.plans import reports as RP
from newslens.session import release


def test_pairs_at_the_threshold_are_settled_in_integers(spark):
    # sim = 3·c / (3·√(c² + …)): counts so that some pairs stand at 0.6 exactly, others next to it
    rows = [(i, "a " * 3 + f"b{i} " * 4) for i in range(12)] + [(20 + i, "a " * 300 + f"c{i} " * (399 + i)) for i in range(4)]
    arts = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = RP.similarity_pairs(arts, (), 2)
    for threshold in (0.36, 0.6, 9 / 25):
        want = {r.doc_id: r.votes for r in SIM.votes(pairs, threshold).collect()}
        assert {r.doc_id: r.votes for r in RP.article_votes(arts, (), 2, threshold=threshold).collect()} == want
    assert len(set(want.values())) > 1


def test_frequent_and_rare_terms_of_uneven_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), " ".join(f"w{x}" for x in rng.zipf(1.3, int(rng.integers(1, 90))) % 400)) for i in rng.permutation(300)]
    arts = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r.doc_id: r.votes for r in SIM.votes(RP.similarity_pairs(arts, (), 4)).collect()}
    for docs, terms in ((300, 10**6), (41, 10**6), (300, 200)):
        tk = SIM.term_table(arts, (), 4, part_docs=100)
        assert {r.doc_id: r.votes for r in SIM.count_votes(tk, group_docs=docs, group_terms=terms).collect()} == want


def test_votes_keep_no_frame_and_shuffle_no_rounds(spark):
    release(spark)
    arts = spark.createDataFrame([(i, f"one w{i % 3} v{i}") for i in range(30)], "doc_id long, text string")
    met = SIM._meet(SIM.blocks_of(SIM.term_table(arts, (), 3, part_docs=5), 5))
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    blocks = SIM.blocks_of(SIM.term_table(arts, (), 3, part_docs=5), 5).count()
    assert met.count() == blocks * (blocks + 1) // 2
