"""Operator 3: few labels beside many documents."""

import random

import numpy as np
import pyarrow as pa
import pytest
from test_texts import docs_of, web

from newslens.llm import quality


def test_positives_are_sampled_from_the_labels(spark):
    r = random.Random(12)
    truth = {i: r.random() < 0.6 for i in range(8000)}
    docs = docs_of(spark, [(i, web(r, g)) for i, g in truth.items()])
    positives = [i for i, g in truth.items() if g][::40]
    labels = spark.createDataFrame([(i, 1) for i in positives], "doc_id long, quality int")
    net = quality.train(docs, labels, sample_rows=100)
    assert net is not None and 100 <= len(positives) < 160
    scores = net.score(quality.features(pa.array([web(r, k < 40) for k in range(80)])))
    assert np.mean(scores[:40]) > np.mean(scores[40:]) + 0.2
    with pytest.warns(UserWarning, match="3 positives"):
        assert quality.train(docs, labels.where(labels.doc_id.isin(positives[:3]))) is None


@pytest.mark.parametrize("every", [1, 2])
def test_rows_with_any_label_still_are_the_unlabelled_side(spark, every):
    """With all documents labelled, those not trusted (label 0, or held out) are what the positives stand against."""
    r = random.Random(4)
    truth = {i: r.random() < 0.6 for i in range(2400)}
    docs = docs_of(spark, [(i, web(r, g)) for i, g in truth.items()])
    labels = spark.createDataFrame([(i, int(g)) for i, g in truth.items() if i % every == 0], "doc_id long, quality int")
    net = quality.train(docs, labels, learnable=~quality.held_out("id"))
    assert net is not None
    got = quality.with_score(docs, net).where(quality.held_out("doc_id")).collect()
    good, bad = ([x.quality_score for x in got if truth[x.doc_id] == side] for side in (True, False))
    assert np.mean([g > b for g in good for b in bad]) > 0.99
    if every == 1:  # with half the positives the prior comes out low, and the scores with it
        assert np.mean([s >= 0.7 for s in good]) > 0.95 and np.mean([s < 0.7 for s in bad]) > 0.95
    # what a label of 0 says is not used
    zeros = labels.where("quality = 1").unionByName(labels.where("quality = 0 and doc_id % 3 = 0"))
    again = quality.train(docs, zeros, learnable=~quality.held_out("id"))
    assert all((again.w[k] == net.w[k]).all() for k in net.w)
