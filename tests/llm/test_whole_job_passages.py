"""Operator 8 beyond its broadcasts: the same spans, and only rows that may be repeats are shuffled a second time."""

import random

from newslens.llm import substring


def test_spans_are_the_same_with_and_without_broadcasts(spark, monkeypatch):
    r = random.Random(8)
    words = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    passages = [words(60) for _ in range(6)]
    rows = [(i, f"{words(30)}\n{passages[i % 6]}\n{words(30)} {passages[i % 5]} {words(9)}") for i in range(40)]
    rows += [(3, f"{words(30)}\n{passages[0]}"), (4, rows[4][1]), (50, None), (51, ""), (None, passages[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lambda: sorted(map(tuple, substring.repeated_passages(docs).collect()))
    want, joined = got(), []
    among = substring.among

    def told(held, asked, scratch):
        out = among(held, asked, scratch)
        left, all_ = out.count(), held.count()
        joined.append((left, all_, held.join(asked, "para").count()))
        return out

    monkeypatch.setattr(substring, "among", told)
    monkeypatch.setattr(substring, "KEEPER_MOST", 0)
    monkeypatch.setattr(substring, "TORN_MOST", 0)
    assert len(want) > 60 and got() == want
    (left, all_, met), = joined
    assert met <= left < all_ and left <= met + 3
