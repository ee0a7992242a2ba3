"""T1 with a dictionary, against all paths through the lattice and a plain dynamic programme."""

import itertools
import math
import random

from newslens.operators import segmentation as SG
from newslens.operators import text as TX

LETTERS = "中文汉字测"


def weight_of(dictionary, longest):
    known = {t: n for t, n in dictionary.items() if 0 < len(t) <= longest and n > 0}
    total = sum(known.values()) or 1
    # whole millionths, halves away from zero
    weigh = lambda n: -math.floor(-math.log(n / total) * 1_000_000 + 0.5)
    return {t: weigh(n) for t, n in known.items()}, weigh(1)


def every_path(run, weights, once, longest):
    """The best of all ways to cut the run; at equal sums the longer word at the first place where two ways differ."""
    best = None
    for cuts in itertools.product((0, 1), repeat=len(run) - 1):
        ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(run)]
        words = [run[a:b] for a, b in zip([0, *ends], ends)]
        if all(w in weights or len(w) == 1 for w in words) and max(map(len, words)) <= longest:
            key = (sum(weights.get(w, once) for w in words), [len(w) for w in words])
            if best is None or key > best[0]:
                best = (key, words)
    return best[1]


def programme(run, weights, once, longest):
    best = [(0, 0)] * (len(run) + 1)
    for i in range(len(run) - 1, -1, -1):
        best[i] = max((weights.get(run[i:i + n], once) + best[i + n][0], n) for n in range(1, min(longest, len(run) - i) + 1)
                      if run[i:i + n] in weights or n == 1)
    words, i = [], 0
    while i < len(run):
        words.append(run[i:i + best[i][1]])
        i += best[i][1]
    return words


def test_runs_are_cut_along_the_best_of_all_paths(spark):
    r = random.Random(7)
    runs = ["".join(r.choice(LETTERS) for _ in range(r.randint(1, 9))) for _ in range(300)]
    # counts of few values, so that many sums are equal
    dictionary = {"".join(r.choice(LETTERS) for _ in range(r.randint(1, 5))): r.choice([1, 2, 4, 8]) for _ in range(120)}
    dictionary |= {"": 5, "无用": 0}
    for longest in (3, SG.MAX_WORD):
        weights, once = weight_of(dictionary, longest)
        rows = spark.createDataFrame([(x,) for x in runs], "run string")
        known = spark.createDataFrame(list(dictionary.items()), "term string, n long")
        got = {x.run: x.words for x in SG.segment_runs(rows, known, longest).collect()}
        assert got == {x: every_path(x, weights, once, longest) for x in runs}


def test_a_long_run_is_one_programme(spark):
    r = random.Random(3)
    run = "".join(r.choice(LETTERS) for _ in range(10_000))
    dictionary = {run[i:i + n]: r.randint(1, 50) for n in (1, 2, 3, 5, 8) for i in r.sample(range(9_900), 60)}
    weights, once = weight_of(dictionary, SG.MAX_WORD)
    known = spark.createDataFrame(list(dictionary.items()), "term string, n long")
    got = SG.segment_runs(spark.createDataFrame([(run,), (run,)], "run string"), known).collect()
    assert [x.words for x in got] == [programme(run, weights, once, SG.MAX_WORD)]


def test_words_of_mixed_text(spark):
    rows = [(1, "我们在北京大学 Learn北京2024"), (2, ""), (3, None), (4, "大"), (5, "abc, DEF")]
    arts = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([("北京", 20), ("大学", 20), ("北京大学", 9), ("我们", 30), ("在", 90)], "term string, n long")
    got = {}
    for x in SG.dictionary_tokens(arts, known).orderBy("doc_id", "pos").collect():
        got.setdefault(x.doc_id, []).append(x.term)
    assert got == {1: ["我们", "在", "北京大学", "learn", "北京", "2024"], 4: ["大"], 5: ["abc", "def"]}
    # as a mode of the tokenizer, with a stop list
    toks = TX.tokens(arts, mode="dictionary", stopwords=["在"], dictionary=known)
    assert sorted(x.term for x in toks.where("doc_id = 1").collect()) == sorted(["我们", "北京大学", "learn", "北京", "2024"])
    # without any word, every character stands alone
    none = SG.dictionary_tokens(arts.where("doc_id = 1"), known.where("false"))
    assert [x.term for x in none.orderBy("pos").collect()] == ["我", "们", "在", "北", "京", "大", "学", "learn", "北", "京", "2024"]


def test_a_dictionary_is_counted(spark):
    texts = spark.createDataFrame([("中文 中文字 x",), ("中",)], "text string")
    grams = SG.count_dictionary(SG.han_ngrams(texts, longest=2), least=2)
    assert {x.term: x.n for x in grams.collect()} == {"中": 3, "文": 2, "中文": 2}


def test_the_lattice_is_built_where_the_run_is(spark):
    runs = spark.createDataFrame([("中文",)], "run string")
    known = spark.createDataFrame([("中文", 3)], "term string, n long")
    plan = SG.segment_runs(runs, known)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(run") == 1 and "BroadcastHashJoin" in plan and "EvalPython" not in plan
