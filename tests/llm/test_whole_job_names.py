"""Operator 5: names that open a sentence, several capitals, values glued to units."""

import random
from itertools import product

import brute

from newslens.llm import decontaminate

UNITS = set(decontaminate.UNITS)


def leaks(spark, docs, items, **options):
    frame = lambda rows, name: spark.createDataFrame(list(rows.items()), f"{name} long, text string")
    rows = decontaminate.contaminated(frame(docs, "doc_id"), frame(items, "item_id"), **options).collect()
    return {(x.doc_id, x.item_id) for x in rows}


def test_opening_names_and_glued_units_are_slots(spark):
    items = {
        1: "Alice has 3 apples. Alice buys 5 more. How many apples does Alice have?",
        2: "A car drives 5km to the town and then 7km back over the hill. How far did it go?",
        3: "Long ago McDonald sold 3 tractors to the farm while IBM bought 9 of them there.",
        4: "THE CATS SAT ON THE MATS AND SLEPT WELL",
    }
    docs = {
        1: "Bob has 4 apples. Bob buys 9 more. How many apples does Bob have?",
        2: "A car drives 6km to the town and then 9km back over the hill. How far did it go?",
        3: "A car drives 6 km to the town and then 9 km back over the hill. How far did it go?",
        4: "Long ago DeVito sold 8 tractors to the farm while NASA bought 2 of them there.",
        5: "ALL DOGS RAN TO THE PARKS THEN WENT HOME",
        6: "Alice has 3 pears. Dan sells 5 less. Where are the plums that Alice had?",
        7: "alice has 3 apples",
    }
    for most in (decontaminate.BROADCAST_WINDOWS, 0):
        assert leaks(spark, docs, items, broadcast_windows=most) == {(1, 1), (2, 2), (3, 2), (4, 3)}


def test_common_opening_words_are_no_names(spark):
    items = {1: "Some trains stop here at 5 every day.", 2: "There are some trains that stop here."}
    docs = {1: "Many trains stop here at 7 every day.", 2: "Some trains stop here at 7 every day."}
    assert leaks(spark, docs, items) == {(2, 1)}


def test_readings_equal_brute_force(spark):
    r = random.Random(11)
    stems = ("apple", "river", "stone", "cloud", "green", "walks")
    text = lambda names, n: " ".join(f"{r.choice(names)} {' '.join(r.choice(stems) for _ in range(4))} {r.randrange(90)} {r.choice(stems)}." for _ in range(n))
    items = {k: text(("Alice", "Boris"), 1 + k % 3) for k in range(12)}
    docs = {}
    for d in range(60):
        leaked = items[r.randrange(12)].replace("Alice", r.choice(("Carol", "Alice"))).replace("Boris", r.choice(("Dora", "boris")))
        docs[d] = " ".join((text(("Eve", "Apple"), 2), leaked if d % 2 else text(("Alice", "Boris"), 1), text(("Eve",), 1)))

    def windows(t):
        """The windows of a text: for each, the set of its readings."""
        upper = [w[0].isupper() for w in t.split()]
        tokens = [x[0] for x in brute.template(t, UNITS)]
        own = [(x, "<name>") if u and not x.startswith("<") else (x,) for x, u in zip(tokens, upper, strict=True)]
        return {tuple(w) for i in range(len(own) - 4) for w in [own[i : i + 5]]}

    read = lambda t: {r for w in windows(t) for r in product(*w)}
    want = set()
    for d, t in docs.items():
        theirs = read(t)
        for i, y in items.items():
            own = windows(y)
            if sum(any(x in theirs for x in product(*w)) for w in own) >= 0.8 * len(own):
                want.add((d, i))
    got = leaks(spark, docs, items)
    assert got <= want and len(got) >= 20
    assert got == leaks(spark, docs, items, broadcast_windows=0)
    consistent = {(d, i) for d, i in want if d % 2}
    assert consistent <= got
