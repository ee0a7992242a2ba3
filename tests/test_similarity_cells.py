"""Pairs are added up inside their cell and never shuffled; cells lose and repeat no pair."""

from newslens.operators import similarity as SIM


def test_pairs_stay_in_the_task_of_their_cell(spark):
    rows = [(i, f"common a{i % 4} a{i % 4} b{i % 7} own{i} " + "many " * (i % 3)) for i in range(50)]
    tk = SIM.term_table(spark.createDataFrame(rows, "doc_id long, text string"), (), 3)
    c, kw = {}, {}
    for r in tk.collect():
        c.setdefault(r.doc_id, {})[r.term] = r.tf
        kw.setdefault(r.doc_id, set()).update([r.term] if r.is_kw else [])
    want = {}
    for a in range(50):
        for b in range(a + 1, 50):
            v = kw[a] | kw[b]
            dot, na, nb = (sum(x.get(w, 0) * y.get(w, 0) for w in v) for x, y in ((c[a], c[b]), (c[a], c[a]), (c[b], c[b])))
            if dot:
                want[a, b] = (dot, na, nb)
    for salt_rows in (7, 1000):
        pairs = SIM.pair_similarity(tk, salt_rows=salt_rows)
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        # the last exchange is that of the cells
        assert "hashpartitioning(cell" in plan and "hashpartitioning(lo" not in plan
        got = pairs.collect()
        assert len(got) == len(want) and {(r.lo, r.hi): (r.dot, r.norm_lo, r.norm_hi) for r in got} == want


def test_an_id_with_two_ages_gives_one_row_a_pair(spark):
    rows = [(1, "news", "grid power", 5), (1, "news", "grid power", 15), (2, "news", "grid plan", 10), (3, "news", "grid", 95)]
    arts = spark.createDataFrame(rows, "doc_id long, section string, text string, age long")
    tk = SIM.term_table(arts, (), 20, attrs=("section", "age"))
    plain = {(r.lo, r.hi): (r.dot, r.norm_lo, r.norm_hi) for r in SIM.pair_similarity(tk).collect()}
    near = SIM.pair_similarity(tk, block=("section",), near=("age", 10)).collect()
    assert [(r.lo, r.hi) for r in near] == [(1, 2)]
    assert (near[0].dot, near[0].norm_lo, near[0].norm_hi) == plain[1, 2]
