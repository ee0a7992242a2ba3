"""Operators 11 to 13 against brute force, the library and round trips, with their edge cases."""

import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from newslens.llm import divergence, filter_audit, token_files

SCHEMA = "doc_id long, text string, lang string, source string, part string, rank int, value long, term string"
EXTRA = ("x", 1, 2, "y")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
WORDS = ["of", "The", "Straße", "naïve", "x1y", "中文", "END", "a-b", "don't"]


def table(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


def some_rows(n, seed=3):
    r = np.random.default_rng(seed)
    rows = [(i, " ".join(r.choice(WORDS, int(r.integers(0, 30)))), str(r.choice(["en", "de"])), f"s{int(r.integers(0, 6)) ** 2 % 5}") for i in range(n)]
    rows += [(None, None, None, None), (7, "The of of", None, "s0"), (7, "The of of", None, "s0"), (n, "", "fr", "é"), (n + 1, "!!! 12", "fr", "z"), (n + 2, "word " * 40_000, "en", "s1")]
    return rows


# --- 11 ----------------------------------------------------------------------------------
def brute_divergences(rows, least, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = [t.translate(lower) for t in TERM.findall(text or "")]
        groups[lang].add(source)
        df[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = set()
    for lang, sources in groups.items():
        kept = {t for t, n in df[lang].items() if n >= least}
        own = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        whole = {t: sum(own[s][t] for s in sources) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (k + 5) // (sum(c.values()) + 5 * len(kept)) for t, k in c.items()}  # noqa: B023, E731
        p, q = {s: share(c) for s, c in own.items()}, share(whole)
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources - {s}]
            terms = [(t, p[s][t] - q[t]) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out |= {(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)}
    return out


@pytest.mark.parametrize("sizes", [{}, {"block_terms": 1, "tile": 2, "spill_cells": 5}])
def test_divergences_equal_brute_force(spark, sizes):
    rows = some_rows(300)
    found = divergence.divergences(table(spark, rows).repartition(7), least_docs=4, top=3, **sizes)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = found.collect()
    assert {tuple(r) for r in got} == brute_divergences(rows, 4, 3)
    assert len(got) == len({tuple(r) for r in got})


def test_divergences_without_kept_terms_and_without_rows(spark):
    rows = [(1, "one", "en", "a"), (2, None, "en", "b"), (3, "x", "de", None)]
    assert {tuple(r) for r in divergence.divergences(table(spark, rows)).collect()} == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}
    assert divergence.divergences(table(spark, [])).count() == 0


def test_shares_are_exact_for_large_counts():
    n, v = 8 * 10**15, 10**6
    counts = [0, 1, 3 * 10**15 + 7, n]
    assert divergence.smoothed(np.array(counts), n, v).tolist() == [1 + 10**9 * (c + 5) // (n + 5 * v) for c in counts]


def test_a_frequent_term_is_one_row_per_spill(spark):
    docs = spark.range(5000, numPartitions=8).selectExpr("id doc_id", "'the the end' text", "'en' lang", "concat('s', id % 4) source")
    assert divergence.folded(docs).where("term = 'the'").count() == 8
    assert {(r.term, r.df, sum(r.counts)) for r in divergence.merged(divergence.folded(docs)).collect()} == {("the", 5000, 10000), ("end", 5000, 5000), ("", 5000, 5000)}


# --- 12 ----------------------------------------------------------------------------------
def brute_audit(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    docs = defaultdict(list)
    for i, text, _, source in rows:
        x = text or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", x) if w]
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in x) > 5 * len(x),
            "D": any(c in x for c in "#$%&*|"), "E": any(j is not None and i is not None and j < i and (y or "") == x for j, y, *_ in rows),
        }
        docs[source or ""].append(({f for f in fails if fails[f]}, i in good, i in toxic))
    out = []
    for part, own in docs.items():
        steps = []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for k, f in enumerate(order, 1):
                gone, left = [d for d in left if f in d[0]], [d for d in left if f not in d[0]]
                steps.append([part, order, k, len(left), len(gone), sum(f in d[0] for d in own) - len(gone), sum(d[0] == {f} for d in own), sum(d[1] for d in gone), sum(d[2] for d in gone)])
        total = Counter()
        for s in steps:
            total[s[1][s[2] - 1]] += s[4]
        out += [(*s, total[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


def audit_rows(n):
    r = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(n):
        text = " ".join(r.choice(vocabulary[: int(r.choice([20, 90]))], int(r.integers(30, 80)), replace=True))
        text = text.upper() if r.random() < 0.2 else text
        rows.append((i, text + "#" * int(r.random() < 0.3), "en", f"s{i % 3}"))
    rows += [(n + i, rows[i % 4][1], "en", f"s{i % 2}") for i in range(40)]  # copies
    rows += [(None, rows[0][1], "en", None), (None, None, None, None), (3, rows[3][1], "en", "s0"), (3, rows[3][1], "en", "s0"), (900, "", "x", "s9"), (901, None, "x", "s9"), (902, "é " * 60_000, "x", "s9"), (-5, rows[9][1], "x", "s1")]
    return rows


def test_filter_audit_equals_brute_force(spark):
    rows = audit_rows(80)
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 120, 2)] + [(4, 1, 1), (6, None, None), (None, 1, 1), (5000, 1, 1)]
    said = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, part string")
    found = filter_audit.audit_filters(table(spark, rows).repartition(5), said)
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, found.collect())) == brute_audit(rows, [x for x in labels if x[0] is not None])
    assert filter_audit.audit_filters(table(spark, []), said).count() == 0
    assert filter_audit.audit_filters(table(spark, rows), said.where("false")).agg({"good_lost": "sum"}).first()[0] == 0


@pytest.mark.parametrize("n", range(1, 7))
def test_swaps_visit_every_order_once(n):
    names = "ABCDEF"[:n]
    r = np.random.default_rng(n)
    counts = {m: tuple(int(x) for x in r.integers(0, 4, 3)) for m in range(1 << n) if r.random() < 0.7}
    diagram, seen = filter_audit.Diagram(names, counts), []
    whole = diagram.weight[diagram.root]

    def look():
        seen.append("".join(diagram.order))
        mask, left = 0, whole
        for name, kept, removed in diagram.steps():
            mask |= 1 << names.index(name)
            assert kept == tuple(sum(c[k] for m, c in counts.items() if not m & mask) for k in range(3))
            assert tuple(a + b for a, b in zip(kept, removed, strict=True)) == left
            left = kept

    look()
    for level in filter_audit.adjacent_swaps(n):
        diagram.swap(level)
        look()
    assert sorted(seen) == sorted(map("".join, itertools.permutations(names)))


def test_copies_fold_before_they_are_shuffled(spark):
    docs = spark.range(20_000, numPartitions=4).selectExpr("id doc_id", "'one text' text", "'s' source")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["mask"]: r["n"] for r in filter_audit.failure_counts(docs, none).collect()}
    assert got == {1: 1, 17: 19_999}


# --- 13 ----------------------------------------------------------------------------------
MODEL = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "Don't STOP it's we'LL <|endoftext|> <|ENDOFTEXT|>a<|startoftext|>", "é É́x K İi ΣΑΣ ß ﬁ", "a b c\u0085d\x1ce\x00f", "12ab34!?x_y 0x1F ...''' 's 'S",
    "日本語テキスト 한국어 😀😀 👩‍👩‍👧 नमस्ते", "word " * 30_000 + "end", "x" * 50_000, "Mixed\tCASE\nlines\r\nand\x0b\x0cmore",
]


def expected(rows):
    """(id, n_tokens, crc) by the library, in order of the ids."""
    library = Tokenizer.from_file(MODEL)
    out = []
    for i, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((i, len(ids), zlib.crc32(ids.tobytes()), ids.tolist()))
    return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


@pytest.mark.parametrize("sizes", [{}, {"file_tokens": 500, "segment_tokens": 60}])
def test_files_hold_the_librarys_ids(spark, sizes):
    texts = ODD + [" ".join(np.random.default_rng(k).choice(WORDS, 40)) for k in range(60)]
    rows = [(3 * i % 71, t) for i, t in enumerate(texts)] + [(None, "no id"), (None, None)] + [(5, "same")] * 90
    docs = table(spark, [(i, t, None, None) for i, t in rows]).repartition(6)
    got = sorted(token_files.round_trip(docs, MODEL, with_ids=True, **sizes).collect(), key=lambda r: r.start)
    want = expected(rows)
    assert [r.doc_id for r in got] == [w[0] for w in want]
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32, tuple(r.ids)) for r in got) == Counter((i, n, c, tuple(x)) for i, n, c, x in want)


def test_chunks_encode_like_the_library_on_random_text():
    r = np.random.default_rng(8)
    signs = list("aZ0 '<|>_-.\n\t#é́中😀 ‍Kİß")
    texts = ["".join(r.choice(signs, int(r.integers(0, 40)))) for _ in range(4000)]
    encoder, library = token_files.Encoder(MODEL, 1), Tokenizer.from_file(MODEL)
    ids, sizes = encoder.encode(pa.array(texts))
    ends = np.cumsum(sizes)
    for text, a, b in zip(texts, ends - sizes, ends, strict=True):
        assert ids[a:b].tolist() == [*library.encode(text, add_special_tokens=False).ids, 1], text


def test_codes_round_trip():
    r = np.random.default_rng(2)
    sizes = np.array([0, 1, 4, 5, 0, 300, 3])
    ranks = (r.integers(0, 1 << 32, sizes.sum(), dtype=np.uint64) >> r.integers(0, 32, sizes.sum(), dtype=np.uint64)).astype(np.uint32)
    control, data, n_control, n_data = token_files.encode_ranks(ranks, sizes)
    assert n_control.tolist() == [0, 1, 1, 2, 0, 75, 1] and n_data.sum() == len(data)
    assert (token_files.decode_ranks(control, data, sizes) == ranks).all()
    raw = token_files.segment_bytes(np.arange(7), np.ones(7, bool), sizes, control.tobytes(), data.tobytes())
    assert (token_files.parse_segment(raw)[3] == ranks).all()
    with pytest.raises(ValueError):
        token_files.parse_segment(raw[:-1] + bytes([raw[-1] ^ 1]))


def test_frequent_ids_take_one_byte_and_no_rows_no_files(spark, scratch):
    docs = spark.range(400).selectExpr("id doc_id", "concat('the end of ', id) text")
    counts = {r["id"]: r["n"] for r in token_files.id_counts(token_files.encoded(docs, MODEL, 1)).collect()}
    assert counts[1] == 400 and max(counts.values()) >= 400
    assert token_files.round_trip(docs.where("false"), MODEL).count() == 0
