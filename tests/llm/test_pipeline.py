"""The corpus pipeline against a brute-force version, and the registered queries."""

import brute
import public_tokenizers
import pyarrow as pa
import sentencepiece

import corpus_pipeline
from newslens.llm import decontaminate, line_dedup, quality
from newslens.llm.queries import ORACLE, QUERIES


def test_pipeline_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/documents.parquet").collect()
    labels = spark.read.parquet(f"{d}/labels.parquet")
    net = quality.train(spark.read.parquet(f"{d}/documents.parquet"), labels, learnable=~quality.held_out("id"))
    docs = {r.doc_id: r.text for r in rows if net is None or net.score(quality.features(pa.array([r.text])))[0] >= 0.7}
    docs = {i: t for i, (t, n, gone) in brute.clean_lines(docs, line_dedup.NEAR_WORDS).items() if not gone or gone < n}
    label = brute.near(docs, 5, 4, 5)
    docs = {i: t for i, t in docs.items() if label[i] == i}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    leaked = {i for i, _ in brute.leaks(docs, items, set(decontaminate.UNITS))}
    docs = {i: t for i, t in docs.items() if i not in leaked}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id: (r.ids, r.decoded) for r in got} == {i: (sp.encode(t), t) for i, t in docs.items()}
    assert 0 < len(got) < len(rows)


def test_stages_keep_the_columns_and_take_odd_rows(spark, scratch):
    d = "/root/testdata/sf0.001"
    rows = [(1, "Clean words stand here.", "en", "s", 5, "x"), (1, "Clean words stand here.", "en", "s", 5, "x"), (None, None, None, None, None, None), (2, "", "en", None, 0, "y"), (3, "word " * 50_000, "en", "s", 1, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality_score string")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        if name != "sentencepiece":
            assert tuple(out.columns) == corpus_pipeline.COLUMNS
        assert out.count() <= len(rows)
        assert stage(spark, docs.where("false"), d).count() == 0


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)
