"""S1 with `}{` inside strings, against a parser that walks over the characters."""

import json
import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from newslens.sources import articles as SA


def walk(text):
    """The records of a file: cut at `}{` outside of strings; braces at the cuts go."""
    out, own, inside, i = [], "", False, 0
    while i < len(text):
        c = text[i]
        if text[i:i + 2] == "}{":
            if not inside:
                out.append(own)
                own = ""
            else:
                own += "}{"
            i += 2
            continue
        if c == "\\":
            # the next character goes along; before a cut it is the cut's own brace
            if text[i + 1:i + 3] == "}{":
                own += c
                i += 1
                continue
            own += text[i:i + 2]
            i += 2
            continue
        if c == '"':
            inside = not inside
        if c == "\n":
            inside = False
        own += c
        i += 1
    return [*out, own]


def records(spark, path, split):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", str(split))
    try:
        raw = SA.with_file_order(spark.read.option("lineSep", "}{").text(path), keep_split=True)
        return [r.value for r in SA.join_quoted(raw).orderBy("ingest_pos").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["}{", '"', "\\", "\n", "a", "{", "}", '"}{"', '\\"', "中"]), max_size=40), st.sampled_from([7, 16, 1000]))
def test_records_are_those_of_a_character_walk(spark, scratch, parts, split):
    text = "".join(parts)
    path = os.path.join(scratch, f"f{abs(hash((text, split)))}.json")
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    want = walk(text)
    if want[-1] == "":  # nothing stands behind the last cut
        want = want[:-1]
    assert records(spark, path, split) == want


def test_strings_with_braces_over_many_splits_and_files(spark, scratch):
    docs = [{"url": f"u{i}", "depth": i, "content": ['say "}{" or \\}{ ' * (i % 4), "}{" * (i % 3)]} for i in range(400)]
    for k in range(4):
        with open(os.path.join(scratch, f"part{k}.json"), "w", encoding="utf-8") as f:
            f.write("".join(json.dumps(d) for d in docs[k::4]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        got = SA.read_concat_json(spark, scratch, quoted=True).orderBy("ingest_pos").collect()
        cut = SA.read_concat_json(spark, scratch).count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.url, r.depth, r.content) for r in got] == [(d["url"], d["depth"], d["content"]) for k in range(4) for d in docs[k::4]]
    assert cut < len(docs)  # by default a `}{` in a string cuts too


@pytest.mark.parametrize("torn", ['{"url":"v","con', '{"url":"v'])
def test_a_torn_string_ends_at_a_line_break(spark, scratch, torn):
    whole = json.dumps({"url": "w", "content": ["}{"]})
    with open(os.path.join(scratch, "t.json"), "w", encoding="utf-8") as f:
        f.write(whole + torn + "\n}" + whole)
    rows = SA.read_concat_json(spark, scratch, quoted=True, keep_rejects=True).collect()
    assert sorted(r.url or "-" for r in rows) == ["-", "w", "w"]
    assert sum(r.rejected is not None for r in rows) == 1


@pytest.mark.parametrize("layout", [{}, {"indent": 1}, {"separators": (",", ":")}])
def test_s12_one_object_over_many_splits(spark, scratch, layout):
    from newslens.sources import sinks as SK

    words = ["a", "x],", '],"k": [', 'q"],', "\\],", "中]", "{}", "]}"]
    doc = {f"2020-11-{1 + i // 24:02d} {i % 24:02d}:00": [{"关键词": words[(i + k) % len(words)], "数量": i + k} for k in range(i % 5)] for i in range(300)}
    path = os.path.join(scratch, "history.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(doc, f, ensure_ascii=False, **layout)
    want = sorted((k, n, e["关键词"], e["数量"]) for k, v in doc.items() for n, e in enumerate(v, 1))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        got = SK.read_history(spark, path, split=True)
        assert sorted(map(tuple, got.collect())) == want == sorted(map(tuple, SK.read_history(spark, path).collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with open(path, "w", encoding="utf-8") as f:
        f.write("{}")
    assert SK.read_history(spark, path, split=True).count() == 0
