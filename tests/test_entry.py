"""The driver contract in __spark_entry__.py."""

import importlib.util
import os

from conftest import ROOT

spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
entry_mod = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry_mod)


def test_entry_runs_with_stable_schema(spark):
    df = entry_mod.entry(spark)
    assert df.columns == ["doc_id", "rank", "term", "tf", "tfidf"]
    assert df.count() > 0


def test_every_library_query_has_an_oracle():
    from newslens.plans.oracle import ORACLE
    from newslens.plans.queries import QUERIES

    qs, sql = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(qs) and set(sql) <= set(qs)
    assert all(callable(f) for f in qs.values())


def test_the_oracles_stand_alone():
    with open(os.path.join(ROOT, "newslens", "plans", "oracle.py"), encoding="utf-8") as f:
        assert not [line for line in f if line.startswith(("import", "from")) and "__future__" not in line]


def test_the_optional_parts_may_be_missing(tmp_path):
    """Without the subpackage `llm` and the pipeline, the entry still imports and lists the other queries."""
    import shutil
    import subprocess
    import sys

    for name in ("__spark_entry__.py", "newslens"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'y1_article_keywords' in q and 'pipeline' not in q; assert 'pipeline' not in e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_a_missing_dependency_of_the_optional_parts_leaves_the_other_queries(tmp_path):
    import subprocess
    import sys

    code = """
import sys, warnings
sys.modules["public_tokenizers"] = None
import __spark_entry__ as e
with warnings.catch_warnings(record=True) as said:
    warnings.simplefilter("always")
    q = e.queries()
assert "y1_article_keywords" in q and "pipeline" not in q
import importlib.util
assert not importlib.util.find_spec("newslens.llm") or any("left out" in str(w.message) for w in said)
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env={**os.environ, "PYTHONPATH": ROOT})
