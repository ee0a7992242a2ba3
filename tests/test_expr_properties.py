"""Column expressions against the Python behaviour they reproduce (hypothesis)."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newslens.functions import exprs as X

INT_ALPHABET = "0123456789+-_ \t\n３２٣.a²　"
WS_ALPHABET = " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0       　ab​"
TEXT_ALPHABET = "abcXYZéÈçßñü0129 ,.;'-\n\t_àÉ"


def _python_int(s: str) -> bool:
    try:
        int(s)
        return True
    except ValueError:
        return False


def _spark_values(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.r for r in df.select("i", expr(F.col("v")).alias("r")).orderBy("i").collect()]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=INT_ALPHABET, max_size=8), min_size=50, max_size=200))
def test_is_int_token_matches_python_int(spark, values):
    assert _spark_values(spark, values, X.is_int_token) == [_python_int(v) for v in values]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=WS_ALPHABET, max_size=10), min_size=50, max_size=200))
def test_py_strip_matches_str_strip(spark, values):
    assert _spark_values(spark, values, X.py_strip) == [v.strip() for v in values]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=TEXT_ALPHABET, max_size=40), min_size=20, max_size=100))
def test_segment_words_matches_regex_runs(spark, values):
    want = [re.findall(r"[^\W_]+", v.lower()) for v in values]
    assert _spark_values(spark, values, X.segment) == want
