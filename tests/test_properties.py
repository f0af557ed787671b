"""Property tests: column functions against their plain-Python definitions on generated batches."""

import string

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kbspark.functions import urls as U
from kbspark.functions.prompts import strip_echo
from kbspark.functions.vectors import token_count, truncate_tokens

SETTINGS = settings(max_examples=8, deadline=None)
ascii_words = st.text(alphabet=string.ascii_letters + string.digits + " \t\n\r.,", max_size=200)
segment = st.text(alphabet=string.ascii_lowercase + string.digits + "-_?=#.", min_size=0, max_size=8)


@SETTINGS
@given(st.lists(st.tuples(st.text(max_size=30), st.text(max_size=30)), min_size=1, max_size=40))
def test_strip_echo_is_python_slicing(spark, pairs):
    df = spark.createDataFrame(pairs, "o string, p string")
    got = [r[0] for r in df.select(strip_echo(F.col("o"), F.col("p"))).collect()]
    assert got == [o[len(p) - 2:] for o, p in pairs]


@SETTINGS
@given(st.lists(ascii_words, min_size=1, max_size=40), st.integers(min_value=1, max_value=12))
def test_truncation_and_count_match_split(spark, texts, n):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(truncate_tokens(F.col("t"), n).alias("h"), token_count(F.col("t")).alias("c")).collect()
    assert [r.h for r in rows] == [" ".join(t.split()[:n]) for t in texts]
    assert [r.c for r in rows] == [len(t.split()) for t in texts]


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["http://", "https://", "HTTPS://", ""]),
                          st.lists(segment, min_size=1, max_size=5)), min_size=1, max_size=40))
def test_paths_stay_under_base_without_empty_segments(spark, parts):
    urls = [scheme + "/".join(segs) for scheme, segs in parts]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    for (p,) in df.select(U.url_to_path(F.col("u"), "/base")).collect():
        assert p.startswith("/base/") and p.endswith(".txt")
        assert "//" not in p[len("/base"):]
