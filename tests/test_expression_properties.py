"""Property tests: scalar expressions against plain-Python versions on generated inputs."""

import re

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from logsmith.functions import cut_stack, mask_email, mask_key, parse_level, pattern_mask, redact_secrets

NAMES = ["Trace", "Debug", "Info", "Warning", "Error", "Fatal"]


def py_level(x):
    if x is None:
        return "Info"
    t = x.strip(" ")
    for i, n in enumerate(NAMES):
        if t.lower() == n.lower() or t == str(i):
            return n
    return "Info"


def py_mask(m):
    return re.sub("[0-9]+", "*", m[:100])


def py_redact(q):
    return re.sub(r"(?i)(apiKey|token|key|secret)=[^&]*", r"\1=***", q)


def py_cut(x):
    lines = x.split("\n")
    return x if len(lines) <= 5 else "\n".join(lines[:5]) + "\n... (truncated)"


def py_email(e):
    at = e.find("@")
    return "***@***" if at <= 1 else e[0] + "***@" + e[at + 1:]


def py_key(k):
    return k[:8] + "..." + k[-4:] if len(k) > 12 else k


def run(spark, values, fn):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


_core_level = st.one_of(
    st.sampled_from(NAMES + [n.upper() for n in NAMES] + [n.lower() for n in NAMES]),
    st.integers(-2, 9).map(str),
    st.text(alphabet="infoERWAt ,9", max_size=8),
)
level_text = st.one_of(
    st.none(),
    st.tuples(st.sampled_from(["", " ", "  "]), _core_level, st.sampled_from(["", " "])).map("".join),
)
TOKENS = list("ab1 2x9_-ıü€\n=&?@") + ["key", "Token", "SECRET", "apikey", "123", "\n\n"]
texts = st.lists(st.sampled_from(TOKENS), max_size=60).map("".join)
SETTINGS = settings(max_examples=20, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(st.lists(level_text, min_size=1, max_size=20))
def test_parse_level(spark, values):
    assert run(spark, values, parse_level) == [py_level(v) for v in values]


@SETTINGS
@given(st.lists(texts, min_size=1, max_size=20))
def test_text_expressions(spark, values):
    assert run(spark, values, pattern_mask) == [py_mask(v) for v in values]
    assert run(spark, values, redact_secrets) == [py_redact(v) for v in values]
    assert run(spark, values, cut_stack) == [py_cut(v) for v in values]
    assert run(spark, values, mask_email) == [py_email(v) for v in values]
    assert run(spark, values, mask_key) == [py_key(v) for v in values]
