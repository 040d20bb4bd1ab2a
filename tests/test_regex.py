"""Patterns that are accepted neither recurse nor explode on long texts."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditlake.functions.regex import problem, to_java

REFUSED = [
    "(ab|c)*d", "(a+)+b", "(a*)*", "((a|bc)d)*", "(?:x+y)*z", "(a|b+)*", "(a?b)+", "(a|b|cd){2,}", "((ab)*c)*", "(.|\\n)*x|(q|rs)+",
]
ACCEPTED = [
    "(a|b|c)*d", "(?:a|\\d|[x-z])+!", "(ab)*c", "a*b*c", "(a|bc)d", "(ab|cd){2,5}e", "(a+b){3}", "(?:[ab]|\\.|\\x41)*q", "(-|&|a)+]",
    "((a|b)c)*d", "(f|g)+?x", "(|a)b",
]


@pytest.mark.parametrize("pattern", REFUSED)
def test_refused_by_name(pattern):
    assert problem(pattern) == "alternatives or repeats inside an unbounded repeat"


@pytest.mark.parametrize("pattern", ACCEPTED)
def test_accepted(pattern):
    assert problem(pattern) is None


def test_choices_of_characters_become_classes():
    assert to_java("(a|b|c)*d") == "[abc]*d"
    assert to_java("(?:a|\\d|[x-z])+!") == "[a\\d[x-z]]+!"
    assert to_java("(a|bc)*") == "(a|bc)*" and to_java("(a|b)c") == "(a|b)c" and to_java("(^|b)*") == "(^|b)*"
    assert to_java("(i|(j|k)*)+") == "(i|[jk]*)+"


def test_long_texts(spark):
    """Texts of 10 MB without a match, made of what the repeats accept."""
    texts = spark.createDataFrame([("abc",), ("ab",), ("a",), ("a.A",)], "part string").select(F.expr("repeat(part, 10000000 div length(part))").alias("text"))
    for pattern in ("(a|b|c)*d", "(ab)*ab\\z", "(?:[ab]|\\.|\\x41)*\\.A\\z", "(a|b)*?\\z"):
        anchored = "\\A" + pattern
        assert problem(anchored) is None
        assert [r.hit for r in texts.select(F.col("text").rlike(to_java(anchored)).alias("hit")).collect()] == [
            bool(re.search(anchored.replace("\\z", "\\Z"), t * (10_000_000 // len(t)))) for t in ("abc", "ab", "a", "a.A")
        ]


PIECES = st.sampled_from(["a", "b", "c", "[ab]", "\\.", "ab", "(a|b)", "(a|b|c)", "(ab|c)", "(?:b|[cd])", "."])
PATTERNS = st.lists(st.tuples(PIECES, st.sampled_from(["", "*", "+", "?", "{2}", "{1,3}"])), min_size=1, max_size=4)


@settings(max_examples=60, deadline=None)
@given(PATTERNS, st.lists(st.text("abcd.", max_size=12), min_size=1, max_size=6))
def test_spelling_keeps_the_meaning(spark, parts, texts):
    pattern = "".join(f"(?:{p}){q}" if len(p) > 1 and p[0] not in "([\\" else p + q for p, q in parts)
    if problem(pattern) is not None:
        return
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r.hit for r in frame.select(F.col("text").rlike(to_java(pattern)).alias("hit")).collect()]
    assert got == [bool(re.search(pattern, t)) for t in texts]
