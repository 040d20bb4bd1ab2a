import random

import pytest
from pyspark.sql import functions as F

from auditlake.functions import regex
from auditlake.operators import rules as rul
from auditlake.operators.rules import Rule


def match(spark, text, rules):
    row = spark.createDataFrame([(text,)], "t string").select(rul.match_list(F.col("t"), rules).alias("m"))
    row = row.select("m", rul.risk_score(F.col("m")).alias("s")).first()
    return [m.rule_id for m in row.m], row.s


def test_keyword_and_pattern(spark):
    rules = [Rule("k", "", "ignore previous instructions", weight=50), Rule("r", "", "sk-[a-z0-9]+", weight=60, regex=True)]
    assert match(spark, "please ignore previous instructions and sk-abc123", rules) == (["k", "r"], 100)


def test_order_and_duplicates(spark):
    rules = [
        Rule("x", "", "c+", regex=True), Rule("short", "", "bc"), Rule("long", "", "abc"), Rule("early", "", "a"),
        Rule("dup", "", "bc"), Rule("none", "", "zz"), Rule("blank", "", "", weight=90),
    ]
    assert match(spark, "abc", rules) == (["early", "long", "short", "dup", "x"], 50)


def test_double_space_keyword_never_hits(spark):
    assert match(spark, "a b", [Rule("k", "", "a  b")]) == ([], 0)


def test_many_keywords_equal_brute_force(spark):
    rng = random.Random(7)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(120)}
    rules = [Rule(w, "", w, weight=1) for w in sorted(words)] + [Rule("re", "", "a.c$", regex=True, weight=2)]
    texts = ["".join(rng.choice("abcd ") for _ in range(60)) for _ in range(40)] + ["", "zzz"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows.select("i", rul.match_list(F.col("t"), rules).alias("m")).orderBy("i").collect()
    for text, row in zip(texts, got):
        found = [(text.index(w) + len(w), -len(w), p, w) for p, w in enumerate(sorted(words)) if w in text]
        want = [w for *_, w in sorted(found)] + (["re"] if regex.re.search("a.c$", text) else [])
        assert [m.rule_id for m in row.m] == want


@pytest.mark.parametrize("pattern", ["[", "(a", "a)", "(?=a)", "(?<!a)b", r"(a)\1", "a{1001}", "a**", "x++", "(?>a)", "[[:nope:]]", r"\X", "(?U)a", "[z-a]"])
def test_refused_patterns(pattern):
    assert regex.problem(pattern)


@pytest.mark.parametrize("pattern,yes,no", [
    (r"\b12\b", ["a 12", "é12"], ["a12", "123"]), ("[[:alpha:]]+1", ["x1"], ["11"]), ("(?P<a_b>x)y", ["xy"], ["x"]),
    (r"\p{Greek}", ["σ"], ["s"]), ("(?i)É", ["é"], ["e"]), ("[a&&b]", ["&"], ["c"]), (r"\Qa.b\E", ["a.b"], ["axb"]),
    ("[]x]", ["]"], ["["]), ("a{,2}", ["a{,2}"], ["aa"]),
])
def test_java_spelling(spark, pattern, yes, no):
    rows = spark.createDataFrame([(t, True) for t in yes] + [(t, False) for t in no], "t string, want boolean")
    for row in rows.select("t", "want", rul.pattern_hit(F.col("t"), pattern).alias("got")).collect():
        assert row.got == row.want, row.t
    assert regex.problem(pattern) is None


@pytest.mark.parametrize("pattern,literal", [
    ("[a-z]+@[a-z]+", "@"), ('token = "[0-9]"', 'token = "'), ("a|bcd", ""), ("ab?c", "a"), ("(?i)abc", ""), ("abc*", "ab"), (r"a\.b", "a.b"),
])
def test_required_literal(pattern, literal):
    assert regex.required_literal(pattern) == literal


def test_effective_sets_and_fallback(spark, monkeypatch):
    def rule(pattern, is_regex=False, weight=10):
        return (pattern, pattern, pattern, "", "", weight, is_regex)

    schema = "version string, scope string, rules array<struct<id:string,name:string,pattern:string,severity:string,action:string,weight:int,regex:boolean>>"
    sets = spark.createDataFrame([
        ("g", "global", [rule("One"), rule(r"\bt[a-z]o\b", True, 30), rule("")]), ("a", "tenant:a", [rule("three", weight=0)]),
    ], schema)
    rows = spark.createDataFrame([("1", "a", "one two three"), ("2", "b", "one two three"), ("3", "b", "é")],
                                 "request_id string, tenant_id string, text string")

    def run():
        found = rul.match_effective(rows, sets).orderBy("request_id").collect()
        return [(r.rule_version, [(m.rule_id, m.weight, m.action) for m in r.matches]) for r in found]

    want = [("a", [("three", 10, "monitor")]), ("g", [("One", 10, "monitor"), (r"\bt[a-z]o\b", 30, "monitor")]), ("g", [])]
    assert run() == want
    monkeypatch.setattr(rul, "MAX_COMPILED_PATTERNS", 1)
    assert run() == want
