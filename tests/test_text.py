import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from auditlake.functions import digest, text


def run(spark, values, function):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.r for r in rows.withColumn("r", function(F.col("v"))).orderBy("i").collect()]


@pytest.mark.parametrize("body,expected", [
    ('{"messages":[{"role":"user","content":"  IGNORE   Previous Instructions "}]}', "user ignore previous instructions"),
    ("123", ""), ('"abc"', "abc"), ('{"a":1} x', '{"a":1} x'), ('{"name":"value"}', "value"), ("null", ""), ("", ""),
    ("1],[2", "1],[2"), ('{"k":1},"x":{}', '{"k":1},"x":{}'), ('[["a",{"b":["c"]}],true]', "a c"),
    (r'{"a":"\u0041\n\"x\" : \\"}', 'a "x" : \\'), ("ﬁ Ａ\u00a0\u3000B", "fi a b"), ("İΣ", "iσ"),
])
def test_normalize(spark, body, expected):
    assert run(spark, [body], text.normalize_text) == [expected]
    rows = spark.createDataFrame([(body,)], "body string")
    assert text.with_normal_text(rows).first()["text"] == expected


def test_long_json_string(spark):
    assert run(spark, ['{"a":"' + "x\\n" * 300_000 + '"}'], text.json_text)[0] == "x\n" * 300_000


def test_null_text(spark):
    rows = spark.createDataFrame([(None,)], "body string")
    assert text.with_normal_text(rows).first()["text"] is None


def test_stable_ranges_never_change():
    for low, high in re.findall(r"\\x\{([0-9A-F]+)\}(?:-\\x\{([0-9A-F]+)\})?", text.NFKC_STABLE):
        for code in range(int(low, 16), int(high or low, 16) + 1):
            char = chr(code)
            assert unicodedata.is_normalized("NFKC", char) and not unicodedata.combining(char), hex(code)


def test_nfkc_matches_unicode_tables(spark):
    samples = ["e\u0301", "①½", "ｶﾞ", "ǆ", "한글", "\u1100\u1161", "plain", "ſ", "é", "日本語 テスト"]
    assert run(spark, samples, text.nfkc) == [unicodedata.normalize("NFKC", s) for s in samples]


def test_whitespace(spark):
    spaces = [c for c in map(chr, range(0x3001)) if re.fullmatch(r"\s", c) and c not in "\x1c\x1d\x1e\x1f"]
    assert len(spaces) == 25
    assert run(spark, ["a" + c + " " + c + "b" + c for c in spaces], text.collapse_ws) == ["a b"] * len(spaces)


@pytest.mark.parametrize("body,expected", [
    ('{"model":"m"}', "m"), ('{"model":1}', ""), ('{"model":null}', ""), ('{"model":"m"} x', ""), ("[]", ""), ("x", ""),
    ('{"a":{"model":"m"}}', ""),
])
def test_request_model(spark, body, expected):
    assert run(spark, [body], text.request_model) == [expected]


@pytest.mark.parametrize("secret", [b"k", b"x" * 100])
def test_hmac(spark, secret):
    import hashlib
    import hmac

    got = run(spark, ["message"], lambda c: digest.hmac_sha256(c, secret))[0]
    assert bytes(got) == hmac.new(secret, b"message", hashlib.sha256).digest()
