"""Body -> canonical text, without leaving the JVM.

JSON strings are read in document order with one possessive regular expression, NFKC uses
the ICU library that ships with Spark, and only for rows that can change under it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Routes with a metric label of their own.
KNOWN_ROUTES = ["/v1/chat/completions", "/v1/completions", "/v1/embeddings", "/v1/responses"]

# Characters of Unicode White_Space.
ASCII_SPACES = "\t\n\x0b\x0c\r"
_OTHER_SPACES = (
    r"\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
WHITESPACE = rf"[ \t-\r{_OTHER_SPACES}]"

# Characters that are never altered by NFKC, alone or next to each other (tests check every
# one of them). Text made only of these skips the normaliser.
NFKC_STABLE = (
    r"\x{A1}-\x{A7}\x{A9}\x{AB}-\x{AE}\x{B0}\x{B1}\x{B6}\x{B7}\x{BB}\x{BF}-\x{131}"
    r"\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}\x{180}-\x{1C3}\x{1CD}-\x{1F0}"
    r"\x{391}-\x{3A1}\x{3A3}-\x{3CE}\x{400}-\x{482}\x{48A}-\x{52F}"
    r"\x{5D0}-\x{5EA}\x{621}-\x{63A}\x{641}-\x{64A}"
    r"\x{2010}\x{2012}-\x{2016}\x{2018}-\x{2023}\x{2030}-\x{2032}\x{2039}\x{203A}\x{20AC}"
    r"\x{3001}-\x{3029}\x{3041}-\x{3096}\x{30A1}-\x{30FE}\x{3400}-\x{4DBF}"
    r"\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}"
)

_JSON_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"\s*+:?'
_JSON_START = r'^[ \t\r\n]*[\[{"\-0-9tfn]'


def as_text(body: Column) -> Column:
    """Bytes or string -> valid UTF-8 string."""
    return F.make_valid_utf8(body.cast("string"))


def json_valid(text: Column) -> Column:
    """True when the whole text is one JSON value.

    A single parse ignores trailing text, so the value is parsed inside an array and inside
    an object: only one complete JSON value fits both.
    """
    inside_array = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    inside_object = F.try_parse_json(F.concat(F.lit('{"k":'), text, F.lit("}")))
    return (
        F.when(~text.rlike(_JSON_START), F.lit(False))
        .when(inside_array.isNull(), F.lit(False))
        .otherwise(inside_object.isNotNull())
    )


def json_strings(text: Column) -> Column:
    """Every string value (never a key) of a valid JSON text, joined by newlines."""
    tokens = F.regexp_extract_all(text, F.lit(_JSON_STRING), F.lit(0))
    values = F.filter(tokens, lambda token: ~token.endswith(":"))
    array = F.concat(F.lit("["), F.array_join(values, ","), F.lit("]"))
    return F.array_join(F.from_json(array, "array<string>"), "\n")


def json_text(body: Column) -> Column:
    text = as_text(body)
    return F.when(json_valid(text), json_strings(text)).otherwise(text)


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def nfkc(text: Column) -> Column:
    composed = F.reflect(
        F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True)
    )
    # ASCII runs and stable runs are skipped whole; the wide class sees other characters only.
    stable = text.rlike(rf"\A(?:[\x00-\x7F]++|[{NFKC_STABLE}]++)*+\z")
    return F.when(~(is_ascii(text) | stable), composed).otherwise(text)


def plain_spaces(text: Column) -> Column:
    """Every white-space character as a plain space, by byte searches where the text is ASCII."""
    plain = F.when(is_ascii(text), text).otherwise(F.regexp_replace(text, f"[{_OTHER_SPACES}]", " "))
    for char in ASCII_SPACES:
        plain = F.replace(plain, F.lit(char), F.lit(" "))
    return plain


def squeeze(text: Column) -> Column:
    """Runs of plain spaces as one, none at the ends."""
    return F.trim(F.when(text.contains("  "), F.regexp_replace(text, " {2,}", " ")).otherwise(text))


def collapse_ws(text: Column) -> Column:
    return squeeze(plain_spaces(text))


def fold_case(text: Column) -> Column:
    """Lower-case rune by rune (no final sigma, no two-character dotted i)."""
    special = text.contains("İ") | text.contains("Σ")
    return F.lower(F.when(special, F.translate(text, "İΣ", "iσ")).otherwise(text))


def normalize_plain(text: Column) -> Column:
    return fold_case(collapse_ws(nfkc(text)))


def normalize_text(body: Column) -> Column:
    return normalize_plain(json_text(body))


def with_normal_text(df: DataFrame, body: str = "body", out: str = "text") -> DataFrame:
    """Adds the canonical text of ``body``.

    Each step is a projection of its own: its input is used more than once, and Spark keeps
    such projections apart, so the JSON parse and the normaliser run once per row.
    """
    step = f"__{out}"
    text, valid = F.col(step), F.col(f"{step}_json")
    return (
        df.withColumn(step, as_text(F.col(body)))
        .withColumn(f"{step}_json", json_valid(text))
        .withColumn(step, F.when(valid, json_strings(text)).otherwise(text))
        .withColumn(step, nfkc(text))
        .withColumn(step, plain_spaces(text))
        .withColumn(step, squeeze(text))
        .withColumn(out, fold_case(text))
        .drop(step, f"{step}_json")
    )


def request_model(body: Column) -> Column:
    """Top-level ``model`` of a JSON object body when it is a string, else ''."""
    text = as_text(body)
    value = F.try_variant_get(F.try_parse_json(text), "$.model", "variant")
    is_string = F.schema_of_variant(value) == "STRING"
    model = F.when(is_string, F.try_variant_get(value, "$", "string"))
    looks_like_object = text.rlike(r"^[ \t\r\n]*\{")
    return F.when(looks_like_object & json_valid(text), F.coalesce(model, F.lit(""))).otherwise("")


def endpoint_bucket(path: Column) -> Column:
    return F.when(path.isin(KNOWN_ROUTES), path).otherwise("/v1/other")


def content_sha256(body: Column) -> Column:
    return F.sha2(body.cast("binary"), 256)


def body_bytes(body: Column) -> Column:
    return F.octet_length(body)
