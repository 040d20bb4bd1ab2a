"""Driver tables -> engine schemas. Each mapping keeps every row of its table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import auditlake
from auditlake.operators.rules import Rule
from auditlake.schemas import POLICY_FIELDS
from auditlake.sources.traffic import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; zone-less times are read as UTC instants."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    times = {c: F.col(c).cast("timestamp") for c, kind in rows.dtypes if kind == "timestamp_ntz"}
    return rows.withColumns(times) if times else rows


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table as a stream of files."""
    path = f"{sf_dir}/{name}.parquet"
    # A pattern, as a file stream takes a plain path for a folder.
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/{name}.parque[t]")
    times = {c: F.col(c).cast("timestamp") for c, kind in rows.dtypes if kind == "timestamp_ntz"}
    return rows.withColumns(times) if times else rows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings the results depend on."""
    auditlake.configure(spark)
    # Work per shuffled byte is high (a 16-byte fragment is audited with its 16 KB window), so
    # small shuffles are still worth many tasks.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    return spark


ROUTE_OF_LANG = {
    "en": "/v1/chat/completions", "fr": "/v1/completions", "de": "/v1/responses", "es": "/v1/embeddings",
}

RULES = [
    Rule("license", "license line", "License", "low", "monitor", 30),
    Rule("email", "mail address", "[a-z0-9.]+@[a-z0-9.]+", "medium", "redact", 40, True),
    Rule("token", "token value", 'token = "[0-9a-f]{40}"', "high", "block", 85, True),
    Rule("card", "card number", r"\b[0-9]{16}\b", "high", "redact", 60, True),
    Rule("empty", "never used", "", "low", "block", 99),
    Rule("script", "defaults only", "</script>", "", "", 0),
]
RULE_VERSION = "rules-1"

POLICIES = [
    ("p1", "global", "*", "request", 30, 80, "block", "fail_open", 1),
    ("p2", "global", "/v1/completions", "request", 20, 50, "redact", "fail_closed", 3),
    ("p3", "tenant:src1", "*", "request", 10, 35, "redact", "fail_closed", 2),
    ("p4", "tenant:src1", "/v1/chat/completions", "request", 30, 60, "block", "fail_open", 4),
    ("p5", "tenant:src2", "/v1/responses", "request", 25, 90, "block", "fail_closed", 0),
    ("p6", "global", "*", "response", 0, 70, "", "", 5),
    ("p7", "tenant:src3", "*", "response", 20, 40, "redact", "fail_open", 1),
    ("p8", "tenant:c1", "*", "response", 20, 40, "block", "fail_open", 6),
]


def policies(spark: SparkSession) -> DataFrame:
    """The policies above as a local table, whose size Spark knows while it plans."""
    columns = list(zip(*POLICIES))
    names = [field.split()[0] for field in POLICY_FIELDS.split(", ")]
    local = spark.createDataFrame(pa.table(dict(zip(names, columns))))
    return local.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in POLICY_FIELDS.split(", ")])


def json_string(text: Column) -> Column:
    """A text as a quoted JSON string."""
    array = F.to_json(F.array(text))
    return F.substring(array, 2, F.length(array) - 2)


def route(lang: Column) -> Column:
    chain = F
    for code, path in ROUTE_OF_LANG.items():
        chain = chain.when(lang == code, path)
    return chain.otherwise("/v1/models")


def wrapped_body(model: Column, text: Column, shape: Column) -> Column:
    """Body in one of four shapes: raw text, chat JSON, nested JSON, JSON with a tail."""
    quoted = json_string(text)
    chat = F.concat(
        F.lit('{"model":'), json_string(model),
        F.lit(',"stream":true,"messages":[{"role":"user","content":'), quoted, F.lit("}]}"),
    )
    nested = F.concat(
        F.lit('{"model":7,"input":[1,null,'), quoted, F.lit(',{"deep":["a\\n\\u0041",{"k":"'), model,
        F.lit('"}]}],"n":1.5}'),
    )
    return (
        F.when(shape == 0, text).when(shape == 1, chat).when(shape == 2, nested)
        .otherwise(F.concat(chat, F.lit(" tail")))
    )


def traffic(spark: SparkSession, sf_dir: str, wrap: bool = False) -> DataFrame:
    return traffic_of(documents(spark, sf_dir), wrap)


def traffic_of(docs: DataFrame, wrap: bool = False) -> DataFrame:
    """Requests from a batch or streaming frame of documents."""
    body = F.col("text")
    if wrap:
        body = wrapped_body(F.concat(F.lit("m-"), F.col("lang")), body, F.col("doc_id") % 4)
    return docs.select(
        F.concat(F.lit("doc-"), "doc_id").alias("capture_id"),
        F.col("doc_id").cast("string").alias("request_id"),
        F.col("source").alias("tenant_id"),
        F.concat(F.lit("key-"), "source").alias("api_key_id"),
        F.lit("request").alias("direction"),
        F.lit("").alias("model"),
        route(F.col("lang")).alias("path"),
        body.cast("binary").alias("body"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")).alias("ts"),
    )


def conversation_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both directions: assistant turns are responses, the others requests."""
    turns = spread(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("request_id"),
        F.concat(F.lit("c"), F.col("conv_id") % 20).alias("tenant_id"),
        F.lit("").alias("api_key_id"),
        F.when(F.col("role") == "assistant", "response").otherwise("request").alias("direction"),
        F.lit("").alias("model"),
        F.lit("/v1/chat/completions").alias("path"),
        F.col("text").cast("binary").alias("body"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 60 + F.col("turn")).alias("ts"),
    )


def page_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages"), "page_id")
    return pages.select(
        F.col("page_id").cast("string").alias("request_id"),
        F.concat(F.lit("src"), F.col("page_id") % 5).alias("tenant_id"),
        F.lit("").alias("api_key_id"),
        F.lit("response").alias("direction"),
        F.lit("").alias("model"),
        F.lit("/v1/completions").alias("path"),
        F.col("html").cast("binary").alias("body"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("page_id")).alias("ts"),
    )


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second opinions from labels; documents without a label have none."""
    labels = table(spark, sf_dir, "labels")
    toxic = F.col("toxic") == 1
    return labels.select(
        F.col("doc_id").cast("string").alias("request_id"),
        F.when(toxic, "block").otherwise("allow").alias("verdict"),
        F.when(toxic, 100).otherwise(0).alias("risk_score"),
        F.lit(0.5).alias("confidence"),
        F.array(F.lit("toxicity")).alias("categories"),
        F.when(toxic, "label").otherwise("").alias("evidence"),
        F.lit("labels").alias("model"),
        F.lit("1").alias("version"),
        F.lit("").alias("error"),
    )


# ---- audit log of calls, from events: k is the number in props

EVENT_ROUTE = {
    "click": "/v1/chat/completions", "view": "/v1/completions", "purchase": "/v1/embeddings",
    "signup": "/v1/responses",
}


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls_of(table(spark, sf_dir, "events"))


def calls_of(events: DataFrame) -> DataFrame:
    """Call log from a batch or streaming frame of events."""
    k = F.get_json_object("props", "$.k").cast("int")
    path = F
    for name, target in EVENT_ROUTE.items():
        path = path.when(F.col("event_type") == name, target)
    return events.select(
        F.col("event_id"),
        F.col("ts").alias("event_time"),
        F.concat(F.lit("u"), "user_id").alias("tenant_id"),
        F.col("event_type"),
        path.otherwise("/v1/errors").alias("path"),
        F.when(F.col("event_id") % 3 == 0, "response").otherwise("request").alias("direction"),
        F.when(k < 70, "allow").when(k < 85, "monitor").when(k < 95, "redact").otherwise("block").alias("decision"),
        F.when(k < 80, 200).when(k < 90, 403).otherwise(429).alias("status"),
        (F.col("value") / 100).alias("seconds"),
        k.alias("k"),
        F.col("user_id"),
    )
