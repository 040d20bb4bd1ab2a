"""Text, rule and rule-set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.functions import text as tx
from auditlake.operators import rules as rul
from auditlake.operators import timeline
from auditlake.plans import audit
from auditlake.sources import config
from workload import data, sql
from workload.data import table

QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str | None = None):
    def register(function):
        def run(spark, sf_dir):
            return function(data.configure(spark), sf_dir)

        QUERIES[name] = run
        if oracle:
            ORACLE[name] = oracle
        return run

    return register


# ---- scans and configuration

@query("traffic_scan", f"""WITH {sql.TRAFFIC}
SELECT tenant_id, path, count(*) AS n, sum(strlen(body))::bigint AS bytes, min(epoch_ms(ts)) AS first_ms
FROM traffic GROUP BY ALL""")
def traffic_scan(spark, sf):
    return data.traffic(spark, sf).groupBy("tenant_id", "path").agg(
        F.count("*").alias("n"), F.sum(F.octet_length("body")).alias("bytes"),
        F.min(F.unix_millis("ts")).alias("first_ms"),
    )


def part_configs(spark, sf):
    """One configuration document per part: two rules and one policy."""
    part = table(spark, sf, "part")
    name = data.json_string(F.col("p_name"))
    rules = F.concat(
        F.lit('{"rules":[{"id":"a","pattern":'), name, F.lit(',"weight":'), F.col("p_size").cast("string"),
        F.lit(',"regex":false},{"id":"b","name":'), name, F.lit(',"pattern":"x+","regex":true,"action":"block"}],'),
    )
    policies = F.concat(
        F.lit('"policies":[{"scope":"tenant:'), F.regexp_replace("p_brand", "#", "-"),
        F.lit('","monitor_at":'), F.col("p_size").cast("string"), F.lit("}]}"),
    )
    return part.select("p_partkey", F.concat(rules, policies).alias("doc"))


@query("config_load", """
SELECT p_partkey, 0 AS position, 'a' AS id, NULL AS name, p_name AS pattern, p_size AS weight, false AS regex, NULL AS action FROM part
UNION ALL SELECT p_partkey, 1, 'b', p_name, 'x+', NULL, true, 'block' FROM part""")
def config_load(spark, sf):
    configs = config.parse_config(part_configs(spark, sf), "doc")
    return config.config_rules(configs, "p_partkey").drop("severity")


# ---- text functions

@query("json_text", f"""WITH {sql.WRAPPED}, {sql.JSON_TEXT}
SELECT request_id, length(raw_text) AS chars, md5(raw_text) AS digest FROM json_texts""")
def json_text(spark, sf):
    text = data.traffic(spark, sf, wrap=True).select("request_id", tx.json_text(F.col("body")).alias("t"))
    return text.select("request_id", F.length("t").alias("chars"), F.md5("t").alias("digest"))


@query("nfkc", "SELECT doc_id, md5(text) AS digest FROM documents")
def nfkc(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.nfkc(F.col("text"))).alias("digest"))


@query("collapse_ws", f"""SELECT doc_id, md5(trim(regexp_replace(text, '{sql.WS}', ' ', 'g'))) AS digest FROM documents
UNION ALL SELECT -1 - page_id, md5(trim(regexp_replace(html, '{sql.WS}', ' ', 'g'))) FROM pages""")
def collapse_ws(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    pages = table(spark, sf, "pages").select((-1 - F.col("page_id")).alias("doc_id"), F.col("html").alias("text"))
    return docs.unionAll(pages).select("doc_id", F.md5(tx.collapse_ws(F.col("text"))).alias("digest"))


@query("fold_case", "SELECT doc_id, md5(lower(text)) AS digest FROM documents")
def fold_case(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.fold_case(F.col("text"))).alias("digest"))


@query("normalize_text", f"""WITH {sql.WRAPPED}, {sql.JSON_TEXT}
SELECT request_id, md5({sql.normal("raw_text")}) AS digest FROM json_texts""")
def normalize_text(spark, sf):
    return tx.with_normal_text(data.traffic(spark, sf, wrap=True)).select(
        "request_id", F.md5("text").alias("digest")
    )


@query("request_model", f"""WITH {sql.WRAPPED}
SELECT request_id, CASE WHEN json_valid(body) AND json_type(CASE WHEN json_valid(body) THEN body ELSE '{{}}' END, '$.model') = 'VARCHAR'
  THEN json_extract_string(CASE WHEN json_valid(body) THEN body ELSE '{{}}' END, '$.model') ELSE '' END AS model
FROM wrapped""")
def request_model(spark, sf):
    return data.traffic(spark, sf, wrap=True).select("request_id", tx.request_model(F.col("body")).alias("model"))


@query("endpoint_bucket", """SELECT CASE WHEN p IN ('/v1/chat/completions', '/v1/completions', '/v1/embeddings', '/v1/responses')
  THEN p ELSE '/v1/other' END AS endpoint, count(*) AS n FROM (
  SELECT CASE event_type WHEN 'click' THEN '/v1/chat/completions' WHEN 'view' THEN '/v1/responses' ELSE '/v1/' || event_type END AS p
  FROM events) GROUP BY ALL""")
def endpoint_bucket(spark, sf):
    path = (
        F.when(F.col("event_type") == "click", "/v1/chat/completions")
        .when(F.col("event_type") == "view", "/v1/responses")
        .otherwise(F.concat(F.lit("/v1/"), "event_type"))
    )
    return table(spark, sf, "events").select(tx.endpoint_bucket(path).alias("endpoint")).groupBy("endpoint").agg(
        F.count("*").alias("n")
    )


@query("content_digest", "SELECT page_id, sha256(html) AS sha256, strlen(html) AS bytes FROM pages")
def content_digest(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", tx.content_sha256(F.col("html")).alias("sha256"), tx.body_bytes(F.col("html")).alias("bytes")
    )


# ---- rules

@query("rule_defaults", """SELECT p_partkey AS id, p_name AS pattern,
  CASE WHEN p_size - 10 <= 0 THEN 10 ELSE p_size - 10 END AS weight,
  CASE WHEN p_type = 'ECONOMY' THEN 'medium' ELSE p_type END AS severity,
  CASE WHEN p_brand = 'Brand#2' THEN 'monitor' ELSE 'block' END AS action, p_size % 2 = 0 AS regex
FROM part WHERE p_type <> 'PROMO'""")
def rule_defaults(spark, sf):
    part = table(spark, sf, "part")
    raw = part.select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_type") == "PROMO", "").otherwise(F.col("p_name")).alias("pattern"),
        (F.col("p_size") - 10).alias("weight"),
        F.when(F.col("p_type") != "ECONOMY", F.col("p_type")).otherwise("").alias("severity"),
        F.when(F.col("p_brand") != "Brand#2", "block").alias("action"),
        F.when(F.col("p_size") % 2 == 0, True).alias("regex"),
    )
    return rul.rule_defaults(raw)


KEYWORDS = [
    "License", "lic", "mit license", "the", "ther", "there", "therea", "tion", "tione", "con", "sh ", "que",
    "quevi", "eau", "eaux", "elle", "elles", "reau", "aio", "und", "unde", "der", "die", "sch", "los ", "ción",
    "ÉTION", "è", "on the", "on", "hahaha", "@mail", "token", "token = ", "###", "%%%", "&&&", "$$$", "...", "zz",
    "never occurs here", "http", "1", "12", "</p>",
]


@query("keyword_match", f"""WITH k(word) AS (VALUES {", ".join(f"({sql.q(w)})" for w in KEYWORDS)}),
texts AS (SELECT doc_id, {sql.normal("text")} AS text FROM documents)
SELECT doc_id, count(word) AS n, string_agg(lower(word), '|' ORDER BY encode(lower(word))) AS words
FROM texts LEFT JOIN k ON contains(text, lower(word)) GROUP BY doc_id""")
def keyword_match(spark, sf):
    docs = tx.with_normal_text(data.documents(spark, sf), "text", "t").select("doc_id", "t")
    found = rul.keyword_hits(F.col("t"), [rul.fold_keyword(w) for w in KEYWORDS])
    return docs.select("doc_id", F.array_sort(found).alias("w")).select(
        "doc_id", F.size("w").cast("bigint").alias("n"),
        F.when(F.size("w") > 0, F.array_join("w", "|")).alias("words"),
    )


PATTERNS = [r"[a-z0-9.]+@[a-z0-9.]+", 'token = "[0-9a-f]{40}"', r"\b[0-9]{16}\b", r"(?i)LICENSE", r"[[:digit:]]{5}",
            r"(?P<tail>tion)\b", r"^[^ ]+ the ", r"NEVER"]


@query("regex_match", "WITH p(pos, pattern) AS (VALUES " + ", ".join(f"({i}, {sql.q(p)})" for i, p in enumerate(PATTERNS))
       + f"""), texts AS (SELECT doc_id, {sql.normal("text")} AS text FROM documents)
SELECT doc_id, string_agg(pos::varchar, ',' ORDER BY pos) AS hits
FROM texts LEFT JOIN p ON regexp_matches(text, pattern) GROUP BY doc_id""")
def regex_match(spark, sf):
    docs = tx.with_normal_text(data.documents(spark, sf), "text", "t").select("doc_id", "t")
    found = rul.pattern_hits(F.col("t"), PATTERNS)
    position = F.transform(found, lambda p: F.array_position(F.array(*[F.lit(x) for x in PATTERNS]), p) - 1)
    return docs.select("doc_id", F.array_join(F.array_sort(position), ",").alias("h")).select(
        "doc_id", F.when(F.col("h") != "", F.col("h")).alias("hits")
    )


def matched(spark, sf):
    return audit.audit_text(data.traffic(spark, sf), data.RULES, data.RULE_VERSION)


def ids(matches="matches"):
    return F.array_join(F.transform(matches, lambda m: m["rule_id"]), ",")


@query("match_list", sql.AUDIT + " SELECT request_id, match_ids FROM scored")
def match_list(spark, sf):
    return matched(spark, sf).select("request_id", ids().alias("match_ids"))


@query("risk_score", sql.AUDIT + " SELECT tenant_id, risk_score, count(*) AS n FROM scored GROUP BY ALL")
def risk_score(spark, sf):
    return matched(spark, sf).groupBy("tenant_id", "risk_score").agg(F.count("*").alias("n"))


@query("rule_hits", sql.AUDIT + """ SELECT request_id, id AS rule_id, action, weight,
  row_number() OVER (PARTITION BY request_id ORDER BY is_regex, end_pos, -len, pos) - 1 AS match_pos FROM hits""")
def rule_hits(spark, sf):
    return rul.rule_hits(matched(spark, sf), "request_id").select(
        "request_id", "rule_id", "action", "weight", F.col("match_pos").cast("bigint").alias("match_pos")
    )


# ---- large rule set: 1000 keywords taken from a rule, over whole texts

def many_rules(n: int = 1000) -> list[rul.Rule]:
    """n keyword rules of two or three syllables, so that some hit and most do not."""
    a = ["the", "on", "er", "re", "en", "al", "ou", "is", "un", "que"]
    b = ["tion", "nd", "ing", "ment", "aux", "elle", "der", "sch", "ión", "zq"]
    c = ["st", "ha", "th", "on", "ei", "qu", "xx", "yy", "zz", "ww"]
    return [
        rul.Rule(f"k{i}", f"k{i}", a[i % 10] + b[i // 10 % 10] + c[i // 100 % 10], "low", "monitor", 1 + i % 7)
        for i in range(n)
    ]


@query("rule_set_1000", f"""WITH texts AS (SELECT doc_id, {sql.normal("text")} AS text FROM documents),
{sql.rules("rules", many_rules())},
h AS (SELECT doc_id, least(sum(weight), 100) AS score, count(*) AS n FROM texts JOIN rules ON contains(text, pattern) GROUP BY doc_id)
SELECT t.doc_id, coalesce(score, 0)::int AS risk_score, coalesce(n, 0) AS n FROM texts t LEFT JOIN h USING (doc_id)""")
def rule_set_1000(spark, sf):
    docs = tx.with_normal_text(data.documents(spark, sf), "text", "t").select("doc_id", "t")
    found = docs.withColumn("m", rul.match_list(F.col("t"), many_rules())).drop("t")
    return found.select("doc_id", rul.risk_score(F.col("m")).alias("risk_score"), F.size("m").cast("bigint").alias("n"))


# ---- rule sets

SET_WORDS = ["license", "The ", "tion", "on the", "que"]


def rule_sets(spark, sf):
    """Rule sets from suppliers: several per scope, in three states."""
    key = F.col("s_suppkey")
    word = F.element_at(F.array(*[F.lit(w) for w in SET_WORDS]), (key % 5 + 1).cast("int"))

    def rule(name, pattern, action, weight, regex):
        return F.struct(
            F.lit(name).alias("id"), F.lit(name).alias("name"), pattern.alias("pattern"), F.lit("").alias("severity"),
            F.lit(action).alias("action"), weight.cast("int").alias("weight"), F.lit(regex).alias("regex"),
        )

    return table(spark, sf, "supplier").select(
        key.cast("string").alias("version"),
        F.when(key % 10 == 0, "global").otherwise(F.concat(F.lit("tenant:src"), key % 15)).alias("scope"),
        F.element_at(F.array(F.lit("published"), F.lit("draft"), F.lit("archived")), (F.col("s_nationkey") % 3 + 1).cast("int")).alias("status"),
        F.when(key % 4 == 0, "demo").otherwise("managed").alias("source"),
        F.array(
            rule("word", word, "monitor", key % 40, False),
            rule("card", F.lit(r"\b[0-9]{16}\b"), "redact", F.lit(60), True),
            rule("blank", F.lit(""), "block", F.lit(99), False),
        ).alias("rules"),
        F.timestamp_seconds(F.lit(1704067200) + key * 60).alias("created_at"),
        F.timestamp_seconds(F.lit(1704067200) + (key % 7) * 3600).alias("published_at"),
    )


SETS_SQL = f"""sets AS (
  SELECT s_suppkey::varchar AS version, s_suppkey AS k,
    CASE WHEN s_suppkey % 10 = 0 THEN 'global' ELSE 'tenant:src' || (s_suppkey % 15) END AS scope,
    (['published', 'draft', 'archived'])[s_nationkey % 3 + 1] AS status,
    CASE WHEN s_suppkey % 4 = 0 THEN 'demo' ELSE 'managed' END AS source,
    ({SET_WORDS!r})[s_suppkey % 5 + 1] AS word, s_suppkey % 7 AS published_at,
    CASE WHEN s_suppkey % 40 = 0 THEN 10 ELSE s_suppkey % 40 END AS word_weight
  FROM supplier),
active AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY scope ORDER BY published_at DESC, version DESC) AS rn FROM sets WHERE status = 'published') WHERE rn = 1)"""


@query("active_rule_set", f"""WITH {SETS_SQL} SELECT 'any' AS kind, scope, version FROM active
UNION ALL SELECT 'managed', scope, version FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY published_at DESC, version DESC) AS rn
  FROM sets WHERE status = 'published' AND source = 'managed') WHERE rn = 1""")
def active_rule_set(spark, sf):
    sets = rule_sets(spark, sf)
    every = rul.active_rule_sets(sets).select(F.lit("any").alias("kind"), "scope", "version")
    managed = rul.active_rule_sets(sets, True).select(F.lit("managed").alias("kind"), "scope", "version")
    return every.unionByName(managed)


@query("effective_rules", f"""WITH {SETS_SQL}, {sql.TRAFFIC},
texts AS (SELECT *, {sql.normal("body")} AS text FROM traffic),
chosen AS (SELECT t.request_id, t.text, coalesce(o.version, g.version) AS version, coalesce(o.word, g.word) AS word,
    coalesce(o.word_weight, g.word_weight) AS word_weight
  FROM texts t LEFT JOIN active o ON o.scope = 'tenant:' || t.tenant_id LEFT JOIN active g ON g.scope = 'global')
SELECT request_id, version AS rule_version,
  least(100, (CASE WHEN contains(text, lower(word)) THEN word_weight ELSE 0 END)
    + (CASE WHEN regexp_matches(text, '\\b[0-9]{{16}}\\b') THEN 60 ELSE 0 END))::int AS risk_score
FROM chosen""")
def effective_rules(spark, sf):
    audited = audit.audit_text_by_tenant(data.traffic(spark, sf), rule_sets(spark, sf))
    return audited.select("request_id", "rule_version", "risk_score")


def publications(spark, sf):
    return table(spark, sf, "orders").select(
        F.concat(F.lit("tenant:"), "o_orderpriority").alias("scope"), F.col("o_orderdate").alias("ts"),
        F.col("o_orderkey").alias("version"),
    )


PUBLICATIONS_SQL = """one AS (SELECT 'tenant:' || o_orderpriority AS scope, o_orderdate AS ts, max(o_orderkey) AS version
  FROM orders GROUP BY ALL)"""


@query("rule_set_timeline", f"""WITH {PUBLICATIONS_SQL} SELECT scope, version, epoch_ms(ts) AS from_ms,
  epoch_ms(lead(ts) OVER (PARTITION BY scope ORDER BY ts)) AS to_ms FROM one""")
def rule_set_timeline(spark, sf):
    spans = timeline.rule_set_timeline(publications(spark, sf))
    return spans.select("scope", "version", F.unix_millis("valid_from").alias("from_ms"),
                        F.unix_millis("valid_to").alias("to_ms"))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("rules_asof", f"""WITH {PUBLICATIONS_SQL},
probes AS (SELECT 'tenant:' || ({PRIORITIES!r})[l_linenumber % 5 + 1] AS scope, l_shipdate AS ts, l_orderkey, l_linenumber FROM lineitem)
SELECT p.l_orderkey, p.l_linenumber, o.version AS rule_version
FROM probes p ASOF LEFT JOIN one o ON p.scope = o.scope AND p.ts >= o.ts""")
def rules_asof(spark, sf):
    scope = F.element_at(F.array(*[F.lit(p) for p in PRIORITIES]), (F.col("l_linenumber") % 5 + 1).cast("int"))
    probes = table(spark, sf, "lineitem").select(
        F.concat(F.lit("tenant:"), scope).alias("scope"), F.col("l_shipdate").alias("ts"), "l_orderkey", "l_linenumber"
    )
    return timeline.rules_asof(probes, publications(spark, sf)).select(
        "l_orderkey", "l_linenumber", "rule_version"
    )


CHECKED = ["ok[0-9]+", "[", "a(b", "x{2000}", "SK-[a-z]+", "(?=a)b", r"(a)\1", "plain text"]


@query("rule_set_check", f"""WITH r AS (SELECT p_brand AS version,
    CASE WHEN p_brand LIKE '%#1' THEN 'team:' || p_brand WHEN p_brand LIKE '%#2%' THEN 'global' ELSE 'tenant:' || p_brand END AS scope,
    ([{', '.join(sql.q(p) for p in CHECKED)}])[p_partkey % 8 + 1] AS pattern, p_size % 25 <> 0 OR true AS is_regex FROM part),
c AS (SELECT version, scope, count(*) AS n_rules,
    count(*) FILTER (pattern IN ('[', 'a(b', 'x{{2000}}', '(?=a)b', '(a)\\1')) AS n_bad_patterns,
    count(*) FILTER (regexp_matches(pattern, '[A-Z]')) AS n_never_hit FROM r GROUP BY ALL)
SELECT *, concat_ws(',', CASE WHEN scope NOT LIKE 'tenant:%' AND scope <> 'global' THEN 'scope' END,
  CASE WHEN n_rules > 1000 THEN 'rule_count' END, CASE WHEN n_bad_patterns > 0 THEN 'pattern' END) AS errors FROM c""")
def rule_set_check(spark, sf):
    brand = F.col("p_brand")
    rules = table(spark, sf, "part").select(
        brand.alias("version"),
        F.when(brand.endswith("#1"), F.concat(F.lit("team:"), brand)).when(brand.contains("#2"), "global")
        .otherwise(F.concat(F.lit("tenant:"), brand)).alias("scope"),
        F.element_at(F.array(*[F.lit(p) for p in CHECKED]), (F.col("p_partkey") % 8 + 1).cast("int")).alias("pattern"),
        F.lit(True).alias("regex"),
    )
    return rul.rule_set_check(rules)
