"""DuckDB SQL for the queries that SQL can express."""

#: Words of a text: runs of characters other than the six ASCII blanks.
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPLICATES = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words
),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
flat AS (SELECT doc_id, md5_number(unnest(s)) AS h FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM flat a JOIN flat b ON a.h = b.h AND a.doc_id < b.doc_id
  GROUP BY ALL
),
linked AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared.n >= 85 * (x.n + y.n - shared.n)
),
both_ways AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (
  SELECT DISTINCT a AS doc_id, a AS other FROM both_ways
  UNION
  SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.other
),
lowest AS (SELECT doc_id, min(other) AS component FROM reach GROUP BY doc_id)
SELECT doc_id, n AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
FROM sizes LEFT JOIN lowest USING (doc_id)
"""


def url_graph(rules: list[tuple[str, str, str]], damping: float, rounds: int, bound: float) -> str:
    """SQL of the URL filter with its rounds written out."""
    listed = ", ".join(f"('{v}', '{h}', '{p}', '{h}{p}')" for v, h, p in rules)
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = low.format("coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')")
    link = r"""(?i)(?:href|src)\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''\s>]+)"""
    parts = [f"""
WITH rules(verdict, host, path, rule) AS (VALUES {listed}),
urls AS (
  SELECT row_number() OVER () AS row, page_id, {host} AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, html
  FROM pages
),
fits AS (
  SELECT row, arg_max(r.rule, (length(r.rule), r.rule)) AS rule, arg_max(r.verdict, (length(r.rule), r.rule)) AS verdict
  FROM urls u JOIN rules r ON (u.host = r.host OR u.host LIKE '%.' || r.host) AND starts_with(u.path, r.path)
  GROUP BY row
),
judged AS (SELECT urls.row, page_id, host, path, rule, verdict, html FROM urls LEFT JOIN fits USING (row)),
start AS (
  SELECT host, {1 - damping!r} * avg((verdict IS NOT DISTINCT FROM 'allow')::int) AS trust,
    {1 - damping!r} * avg((verdict IS NOT DISTINCT FROM 'block')::int) AS distrust
  FROM judged WHERE host <> '' GROUP BY host
),
targets AS (
  SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(html, '{link}', 1), lambda h: {low.format("h")}))) AS dst
  FROM judged WHERE html IS NOT NULL
),
counted AS (
  SELECT src, dst, count(*) AS n FROM targets WHERE src <> '' AND src <> dst GROUP BY ALL
),
links AS (
  SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS forth, n / sum(n) OVER (PARTITION BY dst) AS back FROM counted
),
ranks0 AS (SELECT * FROM start)"""]
    for k in range(rounds):
        parts.append(f"""
ranks{k + 1} AS (
  SELECT host, sum(trust) AS trust, sum(distrust) AS distrust FROM (
    SELECT * FROM start
    UNION ALL SELECT dst, {damping} * trust * forth, 0.0 FROM links JOIN ranks{k} ON host = src
    UNION ALL SELECT src, 0.0, {damping} * distrust * back FROM links JOIN ranks{k} ON host = dst
  ) GROUP BY host
)""")
    return ",".join(parts) + f"""
SELECT page_id, j.host, path, rule,
  coalesce(verdict, CASE WHEN r.distrust > r.trust AND r.distrust >= {bound * (1 - damping) - 1e-12!r} THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN ranks{rounds} r USING (host)
"""

SOURCE_DIVERGENCE = f"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({_LOWER.replace("text", "coalesce(text, '')", 1)}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t
  FROM documents
),
kept AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(t)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 10
),
vocab AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
flat AS (SELECT lang, source, unnest(t) AS term FROM d),
seen AS (SELECT lang, source, term, count(*) AS n FROM flat SEMI JOIN kept USING (lang, term) GROUP BY ALL),
cells AS (
  SELECT lang, source, term, coalesce(n, 0)::hugeint AS n FROM groups JOIN kept USING (lang) LEFT JOIN seen USING (lang, source, term)
),
totals AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total, sum(n) OVER (PARTITION BY lang, term) AS of_lang,
    sum(n) OVER (PARTITION BY lang) AS lang_total
  FROM cells
),
shares AS (
  SELECT lang, source, term, n, (1 + (1000000000 * (n + 2)) // (total + 2 * v))::bigint AS p,
    (1 + (1000000000 * (of_lang + 2)) // (lang_total + 2 * v))::bigint AS q
  FROM totals JOIN vocab USING (lang)
),
gaps AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL
),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::bigint AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN gaps ON gaps.lang = a.lang AND gaps.source = a.source AND gaps.item = b.source
),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM shares WHERE n > 0 AND p > q
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::int AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""

HARD_NEGATIVES = """
WITH listed AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS units
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
rows AS (SELECT vec_id, label, units FROM listed QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, units) = 1),
cells AS (SELECT vec_id, label, unnest(range(1, len(units) + 1)) AS k, unnest(units) AS x FROM rows),
products AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, sum(a.x::hugeint * b.x)::bigint AS score
  FROM cells a JOIN cells b USING (k) WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id GROUP BY ALL
),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, coalesce(score, 0) AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
  LEFT JOIN products p ON p.anchor_id = a.vec_id AND p.vec_id = b.vec_id
),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
  row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::int AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 30 * positive_score::hugeint <= 100 * score::hugeint AND 100 * score::hugeint <= 90 * positive_score::hugeint
QUALIFY rank <= 10
"""
