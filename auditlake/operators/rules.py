"""Rule matching: defaults, keyword and pattern hits, ordered match list, risk score."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.functions import regex
from auditlake.plans.lookup import lookup
from auditlake.schemas import RULE

# Up to this many keywords each get a literal ``contains``; beyond it one shared-prefix
# pattern finds all of them in a single pass over the text.
LITERAL_KEYWORDS = 32
MAX_RULES_PER_SET = 1000
# Distinct patterns of all published sets that may be compiled into one plan.
MAX_COMPILED_PATTERNS = 20_000

DEFAULT_WEIGHT, DEFAULT_SEVERITY, DEFAULT_ACTION = 10, "medium", "monitor"
_MATCH_FIELDS = ["rule_id", "name", "severity", "action", "weight", "evidence"]
NO_MATCHES = "array<struct<rule_id:string,name:string,severity:string,action:string,weight:int,evidence:string>>"


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    pattern: str
    severity: str = ""
    action: str = ""
    weight: int = 0
    regex: bool = False


def active(rules: Sequence[Rule]) -> list[Rule]:
    """Rules that take part, with defaults filled in."""
    return [
        Rule(
            r.id, r.name, r.pattern, r.severity or DEFAULT_SEVERITY, r.action or DEFAULT_ACTION,
            r.weight if r.weight > 0 else DEFAULT_WEIGHT, r.regex,
        )
        for r in rules
        if r.pattern
    ]


def rule_defaults(rules: DataFrame) -> DataFrame:
    """The same on a table with one rule per row."""
    def filled(name: str, value: str) -> Column:
        return F.when(F.coalesce(F.col(name), F.lit("")) == "", value).otherwise(F.col(name))

    return rules.filter(F.coalesce(F.col("pattern"), F.lit("")) != "").withColumns(
        {
            "weight": F.when(F.coalesce(F.col("weight"), F.lit(0)) <= 0, DEFAULT_WEIGHT)
            .otherwise(F.col("weight")).cast("int"),
            "severity": filled("severity", DEFAULT_SEVERITY),
            "action": filled("action", DEFAULT_ACTION),
            "regex": F.coalesce(F.col("regex"), F.lit(False)),
        }
    )


def fold_keyword(pattern: str) -> str:
    """Rune-wise lower case; keywords are not otherwise normalised."""
    return "".join({"İ": "i", "Σ": "σ"}.get(c, c.lower()) for c in pattern)


def keyword_hits(text: Column, keywords: Sequence[str]) -> Column:
    """array<string> of the given lower-cased keywords that occur in ``text``."""
    words = sorted(set(keywords))
    if not words:
        return F.array().cast("array<string>")
    if len(words) <= LITERAL_KEYWORDS:
        return F.array_compact(F.array(*[F.when(text.contains(F.lit(w)), F.lit(w)) for w in words]))
    # Every start position yields its longest keyword; the keywords that are prefixes of a
    # found one start there too.
    known = set(words)
    prefixes = {w: [w[:n] for n in range(1, len(w) + 1) if w[:n] in known] for w in words}
    found = F.array_distinct(
        F.regexp_extract_all(text, F.lit(f"(?=({regex.keyword_trie(words)}))"), F.lit(1))
    )
    nested = {w: p for w, p in prefixes.items() if len(p) > 1}
    if not nested:
        return found
    table = F.from_json(
        F.lit(_json(nested)), T.MapType(T.StringType(), T.ArrayType(T.StringType()))
    )
    expanded = F.transform(found, lambda w: F.coalesce(F.try_element_at(table, w), F.array(w)))
    return F.array_distinct(F.flatten(expanded))


def _json(value) -> str:
    return json.dumps(value, ensure_ascii=False)


def pattern_hit(text: Column, pattern: str) -> Column:
    """Unanchored match, after cheaper tests that every matching text passes."""
    hit = text.rlike(regex.to_java(pattern))
    if regex.has_boundary(pattern):
        # Word boundaries are costly to try at every position.
        hit = text.rlike(regex.without_boundaries(pattern)) & hit
    literal = regex.required_literal(pattern)
    return text.contains(F.lit(literal)) & hit if literal else hit


def pattern_hits(text: Column, patterns: Sequence[str]) -> Column:
    """array<string> of the given patterns that match ``text`` anywhere."""
    unique = sorted(set(patterns))
    if not unique:
        return F.array().cast("array<string>")
    return F.array_compact(
        F.array(*[F.when(pattern_hit(text, p), F.lit(p)) for p in unique])
    )


def _struct(rule: Rule) -> Column:
    values = [rule.id, rule.name, rule.severity, rule.action, rule.weight, rule.pattern]
    return F.struct(
        *[F.lit(v).cast("int" if f == "weight" else "string").alias(f)
          for f, v in zip(_MATCH_FIELDS, values)]
    )


def _sort_key(is_pattern, end, length, position) -> list[Column]:
    """Keywords by first end offset, then longer first, then position; patterns after, by position."""
    return [
        is_pattern.alias("kind"), end.alias("end"), (-length).alias("shorter"), position.alias("pos"),
    ]


def match_list(text: Column, rules: Sequence[Rule]) -> Column:
    """Ordered array of matches of one rule set over lower-cased, normalised text."""
    rules = active(rules)
    keywords = [fold_keyword(r.pattern) for r in rules if not r.regex]
    if len(set(keywords)) > LITERAL_KEYWORDS:
        return _match_many(text, rules)
    hits = []
    for position, rule in enumerate(rules):
        pos = F.lit(position)
        if rule.regex:
            hit = pattern_hit(text, rule.pattern)
            key = _sort_key(F.lit(1), F.lit(0), F.lit(0), pos)
        else:
            word = fold_keyword(rule.pattern)
            hit = text.contains(F.lit(word))
            key = _sort_key(F.lit(0), F.instr(text, word) + len(word), F.lit(len(word)), pos)
        hits.append(F.when(hit, F.struct(*key, _struct(rule).alias("m"))))
    if not hits:
        return F.array().cast(NO_MATCHES)
    return F.transform(F.array_sort(F.array_compact(F.array(*hits))), lambda h: h["m"])


def _match_many(text: Column, rules: Sequence[Rule]) -> Column:
    # Rule structs travel as one JSON literal keyed by keyword, so plan size grows by bytes,
    # not by expressions.
    by_word: dict[str, list[dict]] = {}
    for position, rule in enumerate(rules):
        if not rule.regex:
            by_word.setdefault(fold_keyword(rule.pattern), []).append(
                {"pos": position, "m": dict(zip(_MATCH_FIELDS, [
                    rule.id, rule.name, rule.severity, rule.action, rule.weight, rule.pattern]))}
            )
    table = F.from_json(
        F.lit(_json(by_word)),
        F.lit(f"map<string,array<struct<pos:int,m:{NO_MATCHES[6:-1]}>>>"),
    )
    words = keyword_hits(text, list(by_word))
    by_keyword = F.flatten(
        F.transform(
            words,
            lambda w: F.transform(
                F.try_element_at(table, w),
                lambda r: F.struct(
                    *_sort_key(F.lit(0), F.instr(text, w) + F.length(w), F.length(w), r["pos"]),
                    r["m"].alias("m"),
                ),
            ),
        )
    )
    by_pattern = [
        F.when(
            pattern_hit(text, r.pattern),
            F.struct(*_sort_key(F.lit(1), F.lit(0), F.lit(0), F.lit(p)), _struct(r).alias("m")),
        )
        for p, r in enumerate(rules)
        if r.regex
    ]
    keyed = F.array_sort(F.concat(by_keyword, F.array_compact(F.array(*by_pattern)))
                         if by_pattern else by_keyword)
    return F.transform(keyed, lambda h: h["m"])


def risk_score(matches: Column) -> Column:
    """Sum of the weights, at most 100 (added up as long, so many matches cannot overflow)."""
    total = F.aggregate(
        matches, F.lit(0).cast("long"), lambda acc, m: acc + F.coalesce(m["weight"], F.lit(0))
    )
    return F.least(total, F.lit(100)).cast("int")


def rule_hits(matched: DataFrame, *columns: str) -> DataFrame:
    """One row per (text, matched rule)."""
    return matched.select(*columns, F.posexplode("matches").alias("match_pos", "m")).select(
        *columns, "match_pos", "m.*"
    )


def active_rule_sets(rule_sets: DataFrame, managed_only: bool = False) -> DataFrame:
    """Latest published set per scope; of equal times, the highest version."""
    published = rule_sets.filter(F.col("status") == "published")
    if managed_only:
        published = published.filter(F.col("source") == "managed")
    newest = F.max_by(F.struct(*rule_sets.columns), F.struct("published_at", "version"))
    return published.groupBy("scope").agg(newest.alias("s")).select("s.*")


def effective_rule_set(traffic: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """Attach ``columns`` of the tenant's own set, or of the global one, to each text.

    ``sets`` has one row per scope. The global set is one value, read as a scalar subquery;
    the tenant side is broadcast if its measured size allows and salted otherwise.
    """
    wanted = F.struct(*columns)
    tenant = sets.filter(F.col("scope").startswith("tenant:")).select(
        F.expr("substring(scope, 8)").alias("tenant_id"), wanted.alias("__tenant_set")
    )
    everyone = sets.filter(F.col("scope") == "global").agg(F.max_by(wanted, F.col("version"))).scalar()
    joined = lookup(traffic, tenant, ["tenant_id"], F.col("request_id"))
    joined = joined.withColumn("__global_set", everyone)
    chosen = F.coalesce("__tenant_set", "__global_set")
    return joined.select(*traffic.columns, *[chosen[c].alias(c) for c in columns])


def match_effective(traffic: DataFrame, sets: DataFrame, text: str = "text") -> DataFrame:
    """Audit each text with the rule set in force for its tenant.

    The distinct patterns of all sets are compiled once into the plan, and each row keeps
    the hits that belong to its own set. Above MAX_COMPILED_PATTERNS patterns (checked by
    reading at most one more than that) each row evaluates its own set instead.
    """
    definitions = rule_defaults(
        sets.select(F.explode("rules").alias("r")).select("r.*")
    ).select("pattern", "regex").distinct()
    sample = definitions.limit(MAX_COMPILED_PATTERNS + 1).collect()
    compiled = len(sample) <= MAX_COMPILED_PATTERNS
    columns = ["version", "rules"]
    if not compiled:
        sets = sets.withColumn("java_patterns", java_patterns(F.col("rules.pattern"), F.col("rules.regex")))
        columns.append("java_patterns")
    rows = effective_rule_set(traffic, sets, *columns).withColumnRenamed("version", "rule_version")
    body = F.col(text)

    def folded(rule: Column) -> Column:
        return F.lower(F.translate(rule["pattern"], "İΣ", "iσ"))

    if not compiled:
        def hit(rule: Column, position: Column) -> Column:
            java = F.get("java_patterns", position)
            return F.when(rule["regex"], F.rlike(body, java)).otherwise(body.contains(folded(rule)))
    else:
        words = {fold_keyword(r["pattern"]) for r in sample if not r["regex"]}
        patterns = {r["pattern"] for r in sample if r["regex"]}
        rows = rows.withColumns(
            {"__words": keyword_hits(body, words), "__patterns": pattern_hits(body, patterns)}
        )

        def hit(rule: Column, position: Column) -> Column:
            return F.when(rule["regex"], F.array_contains("__patterns", rule["pattern"])).otherwise(
                F.array_contains("__words", folded(rule))
            )

    def entry(rule: Column, position: Column) -> Column:
        is_pattern = F.coalesce(rule["regex"], F.lit(False))
        end = F.when(is_pattern, 0).otherwise(
            F.position(folded(rule), body) + F.length(folded(rule))
        )
        match = F.struct(
            rule["id"].alias("rule_id"), rule["name"].alias("name"),
            _or_default(rule["severity"], DEFAULT_SEVERITY).alias("severity"),
            _or_default(rule["action"], DEFAULT_ACTION).alias("action"),
            F.when(F.coalesce(rule["weight"], F.lit(0)) <= 0, DEFAULT_WEIGHT)
            .otherwise(rule["weight"]).cast("int").alias("weight"),
            rule["pattern"].alias("evidence"),
        )
        length = F.when(is_pattern, 0).otherwise(F.length(folded(rule)))
        key = _sort_key(is_pattern.cast("int"), end, length, position)
        applies = (F.coalesce(rule["pattern"], F.lit("")) != "") & hit(rule, position)
        return F.when(applies, F.struct(*key, match.alias("m")))

    matched = F.transform(
        F.array_sort(F.array_compact(F.transform(F.coalesce("rules", F.array().cast(f"array<{RULE}>")), entry))),
        lambda h: h["m"],
    )
    return rows.withColumn("matches", matched).drop(
        "rules", "java_patterns", "__words", "__patterns"
    )


def _or_default(value: Column, default: str) -> Column:
    return F.when(F.coalesce(value, F.lit("")) == "", default).otherwise(value)


@F.pandas_udf(T.StringType())
def pattern_problem(patterns: pd.Series) -> pd.Series:
    """Why a pattern is refused (null when it is fine); checked batch by batch."""
    return patterns.map(lambda p: None if p is None else regex.problem(p))


@F.pandas_udf(T.ArrayType(T.StringType()))
def java_patterns(patterns: pd.Series, is_regex: pd.Series) -> pd.Series:
    """Java spelling of the regular expressions of one set (null for keywords)."""
    return pd.Series(
        [[regex.to_java(p) if r else None for p, r in zip(ps, rs)]
         for ps, rs in zip(patterns, is_regex)]
    )


def rule_set_check(rules: DataFrame) -> DataFrame:
    """One row per set: number of rules, refused patterns, patterns that can never hit, errors.

    ``rules`` has one row per (version, scope, rule). Upper-case literals in a regular
    expression can never hit lower-cased text, so they are counted as a warning.
    """
    # Every distinct pattern is compiled once, however many sets share it.
    distinct = rules.filter("regex").select("pattern").distinct()
    problems = distinct.withColumn("problem", pattern_problem("pattern")).filter(
        F.col("problem").isNotNull()
    )
    marked = rules.join(problems, "pattern", "left")
    never = F.col("regex") & F.regexp_replace("pattern", r"\\.|\(\?[^)]*", "").rlike("[A-Z]")
    sets = marked.groupBy("version", "scope").agg(
        F.count("*").alias("n_rules"),
        F.count_if(F.col("regex") & F.col("problem").isNotNull()).alias("n_bad_patterns"),
        F.count_if(never).alias("n_never_hit"),
    )
    scope_ok = (F.col("scope") == "global") | F.col("scope").startswith("tenant:")
    errors = F.array_compact(
        F.array(
            F.when(~scope_ok, "scope"),
            F.when((F.col("n_rules") < 1) | (F.col("n_rules") > MAX_RULES_PER_SET), "rule_count"),
            F.when(F.col("n_bad_patterns") > 0, "pattern"),
        )
    )
    return sets.withColumn("errors", F.array_join(errors, ","))
