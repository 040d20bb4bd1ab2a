"""URL filter: host and path rules, and trust and distrust propagated over links between hosts.

Trusted hosts pass personalised PageRank along links, blocked hosts pass distrust against them: who
links to a blocked host becomes suspect. Everything is DataFrame work on one row for each pair of
hosts; each round is written once, so it depends on no earlier one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.shared import written


@dataclass(frozen=True)
class Rule:
    """Fits `host` and its subdomains where the path starts with `path`."""

    verdict: str
    host: str
    path: str


@dataclass(frozen=True)
class Propagation:
    """`damping` of what a host has goes over its links in each of `rounds` rounds.

    A host is blocked if its distrust exceeds its trust and is at least `bound` of what a host
    with all pages blocked starts with.
    """

    damping: float = 0.85
    rounds: int = 10
    bound: float = 0.5


#: Rules are configuration, held in the plan; more are refused.
MAX_RULES = 10_000
#: Targets of links with a host, in attributes of an HTML page.
LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(length, rule, verdict) of the longest rule that fits, the first by name of equal ones; else null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    if not rules:
        return F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    entries = []
    for name in sorted({r.host for r in rules}):
        mine = [F.struct(F.lit(r.path).alias("path"), F.lit(r.verdict).alias("verdict")) for r in rules if r.host == name]
        entries += [F.lit(name), F.array(*mine)]
    by_host, labels = F.create_map(*entries), F.split(host, "[.]")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    known = F.filter(ends, lambda e: F.map_contains_key(by_host, e))
    each = F.transform(known, lambda e: F.transform(by_host[e], lambda r: F.struct(
        (F.length(e) + F.length(r.path)).alias("length"), F.concat(e, r.path).alias("rule"), r.verdict.alias("verdict"),
        r.path.alias("path"),
    )))
    fits = F.filter(F.flatten(each), lambda r: F.startswith(path, r.path))
    return F.array_max(F.transform(fits, lambda r: F.struct(r.length.alias("length"), r.rule.alias("rule"), r.verdict.alias("verdict"))))


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links from hosts to other hosts in (url, html)."""
    found = F.transform(F.regexp_extract_all("html", F.lit(LINK), 1), lambda h: F.translate(h, _UPPER, _LOWER))
    links = pages.where("html is not null").select(host_of(F.col("url")).alias("src"), F.explode(F.array_distinct(found)).alias("dst"))
    return links.where("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, links: DataFrame, how: Propagation = Propagation()) -> DataFrame:
    """(host, trust, distrust) from seeds (host, trusted, blocked; 0 to 1) over links (src, dst, n).

    Hosts without links pass nothing on. An empty link table leaves the seeds' own shares.
    """
    out = links.groupBy("src").agg(F.sum("n").alias("n_out"))
    in_ = links.groupBy("dst").agg(F.sum("n").alias("n_in"))
    links = links.join(out, "src").join(in_, "dst")
    links = written(links.select("src", "dst", (F.col("n") / F.col("n_out")).alias("forth"), (F.col("n") / F.col("n_in")).alias("back")), "links")
    start = seeds.select("host", ((1 - how.damping) * F.col("trusted")).alias("trust"), ((1 - how.damping) * F.col("blocked")).alias("distrust"))
    start = written(start, "seeds")
    now, zero = start, F.lit(0.0)
    for _ in range(how.rounds if not links.isEmpty() else 0):
        forth = links.join(now.where("trust > 0").select(F.col("host").alias("src"), "trust"), "src")
        forth = forth.select(F.col("dst").alias("host"), (how.damping * F.col("trust") * F.col("forth")).alias("trust"), zero.alias("distrust"))
        back = links.join(now.where("distrust > 0").select(F.col("host").alias("dst"), "distrust"), "dst")
        back = back.select(F.col("src").alias("host"), zero.alias("trust"), (how.damping * F.col("distrust") * F.col("back")).alias("distrust"))
        moved = start.union(forth).union(back).groupBy("host")
        now = written(moved.agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")), "ranks")
    return now


def judged_urls(pages: DataFrame, rules: Sequence[Rule], how: Propagation = Propagation()) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages (page_id, url, html).

    `rule` is the longest rule that fits, host and path, and gives the verdict; without one, `rule`
    is null and the verdict is the host's. Seeds of a host are the shares of its pages that rules
    allow and block. A null url, or one without ://, has an empty host and path; an empty host is
    allowed and takes no part in links. A null html has no links. Repeated rows count as pages of
    their own; further columns are ignored; an empty table gives an empty table.
    """
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    share = {k: F.avg(F.when(F.col("best.verdict") == v, 1.0).otherwise(0.0)).alias(k) for k, v in (("trusted", "allow"), ("blocked", "block"))}
    seeds = urls.where("host <> ''").groupBy("host").agg(*share.values())
    ranks = propagate(seeds, host_links(pages), how)
    bad = ranks.where((F.col("distrust") > F.col("trust")) & (F.col("distrust") >= how.bound * (1 - how.damping) - 1e-12))
    judged = urls.join(bad.select("host", F.lit(True).alias("bad")), "host", "left")
    host = F.when(F.col("bad"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", host).alias("verdict"))
