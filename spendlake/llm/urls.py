"""URL filters with link-graph propagation (operator 10).

Every URL is judged by the longest rule that fits its host and path.  URLs without a rule get
the verdict of their host: trust flows along host links from hosts whose pages the rules allow
(personalised PageRank), distrust flows against the links from hosts whose pages the rules block
(a host that links to blocked hosts is suspect), and a host is blocked when its distrust exceeds
its trust by the threshold.  Scores are relative to the seeds (a seed's own weight is the share
of its pages that a rule decides), so they do not depend on the number of hosts.

Host edges are counted distinct per page and pre-aggregated, links of a host to itself are left
out.  Built-in functions only.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule and is
allowed by the method (the empty host takes no part in the graph); a null html has no links;
repeated rows count as pages of their own; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialise

BLOCK, ALLOW = "block", "allow"

# Fixed values: (host, path, verdict); a small list that is written into the plan.
RULES = (
    ("net", "/", BLOCK),
    ("example.net", "/en/", ALLOW),
    ("example.com", "/de/", BLOCK),
    ("org", "/fr/", ALLOW),
)


@dataclass(frozen=True)
class LinkSettings:
    """``threshold``: distrust minus trust from which a host is blocked, as a share of what a host
    gets all of whose pages are blocked and that has no links.  ``rounds``: least number of rounds;
    ``tolerance``: summed change of all scores over ``cut_every`` rounds at which they count as settled."""

    damping: float = 0.85
    rounds: int = 20
    cut_every: int = 4
    threshold: float = 0.5
    tolerance: float = 1e-6


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    ordered = sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r[0], r[1]))
    for rule_host, rule_path, verdict in ordered:
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        answer = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, answer).otherwise(found)
    return found


def judged_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, __r (rule and verdict, or null)."""
    parts = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    return parts.withColumn("__r", longest_rule(F.col("host"), F.col("path"), rules))


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: pages of src that link to dst, from absolute and scheme-relative links."""
    links = F.regexp_extract_all(
        F.col("html"), F.lit(r"(?i)\bhref\s*=\s*[\"']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s>]+)"), F.lit(1))
    targets = F.array_distinct(F.transform(links, lambda x: url_host(F.regexp_replace(x, r"^//", "any://"))))
    return (
        pages.select(url_host(F.col("url")).alias("src"), F.explode(targets).alias("dst"))
        .where((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst")))
        .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    )


def seed_hosts(judged: DataFrame) -> DataFrame:
    """host, trusted, blocked: shares of the host's pages that rules allow or block."""
    verdict = F.col("__r.verdict")
    share = lambda v: F.coalesce(F.avg(F.when(verdict == v, 1.0).otherwise(0.0)), F.lit(0.0))
    return judged.where(F.col("host") != "").groupBy("host").agg(
        share(ALLOW).alias("trusted"), share(BLOCK).alias("blocked"))


def propagate(edges: DataFrame, seeds: DataFrame, settings: LinkSettings = LinkSettings()) -> DataFrame:
    """Personalised PageRank over weighted edges (src, dst, n) from seeds (host, seed): host, score.

    ``score(h) = (1 - d) * seed(h) + d * sum over u->h of score(u) * n(u, h) / n(u, all)``.

    Rounds go on until the scores settle: the sum of all changes shrinks by d a round, so what is still to
    come after a change of x over k rounds is at most x * d**k / (1 - d**k)."""
    d = settings.damping
    out = edges.groupBy("src").agg(F.sum("n").alias("__all"))
    shares = materialise(
        edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("__all")).alias("__share")), "edges")
    base = seeds.select("host", (F.col("seed") * (1 - d)).alias("__base"))
    rank = base.select("host", F.col("__base").alias("score"))
    if shares.isEmpty():  # nothing flows: the sum above is empty for every host
        return rank
    done, before = 0, rank
    while True:
        moved = (
            shares.join(rank.withColumnRenamed("host", "src"), "src")
            .groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("score") * F.col("__share") * d).alias("__in"))
        )
        rank = base.join(moved, "host", "full").select(
            "host", (F.coalesce("__base", F.lit(0.0)) + F.coalesce("__in", F.lit(0.0))).alias("score"))
        done += 1
        if done % settings.cut_every:
            continue
        rank = materialise(rank, "rank")
        if done >= settings.rounds:
            both = rank.join(before.withColumnRenamed("score", "__before"), "host", "full")
            change = both.agg(F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("__before", F.lit(0.0))))).first()[0]
            if (change or 0.0) <= settings.tolerance:
                return rank
        before = rank


def host_verdicts(judged: DataFrame, edges: DataFrame, settings: LinkSettings = LinkSettings()) -> DataFrame:
    """host, trust, distrust, host_verdict."""
    seeds = materialise(seed_hosts(judged), "seeds")
    edges = materialise(edges, "links")
    trust = propagate(edges, seeds.select("host", F.col("trusted").alias("seed")), settings)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = propagate(back, seeds.select("host", F.col("blocked").alias("seed")), settings)
    both = trust.withColumnRenamed("score", "trust").join(
        distrust.withColumnRenamed("score", "distrust"), "host", "full")
    scored = both.select("host", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("trust", "distrust")])
    bad = F.col("distrust") - F.col("trust") >= settings.threshold * (1 - settings.damping)
    return scored.withColumn("host_verdict", F.when(bad, BLOCK).otherwise(ALLOW))


def url_verdicts(pages: DataFrame, rules=RULES, settings: LinkSettings = LinkSettings()) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every page."""
    pages = pages.select("page_id", "url", "html")
    judged = judged_urls(pages, rules)
    hosts = materialise(host_verdicts(judged, host_edges(pages), settings), "hosts")
    joined = judged.join(hosts, "host", "left")
    return joined.select(
        "page_id", "host", "path", F.col("__r.rule").alias("rule"),
        F.coalesce(F.col("__r.verdict"), F.col("host_verdict"), F.lit(ALLOW)).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
