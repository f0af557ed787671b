"""URL filters: host and path rules, and link-graph propagation for hosts that no rule reaches.

A rule (action, host, path) fits its host and all subdomains if the url's path starts with the rule's; the longest
fitting rule wins.  Pages that no rule fits take their host's verdict: trust is a personalised PageRank from hosts with
allowed pages along links, distrust one from hosts with blocked pages against the links, and a host is blocked if its
distrust is ``threshold`` or more of the two together.  A host that neither reaches is allowed.

All of it is DataFrame expressions: parsing and rules are one projection, links one regular expression over the page,
edges a partial aggregate per pair of hosts, and each round one join and one aggregate over hosts; both ranks go
through the same rounds, which start from the seeds' own share and end when no host's rank changes by more than
``tolerance`` of itself, however far from the seeds it lies (ranks are doubles: beyond some 4,000 links they are zero).
Rank that reaches a host without links stays there.

Defined results: a null url or one without ``://`` has an empty host and path and no rule, and the empty host links to
nothing; links to the page's own host are no edges; repeated rows count as often as they occur; an empty table gives an
empty table; only the named columns are read.  ``rules`` is a list held in the plan, for up to some hundreds of rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)(?:href|src|action)\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class LinkParams:
    damping: float = 0.85
    rounds: int = 8            # of the SQL check only, whose pages hold no links to other hosts
    tolerance: float = 1e-10   # largest share by which a round may still change the rank of any host
    threshold: float = 0.5


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest fitting rule; null where none fits."""
    rule = action = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1:])):       # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, action = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(action)
    return rule, action


def host_edges(pages: DataFrame, url: str, html: str) -> DataFrame:
    """``src, dst, n``: how many links lead from pages of one host to another host."""
    return (pages.select(url_host(F.col(url)).alias("src"),
                         F.explode(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1))).alias("link"))
            .select("src", F.translate("link", UPPER, LOWER).alias("dst"))
            .filter("src != '' AND src != dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("n")))


def host_verdicts(seeds: DataFrame, edges: DataFrame, p: LinkParams = LinkParams()) -> DataFrame:
    """``host, trust, distrust, verdict`` of every host reached, from ``seeds`` (host, allowed, blocked page counts)
    and ``edges`` (src, dst, n)."""
    total = seeds.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b"))
    start = (seeds.crossJoin(F.broadcast(total))                    # one row
             .select("host", F.explode(F.array(
                 F.struct(F.lit(0).alias("kind"), F.try_divide("allowed", "a").alias("rank")),
                 F.struct(F.lit(1).alias("kind"), F.try_divide("blocked", "b").alias("rank")))).alias("s"))
             .select("s.kind", "host", "s.rank").filter("rank > 0").checkpoint())
    ways = (edges.select(F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "n"),
        F.struct(F.lit(1).alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "n"))).alias("e"))
        .select("e.*"))
    out = ways.groupBy("kind", "host").agg(F.sum("n").alias("out"))
    ways = ways.join(out, ["kind", "host"]).select("kind", "host", "to", (F.col("n") / F.col("out")).alias("share"))
    ways = ways.checkpoint()
    base = start.select("kind", "host", (F.col("rank") * (1 - p.damping)).alias("rank"))
    ranks, moved = base, 1.0
    # Ranks only grow, and a host reached for the first time changes by all of its rank, so paths of any length end.
    while moved > p.tolerance:
        given = ranks.join(ways, ["kind", "host"]).select(
            "kind", F.col("to").alias("host"), (F.col("rank") * F.col("share") * p.damping).alias("rank"))
        new = base.union(given).withColumn("old", F.lit(0.0))
        held = ranks.select("kind", "host", F.lit(0.0).alias("rank"), F.col("rank").alias("old"))
        sums = new.union(held).groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("old").alias("old")).checkpoint()
        moved = sums.agg(F.max(F.try_divide(F.col("rank") - F.col("old"), F.col("rank")))).first()[0] or 0.0
        ranks = sums.drop("old")
    both = ranks.groupBy("host").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == 0, F.col("rank"))), F.lit(0.0)).alias("trust"),
        F.coalesce(F.sum(F.when(F.col("kind") == 1, F.col("rank"))), F.lit(0.0)).alias("distrust"))
    blocked = F.round(F.try_divide("distrust", F.col("trust") + F.col("distrust")), 9) >= p.threshold
    return both.withColumn("verdict", F.when(blocked, "block").otherwise("allow"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], p: LinkParams = LinkParams(), key: str = "page_id",
          url: str = "url", html: str = "html") -> DataFrame:
    """``key, host, path, rule, verdict`` of every page."""
    host, path = url_host(F.col(url)), url_path(F.col(url))
    parsed = pages.select(F.col(key).alias("page_key"), host.alias("host"), path.alias("path"))
    rule, action = fitting_rule(F.col("host"), F.col("path"), rules)
    ruled = parsed.select("*", rule.alias("rule"), action.alias("action"))
    seeds = (ruled.filter("host != ''").groupBy("host")
             .agg(F.sum(F.when(F.col("action") == "allow", 1).otherwise(0)).alias("allowed"),
                  F.sum(F.when(F.col("action") == "block", 1).otherwise(0)).alias("blocked")))
    verdicts = host_verdicts(seeds, host_edges(pages, url, html), p).select("host", "verdict")
    return (ruled.join(verdicts, "host", "left")
            .select(F.col("page_key").alias(key), "host", "path", "rule",
                    F.coalesce("action", "verdict", F.lit("allow")).alias("verdict")))
