"""URL filters: host and path rules, and trust spread over the link graph of hosts, in DataFrame functions only.

A rule is a host and a path prefix (``example.org/es/``); it fits its host and all subdomains if the path of the url
starts with the rule's path; the longest rule wins. Urls without a rule get the verdict of their host: trust is a
personalised PageRank from the hosts of which the rules allow more pages than they block, along links; distrust is one
from those of which they block more, against links, so it reaches those who link to blocked hosts. Seeds weigh as much as
the number of pages by which one outweighs the other. A host is blocked if its share
distrust / (trust + distrust) is over a threshold; hosts that neither reaches are allowed. Ranks are spread until less
than TOLERANCE of either is still on its way.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule and is allowed; null html
has no links; repeated rows are judged one by one (their links count again); an empty table gives an empty table; extra
columns are ignored. Ranks are sums of doubles, which the order of rows can change in the last digits.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonelake.llm.common import materialise

DAMPING, THRESHOLD, TOLERANCE = 0.85, 0.5, 1e-9
#: Steps between two checks of what is left.
STEPS = 4
#: Hosts up to which their verdicts are broadcast; beyond, a join with skew handling takes over.
BROADCAST_HOSTS = 100_000
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null if none does. rules: (verdict, "host/path")."""
    found = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, prefix = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{prefix}")
        made = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = (F if found is None else found).when(fits, made)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if found is None else found


def host_edges(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(src, dst, pages): how many pages of one host link to another."""
    linked = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(f"`{html_col}`"), F.lit("")), F.lit(LINK), F.lit(1)))
    links = pages.select(host_of(F.col(f"`{url_col}`")).alias("src"), F.explode(linked).alias("dst"))
    links = links.select("src", F.translate("dst", string.ascii_uppercase, string.ascii_lowercase).alias("dst")).where("src <> '' and src <> dst")
    return links.groupBy("src", "dst").agg(F.count("*").alias("pages"))


def spread(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Personalised PageRank (side, host, rank) of weighted edges (side, src, dst, w) from seeds (side, host, rank).

    Each step moves the mass that is left along the edges; it ends when under TOLERANCE is left on every side. The mass of
    hosts without outgoing edges goes back to the seeds, which is the same as dividing by what was reached.
    """
    outgoing = edges.groupBy("side", "src").agg(F.sum("w").alias("total"))
    shares = materialise(edges.join(outgoing, ["side", "src"]).select("side", F.col("src").alias("host"), "dst", (F.col("w") / F.col("total")).alias("share")))
    state = seeds.select("side", "host", (F.col("rank") * (1 - DAMPING)).alias("rank"), F.col("rank").alias("left"))
    left = 1.0
    while left > TOLERANCE and not shares.isEmpty():
        for _ in range(STEPS):
            moved = state.where("left > 0").join(shares, ["side", "host"]).select("side", F.col("dst").alias("host"), (F.col("left") * F.col("share") * DAMPING).alias("left"))
            both = state.select("side", "host", "rank", F.lit(0.0).alias("left")).union(moved.select("side", "host", F.col("left") * (1 - DAMPING), "left"))
            state = both.groupBy("side", "host").agg(F.sum("rank").alias("rank"), F.sum("left").alias("left"))
        state = materialise(state)
        left = max((r[0] for r in state.groupBy("side").agg(F.sum("left")).select("sum(left)").collect()), default=0.0)
    reached = {r["side"]: r["rank"] for r in state.groupBy("side").agg(F.sum("rank").alias("rank")).collect()}
    whole = F.when(F.col("side") == "trust", F.lit(reached.get("trust", 1.0))).otherwise(F.lit(reached.get("distrust", 1.0)))
    return state.select("side", "host", (F.col("rank") / whole).alias("rank"))


def host_verdicts(edges: DataFrame, hosts: DataFrame) -> DataFrame:
    """(host, trust, distrust, blocked) of all hosts reached; hosts: (host, allowed, blocked) weights of seeds."""
    totals = hosts.agg(F.sum("allowed").alias("trust"), F.sum("blocked").alias("distrust")).first()

    def seeds(side: str, name: str) -> DataFrame:
        return hosts.where(F.col(name) > 0).select(F.lit(side).alias("side"), "host", (F.col(name) / F.lit(float(totals[side] or 1))).alias("rank"))

    along = edges.select(F.lit("trust").alias("side"), "src", "dst", F.col("pages").cast("double").alias("w"))
    against = along.select(F.lit("distrust"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    ranks = spread(along.union(against), seeds("trust", "allowed").union(seeds("distrust", "blocked")))
    of = lambda side: F.sum(F.when(F.col("side") == side, F.col("rank")).otherwise(0.0)).alias(side)
    both = ranks.groupBy("host").agg(of("trust"), of("distrust"))
    return both.withColumn("host_blocked", F.col("distrust") > THRESHOLD * (F.col("trust") + F.col("distrust")))


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, host, path, the rule that decides (null if none), verdict, and the ranks of its host."""
    url = F.col(f"`{url_col}`")
    urls = pages.select(F.col(f"`{id_col}`").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    urls = urls.withColumn("found", longest_rule(F.col("host"), F.col("path"), rules))
    more = F.sum(F.when(F.col("found.verdict") == "allow", 1).when(F.col("found.verdict") == "block", -1).otherwise(0))
    hosts = urls.groupBy("host").agg(more.alias("more"))
    hosts = materialise(hosts.select("host", F.greatest("more", F.lit(0)).alias("allowed"), F.greatest(-F.col("more"), F.lit(0)).alias("blocked")))
    verdicts = materialise(host_verdicts(materialise(host_edges(pages, url_col, html_col)), hosts))
    small = verdicts.count() <= BROADCAST_HOSTS
    judged = urls.join(F.broadcast(verdicts) if small else verdicts, "host", "left")
    own = F.when(F.col("host_blocked"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", own).alias("verdict"), F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"))
