"""URL filters: rules on hosts and paths, and trust that spreads over the link graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T

#: (verdict, rule): the rules of op8's contract. A rule is a host and a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DAMPING = 0.85
ROUNDS = 20
#: A host is blocked where its share of distrust exceeds its share of trust by more than this.
THRESHOLD = 0.4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z in lower case; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), or null.

    A rule fits its host and all subdomains where the path starts with the rule's path. Of rules of
    one length the first in code point order holds. The list of rules is a parameter that stands in
    the query's text; it doesn't grow with the data.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda x: (len(x[1]), [-ord(c) for c in x[1]])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, counted. `pages` has (host, html).

    Links without a host stay on their page's host and are no edges of this graph.
    """
    link = F.regexp_extract_all("html", F.lit(r"""(?i)\b(?:href|src)\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^/?#"'\s>]+)"""), F.lit(1))
    x = pages.select(F.col("host").alias("src"), F.explode(link).alias("link"))
    x = x.withColumn("dst", F.translate(F.regexp_extract("link", r"//(.*)$", 1), _UPPER, _LOWER))
    return x.filter("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def _spread(edges: DataFrame, seeds: DataFrame, rounds: int, damping: float) -> DataFrame:
    """(host, r): what the seeds (host, seed) pass on along (src, dst, n), without what hosts without links would."""
    out = edges.groupBy("src").agg(F.sum("n").alias("all"))
    share = T.checkpointed(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("w")))
    own = seeds.filter("seed > 0").select("host", (F.col("seed") * (1 - damping)).alias("r"))
    if share.isEmpty():
        return own
    rank = seeds.filter("seed > 0").select("host", F.col("seed").alias("r"))
    hubs = T.checkpointed(T.hubs_of(share, "src", share.count()))
    for k in range(rounds):
        moved = T.hub_join(share, rank.withColumnRenamed("host", "src"), "src", hubs).select(F.col("dst").alias("host"), (F.col("w") * F.col("r") * damping).alias("r"))
        rank = moved.unionByName(own).groupBy("host").agg(F.sum("r").alias("r"))
        if k % 5 == 4:
            rank = T.checkpointed(rank)
    return rank


def _scaled(rank: DataFrame, seeds: DataFrame) -> DataFrame:
    total = rank.agg(F.sum("r").alias("got")).join(F.broadcast(seeds.filter("seed > 0").agg(F.sum("seed").alias("want"))))  # one row each
    return rank.join(F.broadcast(total)).select("host", (F.col("r") * F.col("want") / F.col("got")).alias("score"))


def _propagated(edges: DataFrame, seeds: DataFrame, rounds: int, damping: float) -> DataFrame:
    """(host, score): personalised PageRank from the seeds (host, seed), along (src, dst, n).

    What hosts without links would pass on goes back to the seeds; by linearity that is one factor at
    the end, so no round needs a global sum. Scores are in units of the seeds' own.
    """
    return _scaled(_spread(edges, seeds, rounds, damping), seeds)


def host_trust(pages: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust, trust_share, distrust_share) of hosts with pages (host, html, verdict).

    Seeds: the share of a host's pages that rules allow, and that they block. Trust flows along the
    links from trusted hosts; distrust flows against them, from blocked hosts to those that link there.

    A seed's mass is split among all hosts that it reaches, so scores fall as the graph grows. A share
    is a score over what the host would have if all hosts were seeds: it tells which part of what can
    reach the host is trust, or distrust, however many others are reached. A host that no rule fits has no
    say of its own in it.
    """
    mean = lambda v: F.avg(F.when(F.col("verdict") == v, 1.0).otherwise(0.0))
    hosts = pages.filter("host <> ''").groupBy("host").agg(mean("allow").alias("allow"), mean("block").alias("block"))
    hosts = T.checkpointed(hosts)
    edges = T.checkpointed(host_edges(pages))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    every = hosts.select("host").unionByName(edges.select(F.col("dst").alias("host"))).distinct().withColumn("seed", F.lit(1.0))
    every = T.checkpointed(every)
    x = hosts
    for name, seed, links in (("trust", "allow", edges), ("distrust", "block", back)):
        seeds = hosts.select("host", F.col(seed).alias("seed"))
        rank = T.checkpointed(_spread(links, seeds, rounds, damping))
        most = _spread(links, every, rounds, damping).withColumnRenamed("r", "most")
        x = x.join(_scaled(rank, seeds).withColumnRenamed("score", name), "host", "left").join(rank, "host", "left").join(most, "host", "left")
        own = F.when(F.col("allow") + F.col("block") > 0, 0.0).otherwise(1 - damping)
        part = F.when(F.col("r") > 0, F.col("r") / (F.col("most") - own)).otherwise(0.0)
        x = x.withColumn(f"{name}_share", part).drop("r", "most")
    return x.select("host", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("trust", "distrust", "trust_share", "distrust_share")])


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """(row, host, path, rule, trust, distrust, verdict) of each page.

    Where a rule fits, its verdict holds. Else a page is blocked when its host's share of distrust
    exceeds its share of trust by more than the threshold, and allowed otherwise. Null urls and urls without :// have an
    empty host and path and are allowed, with scores of 0; null html has no links; repeated rows are
    judged each; an empty table gives an empty result; all columns travel in `row`, or those that
    `keep` names: without the html among them no html is shuffled.

    Hosts with very many pages, of which there are few, meet their scores in pieces.
    """
    url = F.col("`url`")
    kept = pages.select(*[F.col(f"`{c}`") for c in keep]) if keep else pages
    x = pages.select(T.packed(kept), host_of(url).alias("host"), path_of(url).alias("path"))
    x = x.withColumn("m", matched(F.col("host"), F.col("path"), rules)).select("row", "host", "path", "m.rule", F.col("m.verdict").alias("ruled"))
    own = pages.select(host_of(url).alias("host"), path_of(url).alias("path"), F.col("`html`").alias("html"))
    own = own.withColumn("verdict", matched(F.col("host"), F.col("path"), rules)["verdict"])
    x = T.hub_join(x, host_trust(own), "host", T.hubs_of(x, "host", pages.count()), "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    method = F.when(F.col("distrust_share") - F.col("trust_share") > threshold, "block").otherwise("allow")
    return x.select("row", "host", "path", "rule", trust.alias("trust"), distrust.alias("distrust"), F.coalesce("ruled", method).alias("verdict"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = T.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    x = judge(pages, RULES, keep=["page_id"])
    return x.select("row.page_id", "host", "path", "rule", "verdict", "trust", "distrust")
