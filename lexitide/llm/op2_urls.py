"""URL filters: rules first, then a host's trust and distrust spread over the link graph.

A rule (host, path) fits a url whose host is the rule's or below it and whose path starts with the rule's; the
longest fitting rule decides, of two equally long the one with the longer host. Pages that no rule fits are judged by
their host. Hosts of allowed pages are trusted seeds and hosts of blocked pages distrusted ones, weighted by the
share of the host's pages. Trust is personalised PageRank along the links between hosts; distrust is the same
against the links, so a host that links to bad ones becomes bad. Both are scaled by the number of hosts, and
a host is blocked if its distrust exceeds its trust by more than THRESHOLD.

Links between two hosts are summed before anything is joined, so the graph has a row for each pair of hosts. Hosts with
more than a thousandth of the pages, under a thousand, are broadcast to their pages; the others are joined.
Rules are a parameter of a few rows and become one column expression. Ranks are written to scratch after
every round.

Null urls, and those without ://, have empty host and path and no rule; the empty host has no links, and its
pages are allowed. Repeated rows count and return each; an empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitide.llm.bounds import join_counted
from lexitide.runtime import Scratch, table

#: (verdict, rule): host up to the first /, then the path.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
ROUNDS, DAMPING, THRESHOLD = 12, 0.85, 1.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule, or null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1].index("/"))):
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        out = F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.lit(rule)).otherwise(out)
    return out


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links from pages of one host to another host, summed."""
    # cut before every <a, so that each tag is looked at once, however many never end
    tags = F.split(F.coalesce("html", F.lit("")), r"(?i)<a(?=\s)")
    target = lambda tag: F.regexp_extract(tag, r"(?i)^[^>]*?\shref\s*=\s*[\"']?((?:https?:)?//[^\"'\s>]+)", 1)
    hrefs = F.filter(F.transform(F.slice(tags, 2, F.greatest(F.size(tags), F.lit(1))), target), lambda x: x != "")
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(hrefs).alias("to"))
    links = links.select("src", host_of(F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), F.col("to"))).otherwise(F.col("to"))).alias("dst"))
    return links.where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(scratch: Scratch, links: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(host, rank): personalised PageRank along links (src, dst, n) from seeds (host, weight).

    Weights are normalised to sum 1. A host without outgoing links gives its rank back to the seeds."""
    total = seeds.agg(F.sum("weight").alias("t")).collect()[0]["t"]
    if not total:
        return seeds.select("host", F.lit(0.0).alias("rank"))
    start = seeds.where("weight > 0").select("host", (F.col("weight") / total).alias("seed"))
    degree = links.groupBy("src").agg(F.sum("n").alias("degree"))
    edges = scratch.save(links.join(degree, "src").select("src", "dst", (F.col("n") / F.col("degree")).alias("share")), "edges")
    if edges.isEmpty():
        return start.withColumnRenamed("seed", "rank")
    rank = scratch.save(start.withColumnRenamed("seed", "rank"), "rank")
    for _ in range(rounds):
        moved = rank.join(edges, rank["host"] == edges["src"]).groupBy(F.col("dst").alias("host")).agg((damping * F.sum(F.col("rank") * F.col("share"))).alias("part"))
        moved = scratch.save(moved, "moved")
        left = 1.0 - (moved.agg(F.sum("part").alias("m")).collect()[0]["m"] or 0.0)  # the sum of all ranks is 1
        back = start.select("host", (left * F.col("seed")).alias("part"))
        new = scratch.save(moved.unionByName(back).groupBy("host").agg(F.sum("part").alias("rank")), "rank")
        scratch.drop(rank, moved)
        rank = new
    return rank


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, rounds: int = ROUNDS, damping: float = DAMPING, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict and the host's trust and distrust, for every row of pages."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.lit(None).cast("string")
    for v, rule in rules:
        verdict = F.when(F.col("rule") == rule, F.lit(v)).otherwise(verdict)
    judged = scratch.save(judged.withColumn("by_rule", verdict), "judged")
    links = scratch.save(host_links(pages), "links")

    share = lambda v: F.avg(F.when(F.col("by_rule") == v, 1.0).otherwise(0.0))
    hosts = scratch.save(judged.where("host <> ''").groupBy("host").agg(share("allow").alias("allow"), share("block").alias("block"), F.count("*").alias("pages")), "hosts")
    trust = propagate(scratch, links, hosts.select("host", F.col("allow").alias("weight")), rounds, damping)
    reverse = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = propagate(scratch, reverse, hosts.select("host", F.col("block").alias("weight")), rounds, damping)
    n = hosts.count()
    scores = (
        hosts.select("host", "pages")
        .join(trust.withColumnRenamed("rank", "t"), "host", "left")
        .join(distrust.withColumnRenamed("rank", "d"), "host", "left")
        .select("host", "pages", (n * F.coalesce("t", F.lit(0.0))).alias("trust"), (n * F.coalesce("d", F.lit(0.0))).alias("distrust"))
    )
    by_host = F.when(F.col("distrust") - F.col("trust") > threshold, F.lit("block")).otherwise(F.lit("allow"))
    known = judged.withColumn("host", F.when(F.col("host") != "", F.col("host")))
    out = join_counted(known, scratch.save(scores, "scores"), "host", "pages", judged.count())
    return out.select("page_id", F.coalesce("host", F.lit("")).alias("host"), "path", "rule", F.coalesce("by_rule", by_host).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
