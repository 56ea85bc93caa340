"""URL filtering by rules and by trust and distrust propagated over the host link graph, in DataFrame functions only.

Method. Links in the pages' html give weighted edges between hosts. Trust is
personalised PageRank from the seeds that allow rules name; distrust is the
same walk on the reversed edges from the seeds that block rules name (who links
to a blocked host shares its distrust). A seed's weight is its number of pages under such
rules; what a host without edges holds returns to the seeds. A host is blocked
if its share of distrust exceeds both its share of trust and its share of the pages.
A page has its longest fitting rule's verdict, else its host's.

Skew: edges and seeds are counted before they are shuffled; each step of the walk
joins ranks to edges (a hub is split by the skew join) and adds up by host with
partial sums. The walk ends when ranks change by less than ``TOLERANCE`` in all, or by
``OF_A_PAGE`` of one page's share of all pages, if that is less: a verdict compares ranks with such shares.
Each step changes ranks by at most ``damping`` times the change before, so the number of steps has a
proven bound; a walk that goes beyond it fails.

Defined results: a null url or one without :// has empty host and path, fits no rule, and is
allowed; null html has no links; repeated rows stay; rules of equal length:
block wins, then the smaller text; no pages, no rows. Only page_id, url and html are read.
"""

from __future__ import annotations

import math
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut

#: (action, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DAMPING, TOLERANCE, OF_A_PAGE = 0.85, 1e-6, 1e-3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Hosts of absolute and protocol-relative links.
_LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): the rules (action, host, path) that fit each host or a domain above it, by a join on its suffixes."""
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    above = hosts.select("host", F.explode(F.array_distinct(suffixes)).alias("suffix"))
    named = rules.select("action", F.col("host").alias("suffix"), "path")
    return (above.join(named, "suffix").groupBy("host")
            .agg(F.collect_list(F.struct(F.length(F.concat("suffix", "path")).alias("size"), (F.col("action") == "block").alias("block"), F.concat("suffix", "path").alias("rule"), "path")).alias("rules")))


def fitting_rule(rules: Column, path: Column) -> Column:
    """The longest rule whose path starts ``path``: struct(size, block, rule, path) or null."""
    return F.array_max(F.filter(F.coalesce(rules, F.array()), lambda r: F.startswith(path, r["path"])))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts. pages: (host, html)."""
    links = (pages.where("host <> '' AND html LIKE '%//%'")
             .select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("to"))
             .select("src", F.translate("to", _UPPER, _LOWER).alias("dst")))
    return links.where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def most_steps(damping: float, tolerance: float) -> int:
    """Steps after which the change, at most 2 at first, must be below ``tolerance``."""
    return math.ceil(math.log(tolerance / 2) / math.log(damping)) + 2


def personalised_rank(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, rank): the walk that starts anew at ``seeds`` (host, weight) with chance 1 - damping; ranks add up to 1, or there are none."""
    total = seeds.agg(F.sum("weight")).first()[0]
    seeds = cut(seeds.where("weight > 0").select("host", (F.col("weight") / F.lit(total or 1)).cast("double").alias("seed")))
    out = edges.groupBy("src").agg(F.sum("n").alias("all"))
    steps = cut(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share")))
    ranks = seeds.select("host", F.col("seed").alias("rank"))
    for done in count(1):
        moved = (steps.join(ranks, steps.src == ranks.host).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share") * damping).alias("got")).withColumnRenamed("dst", "host"))
        kept = moved.agg(F.coalesce(F.sum("got"), F.lit(0.0))).first()[0]
        step = cut(ranks.join(moved, "host", "full").join(seeds, "host", "full")
                   .select("host", F.coalesce("rank", F.lit(0.0)).alias("old"), (F.coalesce("got", F.lit(0.0)) + F.coalesce("seed", F.lit(0.0)) * (1 - kept)).alias("rank")))
        change = step.agg(F.coalesce(F.sum(F.abs(F.col("rank") - F.col("old"))), F.lit(0.0))).first()[0]
        ranks = step.select("host", "rank")
        if change < tolerance:
            return ranks
        if done >= most_steps(damping, tolerance):
            raise RuntimeError(f"ranks still change by {change} after {done} steps, not by less than {tolerance}")


def judge_pages(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every row of ``pages``."""
    pages = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    counts = cut(pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages")))
    found = cut(rules_by_host(counts, rules))
    ruled = pages.select("page_id", "host", "path").join(found, "host", "left").select("page_id", "host", "path", fitting_rule(F.col("rules"), F.col("path")).alias("r"))
    seeds = cut(ruled.where("r IS NOT NULL").groupBy("host").agg(F.count_if(~F.col("r.block")).alias("allow"), F.count_if("r.block").alias("block")))
    edges = cut(host_edges(pages.select("host", "html")))
    total = counts.agg(F.coalesce(F.sum("pages"), F.lit(1))).first()[0]
    tolerance = min(TOLERANCE, OF_A_PAGE / total)
    trust = personalised_rank(seeds.select("host", F.col("allow").alias("weight")), edges, tolerance=tolerance)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = personalised_rank(seeds.select("host", F.col("block").alias("weight")), back, tolerance=tolerance)
    hosts = cut(counts.join(trust.withColumnRenamed("rank", "trust"), "host", "left").join(distrust.withColumnRenamed("rank", "distrust"), "host", "left")
                .select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"), (F.col("pages") / F.lit(total)).alias("share"))
                .withColumn("blocked", (F.col("host") != "") & (F.col("distrust") > F.col("trust")) & (F.col("distrust") > F.col("share"))))
    blocked = F.coalesce(F.col("r.block"), F.col("blocked"))
    return ruled.join(hosts, "host").select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.when(blocked, "block").otherwise("allow").alias("verdict"), "trust", "distrust")
