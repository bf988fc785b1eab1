"""URL filter with link-graph propagation, in DataFrame operations only.

A rule `host/path` fits its host and all subdomains where the url's path starts with the rule's path; the longest that fits
wins. Hosts without a fitting rule are judged by the link graph: personalised PageRank over host edges carries trust from
hosts with allowed pages to the hosts that they link to, and over the reversed edges distrust from hosts with blocked pages to
the hosts that link to them. A host's seed mass is the number of its pages that a rule allows or blocks. Steps go on until the
mass that CUT of them add is less than TOLERANCE of the seeds'.

A host is judged twice, and blocked at BLOCK or below in either. Its own share is (allowed - blocked) for each of its pages. Its
standing is (trust - distrust) / (trust + distrust), where trust counts its own seeds and what reaches it, and distrust only what reaches it over links; so it
doesn't matter into how many parts a blocked host's mass is split, nor how many pages the linking host has. host_score is the lesser of the two; a host
that no distrust reaches has just its own share. So a host of which a minority of pages is blocked by a rule isn't blocked as a
whole, unless it links to such hosts and little trust is there to outweigh them.

A null url, or one without `://`, has an empty host and path, no rule, and is allowed, as an empty host is no node. A
null html has no links. Repeated page_ids and nulls stay separate rows. Rows of an unknown host with no links score 0. An empty table
gives an empty result.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, heavy_keys, spread_join, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING, TOLERANCE, CUT, BLOCK = 0.85, 1e-4, 4, -0.75

#: (verdict, rule)
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, rule).otherwise(out)
    return out


def verdict_of(rule: Column, rules: list[tuple[str, str]]) -> Column:
    return F.when(rule.isin([r for v, r in rules if v == "block"]), "block").when(rule.isNotNull(), "allow")


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst and w, the number of pages of src that link to dst."""
    links = F.regexp_extract_all("html", F.lit(r"""(?i)href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]*)"""), F.lit(1))
    hosts = F.array_distinct(F.transform(links, lambda x: F.translate(F.regexp_extract(x, "//([^/?#]*)", 1), UPPER, LOWER)))
    out = pages.select(host_of(F.col("url")).alias("src"), F.explode(hosts).alias("dst"))
    return out.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("w"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, steps: int | None = None) -> DataFrame:
    """node, trust and distrust, from seeds (node, trust, distrust) along edges (src, dst, w), in units of the seeds' mass.

    Without steps, until they add less than TOLERANCE.
    """
    edges = cut(edges)
    both = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "w")
    both = both.unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), "w"))
    out = both.groupBy("kind", "a").agg(F.sum("w").alias("total"))
    both = cut(spread_join(both, out, ["kind", "a"], heavy_keys(both, ["kind", "a"], 2 * edges.count()), "b").select("kind", "a", "b", (F.col("w") / F.col("total")).alias("share")))
    start = cut(seeds.select("node", F.explode(F.map_from_arrays(F.array(F.lit("trust"), F.lit("distrust")), F.array(F.col("trust").cast("double"), F.col("distrust").cast("double")))).alias("kind", "mass")).where("mass > 0"))
    now = start
    if n_edges := both.count():
        heavy = heavy_keys(both, ["kind", "a"], n_edges)
        total = lambda df: df.agg(F.coalesce(F.sum("mass"), F.lit(0.0))).first()[0]
        seeded = before = total(start)
        for step in count() if steps is None else range(steps):
            along = spread_join(both, now.withColumnRenamed("node", "a"), ["kind", "a"], heavy, "b")
            moved = along.select("kind", F.col("b").alias("node"), (damping * F.col("mass") * F.col("share")).alias("mass"))
            now = start.unionByName(moved).groupBy("kind", "node").agg(F.sum("mass").alias("mass"))
            if step % CUT == CUT - 1:
                now = cut(now)
                if steps is None:
                    before, last = total(now), before
                    if before - last <= TOLERANCE * seeded:
                        break
    mass = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("mass"))), F.lit(0.0)).alias(k)
    return now.groupBy("node").agg(mass("trust"), mass("distrust"))


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str]] = RULES, block: float = BLOCK) -> DataFrame:
    """page_id, host, path, rule, verdict and host_score of every row of pages (page_id, url, html)."""
    pages = pages.select("page_id", "url", "html")
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = judged.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("said", verdict_of(F.col("rule"), rules))
    hosts = cut(judged.where("host <> ''").groupBy(F.col("host").alias("node")).agg(F.count("*").alias("pages"), F.count_if(F.col("said") == "allow").alias("trust"), F.count_if(F.col("said") == "block").alias("distrust")))
    found = propagate(hosts, host_edges(pages))
    scored = hosts.join(found.select("node", F.col("trust").alias("t"), F.col("distrust").alias("d")), "node", "left")
    own, reached = (F.col("trust") - F.col("distrust")) / F.col("pages"), F.col("d") - F.col("distrust")
    # sums of floats: what is left of a host's own seeds isn't distrust
    standing = F.when(reached > 1e-9 * (1 + F.col("distrust")), (F.col("t") - reached) / (F.col("t") + reached))
    scored = scored.select(F.col("node").alias("host"), F.round(F.least(own, standing), 9).alias("host_score"))
    # a host's pages go to several tasks where there are very many
    out = spread_join(judged.withColumn("row_of_page", F.monotonically_increasing_id()), scored, ["host"], heavy_keys(judged, ["host"], judged.count()), "row_of_page", "left")
    verdict = F.coalesce("said", F.when(F.col("host_score") <= block, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("host_score", F.lit(0.0)).alias("host_score"))


def op3_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))


QUERIES = {"op3_url_verdicts": op3_url_verdicts}
ORACLES: dict[str, str] = {}
