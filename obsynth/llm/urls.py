"""Host verdicts from rules and from trust that spreads over a host graph.

Rules decide the pages they fit.  For all other pages the host decides: personalised PageRank starts
from hosts with allowed pages and follows links (trust); it starts from hosts with blocked pages and
follows links backwards (distrust: who links to bad hosts is suspect).  A host is blocked where
distrust exceeds trust.  All of it are joins and aggregates over (host, host, weight) rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

# The rules of the numbered query: fixed values of its contract.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]

DAMPING = 0.85
ROUNDS = 20
HREF = r"""(?i)\bhref\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]*)"""
FROM_UPPER, TO_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next / ? # or the end, A-Z in lower case; empty
    without :// or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), FROM_UPPER, TO_LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? or # or the end; empty without :// or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule (the first listed on ties) and its verdict; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, said in sorted(rules, key=lambda r: len(r[0])):  # the longest ends outermost
        domain, start = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def link_edges(pages: DataFrame, host: str = "_host", html: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts, absolute or protocol-relative, counted."""
    found = F.explode(F.array_distinct(F.regexp_extract_all(F.col(html), F.lit(HREF), F.lit(1))))
    to = pages.select(F.col(host).alias("src"), found.alias("_u")).select(
        "src", host_of(F.when(F.col("_u").startswith("//"), F.concat(F.lit("http:"), "_u")).otherwise(F.col("_u"))).alias("dst")
    )
    return to.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("n"))


# Names of several labels under which anyone may register (those of one label always are); a parameter.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "co.kr", "com.br", "com.cn", "co.in", "co.za")


def domain_edges(hosts: DataFrame, host: str = "host", suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(src, dst, n): each host and its parent domains up to the registered one, step by step, both ways
    (weight 1): a site's subdomains answer for each other although their links are relative.  What lies
    above, such as a top-level domain, is no site and passes nothing on."""
    labels = F.split(host, r"\.")
    chain = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    up = (
        hosts.where(F.col(host) != "")
        .select(F.explode(F.arrays_zip(F.slice(chain, 1, F.size(chain) - 1).alias("a"), F.slice(chain, 2, F.size(chain)).alias("b"))).alias("e"))
        .where(F.col("e.b").contains(".") & ~F.col("e.b").isin(*suffixes))
        .select(F.col("e.a").alias("src"), F.col("e.b").alias("dst"))
        .distinct()
    )
    return up.union(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("n", F.lit(1.0))


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, rank): personalised PageRank along ``edges`` (src, dst, n) from ``seeds`` (host, weight).

    A round is (1 - damping) of the seeds' shares plus damping times what moves along the edges;
    mass that arrives where no edge leaves is not passed on.  No seeds, no rows.  Each round is one
    join and one aggregate with partial sums before the shuffle, so a hub host is safe; every fifth
    round is written to cut lineage.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("all"))
    step = cut_lineage(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share")))
    home = cut_lineage(seeds.groupBy("host").agg(F.sum("weight").alias("w")).select("host", (F.col("w") / seeds.agg(F.sum("weight")).scalar()).alias("home")))
    rank = home.select("host", F.col("home").alias("rank"))
    start = home.select("host", ((1 - damping) * F.col("home")).alias("rank"))
    for i in range(rounds):
        moved = rank.join(step, rank["host"] == step["src"]).select(F.col("dst").alias("host"), (damping * F.col("rank") * F.col("share")).alias("rank"))
        rank = moved.union(start).groupBy("host").agg(F.sum("rank").alias("rank"))
        if i % 5 == 4 or i == rounds - 1:
            rank = cut_lineage(rank)
    return rank


def judge_pages(pages: DataFrame, rules: list[tuple[str, str]] = RULES, damping: float = DAMPING, rounds: int = ROUNDS, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, and the host's trust and distrust.

    Seeds weigh as many pages of the host as rules allow or block.  A host is blocked if its distrust
    exceeds its trust, so hosts that neither reaches (and pages without a host) are allowed.  Null
    urls have empty host and path, null html has no links, very long html is searched whole; repeated
    rows stay; further columns do not matter, whatever their names; no rows, no rows.
    """
    url = F.col(url_col)
    p = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("_host"), path_of(url).alias("_path"), F.col(html_col).alias("html"))
    name, said = rule_of(F.col("_host"), F.col("_path"), rules)
    p = p.withColumns({"rule": name, "_said": said})
    seen = cut_lineage(
        p.groupBy(F.col("_host").alias("host")).agg(F.count_if(F.col("_said") == "allow").cast("double").alias("allowed"), F.count_if(F.col("_said") == "block").cast("double").alias("blocked"))
    )
    edges = cut_lineage(link_edges(p).union(domain_edges(seen)).groupBy("src", "dst").agg(F.sum("n").alias("n")))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    named = seen.where("host <> ''")
    trust = spread(edges, named.where("allowed > 0").select("host", F.col("allowed").alias("weight")), damping, rounds)
    distrust = spread(back, named.where("blocked > 0").select("host", F.col("blocked").alias("weight")), damping, rounds)
    hosts = reduce(
        lambda d, x: d.join(x[0].withColumnRenamed("rank", x[1]), "host", "left"), [(trust, "trust"), (distrust, "distrust")], seen.select("host")
    ).select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    hosts = cut_lineage(hosts)
    verdict = F.coalesce("_said", F.when(F.round("distrust", 12) > F.round("trust", 12), "block").otherwise("allow"))
    return p.drop("html").join(hosts, p["_host"] == hosts["host"]).select("page_id", "host", F.col("_path").alias("path"), "rule", verdict.alias("verdict"), "trust", "distrust")
